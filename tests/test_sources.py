"""Readers and writers."""

import json

from pyspark.sql import functions as F

from procstats.sources import readers, writers


def test_delimited_with_decimal_comma(spark, tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text("﻿A\tB\n1\t2,5\n3\t4,5\n\t\n")
    df = readers.read_delimited(spark, str(f))
    assert df.columns == ["A", "B"] and [tuple(r) for r in df.orderBy("A").collect()] == [(1.0, 2.5), (3.0, 4.5)]


def test_quotes_newlines_and_repeated_names(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text('name;name;note\n"a ""x""";b;"line 1\nline 2"\nc;d;e\n')
    df = readers.read_delimited(spark, str(f), multi_line=True)
    rows = df.collect()
    assert len(rows) == 2 and rows[0][0] == 'a "x"' and rows[0][2] == "line 1\nline 2"
    assert len(set(df.columns)) == 3


def test_numbers_only_have_no_header(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("1,2\n3,4\n5,6\n")
    df = readers.read_delimited(spark, str(f))
    assert df.columns == ["C1", "C2"] and df.count() == 3


def test_json_shapes(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("a.json", "b.json", "c.json"))
    a.write_text(json.dumps([{"x": 1, "y": "p"}, {"x": 2}]))
    b.write_text(json.dumps({"columns": [{"name": "x", "values": [1, 2, 3]}, {"name": "y", "values": ["p", "q", None]}]}))
    c.write_text(json.dumps({"x": [1, 2], "y": ["p", "q"]}))
    assert readers.read_json(spark, str(a)).count() == 2
    got = readers.read_json(spark, str(b), "columns")
    assert [tuple(r) for r in got.orderBy("x").select("x", "y").collect()] == [(1.0, "p"), (2.0, "q"), (3.0, None)]
    assert sorted((r["x"], r["y"]) for r in readers.read_json(spark, str(c), "arrays").collect()) == [(1, "p"), (2, "q")]


def test_records(spark):
    df = readers.from_records(spark, [{"a": 1, "b": "x"}, {"a": "2,5", "c": 3}])
    assert df.columns == ["a", "b", "c"] and sorted(r["a"] for r in df.collect()) == [1.0, 2.5]


def test_type_inference_thresholds(spark):
    rows = [("1,5" if i < 18 else "x", "2024-01-0%d" % (i % 9 + 1), "word", None) for i in range(20)]
    kinds = {r["column"]: r["type"] for r in readers.infer_types(spark.createDataFrame(rows, "n string, d string, c string, e string")).collect()}
    assert kinds == {"n": "num", "d": "date", "c": "cat", "e": "cat"}


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', None, [1, 5]), (2, "b;c", 2.5, [])], "i int, s string, x double, v array<int>")
    writers.write_csv(df.drop("v"), str(tmp_path / "csv"), ";")
    back = spark.read.csv(str(tmp_path / "csv"), sep=";", header=True, escape='"')
    assert sorted(tuple(r) for r in back.select("i", "s").collect()) == [("1", 'a "q"'), ("2", "b;c")]
    assert back.where(F.col("x").isNull()).count() == 1
    writers.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    writers.export_result(df, str(tmp_path / "out"), {"i": "id", "v": "rules"})
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["id", "rules"]
