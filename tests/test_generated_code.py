"""Generated methods of over 8000 bytes are not compiled, which makes a pass over a large table some ten times slower."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from procstats.operators import describe, experiments
from procstats.plans import gram


@pytest.fixture
def largest_method(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def size(df):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain(mode="codegen")
        return max(int(x) for x in re.findall(r"maxMethodCodeSize:\s*(\d+)", text.getvalue()))

    yield size
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_shape_is_compiled(spark, largest_method):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.5), ("a", 7.0), ("b", 1.0), ("b", None), ("b", float("nan")), (None, 3.0)]
    out = describe.shape(spark.createDataFrame(rows, "g string, x double").where(F.col("x").isNull() | (F.col("x") < 1e9)), "x", ["g"])
    assert largest_method(out) < 8000
    got = {r["g"]: (r["skew"], r["kurt"]) for r in out.collect()}
    assert got["a"] == pytest.approx((1.666658, 3.047694), abs=1e-5) and got["b"] == got[None] == (None, None)


def test_shares_are_compiled(spark, largest_method):
    rows = [(float(i), 2.0, float(i % 3), 1.0 * i) for i in range(1, 7)] + [(0.0, 0.0, 0.0, 1.0), (1.0, None, 1.0, 1.0), (1.0, float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    df = df.select("a", *[(F.col(c) * 10).alias(c) for c in ("b", "c")], "y").where("y > 0")
    shares = experiments._shares(df, ["a", "b", "c"])
    assert shares.columns == ["a", "b", "c", "y"]
    dm = gram.design(shares, ["a", "b", "c", "a*b", "a*c", "b*c"], intercept=False)
    out = gram.design_rows(shares, dm, "y")
    assert largest_method(out) < 8000
    got = sorted((r["_x0"], r["_x1"], r["_x2"], r["_x3"]) for r in out.collect())
    want = []
    for a, b, c in [(float(i), 20.0, 10.0 * (i % 3)) for i in range(1, 7)]:
        want.append((a / (a + b + c), b / (a + b + c), c / (a + b + c), a * b / (a + b + c) ** 2))
    assert got[0] == (0.0, 0.0, 0.0, 0.0) and len(got) == 7
    assert all(g == pytest.approx(w) for g, w in zip(got[1:], sorted(want)))
