"""Groups far apart, subgroups of any size, whole columns, executors without the package."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

from procstats.functions import constants
from procstats.operators import control, fitting, multivariate, regression
from procstats.sources import readers


def test_groups_far_apart_keep_their_slopes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(5):
        t = 1.5e9 + g * 3.15e7 + rng.uniform(0, 10, 300)
        rows += [(g, float(x), float(3 * x + e)) for x, e in zip(t, rng.normal(0, 1e-3, 300))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    c = regression.linear_model(df, "y", ["x"], by=["g"]).coefficients().where("term = 'x'").collect()
    assert len(c) == 5 and all(abs(r["coef"] - 3) < 1e-2 for r in c)


def test_distances_of_groups_far_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(k, k % 2, *map(float, 1e9 * (k % 2) + rng.normal(0, 1, 2))) for k in range(800)]
    d = multivariate.mahalanobis(spark.createDataFrame(rows, "k int, g int, a double, b double"), ["a", "b"], key=["k"], by=["g"])
    means = [r[0] for r in d.groupBy("g").avg("d2").select("avg(d2)").collect()]
    assert means == pytest.approx([2, 2], abs=0.05)


def test_constants_beyond_the_table(spark):
    assert constants.d3(100) == pytest.approx(0.605, abs=2e-3)
    assert all(constants._d3(n) == pytest.approx(v, abs=1.1e-4) for n, v in constants.D3_TABLE.items())
    df = spark.createDataFrame([(n, 10.0) for n in (5, 100, 430)], "n int, range double")
    got = {r["n"]: r["d"] for r in df.select("n", constants.by_size(constants.d2, df["n"]).alias("d")).collect()}
    assert got == pytest.approx({n: constants.d2(n) for n in (5, 100, 430)})
    one = control.sigma_within(df.where("n = 430")).first()["sigma"]
    assert one == pytest.approx(10 / constants.d2(430))


def test_a_column_that_turns_into_text_late_keeps_its_values(spark):
    df = spark.createDataFrame([(i, str(i) if i < 900 else f"x{i}") for i in range(1000)], "i int, v string").select("v").coalesce(1)
    out = readers.apply_types(df, readers.infer_types(df))
    assert out.columns == ["v", "v_text"] and out.where("v_text IS NOT NULL").count() == 1000
    half = df.where("v LIKE 'x%'").unionByName(df.limit(300))
    assert readers.infer_types(half).first()["type"] == "cat"


def test_shapiro_uses_all_values(spark):
    rng = np.random.default_rng(3)
    r = fitting.shapiro_wilk(spark.createDataFrame([(float(x),) for x in rng.normal(size=6000)], "x double"), "x").first()
    assert r["n"] == 6000 and r["w"] > 0.99 and r["p_value"] is None


def test_spearman_joins_ranks_to_rows_as_they_are(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = pd.DataFrame({"a": rng.integers(0, 5, 300) * 1.0, "b": rng.normal(size=300), "c": rng.integers(-3, 40, 300) * 0.5})
    x.loc[x["a"] == 0, "a"] = rng.choice([0.0, -0.0], int((x["a"] == 0).sum()))
    joined, sizes = multivariate.attach, []

    def counted(big, *args, **kwargs):
        sizes.append(big.count())
        return joined(big, *args, **kwargs)

    monkeypatch.setattr(multivariate, "attach", counted)
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in multivariate.correlation_matrix(spark.createDataFrame(x), ["a", "b", "c"], "spearman").collect()}
    assert sizes == [300, 300, 300]
    want = x.rank().corr()
    for (a, b), (n, r) in got.items():
        assert n == 300 and r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert len(got) == 3


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in {names!r}:
    e.queries()[name](spark, {folder!r}).collect()
print("fine")
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    names = ["vif", "stepwise", "best_subsets", "absorbed_anova", "box_cox_lambda", "bootstrap_interval", "pca", "mahalanobis", "hotelling_t2_individuals", "hotelling_t2_subgroups", "discriminant"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, names=names, folder="/root/testdata/sf0.001")], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=400)
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]
