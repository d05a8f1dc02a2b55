from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    """Small blocks, so that every ordered operator crosses block borders."""
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
         .config("spark.procstats.blockRows", "32")
         # keep several ranges even for tiny tables
         .config("spark.sql.adaptive.coalescePartitions.enabled", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def values(spark):
    """Build a one-column table with a row id."""
    def make(xs, name="x"):
        return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], f"id long, {name} double")
    return make


@pytest.fixture(scope="session")
def groups(spark):
    """Build (id, g, x) from a dict of lists."""
    def make(data):
        rows = [(g, float(x)) for g, xs in data.items() for x in xs]
        return spark.createDataFrame([(i, str(g), x) for i, (g, x) in enumerate(rows)], "id long, g string, x double")
    return make
