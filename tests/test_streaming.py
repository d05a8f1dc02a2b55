"""Replaying a table as a stream gives the batch points."""

import pytest
from pyspark.sql import functions as F

from procstats.streaming import monitor

SOURCE = "/root/testdata/sf0.001"


def replay(spark, df, name, tmp_path):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    events = spark.read.parquet(f"{SOURCE}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = tmp_path / "in"
    events.orderBy("ts").coalesce(1).write.parquet(str(folder))
    far = events.limit(1).withColumn("ts", F.expr("timestamp'2031-01-01'"))
    far.coalesce(1).write.mode("append").parquet(str(folder))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_xbar_stream(spark, stream, tmp_path):
    events, live = stream
    limits = monitor.freeze_limits(events, "value", ["event_id"], ["event_type"])
    points = monitor.xbar_stream(live, "value", "ts", limits, ["event_type"], "1 day", "1 minute")
    got = {(r["event_type"], r["start"]): (r["n"], round(r["value"], 6)) for r in replay(spark, points, "xbar", tmp_path).collect()}
    want = events.groupBy("event_type", F.window("ts", "1 day").start.alias("start")).agg(F.count("*").alias("n"), F.avg("value").alias("v")).collect()
    assert got == {(r["event_type"], r["start"]): (r["n"], round(r["v"], 6)) for r in want}


def test_proportion_stream(spark, stream, tmp_path):
    events, live = stream
    points = monitor.proportion_stream(live, F.col("event_type") == "error", "ts", 0.2, window="1 day", delay="1 minute")
    rows = replay(spark, points, "share", tmp_path).collect()
    assert sum(r["n"] for r in rows) == events.count() and all(0 <= r["lcl"] <= r["cl"] <= r["ucl"] <= 1 for r in rows)
