"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROWS = "procstats.broadcastRows"
BLOCK_ROWS = "procstats.blockRows"
SKETCH_FROM = "procstats.sketchFrom"


def setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get("spark." + key, str(default)))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="procstats-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def persist(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
