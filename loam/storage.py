"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder from spark.checkpoint.dir; set a temporary one only on a local master without it."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="loam-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared checkpoint folder; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers up to which the small side of a join is broadcast (some 10 MB).
BROADCAST_ROWS = 300_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df materialised, with a broadcast hint if its counted rows are few; else the join shuffles as usual."""
    held = cut(df)
    return broadcast(held) if held.count() <= most else held
