"""Sessions and checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "tallyforge", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings as named, or as the cluster has them."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only where driver and executors are one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that isn't there yet, within the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the session's cores, for rows that cost far more than their bytes: a file of one row group would be one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as ``name``, computed once a row: a filter on a plain alias moves below it and computes it again for each time it is named there."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
