"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: A word of a text, as every word-based operator here takes it.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only where driver and executors are one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed table to a new folder within the shared one, and read from there."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing is read from any more, through Spark's own file systems."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    sc = df.sparkSession.sparkContext
    out = df.checkpoint(eager=True)
    # What the lineage held is garbage now; once the driver collects it, Spark deletes its shuffle files.
    del df
    gc.collect()
    sc._jvm.System.gc()
    return out


def cut_by(df: DataFrame, n: int, key: str) -> DataFrame:
    """``cut`` of ``df`` dealt by ``key`` to n partitions and sorted there, such that later joins on the key need no other exchange of it.

    Only a plan that adaptive execution doesn't change tells its partitioning, so that is off while this one is written.
    """
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(n, key).sortWithinPartitions(key))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of ``docs`` (null text: empty), with the columns named in ``more``; any others go."""
    return docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *more)


def partitions(df: DataFrame, at_least: int = 1) -> int:
    """Partitions for a deal by key: the session's shuffle partitions, a number that operators size to the input."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of ``column``, one row at least: a bound on scratch memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.get_total_buffer_size() <= size:
            yield batch
            continue
        lengths = [x or 0 for x in pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()]
        start = held = 0
        for i, x in enumerate(lengths):
            if i > start and held + x > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += x
        yield batch.slice(start, n - start)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def ddl(schema: pa.Schema) -> str:
    """The Spark schema string of an Arrow one."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def unit(*columns: Column | str, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from the MD5 of the columns' text."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *columns, F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
