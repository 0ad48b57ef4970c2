"""Data sets built as files arrive: each record once, however often a batch is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

IMAGE = "path string, modificationTime timestamp, length long, content binary"


def images(spark: SparkSession, root: str, pattern: str = "*.{jpg,jpeg,png,webp,bmp}", files: int = 1000) -> DataFrame:
    """A stream of path and length of image files as they are put under ``root``; contents aren't read."""
    found = spark.readStream.format("binaryFile").schema(IMAGE).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files)
    return found.load(root).select("path", "length")


def records(spark: SparkSession, root: str, files: int = 1000) -> DataFrame:
    """A stream of (line) of JSON lines files as they are put under ``root``, as the loaders take them."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(root).where(F.trim("value") != "").select(F.col("value").alias("line"))


def built(spark: SparkSession, out: str) -> DataFrame | None:
    """What is in ``out`` so far, with ``batch``; None before the first batch."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return spark.read.option("basePath", out).parquet(*[f"{out}/{n}" for n in done]) if done else None


def once(out: str, key: str = "path") -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: the rows whose key no earlier batch has, one of each (the least), to the batch's own folder.

    A batch that is tried again, after a failure at any point, has the same number and the same files, and writes its folder
    anew; so ``out`` never holds a row twice. Keys of earlier batches are joined, not collected.
    """

    def write(rows: DataFrame, batch: int) -> None:
        own = rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
        before = built(rows.sparkSession, out)
        if before is not None:
            own = own.join(before.where(F.col("batch") < batch).select(key), key, "left_anti")
        own.select(*rows.columns).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def build(rows: DataFrame, out: str, checkpoint: str, key: str = "path", sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """A query that brings ``out`` up to date with all files there are, then ends; started again with the same checkpoint, it goes on."""
    return rows.writeStream.foreachBatch(sink or once(out, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
