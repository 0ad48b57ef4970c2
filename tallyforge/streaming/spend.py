"""Ledger streams: daily totals with a watermark, and records once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def daily_totals(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Sum and count by day and category of event time ``ts``; later records than ``late`` are dropped."""
    days = records.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "category").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("count"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "category", F.round("total", 2).alias("total"), "count")


def once_each(records: DataFrame, late: str = "1 day") -> DataFrame:
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
