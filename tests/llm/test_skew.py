"""Joins of op2 on keys that one value fills: no task takes all of its rows."""

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import suffixes

SKEW = {
    "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}
N, HOT = 40_000, 16_000


@pytest.fixture
def skewed(spark):
    was = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    """The plan that adaptive execution came to."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_of_segments_is_dealt_to_several_tasks(skewed):
    rows = skewed.range(0, N, 1, 16)
    distinct = rows.select(F.when(F.col("id") < HOT, 0).otherwise(F.col("id") % 1000 + 1).cast("long").alias("key"), F.hash("id").cast("long").alias("s0"), F.col("id").alias("s1"), (F.col("id") % 3 + 1).alias("times"), F.col("id").alias("uid"), F.col("id").alias("ac"))
    distinct = suffixes.cut(distinct.repartition(16))
    found = suffixes._lists(suffixes.open_segments(distinct), "key", "ac", "m")
    assert found.agg(F.count(F.lit(1)), F.max(F.col("m")[0]), F.count(F.when(F.col("m")[0] == HOT, 1))).first() == (N, HOT, HOT)
    assert "skew=true" in executed(found)


def test_a_hot_passage_is_dealt_to_several_tasks(skewed, monkeypatch):
    rows = skewed.range(0, N, 1, 16).select(F.col("id").alias("uid"), F.array(F.when(F.col("id") < HOT, F.lit("hot")).otherwise(F.concat(F.lit("p"), (F.col("id") % 5000).cast("string"))).cast("binary")).alias("passages"))
    rows = suffixes.cut(rows.repartition(16))
    found = suffixes.shared_passages(rows)
    assert found.agg(F.count(F.lit(1)), F.min("n_passages"), F.max("n_passages")).first() == (N, 1, 1)
    assert "skew=true" in executed(found)
