"""Numbers of rows in an order, and what stands at given places, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``number`` from 1 on by ``order``: within ranges, and on from the counts of the ranges before."""
    parts = checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))  # ranges stay what they are
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return own.join(before, "part").withColumn("number", F.col("before") + F.col("k")).drop("part", "k", "c", "before")


#: Entries of the sketch that brackets a middle; up to so many rows a group is bracketed by its ends.
ACCURACY = 10_000


def medians(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """For each group of ``by`` (one row for all without it): median, the mean of the middle two, and upper_median, the element at place n // 2.

    Nothing is sorted as a whole. A sketch of each group brackets its middle between two values, and only rows within the
    bracket are read on, as counts of equal values, with one count of all below it: about a thousandth of a group's
    distinct values, which one window orders. Counts and sketches merge before they are dealt, so neither a group nor a
    value has to fit a task. Should a bracket miss the middle, which its sketch's error bound rules out, an error is raised.
    """
    own = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    edge = 5 / ACCURACY
    near = F.percentile_approx("_v", [0.5 - edge, 0.5 + edge], ACCURACY)
    ends = own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), near.alias("_p"))
    small = F.col("_n") <= ACCURACY
    ends = ends.select(*by, "_n", F.when(small, F.col("_a")).otherwise(F.get("_p", F.lit(0))).alias("_low"), F.when(small, F.col("_b")).otherwise(F.get("_p", F.lit(1))).alias("_high"))
    placed = (own.join(ends, list(by)) if by else own.crossJoin(F.broadcast(ends))).where(F.col("_v") <= F.col("_high"))  # without groups, one row
    counts = placed.groupBy(*by, "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_n").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    counts, n = counts.withColumn("_upto", upto), F.col("_n")

    def at(place: Column) -> Column:
        """The value at a place counted from 1."""
        return F.max(F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_c") < place), F.col("_v")))

    low, high, upper = at(F.floor((n + 1) / 2)), at(F.floor((n + 2) / 2)), at(F.floor(n / 2) + 1)
    found = counts.groupBy(*by).agg(F.max("_n").alias("_n"), low.alias("_l"), high.alias("_h"), F.when(F.max("_n") > 1, upper).otherwise(low).alias("upper_median"))
    missed = F.raise_error(F.lit("a sketch missed the middle"))
    median = F.when(F.col("_n").isNull() | F.col("_l").isNotNull() & F.col("_h").isNotNull(), (F.col("_l") + F.col("_h")) / 2).otherwise(missed.cast("double"))
    return found.select(*by, median.alias("median"), "upper_median")
