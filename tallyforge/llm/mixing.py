"""Mixing sources to target weights by systematic sampling.

``targets`` gives every source its share of all words: weights, each target stopped at ``cap`` times the source's
own words, the excess shared again by weight among the rest until none is above its cap (a water level).
``mix`` then gives each document of a source the same expected copies (target / words of the source), prefix-sums
them over the source's documents in order of size, adds one random offset per source, and takes a document once for
every integer boundary that its stretch of the sum crosses. In order of size, the words taken differ from the target
by less than the source's longest document.

Scale: only (doc_id, source, size) moves, dealt by range over (source, size, doc_id), so a source with a third of all
rows spreads over a third of the partitions; prefix sums need one count per (partition, source), which are as many as
sources plus partitions. Nothing is collected.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a source without words has
target 0 and copies 0; repeated rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, partitions, unit

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources in order weigh these, repeating.
WEIGHTS = (1.0, 2.0, 3.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; sorts by code point, a null source last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(skey, source_size, target) from (skey, size).

    One row per source; its windows over all sources hold as many rows as there are sources, not documents.
    """
    totals = sized.groupBy("skey").agg(F.sum("size").cast("long").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights)
    totals = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    # Water level: with sources in order of cap / weight, the first k are at their caps and share the rest by weight.
    ratio = cap * F.col("source_size") / F.col("w")
    order = Window.orderBy(F.col("ratio"), F.col("skey"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.withColumn("ratio", ratio).select(
        "skey", "source_size", "w", "ratio",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    level = (F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    held = totals.withColumn("level", F.when(F.col("ratio") >= level, level))  # true first where the rest stay below their caps; beyond, the level only falls
    held = held.withColumn("level", F.max("level").over(everything))
    return held.select("skey", "source_size", F.coalesce(F.least(cap * F.col("source_size"), F.col("level") * F.col("w")), cap * F.col("source_size")).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times that the mix takes the document), and ``keep``."""
    sized = docs.select("doc_id", docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size"), *keep)
    sized = cut(sized.withColumn("skey", source_key(F.col("source"))))
    goals = cut(targets(sized, weights, cap))
    dealt = sized.repartitionByRange(partitions(docs), "skey", "size", "doc_id").withColumn("part", F.spark_partition_id())
    dealt = cut(dealt)  # the parts stay what they are, whichever executor is lost
    counts = dealt.groupBy("skey", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("skey", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(goals, "skey")
    ranked = dealt.withColumn("i", F.row_number().over(Window.partitionBy("part", "skey").orderBy("size", "doc_id")))
    rows = ranked.join(starts, ["skey", "part"])
    rank = F.col("start") + F.col("i")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole, rest = F.floor(F.col("each")), F.col("each") - F.floor(F.col("each"))
    offset = unit("skey", seed=seed)
    crossed = F.floor(F.col("u") + rest * F.col("rank")) - F.floor(F.col("u") + rest * (F.col("rank") - 1))
    copies = (whole + F.least(crossed, F.lit(1))).cast("long")
    out = rows.withColumns({"rank": rank, "each": each, "u": offset})
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *keep)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: The same water level and the same crossings in DuckDB; texts are split at the six ASCII spaces.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::DOUBLE AS w
  FROM sized GROUP BY skey),
pre AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS all_size, sum(w) OVER () AS all_w,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM totals),
lev AS (SELECT max((all_size - cap_before) / (all_w - w_before)) AS level FROM pre WHERE ratio >= (all_size - cap_before) / (all_w - w_before)),
goals AS (
  SELECT skey, source_size, coalesce(least(3.0::DOUBLE * source_size, level * w), 3.0::DOUBLE * source_size) AS target FROM pre CROSS JOIN lev),
ranked AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         CAST('0x' || substr(md5(skey || chr(31) || '0'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY sized.skey ORDER BY size, doc_id) AS r
  FROM sized JOIN goals USING (skey))
SELECT doc_id, size, source_size, target,
       CAST((floor(each) + least(floor(u + (each - floor(each)) * r) - floor(u + (each - floor(each)) * (r - 1)), 1)) * size AS BIGINT) AS taken
FROM ranked
"""
