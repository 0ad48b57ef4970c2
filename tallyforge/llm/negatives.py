"""Hard negatives by a full sort of each anchor's scores.

``quantised`` numbers the rows that take part and turns components into integers; it is written once. Rows are dealt by
hash to blocks of about ``BLOCK``, anchors to groups of about ``GROUP``, and each pair of a block and a group is one task:
a row moves once per group and an anchor once per block, so neither side is broadcast or collected, and a label or a vector
that a third of all rows share spreads over all blocks.

Two passes of the same deal, both with integer inner products:

* ``nearest``: a block's first k rows of an anchor's own label, then the first k of those of all blocks: its positives;
* ``between``: per anchor the block's scores are lexsorted by score and id, each positive's upper limit is found in them by
  binary search, and the first k entries of other labels are read from there down to the lower limit; then the first k of
  those of all blocks.

What a block keeps is k an anchor (and positive), which is enough for the first k of all, so nothing is lost.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; vectors of unequal
length are compared over the shorter's; an integer component stops at the ends of a long, and a score at 2**56 either way;
rows that repeat an id (or all of a row) each count, and one is a positive of the other if their labels agree; a null id
comes after all others and is no anchor; an anchor without another row of its label has no result; an empty table gives no
row; other columns go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import batch_of, cut, ddl, partitions, ship, table

#: Rows of a block and anchors of a group, on average.
BLOCK, GROUP = 1 << 16, 1 << 10
#: Scores of so many pairs are in memory at once.
AT_ONCE = 1 << 20
#: Scores stop here, so that a hundred times one is still a long.
MOST = 1 << 56
#: Stands for a null id in workers.
LAST = (1 << 63) - 1
NEAREST = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
BETWEEN = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def quantised(rows: DataFrame, vec_id: str, label: str | Column, vector: str, scale: float) -> DataFrame:
    """(row, id, label, vector) of the rows that take part: a number of its own, and components as floor(scale * x)."""
    label = F.col(label) if isinstance(label, str) else label
    own = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    own = own.where(F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    return own.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vector"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The lists as rows, short ones filled up with zeros."""
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    wide = int(lengths.max(initial=0))
    if (lengths == wide).all():
        return flat.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = flat
    return out


def largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: as floats where no sum can reach 2**53, else as Python's integers."""
    wide = min(anchors.shape[1], rows.shape[1])
    a, r = anchors[:, :wide], rows[:, :wide]
    if wide * largest(a) * largest(r) < 1 << 53:
        return (a.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ r.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def first_of_own(s: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of ``own``, by descending score and ascending id."""
    at = np.flatnonzero(own)
    return at[np.lexsort((ids[at], -s[at]))[:k]]


def first_between(order: np.ndarray, s: np.ndarray, other: np.ndarray, positive: int, lower: int, upper: int, k: int) -> np.ndarray:
    """Places of the first k entries of another label with lower * positive <= 100 * score <= upper * positive.

    ``order`` sorts by descending score; ``s`` are the scores negated in that order; ``other`` are places within it.
    """
    start = np.searchsorted(s, -(upper * positive // 100), "left")
    end = np.searchsorted(s, lower * positive // -100, "right")
    lo, hi = np.searchsorted(other, (start, end))
    return order[other[lo : min(lo + k, hi)]]


def blocks(anchors: DataFrame, rows: DataFrame, n_groups: int, n_blocks: int, schema: pa.Schema, pick: Callable) -> DataFrame:
    """``pick(anchor, scores, rows)`` for each anchor and block, one task for each pair of a group and a block."""
    ship(rows.sparkSession)
    names = ["id", "label", "vector", "row", *(["wanted"] if "wanted" in anchors.columns else [])]
    more = [] if "wanted" in anchors.columns else [F.lit(None).cast("array<struct<place:long,id:long,score:long>>").alias("wanted")]
    group, block = (F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(n)).cast("int") for salt, n in ((1, n_groups), (2, n_blocks)))
    each = lambda n, pair: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pair)).alias("pair")
    left = anchors.select(*names, *more, F.lit(0).alias("side"), each(n_blocks, lambda k: group * n_blocks + k))
    none = F.lit(None).cast("array<struct<place:long,id:long,score:long>>").alias("wanted")
    right = rows.select("id", "label", "vector", "row", none, F.lit(1).alias("side"), each(n_groups, lambda k: k * n_blocks + block))
    dealt = left.unionByName(right).repartitionById(n_groups * n_blocks, F.col("pair")).sortWithinPartitions("side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        both = pa.Table.from_batches(held).combine_chunks()
        side = both["side"].to_numpy()
        n = int(np.searchsorted(side, 1))
        if n in (0, len(side)):
            return
        column = lambda name: both[name].combine_chunks()
        ids, labels, numbers = (column(c).fill_null(LAST).to_numpy(zero_copy_only=False) for c in ("id", "label", "row"))
        vectors = [matrix(column("vector").slice(*span)) for span in ((0, n), (n, len(side) - n))]
        wanted = column("wanted").slice(0, n).to_pylist()
        step, out = max(1, AT_ONCE // (len(side) - n)), {f.name: [] for f in schema}
        for at in range(0, n, step):
            for i, s in enumerate(scores(vectors[0][at : at + step], vectors[1]), at):
                pick(out, (numbers[i], ids[i], labels[i], wanted[i]), s, (numbers[n:], ids[n:], labels[n:]))
            yield batch_of(schema, **{c: np.concatenate(x) if x else [] for c, x in out.items()})
            out = {f.name: [] for f in schema}

    return dealt.mapInArrow(run, ddl(schema))


def add(out: dict[str, list], n: int, **columns) -> None:
    for name, x in columns.items():
        out[name].append(np.broadcast_to(np.asarray(x, np.int64), (n,)))


def first_rows(found: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
    scale: float = 256.0, positives: int = 5, negatives: int = 10, lower: int = 30, upper: int = 90, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is over ``id``, the limits are percents."""
    taking = cut(quantised(rows, vec_id, label, vector, scale))
    anchors = taking.where(is_anchor)
    n_rows, n_anchors = taking.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    n_blocks, n_groups = max(partitions(rows), ceil(n_rows / block)), max(1, ceil(n_anchors / group))

    def own(out, anchor, s, of):
        (number, _, kind, _), (numbers, ids, labels) = anchor, of
        at = first_of_own(s, ids, (labels == kind) & (numbers != number), positives)
        add(out, len(at), anchor=number, row=numbers[at], id=ids[at], score=s[at])

    def other(out, anchor, s, of):
        (number, anchor_id, kind, wanted), (numbers, ids, labels) = anchor, of
        order = np.lexsort((ids, -s))
        falling, others = -s[order], np.flatnonzero(labels[order] != kind)
        for w in wanted:
            at = first_between(order, falling, others, w["score"], lower, upper, negatives)
            add(out, len(at), anchor=number, anchor_id=anchor_id, place=w["place"], positive_id=w["id"], positive_score=w["score"], row=numbers[at], id=ids[at], score=s[at])

    nearest = first_rows(blocks(anchors, taking, n_groups, n_blocks, NEAREST, own), ["anchor"], positives, "place")
    wanted = nearest.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "id", "score")).alias("wanted"))
    between = blocks(anchors.join(wanted, "row"), taking, n_groups, n_blocks, BETWEEN, other)
    named = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return first_rows(between, ["anchor", "place"], negatives, "rank").select(
        "anchor_id", named("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Labels change where the id is divisible by 7; anchors are the ids divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


#: All anchors against all rows, as the contract states it; sums of whole numbers are exact as doubles here.
ORACLE = """
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS own, r.vec_id, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM taking a JOIN taking r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
