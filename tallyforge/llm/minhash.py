"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``bins`` coordinates. In round i < bins every shingle is hashed to a random bin with the value i + fraction,
in round bins + i to bin i; a bin keeps its least value, and rounds end when every bin is filled. So each coordinate is
filled whatever the set's size, and the share of equal coordinates concentrates about the Jaccard similarity. ``rows``
coordinates make a band; documents that agree on a band are candidates.

1. Documents with the same shingle set (128-bit digest of the sorted set) are one text; the smallest id stands for it.
2. Each distinct set's bands are dealt by band value. In every bucket the first member by a hash of its id is a candidate
   link of all others whose sizes allow the threshold: no more candidates than rows, never all pairs of a group.
3. Each member's candidate that most bands agree on is verified on the full sets, recomputed from the texts: exact. Of
   its others, only those are verified that still lie in different components.
4. Components by alternating large-star and small-star steps over the links, until nothing changes.
5. The rest: buckets whose members still lie in different components, as those of many copies that are unlike each other. Every
   pair across components is a candidate, once, in the least bucket it shares. Before texts are read, ``LONG`` further
   coordinates of both, one bit of each, must agree as often as those of a pair at the threshold do, less ``SLACK`` standard
   deviations; exact verification follows. Pairs that agree as often as expected go first, for their links join components
   and so leave fewer pairs for the second round, which takes all others. No pivot, cap or bound on a bucket's size decides.

A pair of similarity 0.8 misses every band with a chance of 5e-8, one of 0.9 of 1e-15; it misses the bits with one of 1e-7.
Groups of equal texts meet in map-side
combined aggregations; group and text joins are left to adaptive execution to split. Links stay distributed throughout.

Defined results: null or wordless text has the empty set, is linked with nothing and kept; repeated rows with one id
count as one document each with equal component; tables without rows give none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch_of, cut, ddl, pieces, ship, table, texts
from .shingles import mix, shingle_sets

FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string()), ("bands", pa.list_(pa.int64()))])
VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Coordinates of the long sketch, one bit each, and the standard deviations that a pair at the threshold may fall short in them.
LONG, SLACK = 2048, 5.2
BITS = pa.schema([("id", pa.int64()), ("bits", pa.list_(pa.int64()))])


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """(len(sets), bins) coordinates of nonempty sets."""
    n = len(sets)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    todo = np.arange(n)
    top = np.uint64(48)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            x = np.concatenate([sets[k] for k in todo])
            of = np.repeat(todo, [len(sets[k]) for k in todo])
            h = mix(x + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            bin_ = (h >> top).astype(np.int64) % bins if i < bins else np.full(len(x), i - bins)
            np.minimum.at(out, of * bins + bin_, (np.uint64(i) << top) | (h & np.uint64((1 << 48) - 1)))
            open_ = (out.reshape(n, bins)[todo] == np.iinfo(np.uint64).max).any(axis=1)
            todo = todo[open_]
            if not len(todo):
                break
    return out.reshape(n, bins)


def band_values(sketch: np.ndarray, rows: int) -> np.ndarray:
    n, bins = sketch.shape
    parts = sketch.reshape(n, bins // rows, rows)
    with np.errstate(over="ignore"):
        h = np.zeros(parts.shape[:2], np.uint64) + np.arange(bins // rows, dtype=np.uint64)
        for k in range(rows):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, k])
    return h.view(np.int64)


def features(docs: DataFrame, width: int, bins: int, rows: int) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [[] for _ in sets]
            if full:
                for i, b in zip(full, band_values(sketches([sets[i] for i in full], bins), rows), strict=True):
                    bands[i] = b
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
            yield batch_of(FEATURES, doc_id=batch.column(0).to_pylist(), n_shingles=[len(s) for s in sets], digest=digests, bands=bands)

    return texts(docs).mapInArrow(run, ddl(FEATURES))


def long_bits(docs: DataFrame, width: int) -> DataFrame:
    """id and LONG bits of each text's sketch in 64-bit words; for texts that have a shingle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                bits = (sketches([sets[i] for i in full], LONG) & np.uint64(1)).astype(np.uint8)
                yield batch_of(BITS, id=part.column(0).take(pa.array(full)), bits=list(np.packbits(bits, axis=1).view(np.int64)))

    return texts(docs).mapInArrow(run, ddl(BITS))


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have 100 * common >= percent * union; ids in ``docs`` are distinct."""
    ship(docs.sparkSession)
    whole = texts(docs)
    left = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(whole.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in pieces(batches, "text_a"):
            for part in pieces(iter([batch]), "text_b"):
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                if len(kept) > 256:
                    kept.clear()
                for ids, column in ((a, part.column(2)), (b, part.column(3))):
                    new = {x: i for i, x in enumerate(ids) if x not in kept}
                    kept.update(zip(new, shingle_sets([column[i].as_py() for i in new.values()], width), strict=True))
                ok = []
                for x, y in zip(a, b, strict=True):
                    s, t = kept[x], kept[y]
                    if len(s) > len(t):
                        s, t = t, s
                    common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(t) else 0
                    ok.append(100 * common >= percent * (len(s) + len(t) - common) and common > 0)
                yield batch_of(VERIFIED, a=[x for x, k in zip(a, ok, strict=True) if k], b=[x for x, k in zip(b, ok, strict=True) if k])

    return both.mapInArrow(run, ddl(VERIFIED))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links of ``edges`` (a, b) reach, for every node in them.

    Alternating large-star and small-star steps; an edge of a star carries its centre, so no node's neighbours are gathered in one row.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    before = None
    while True:
        # large star: every neighbour above x goes to the least of x and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: x and its lower neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _stars(buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b, x, m): in each bucket (h, id, n), its first member by a hash of the id with every other x whose size allows the threshold; m buckets agree."""
    pivot = buckets.groupBy("h").agg(F.min(F.struct(F.xxhash64("id").alias("o"), F.col("id").alias("p"), F.col("n").alias("pn"))).alias("s"))
    pivot = pivot.select("h", "s.p", "s.pn")
    fits = (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")) & (F.col("id") != F.col("p"))
    found = buckets.join(pivot, "h").where(fits)
    return found.groupBy(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"), F.col("id").alias("x")).agg(F.count(F.lit(1)).alias("m"))


def _labelled(rows: DataFrame, comps: DataFrame, column: str, to: str) -> DataFrame:
    """``rows`` with the component of ``column`` as ``to``; a node without links is its own."""
    named = comps.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return rows.join(named, column, "left").withColumn(to, F.coalesce("_c", column)).drop("_c")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The (a, b) that lie in different components."""
    return _labelled(_labelled(pairs.select("a", "b"), comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b").distinct()


def _open(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """The buckets (h, id, n) whose members lie in different components, with each member's component c and its bucket's largest one, main."""
    placed = _labelled(buckets.select("h", "id", "n"), comps, "id", "c")
    held = placed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"))
    main = held.groupBy("h").agg(F.count(F.lit(1)).alias("cs"), F.max(F.struct("k", "c")).alias("s")).where("cs > 1").select("h", F.col("s.c").alias("main"))
    return cut(placed.join(main, "h"))


def _across(open_: DataFrame, known: DataFrame, percent: int, slack: float) -> DataFrame:
    """The (a, b) of members of a bucket in different components that may be alike, each once.

    ``known`` has id, bands and the long sketch. One side is the members outside their bucket's largest component.
    """
    full = open_.join(known, "id")
    x = full.where("c <> main").select("h", *[F.col(k).alias(f"{k}_x") for k in ("id", "n", "c", "bands", "bits")])
    differ = F.aggregate(F.zip_with("bits", "bits_x", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    chance = (1 + percent / 100) / 2  # that a bit agrees, at the threshold
    least = LONG * chance - slack * (LONG * chance * (1 - chance)) ** 0.5
    once = (F.col("c") == F.col("main")) | (F.col("id") < F.col("id_x"))
    fits = (F.col("c") != F.col("c_x")) & once & (100 * F.least("n", "n_x") >= percent * F.greatest("n", "n_x")) & (differ <= LONG - int(least))
    first = F.array_min(F.array_intersect("bands", "bands_x")) == F.col("h")
    return full.join(x, "h").where(fits & first).select(F.least("id", "id_x").alias("a"), F.greatest("id", "id_x").alias("b"))


def link(docs: DataFrame, width: int = 5, percent: int = 80, bins: int = 128, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """(membership, links): doc_id, n_shingles, component_id, kept per row of ``docs``; verified links (a, b) between distinct texts."""
    feats = cut(features(docs, width, bins, rows))
    sets = cut(feats.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")))
    reps = sets.select("id", "n").join(feats.select(F.col("doc_id").alias("id"), "bands").where(F.size("bands") > 0).dropDuplicates(["id"]), "id")
    rows_ = reps.select("id", "n", F.explode("bands").alias("h"))
    shared = rows_.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = cut(rows_.join(shared, "h").select("h", "id", "n"))
    pairs = cut(_stars(buckets, percent))
    one_text = docs.select("doc_id", "text").join(sets.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    # Each member's likeliest link first; then those of its other links that still join two components.
    likeliest = pairs.groupBy("x").agg(F.max(F.struct("m", "a", "b")).alias("s")).select("s.a", "s.b").distinct()
    links = cut(verify(likeliest, one_text, width, percent))
    comps = components(links)
    left = cut(_apart(pairs, comps).join(likeliest, ["a", "b"], "left_anti"))
    links = links.unionByName(cut(verify(left, one_text, width, percent)))
    comps = components(links)
    # What the stars left apart: every pair across components that may be alike, the likeliest first.
    rest = _open(buckets, comps)
    if not rest.isEmpty():
        live = rest.select("id").distinct()
        bits = long_bits(one_text.join(live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), width)
        known = cut(reps.select("id", "bands").join(bits, "id"))
        tried = pairs.select("a", "b").distinct()
        for slack in (0.0, SLACK):
            more = cut(_across(rest, known, percent, slack).join(tried, ["a", "b"], "left_anti"))
            found = cut(verify(more, one_text, width, percent))
            if slack == SLACK or found.isEmpty():
                links = links.unionByName(found)
                continue
            links, tried = links.unionByName(found), tried.unionByName(more)
            rest = _open(rest.select("h", "id", "n"), components(links))
        comps = components(links)
    to = sets.select("digest", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("c"))
    many = sets.select("digest", "copies").join(to, "digest").join(sets.select("digest", "id"), "digest").where("copies > 1 or c <> id").select("digest", "c")
    out = feats.select("doc_id", "n_shingles", "digest").join(many, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), links


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that another of their group stands for: the row of the smallest id stays, one row if rows repeat it."""
    gone = link(docs, width, percent)[0].where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if repeated.isEmpty():
        return left
    named = left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(left.where(F.col("doc_id").isNull()))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), width=4)[0]
