"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another.

*Anchors.* A position is an anchor if the hash of its K bytes is the least of some W neighbours'. Wherever a string recurs, its
anchors that lie far enough inside (so that all their neighbours do) recur with it. So an anchor that the whole corpus
holds once rules out every window that has it inside; what remains are candidate windows.
*Segments.* Candidate windows of one document with the same first inner anchor form a segment, a text of at most length + W
bytes. Its key is made of its first two inner anchors; equal windows have equal keys. Segments found twice or more are
repeated as they stand. Those found once may share some windows with others of their key.
*Transforms.* These and one of each other segment of their keys are dealt by key. A worker takes keys together into shards of
bounded size, leaves out windows with a symbol that the shards hold once (they can't recur), sorts each shard's suffixes over an alphabet of ``SYMBOL``-byte blocks (each segment gives one string for
each residue of the position), and forms the shard's transform. Shards are merged by iterative interleave refinement: from the
interleave that is right for h symbols, a stable distribution of the merged transform's symbols gives that for
h + 1, without comparing suffixes again. Block bounds that appear in round h + 1 have a common prefix of h symbols; blocks
of two or more suffixes after length / SYMBOL rounds are the repeated intervals.
*Hot keys.* A key with over ``MOST`` distinct segments (a passage within thousands of contexts) would land in one task. Its windows
are counted singly by a 128-bit hash instead, with map-side combining. That is exact too, and never gathers a group.

Only what occurs once travels back to the documents, so no hot value is joined. Texts are dealt once, compressed, by row, and
kept in the shared folder under that partitioning. Rows are numbered, so none can be taken for another. Hashes are 64 bits
for anchors (where a collision only costs a candidate) and 128 for segments and windows.

Beside the bytes, ``n_passages`` counts a document's paragraphs (lines) of over ``WORDS`` words that another document holds
too, which may be shorter than ``length``; they stay in the text. Each row's paragraphs are hashed as it is packed (128
bits); of a hash only the least and the greatest row meet, and what is shared joins back row by row.

Defined results: null text is empty; texts below ``length`` bytes stay whole; rows that repeat id and text are
copies of each other; an empty table gives none; other columns go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch_of, cut, cut_by, ddl, partitions, pieces, ship, table, texts
from .shingles import _inverse_powers, mix

LENGTH, K, W = 400, 28, 92
#: Words that a paragraph must have more than to count as a passage.
WORDS = 50
SYMBOL = 100
#: Distinct segments of a key up to which it is left to the merged transforms, and bytes of text that are merged together:
#: so few that ranks have 16 bits, which sort by radix.
MOST, SHARD = 100, 60_000
#: Bytes of texts that are hashed together, few enough for a core's cache.
LOT = 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))
_WORDS = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)


class Hashes:
    """Hashes of all substrings of a text, by prefix sums of two polynomials."""

    def __init__(self, data: np.ndarray):
        up, self.down = _inverse_powers(len(data) + 1)
        x = data.astype(np.uint64) + np.uint64(1)
        self.data = data
        self.one = np.concatenate([[np.uint64(0)], np.cumsum(x * up[: len(x)], dtype=np.uint64)])
        self.up, self.two = up, None

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.one[at + size] - self.one[at]) * self.down[at] + np.asarray(size).astype(np.uint64))

    def each(self, size: int) -> np.ndarray:
        """``of`` for every position that has ``size`` bytes."""
        n = len(self.data) - size + 1
        return mix((self.one[size:] - self.one[:n]) * self.down[:n] + np.uint64(size))

    def other(self, at: np.ndarray, size) -> np.ndarray:
        """An independent hash: of a random word for each byte."""
        if self.two is None:
            self.two = np.concatenate([[np.uint64(0)], np.cumsum(_WORDS[self.data] * self.up[: len(self.data)], dtype=np.uint64)])
        return mix((self.two[at + size] - self.two[at]) * self.down[at] + _A)


def _sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every w neighbours: len(x) - w + 1 values, from those over 1, 2, 4... neighbours."""
    k = 1
    while 2 * k <= w:
        x, k = op(x[: len(x) - k], x[k:]), 2 * k
    return op(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def anchors(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some w neighbours by its upper half, equals included."""
    h = (h >> np.uint64(32)).astype(np.uint32)
    padded = np.zeros(len(h) + w - 1, np.uint32)
    padded[w - 1 : len(h)] = _sliding(h, w, np.minimum)
    return np.flatnonzero(_sliding(padded, w, np.maximum) == h)


def candidates(size: int, once: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Runs [a, b) of the window starts of a text of ``size`` bytes that remain, given positions of its anchors that occur once."""
    n = size - length + 1
    once = np.sort(once)
    a = np.concatenate([[0], np.clip(once - (W - 1) + 1, 0, n)])
    b = np.concatenate([np.clip(once - (length - K - W + 1), 0, n), [n]])
    return a[a < b], b[a < b]


class Texts:
    """Texts of at least ``length`` bytes, one after another, with their anchors.

    Neighbours beyond a text's bounds may make or hide anchors near them, but none that a window has inside.
    """

    def __init__(self, raws: list[bytes], length: int = LENGTH):
        self.length = length
        self.ends = np.cumsum([len(x) for x in raws])
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.hashes = Hashes(np.frombuffer(b"".join(raws), np.uint8))
        h = self.hashes.each(K)
        self.at = anchors(h, W)
        self.h = h[self.at]

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, hash) of the anchors that lie within one text."""
        of = np.searchsorted(self.starts, self.at, "right") - 1
        whole = self.at + K <= self.ends[of]
        return of[whole], (self.at - self.starts[of])[whole], self.h[whole]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first start, starts, key, hash, hash) of the segments; all windows of the texts are candidates."""
        new = self.at - W + 2  # the first start that has an anchor no longer inside
        of = np.searchsorted(self.starts, new, "right") - 1
        new = new[(of >= 0) & (new > self.starts[of]) & (new <= self.ends[of] - self.length)]
        a = np.sort(np.concatenate([self.starts, new]))
        of = np.searchsorted(self.starts, a, "right") - 1
        count = np.minimum(np.append(a[1:], self.ends[-1]), self.ends[of] - self.length + 1) - a
        k = np.searchsorted(self.at, a + W - 1)
        p, q = self.at[k], self.at[k + 1]
        key = mix(mix(self.h[k] * _A + self.h[k + 1]) + (q - p).astype(np.uint64))
        size = count - 1 + self.length
        where = (p - a).astype(np.uint64)
        return of, a - self.starts[of], count, key, mix(self.hashes.of(a, size) + where), mix(self.hashes.other(a, size) + where * _B)


def lots(rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """Rows put together until they hold ``LOT`` bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= LOT:
            yield held
            held, n = [], 0
    if held:
        yield held


def _width(n: int) -> type:
    """The narrowest unsigned type for numbers below n."""
    return np.uint16 if n <= 1 << 16 else np.uint32 if n <= 1 << 32 else np.uint64


class Transform:
    """A transform of a collection of strings of symbols: suffix order, preceding symbols (0: none), strings."""

    def __init__(self, order: np.ndarray, before: np.ndarray, strings: int):
        self.order, self.before, self.strings = order, before, strings

    @classmethod
    def of(cls, symbols: np.ndarray, ends: np.ndarray) -> Transform:
        """From strings one after another, each ended by a 0 at ``ends``; other symbols are positive.

        Ends rank below all symbols, by string; ranks of 1, 2, 4... symbols are doubled until all differ.
        """
        n, s = len(symbols), len(ends)
        small = _width(n + s + 1)
        rank = symbols + s
        rank[ends] = np.arange(s)
        order = np.argsort(rank.astype(_width(int(rank.max()) + 1)), kind="stable")
        new = np.concatenate([[False], np.diff(rank[order]) != 0])
        h = 1
        while True:
            rank = np.empty(n, small)
            rank[order] = np.cumsum(new)
            if int(rank[order[-1]]) == n - 1 or h > n:
                break
            after = np.zeros(n, small)
            after[: n - h] = rank[h:] + small(1)
            order = np.lexsort((after, rank))
            new = np.concatenate([[False], (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)])
            h *= 2
        before = np.where(order > 0, symbols[order - 1], 0)
        return cls(order, before, len(ends))


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The transform of both collections (b's positions after a's) and each suffix's common prefix with the one before, up to ``depth`` symbols."""
    n1, n2, s = len(a.order), len(b.order), a.strings + b.strings
    n = n1 + n2
    source = np.concatenate([np.zeros(n1, np.int8), np.ones(n2, np.int8)])
    block = np.zeros(n, np.int64)
    common = np.full(n, depth, np.int64)
    found = np.zeros(n, bool)
    found[0] = True
    common[0] = 0
    ends = np.concatenate([np.zeros(a.strings, np.int8), np.ones(b.strings, np.int8)])
    small = _width(int(max(a.before.max(initial=0), b.before.max(initial=0))) + 1)
    for h in range(depth):
        symbol = np.empty(n, small)
        symbol[source == 0], symbol[source == 1] = a.before, b.before
        order = np.argsort(symbol, kind="stable")[s:]  # those with a symbol before them; the rest begin strings
        source = np.concatenate([ends, source[order]])
        c, was = symbol[order], block[order]
        bound = np.concatenate([np.ones(s + 1, bool)[: min(s + 1, n)], (np.diff(c) != 0) | (np.diff(was) != 0)])[:n]
        common[bound & ~found] = h
        found |= bound
        block = np.cumsum(bound)
    order = np.empty(n, np.int64)
    order[source == 0], order[source == 1] = a.order, b.order + n1
    before = np.empty(n, a.before.dtype)
    before[source == 0], before[source == 1] = a.before, b.before
    return Transform(order, before, s), common


def recurring(data: np.ndarray, hashes: Hashes, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of symbols in windows of ``depth`` symbols none of which is seen to occur once; texts of ``sizes`` lie one after another in ``data``.

    Symbols are counted in buckets, so one that recurs is never left out; a window that recurs consists of such. The second
    round counts only what the first left.
    """
    n = len(data) - SYMBOL + 1
    bits = max(16, len(data).bit_length() + 2)
    bucket = (((hashes.one[SYMBOL:] - hashes.one[:n]) * hashes.down[:n] * _A) >> np.uint64(64 - bits)).astype(np.int64)
    room = np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n)
    held = room >= SYMBOL
    for _ in range(2):
        held &= (np.bincount(bucket[held], minlength=1 << bits) > 1)[bucket]
        m = n - (depth - 1) * SYMBOL
        window = room[:m] >= depth * SYMBOL
        for k in range(depth):
            window &= held[k * SYMBOL : k * SYMBOL + m]
        held = np.zeros(n, bool)
        for k in range(depth):
            held[k * SYMBOL : k * SYMBOL + m] |= window
    return np.flatnonzero(held)


def repeated_windows(raws: list[bytes], length: int = LENGTH, shards: int = 2) -> list[np.ndarray]:
    """For each text, whether each of its windows of ``length`` bytes (a multiple of SYMBOL) also starts elsewhere in ``raws``."""
    depth = length // SYMBOL
    out = [np.zeros(max(0, len(x) - length + 1), bool) for x in raws]
    data = np.frombuffer(b"".join(raws), np.uint8)
    if len(data) < length:
        return out
    sizes = np.array([len(x) for x in raws])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = Hashes(data)
    place = recurring(data, hashes, sizes, depth)
    if not len(place):
        return out
    of = np.searchsorted(starts, place, "right") - 1
    pos = place - starts[of]
    # Strings: runs of neighbouring symbols of a text and residue.
    turn = (of * SYMBOL + pos % SYMBOL) * (int(sizes.max()) // SYMBOL + 2) + pos // SYMBOL
    order = np.argsort(turn)
    of, pos, place = of[order], pos[order], place[order]
    string_start = np.concatenate([[True], np.diff(turn[order]) != 1])
    hashed = hashes.of(place, SYMBOL) ^ hashes.other(place, SYMBOL)
    _, symbol = np.unique(hashed, return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    number = np.cumsum(string_start) - 1
    # Each string with its end.
    at = np.arange(len(symbol)) + number
    line = np.zeros(len(symbol) + number[-1] + 1, np.int64)
    line[at] = symbol
    owner = np.full(len(line), -1)
    owner[at] = np.arange(len(symbol))
    ends = np.flatnonzero(owner < 0)
    bounds = [0, *(ends[[min(len(ends) - 1, len(ends) * k // shards - 1) for k in range(1, shards) if len(ends) * k // shards]] + 1), len(line)]
    bounds = sorted(set(int(x) for x in bounds))
    merged, common = None, None
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = Transform.of(line[lo:hi], ends[(ends >= lo) & (ends < hi)] - lo)
        merged, common = merge(merged or Transform(np.zeros(0, np.int64), np.zeros(0, np.int64), 0), part, depth) if merged or hi == len(line) else (part, None)
    twice = common >= depth
    twice[:-1] |= twice[1:]
    found = owner[merged.order[twice]]
    found = found[found >= 0]
    flat, offset = np.zeros(sum(map(len, out)), bool), np.cumsum([0, *map(len, out)])
    inside = pos[found] < np.array([len(x) for x in out])[of[found]]
    flat[offset[of[found[inside]]] + pos[found[inside]]] = True
    return [flat[offset[i] : offset[i + 1]] for i in range(len(raws))]


def _unpacked(packed: pa.Scalar) -> bytes:
    return zstandard.decompress(packed.as_py())


def _ints(values: pa.ListScalar) -> np.ndarray:
    """A list of numbers; null is empty."""
    return np.zeros(0, np.int64) if values.values is None else values.values.to_numpy(zero_copy_only=False)


def _longs(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


_ROWS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("packed", pa.binary()), ("passages", pa.list_(pa.binary()))])
_ANCHORS = pa.schema([("h", pa.int64()), ("uid", pa.int64()), ("at", pa.int32())])
_SEGMENTS = pa.schema([("key", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("uid", pa.int64()), ("a", pa.int32()), ("count", pa.int32())])
_TEXTS = pa.schema([("key", pa.int64()), ("w0", pa.int64()), ("w1", pa.int64()), ("times", pa.int64()), ("uid", pa.int64()), ("a", pa.int32()), ("raw", pa.binary())])
_KEEPS = pa.schema([("uid", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64())])


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    """uid and arrays of the columns, entry by entry; a row's lists are bounded by its text."""
    lists = rows.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("l"))
    return lists.select("uid", *[F.col(f"l.{c}").alias(c) for c in columns])


def passages(raw: bytes) -> list[bytes]:
    """Hashes of a text's distinct paragraphs of over WORDS words, white space apart."""
    found = (p.split() for p in raw.split(b"\n") if len(p) > 2 * WORDS)
    return sorted({hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in found if len(w) > WORDS})


def shared_passages(rows: DataFrame) -> DataFrame:
    """uid and n_passages of rows with passages that another row has too."""
    each = rows.select("uid", F.explode("passages").alias("p"))
    # Cut, as in open_segments.
    shared = cut(each.groupBy("p").agg(F.min("uid").alias("least"), F.max("uid").alias("most")).where("least <> most").select("p"))
    return each.join(shared, "p").groupBy("uid").agg(F.count(F.lit(1)).alias("n_passages"))


def open_segments(distinct: DataFrame) -> DataFrame:
    """The distinct segments of keys that have one found once, each with its key's number of them, ``m``.

    The keys are cut: adaptive execution deals a hot key's rows to several tasks only where both sides of a join come straight
    from an exchange, which an aggregate's result doesn't.
    """
    keys = cut(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("times").alias("least")).where("least = 1"))
    return distinct.join(keys, "key")


def removed_windows(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, once, keeps): packed texts by row; positions of anchors found once; window starts [a, b) that are candidates but not repeated."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(docs, 2 * spark.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield batch_of(_ROWS, uid=batch.column(2), doc_id=batch.column(0), n=[len(x) for x in raw], packed=[packer.compress(x) for x in raw], passages=list(map(passages, raw)))

    rows = cut_by(texts(docs.withColumn("uid", F.monotonically_increasing_id()), "uid").mapInArrow(pack, ddl(_ROWS)), n, "uid")
    long = rows.where(F.col("n") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            rows = ((uid, _unpacked(packed)) for batch in batches for uid, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            for lot in lots(rows, lambda row: len(row[1])):
                of, at, h = Texts([raw for _, raw in lot], length).own()
                yield batch_of(_ANCHORS, h=_longs(h), uid=np.array([uid for uid, _ in lot])[of], at=at.astype(np.int32))

    found = long.select("uid", "packed").mapInArrow(lambda b: _joined(find(b), _ANCHORS), ddl(_ANCHORS))
    once = found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("uid"), F.min("at").alias("at")).where("c = 1")
    once = cut(_lists(once, "at"))
    with_once = long.select("uid", "n", "packed").join(once, "uid", "left")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                for uid, n, packed, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                    a, b = candidates(n, _ints(at), length)
                    raw = _unpacked(packed) if len(a) else b""
                    for i, j in zip(a.tolist(), b.tolist(), strict=True):
                        yield uid, i, raw[i : j - 1 + length]

        with np.errstate(over="ignore"):
            for lot in lots(runs(), lambda run: len(run[2])):
                of, a, count, key, s0, s1 = Texts([raw for *_, raw in lot], length).segments()
                a += np.array([i for _, i, _ in lot])[of]
                yield batch_of(_SEGMENTS, key=_longs(key), s0=_longs(s0), s1=_longs(s1), uid=np.array([uid for uid, *_ in lot])[of], a=a.astype(np.int32), count=count.astype(np.int32))

    segments = with_once.mapInArrow(lambda b: _joined(cut_up(b), _SEGMENTS), ddl(_SEGMENTS))
    # One of each distinct segment; both firsts see the same row.
    packed = (F.col("a").cast("long") * 4096 + F.col("count")).alias("ac")
    distinct = segments.select("key", "s0", "s1", "uid", packed).groupBy("key", "s0", "s1").agg(F.count(F.lit(1)).alias("times"), F.first("uid").alias("uid"), F.first("ac").alias("ac"))
    open_ = open_segments(cut(distinct))
    alone = open_.where("m = 1").select("uid", F.floor(F.col("ac") / 4096).cast("int").alias("a"), (F.floor(F.col("ac") / 4096) + F.col("ac") % 4096).cast("int").alias("b"))
    wanted = _lists(open_.where("m > 1").select("uid", "key", "ac", "times", (F.col("m") > MOST).alias("hot")), "key", "ac", "times", "hot")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for uid, packed, key, ac, times, hot in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                    a, count = np.divmod(_ints(ac), 4096)
                    yield uid, _unpacked(packed), _ints(key), a, count, _ints(times), _ints(hot).astype(bool)

        with np.errstate(over="ignore"):
            for lot in lots(rows(), lambda row: len(row[1])):
                whole: dict[str, list] = {f.name: [] for f in _TEXTS}
                for uid, raw, key, a, count, times, hot in lot:
                    cold = ~hot
                    if hot.any():
                        hashes, n = Hashes(np.frombuffer(raw, np.uint8)), count[hot]
                        at = np.repeat(a[hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        yield batch_of(_TEXTS, key=np.repeat(key[hot], n), w0=_longs(hashes.of(at, length)), w1=_longs(hashes.other(at, length)), times=np.repeat(times[hot], n), uid=np.full(len(at), uid), a=at.astype(np.int32), raw=pa.nulls(len(at), pa.binary()))
                    first, end = a[cold].tolist(), (a + count - 1 + length)[cold].tolist()
                    none = [None] * len(first)
                    new = {"key": key[cold].tolist(), "w0": none, "w1": none, "times": times[cold].tolist(), "uid": [uid] * len(first), "a": first, "raw": [raw[i:j] for i, j in zip(first, end, strict=True)]}
                    for k, v in new.items():
                        whole[k].extend(v)
                yield batch_of(_TEXTS, **whole)

    fetched = cut(long.select("uid", "packed").join(wanted, "uid").mapInArrow(lambda b: _joined(fetch(b), _TEXTS), ddl(_TEXTS)))
    single = fetched.where("raw is null").groupBy("w0", "w1").agg(F.sum("times").alias("c"), F.first("uid").alias("uid"), F.first("a").alias("a")).where("c = 1")
    single = single.select("uid", "a", (F.col("a") + 1).alias("b"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], []

        def solve() -> pa.RecordBatch:
            keep: dict[str, list] = {"uid": [], "a": [], "b": []}
            with np.errstate(over="ignore"):
                for (_, times, uid, a, _), again in zip(held, repeated_windows([x[4] for x in held], length), strict=True):
                    if times == 1:
                        for i, j in zip(*_runs(~again), strict=True):
                            for k, v in zip(keep, (uid, a + int(i), a + int(j)), strict=True):
                                keep[k].append(v)
            return batch_of(_KEEPS, **keep)

        weight = lambda rows: sum(len(x[4]) for x in rows)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    if held and weight(held) + weight(group) > SHARD:
                        yield solve()
                        held.clear()
                    held += group
                    group = []
                group.append(row)
        held += group
        if held:
            yield solve()

    dealt = fetched.where("raw is not null").select("key", "times", "uid", "a", "raw").repartition(n, "key").sortWithinPartitions("key")
    merged = dealt.mapInArrow(lambda b: _joined(shards(b), _KEEPS), ddl(_KEEPS))
    return rows, once, alone.unionByName(single).unionByName(merged)


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()


def deduplicate(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """RESULT's columns (and with ``with_text`` the bytes left, as ``kept``) for each row of ``docs``."""
    rows, once, keeps = removed_windows(docs, length)
    lists = _lists(cut(keeps), "a", "b")
    schema = RESULT.append(pa.field("kept", pa.binary())) if with_text else RESULT
    both = rows.join(once, "uid", "left").join(lists, "uid", "left").join(shared_passages(rows), "uid", "left")
    both = both.select("doc_id", "n", "packed", "at", "a", "b", F.coalesce("n_passages", F.lit(0)).alias("n_passages"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out: dict[str, list] = {f.name: [] for f in schema}
                for doc, n, packed, at, a, b, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                    raw = _unpacked(packed)
                    starts, ends = candidates(n, _ints(at), length) if n >= length else _NONE
                    if len(starts):
                        ok = np.zeros(n - length + 2, np.int8)
                        ok[starts] += 1
                        ok[ends] -= 1
                        np.subtract.at(ok, _ints(a), 1)
                        np.add.at(ok, _ints(b), 1)
                        starts, ends = _runs(np.cumsum(ok[:-1]) > 0)
                    # Spans: runs of windows that touch or overlap.
                    apart = starts[1:] > ends[:-1] - 1 + length
                    starts, ends = starts[np.append(True, apart)[: len(starts)]], (ends - 1 + length)[np.append(apart, True)[: len(ends)]]
                    kept = b"".join(raw[i:j] for i, j in zip([0, *ends.tolist()], [*starts.tolist(), n], strict=True)) if len(starts) else raw
                    row = {"doc_id": doc, "n_bytes": n, "n_removed": n - len(kept), "n_spans": len(starts), "kept_sha256": hashlib.sha256(kept).hexdigest(), "n_passages": found.as_py(), "kept": kept}
                    for k in out:
                        out[k].append(row[k])
                yield batch_of(schema, **out)

    return both.mapInArrow(remove, ddl(schema))


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
