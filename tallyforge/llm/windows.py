"""Packing into windows by non-negative least squares over the histogram of lengths.

``tokenised`` cuts every document into full windows and one rest, shorter than a window, that keeps its ids. ``plan`` works
on the histogram of the rests, one count per length whatever the corpus' size:

* ``combinations`` lists shallow combinations that fill a window exactly: up to three lengths once each, or one or two
  lengths as often as it takes;
* ``solve`` finds repeat counts x >= 0 that minimise the weighted squares of (uses of each length - its count), by
  accelerated projected gradients with a diagonal majoriser; a sparse solution is asked for by solving again over those
  combinations that carry most;
* counts are rounded and stopped at what is there; what is left is solved and rounded again while that places enough;
* the residuals are packed greedily, longest first, each sequence filled to the end: the piece that reaches over it is cut
  there. The last, short sequence is cut at powers of two, which need no padding; so no sequence has any.

``place`` numbers the rests of each length (dealt by range over length and row, so that a length that a third of all rests
have spreads over a third of the partitions) and looks each number up in the plan. The plan holds blocks of (combination,
length), bounded by rounds times lengths, and residual counts: nothing in it grows with the documents.

Defined results: null or empty text is its end id alone; repeated rows each are packed; a null id stays; an empty table
gives no piece; other columns go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch_of, cut, ddl, partitions, pieces, ship, table, texts
from .packing import END, Plan, default_tokenizer

CAPACITY = 1024
CUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PLACED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
#: Steps of a solution; combinations kept per length for the sparse one; rounds at most, and the share of the tokens left
#: that a round has to place for another to follow.
STEPS, KEPT, ROUNDS, ENOUGH = 120, 2, 16, 0.05


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """CUT's columns: a document's full windows, then its rest with its ids, two bytes each where they all fit."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import Encoder

        encoder = Encoder.at(tokenizer)
        for batch in pieces(batches):
            out: dict[str, list] = {f.name: [] for f in CUT}
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += END
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    kept = None
                    if (n := len(part) // 4) < capacity:
                        x = np.frombuffer(part, "<u4")
                        kept = x.astype("<u2").tobytes() if x.max() < 1 << 16 else part
                    for name, value in zip(out, (doc, at, n, zlib.crc32(part), total, kept), strict=True):
                        out[name].append(value)
            yield batch_of(CUT, **out)

    return texts(docs).mapInArrow(run, ddl(CUT))


def combinations(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, counts), three of each a combination: indices into ``lengths``, and how often that length (0: unused)."""
    at = np.full(capacity + 1, -1)
    at[lengths] = np.arange(len(lengths))
    rows: list[np.ndarray] = []

    def add(*columns) -> None:
        rows.append(np.stack(np.broadcast_arrays(*columns), axis=-1).reshape(-1, 6))

    for i, a in enumerate(lengths.tolist()):
        if capacity % a == 0:
            add(i, 0, 0, capacity // a, 0, 0)
        # a once with two longer ones, each once.
        b = lengths[i + 1 :]
        c = capacity - a - b
        fits = c > b
        third = at[np.where(fits, c, 0)]
        k = np.flatnonzero(fits & (third >= 0))
        add(np.full(len(k), i), k + i + 1, third[k], np.ones(len(k), int), 1, 1)
        # a as often as it goes, with a longer one as often as fills the rest.
        times = np.arange(1, (capacity - 1) // a + 1)
        rest = capacity - a * times
        other = np.arange(1, int(rest.max(initial=0)) // (a + 1) + 1)
        size, left = np.divmod(rest[:, None], other)
        second = at[np.where((left == 0) & (size > a), size, 0)]
        t, o = np.nonzero(second >= 0)
        add(np.full(len(t), i), second[t, o], 0, times[t], other[o], 0)
    made = np.concatenate(rows) if rows else np.zeros((0, 6), int)
    return made[:, :3], made[:, 3:]


def solve(index: np.ndarray, count: np.ndarray, demand: np.ndarray, weight: np.ndarray, steps: int, x: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that makes |weight * (uses - demand)|^2 small, uses being what x times the combinations use of each length."""
    x = np.zeros(len(index)) if x is None else x
    uses = lambda v: np.bincount(index.ravel(), (count * v[:, None]).ravel(), minlength=len(demand))
    back = lambda r: (count * r[index]).sum(axis=1)
    square = weight * weight
    bound = back(square * uses(np.ones(len(index))))  # above the curvature, entry by entry, for nothing in it is negative
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(square * (uses(y) - demand)) / bound)
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if float((y - new) @ (bound * (new - x))) > 0:  # it overshot: begin again from here
            faster, y = 1.0, new
        else:
            y = new + (t - 1) / faster * (new - x)
        x, t = new, faster
    return x


@dataclass
class Windows:
    """Whole pieces, by length and number, up to ``whole``; residual ones lie end to end from ``first`` of their length on."""

    plan: Plan
    whole: dict[int, int]
    first: dict[int, int]
    #: Places of residual tokens at which sequences begin, after the full ones: the powers of two of the last.
    tail: np.ndarray
    capacity: int
    base: int

    def parts(self, length: int, number: int) -> Iterator[tuple[int, int, int, int]]:
        """(from, length, sequence, offset) of the pieces of a residual one."""
        at = self.first[length] + (number - self.whole.get(length, 0)) * length
        done, full = 0, int(self.tail[0]) // self.capacity
        while done < length:
            if at < self.tail[0]:
                sequence, offset = divmod(at, self.capacity)
                room = self.capacity - offset
            else:
                k = int(np.searchsorted(self.tail, at, "right")) - 1
                sequence, offset, room = full + k, at - int(self.tail[k]), int(self.tail[k + 1]) - at
            n = min(room, length - done)
            yield done, n, self.base + sequence, offset
            done, at = done + n, at + n


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Windows:
    lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    index, count = combinations(lengths, capacity)
    made: list[tuple[list[int], list[int], int]] = []
    for _ in range(ROUNDS if len(index) else 0):
        open_ = np.flatnonzero((left[index] >= count).all(axis=1))
        if not len(open_):
            break
        weight = lengths / capacity
        x = solve(index[open_], count[open_], left, weight, STEPS)
        best = np.argsort(-x, kind="stable")[: KEPT * len(lengths)]
        open_, x = open_[best], solve(index[open_[best]], count[open_[best]], left, weight, STEPS, x[best])
        before = int(left @ lengths)
        for k in np.argsort(-x, kind="stable"):
            used = count[open_[k]] > 0
            ks, counts = index[open_[k]][used], count[open_[k]][used]
            if (times := min(round(x[k]), int((left[ks] // counts).min()))) > 0:
                left[ks] -= times * counts
                made.append((lengths[ks].tolist(), counts.tolist(), times))
        if before - int(left @ lengths) < ENOUGH * before:
            break
    if full := histogram.get(capacity, 0):
        made.append(([capacity], [1], full))
    numbers, at, sequence = {}, {}, 0
    for of, counts, times in made:
        offset = 0
        for length, n in zip(of, counts, strict=True):
            at.setdefault(length, []).append((numbers.get(length, 0), sequence, n, offset))
            numbers[length] = numbers.get(length, 0) + times * n
            offset += n * length
        sequence += times
    split = {n: np.array(rows, np.int64).T for n, rows in at.items()}
    placed = Plan(sequence, sequence, *({n: x[j] for n, x in split.items()} for j in range(4)))
    first, end = {}, 0
    for length, n in zip(lengths[::-1].tolist(), left[::-1].tolist(), strict=True):
        first[length] = end
        end += n * length
    tail = [end - end % capacity]
    while tail[-1] < end:
        tail.append(tail[-1] + (1 << (end - tail[-1]).bit_length() - 1))
    return Windows(placed, numbers, first, np.array(tail, np.int64), capacity, sequence)


def place(cut_windows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PLACED's columns for the rows of ``tokenised``."""
    spark = cut_windows.sparkSession
    ship(spark)
    numbered = cut(cut_windows.withColumn("row", F.monotonically_increasing_id()))
    dealt = numbered.repartitionByRange(partitions(cut_windows), "length", "row").sortWithinPartitions("length", "row").drop("row")
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()))
    # One count per length and part: as many as lengths plus parts, for parts are ranges of length.
    histogram: dict[int, int] = {}
    starts: dict[tuple[int, int], int] = {}
    for length, part, n in sorted(tuple(x) for x in dealt.groupBy("length", "part").agg(F.count(F.lit(1))).collect()):
        starts[part, length] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    shared = spark.sparkContext.broadcast((plan(histogram, capacity), starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first = shared.value
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            names = batch.schema.names
            lengths, parts = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "part"))
            sequence, offset, residual = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.full(len(lengths), -1)
            edges = np.flatnonzero(np.diff(np.concatenate([[-1], lengths, [-1]])))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = (int(parts[i]), int(lengths[i]))
                at = first[key] + seen.get(key, 0)
                seen[key] = seen.get(key, 0) + j - i
                whole = min(max(windows.whole.get(key[1], 0) - at, 0), j - i)
                if whole:
                    sequence[i : i + whole], offset[i : i + whole] = windows.plan.place(key[1], np.arange(at, at + whole))
                residual[i + whole : j] = np.arange(at + whole, at + j - i)
            keep = pa.array(residual < 0)
            placed = batch.select([f.name for f in CUT][:-1]).filter(keep)
            yield pa.RecordBatch.from_arrays([*placed.columns, pa.array(sequence[residual < 0]), pa.array(offset[residual < 0])], schema=PLACED)
            out: dict[str, list] = {f.name: [] for f in PLACED}
            for k in np.flatnonzero(residual >= 0).tolist():
                doc, start, length, crc, total, ids = (batch.column(names.index(f.name))[k].as_py() for f in CUT)
                for a, n, seq, off in windows.parts(length, int(residual[k])):
                    if n < length:
                        crc = zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // length}")[a : a + n].astype("<u4").tobytes())
                    for name, value in zip(out, (doc, start + a, n, crc, total, seq, off), strict=True):
                        out[name].append(value)
            yield batch_of(PLACED, **out)

    return dealt.mapInArrow(run, ddl(PLACED))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return place(tokenised(docs, tokenizer, capacity), capacity)


def op11_windows(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
