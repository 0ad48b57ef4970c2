"""Best-fit packing of token sequences by a configuration linear program.

``pieces_of`` tokenises whole texts and cuts only those longer than a sequence: full pieces, the first may be shorter.
``plan`` works on the histogram of piece lengths, at most one count per length whatever the corpus' size:

* the configuration LP (fewest sequences whose configurations cover every length's count) is solved by multiplicative
  weights. A round prices every length by its bytes' worth times a weight, and one knapsack dynamic program gives the
  dearest filling of every room; so each length that is not yet covered gets the dearest configuration that holds it, and
  takes a ``SHARE`` of what its scarcest length has left. Weights fall exponentially with the share of a length's demand
  that the round covered. Rounds end once less than ``GAP`` of the tokens is uncovered;
* every round's prices, over the dearest configuration's, are a dual solution: ``Plan.bound`` is the best lower bound met;
* multiplicities are rounded down, and what that leaves is priced and laid out again in whole multiplicities, with the
  weights going on; the few pieces for which no priced configuration is left whole are packed best-fit decreasing.

``pack`` numbers the pieces of each length (dealt by range over length and id, so a length that a third of all pieces
have spreads over a third of the partitions) and looks each number up in the plan: (sequence, offset). The plan holds
blocks of (configuration, length), bounded by rounds times distinct lengths (2048 at most), not by documents.

Defined results: a null or empty text is its end id alone; repeated rows each are packed; an empty table gives no piece.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch_of, cut, ddl, partitions, pieces, ship, table, texts

CAPACITY = 2048
END = b"\0\0\0\0"
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first is what full pieces leave over."""
    first = n % capacity or capacity
    yield 0, min(first, n)
    for at in range(first, n, capacity):
        yield at, capacity


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    ship(docs.sparkSession)
    schema = PIECES.append(pa.field("ids", pa.binary())) if keep_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import Encoder

        encoder = Encoder.at(tokenizer)
        for batch in pieces(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += END
                for k, (at, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + n)]
                    row = {"doc_id": doc, "piece": k, "start": at, "length": n, "ids_crc32": zlib.crc32(part), "ids": part}
                    for name in out:
                        out[name].append(row[name])
            yield batch_of(schema, **out)

    return texts(docs).mapInArrow(run, ddl(schema))


#: Share of its scarcest length's rest that a configuration takes; uncovered share of tokens at which rounds end; how
#: fast weights fall; how much more a token is worth in a long piece than in a short one, so that short ones stay for the gaps.
SHARE, GAP, RATE, TILT = 0.9, 1e-3, 0.3, 0.05


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, pick) by room: the dearest filling of each room up to capacity, and a length in it (-1: one token stays empty)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    last = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        value = best[c - lengths[: last[c]]] + prices[: last[c]]
        k = int(value.argmax())
        best[c], pick[c] = (value[k], k) if value[k] > best[c - 1] else (best[c - 1], -1)
    return best, pick


def filling(pick: list[int], lengths: list[int], room: int) -> dict[int, int]:
    """Counts by index of the dearest filling of ``room``."""
    out: dict[int, int] = {}
    while room > 0:
        k = pick[room]
        if k < 0:
            room -= 1
        else:
            out[k] = out.get(k, 0) + 1
            room -= lengths[k]
    return out


class Pricing:
    """Rounds of knapsack pricing over what is left of each length's demand, with the weights and the best dual bound so far."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int):
        self.lengths, self.demand, self.capacity = lengths, demand, capacity
        self.weights, self.bound = np.ones(len(lengths)), float(lengths @ demand) / capacity

    def round(self, left: np.ndarray, take) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """(indices, counts, multiplicity) of a round's configurations; ``left`` is lessened. ``take`` gives a multiplicity from left / counts."""
        at = np.flatnonzero(left > 1e-9)
        own = self.lengths[at]
        price = own * (1 + TILT * own / self.capacity) * self.weights[at]
        best, pick = knapsack(price, own, self.capacity)
        self.bound = max(self.bound, float(self.demand[at] @ price) / best[self.capacity])
        picks, sizes, used, out = pick.tolist(), own.tolist(), np.zeros(len(left)), []
        for i in range(len(at) - 1, -1, -1):
            if left[at[i]] <= 1e-9:
                continue
            held = filling(picks, sizes, self.capacity - sizes[i])
            held[i] = held.get(i, 0) + 1
            ks, counts = at[list(held)], np.fromiter(held.values(), np.int64)
            times = take(left[ks] / counts)
            if times > 0:
                left[ks] -= times * counts
                used[ks] += times * counts
                out.append((ks, counts, times))
        self.weights *= np.exp(-RATE * used / self.demand)
        return out


def solve_lp(pricing: Pricing, rounds: int) -> dict[tuple, float]:
    """Multiplicities by configuration, ((index, count), ...), that cover all but GAP of the tokens, by multiplicative weights."""
    left, made = pricing.demand.astype(float), {}
    for _ in range(rounds):
        for ks, counts, times in pricing.round(left, lambda rest: SHARE * float(rest.min())):
            key = tuple(sorted(zip(ks.tolist(), counts.tolist(), strict=True)))
            made[key] = made.get(key, 0.0) + times
        if float(left @ pricing.lengths) <= GAP * float(pricing.demand @ pricing.lengths):
            break
    return made


@dataclass
class Plan:
    """Blocks by (length, first number): numbers of a length from ``first`` go to sequence base + (number - first) // per."""

    sequences: int
    bound: int
    starts: dict[int, np.ndarray]
    bases: dict[int, np.ndarray]
    pers: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]

    def place(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.starts[length], numbers, "right") - 1
        into, per = numbers - self.starts[length][k], self.pers[length][k]
        return self.bases[length][k] + into // per, self.offsets[length][k] + into % per * length


def fill_rest(left: np.ndarray, lengths: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on counts: (configuration, multiplicity) for all that is left.

    A sequence takes the longest piece left and then, again and again, the longest that fits; the same configuration is
    repeated as often as its scarcest length allows.
    """
    left, out = left.copy(), []
    while left.any():
        counts, room = np.zeros(len(lengths), np.int64), capacity
        while True:
            fit = np.flatnonzero((left - counts > 0) & (lengths <= room))
            if not len(fit):
                break
            k = int(fit[-1])
            n = min(int(left[k] - counts[k]), room // int(lengths[k]))
            counts[k] += n
            room -= n * int(lengths[k])
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        out.append((counts, times))
        left -= times * counts
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 60) -> Plan:
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    left, made, bound = demand.astype(float), [], 0.0
    if len(lengths):
        pricing = Pricing(lengths, demand, capacity)
        for key, x in sorted(solve_lp(pricing, rounds).items(), key=lambda z: (-z[1], z[0])):
            ks, counts = np.array(key, np.int64).T
            if (times := int(min(np.floor(x + 1e-9), (left[ks] // counts).min()))) > 0:
                made.append((ks, counts, times))
                left[ks] -= times * counts
        while left.any() and (more := pricing.round(left, lambda rest: int(rest.min()))):
            made += more
        made += [(ks := np.flatnonzero(c), c[ks], times) for c, times in fill_rest(left.astype(np.int64), lengths, capacity)]
        bound = pricing.bound
    numbers, at, sequence = np.zeros(len(lengths), np.int64), {}, 0
    for ks, counts, times in made:
        offset = 0
        for k, count in zip(ks.tolist(), counts.tolist(), strict=True):
            at.setdefault(int(lengths[k]), []).append((int(numbers[k]), sequence, count, offset))
            numbers[k] += times * count
            offset += count * int(lengths[k])
        sequence += times
    split = {n: np.array(rows, np.int64).T for n, rows in at.items()}
    parts = [{n: x[j] for n, x in split.items()} for j in range(4)]
    return Plan(sequence, math.ceil(bound - 1e-6), *parts)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, rounds: int = 60) -> DataFrame:
    """``cut_pieces`` (with integer ``length`` of 1 to capacity, and ``doc_id`` and ``piece``) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    ship(spark)
    dealt = cut_pieces.repartitionByRange(partitions(cut_pieces), "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()))
    # One count per length and part: as many as lengths plus parts, for parts are ranges of length.
    counts = sorted(tuple(x) for x in dealt.groupBy("length", "part").agg(F.count(F.lit(1))).collect())
    histogram: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for length, part, n in counts:
        first[part, length] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    made = plan(histogram, capacity, rounds)
    shared = spark.sparkContext.broadcast((made, first))
    schema = dealt.drop("part").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, starts = shared.value
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            names = batch.schema.names
            length, part = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "part"))
            ids, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            edges = np.flatnonzero(np.diff(np.concatenate([[-1], length, [-1]])))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = (int(part[i]), int(length[i]))
                at = starts[key] + seen.get(key, 0)
                seen[key] = seen.get(key, 0) + j - i
                ids[i:j], offsets[i:j] = found.place(key[1], np.arange(at, at + j - i))
            kept = [batch.column(k) for k, c in enumerate(names) if c != "part"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids), pa.array(offsets)], names=[c for c in names if c != "part"] + ["sequence_id", "offset"])

    return dealt.mapInArrow(run, schema)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(cut(pieces_of(table(spark, sf_dir, "documents"), default_tokenizer())))
