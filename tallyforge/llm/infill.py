"""Fill-in-the-middle by a table-driven automaton over UTF-8 bytes.

``Automaton`` is built from a unit (code points, words or lines) and sentinels: the product of how many continuation bytes
are still due, whether the last code point ends a unit, and the longest part of a sentinel just read. Each transition
tells whether its byte starts a unit and how many sentinels it completes; one table lookup a byte does all three.

``scan`` runs it over a batch of texts at once. Texts are laid in lanes of ``LANE`` bytes, every lane is run from every
state side by side, and the lanes of a text are then joined from its first: one scan, whatever the texts' lengths, that
leaves each lane's true entry state and the units and sentinels counted before it. ``locate`` is the second pass: it runs
only the lanes that hold a cut, from their entry states, until the counter meets the cut's unit.

``transform`` draws cuts and forms from SHA-256 of the seed and id, so a rerun, on whatever partitions, agrees. A text with
a sentinel stays plain, so ``restore`` finds the sentinels of a transformed one where they were put.

Defined results: null text is empty, and an empty text plain; a null id draws as an empty one; rows that repeat an id draw
alike; bytes that are no UTF-8 are units of their own; an empty table gives no row; other columns go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._common import batch_of, ddl, pieces, ship, table

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a lane.
LANE = 512
#: What a byte that completes a sentinel counts, beside 1 for one that starts a unit.
SENTINEL = 1 << 40
MADE = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
])


@dataclass(frozen=True)
class Automaton:
    """``to[state, byte]`` and ``counts[state, byte]``; state 0 is the start of a text."""

    to: np.ndarray
    counts: np.ndarray


def automaton(unit: str = "codepoint", sentinels: Sequence[str] = SENTINELS) -> Automaton:
    """unit: ``codepoint``; ``word``: a run of non-spaces with the spaces after it; ``line``: a line with its end."""
    marks = [s.encode() for s in sentinels]
    parts = sorted({m[:k] for m in marks for k in range(len(m))} | {b""}, key=lambda p: (len(p), p))

    def read(part: bytes, byte: int) -> tuple[bytes, int]:
        """The longest part that the bytes now end with, and how many sentinels they end with."""
        now = part + bytes([byte])
        while now not in parts and now not in marks and now:
            now = now[1:]
        found = sum(now.endswith(m) for m in marks)
        while now not in parts:
            now = now[1:]
        return now, found

    def starts(edge: str, byte: int) -> bool:
        return unit == "codepoint" or edge == "start" or (edge == "end" and (unit == "line" or byte not in b" \t\n\v\f\r"))

    def edge_after(edge: str, byte: int) -> str:
        if unit == "codepoint":
            return "start"
        return "end" if byte == 10 or (unit == "word" and byte in b" \t\v\f\r") else "inside"

    first = (0, "start", b"")
    states, at, to, counts = [first], {first: 0}, [], []
    for due, edge, part in states:
        row, tally = [], []
        for byte in range(256):
            now, found = read(part, byte)
            if due and byte & 0xC0 == 0x80:
                after, new = (due - 1, edge, now), False
            else:
                follow = 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 0
                after, new = (follow, edge_after(edge, byte), now), starts(edge, byte)
            if after not in at:
                at[after] = len(states)
                states.append(after)
            row.append(at[after])
            tally.append(new + found * SENTINEL)
        to.append(row)
        counts.append(tally)
    return Automaton(np.array(to, np.uint8), np.array(counts, np.int64))


@dataclass
class Scan:
    """Of every lane: text, first byte, bytes, state at entry, and units before it in its text. Of every text: units, and sentinels found."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    entry: np.ndarray
    before: np.ndarray
    first: np.ndarray
    units: np.ndarray
    found: np.ndarray


def scan(data: np.ndarray, offsets: np.ndarray, made: Automaton) -> Scan:
    """``data`` holds the texts' bytes end to end, text i from offsets[i] to offsets[i + 1]."""
    to, counts, n_states = made.to.ravel(), made.counts.ravel(), len(made.to)
    sizes = np.diff(offsets)
    lanes = -(-sizes // LANE)
    first = np.concatenate([[0], np.cumsum(lanes)])
    text = np.repeat(np.arange(len(sizes)), lanes)
    place = np.arange(len(text)) - first[text]
    start = offsets[text] + place * LANE
    size = np.minimum(LANE, offsets[text + 1] - start)
    # Longest lanes first: those that still have a byte are a prefix.
    order = np.argsort(-size, kind="stable")
    alive, at = np.searchsorted(-size[order], -np.arange(LANE), "left"), start[order]
    state = np.tile(np.arange(n_states), (len(text), 1))
    tally = np.zeros((len(text), n_states), np.int64)
    for t in range(LANE):
        n = alive[t]
        if not n:
            break
        key = state[:n] * 256 + data[at[:n] + t][:, None]
        tally[:n] += counts[key]
        state[:n] = to[key]
    last, tallied = np.empty_like(state), np.empty_like(tally)
    last[order], tallied[order] = state, tally
    # Join the lanes of each text: the k-th lanes of all texts that have so many.
    entry, before = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    now, seen = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_lanes = np.argsort(-lanes, kind="stable")
    for k in range(int(lanes.max(initial=0))):
        own = by_lanes[: np.searchsorted(-lanes[by_lanes], -k, "left")]
        lane = first[own] + k
        entry[lane], before[lane] = now[own], seen[own]
        seen[own] += tallied[lane, now[own]]
        now[own] = last[lane, now[own]]
    return Scan(text, start, size, entry, before % SENTINEL, first, seen % SENTINEL, seen // SENTINEL)


def locate(data: np.ndarray, offsets: np.ndarray, made: Automaton, seen: Scan, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The byte, from its text's first, at which each (text, unit) starts; a text's length for the unit after its last."""
    out = offsets[text + 1] - offsets[text]
    asked = np.flatnonzero(unit < seen.units[text])
    # The last lane of the text with no more units before it; lanes without a unit of their own are passed over.
    width = int(seen.units.max(initial=0)) + 1
    lane = np.searchsorted(seen.text * width + seen.before, text[asked] * width + unit[asked], "right") - 1
    state, left, at = seen.entry[lane], unit[asked] - seen.before[lane], seen.start[lane].copy()
    to, counts, open_ = made.to.ravel(), made.counts.ravel(), np.arange(len(asked))
    while len(open_):
        key = state[open_] * 256 + data[at[open_]]
        starts = counts[key] % SENTINEL
        done = (left[open_] == 0) & (starts == 1)
        out[asked[open_[done]]] = at[open_[done]] - offsets[text[asked[open_[done]]]]
        left[open_] -= starts
        state[open_] = to[key]
        at[open_] += 1
        open_ = open_[~done]
    return out


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes, sentinels: Sequence[str]) -> bytes:
    p, s, m = (x.encode() for x in sentinels)
    return b"".join([p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle])


def parted(output: bytes, form: str, sentinels: Sequence[str]) -> bytes:
    """The text of an output: its parts, between the sentinels, in the order of the text."""
    p, s, m = (x.encode() for x in sentinels)
    if form == "plain":
        return output
    one, two = (p, s) if form == "psm" else (s, p)
    head, _, middle = output[len(one) :].partition(m)
    a, _, b = head.partition(two)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, unit: str = "codepoint", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars and middle_chars (in units), and the output text.

    ``percent`` of the texts are cut, of those ``spm_percent`` have their suffix first.
    """
    ship(docs.sparkSession)
    if len(set(sentinels)) != 3 or any(a.startswith(b[k:]) for a in sentinels for b in sentinels for k in range(1, len(b))):
        raise ValueError("three sentinels, none of which begins as another, or itself, ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(unit, sentinels)
        for batch in pieces(batches):
            ids, raw = batch.column(0).to_pylist(), batch.column(1)
            whole = raw.to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int64)
            data = np.frombuffer(b"".join(whole), np.uint8)
            seen = scan(data, offsets, made)
            lot = [draws(seed, i) for i in ids]
            units, plain = seen.units.tolist(), (seen.found > 0).tolist()
            forms = ["plain" if not n or odd or h[2] % 100 >= percent else "spm" if h[3] % 100 < spm_percent else "psm" for n, odd, h in zip(units, plain, lot, strict=True)]
            cut = np.array([k for k, f in enumerate(forms) if f != "plain"], np.int64)
            ends = np.sort(np.array([[lot[k][j] % (units[k] + 1) for j in (0, 1)] for k in cut], np.int64).reshape(-1, 2), axis=1)
            bytes_ = [locate(data, offsets, made, seen, cut, ends[:, j]) for j in (0, 1)]
            outputs, prefix, middle = list(whole), [None] * len(ids), [None] * len(ids)
            for k, a, b, (p, q) in zip(cut.tolist(), *(x.tolist() for x in bytes_), ends.tolist(), strict=True):
                text = whole[k]
                outputs[k], prefix[k], middle[k] = joined(forms[k], text[:a], text[a:b], text[b:], sentinels), p, q - p
            yield batch_of(MADE, doc_id=batch.column(0), n=units, form=forms, prefix_chars=prefix, middle_chars=middle, output=pa.array(outputs, pa.binary()).cast(pa.string(), safe=False))

    raw = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw).mapInArrow(run, ddl(MADE))


def restore(made: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``made`` with the text that each output and form came from, as ``restored``; nothing else of the row is looked at."""
    ship(made.sparkSession)
    schema = StructType([*made.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "output"):
            named = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            outputs = named["output"].cast(pa.binary()).to_pylist()
            texts = [parted(o, f, sentinels) for o, f in zip(outputs, named["form"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], names=[*named, "restored"])

    return made.mapInArrow(run, schema)


def op12_infill(spark, sf_dir: str) -> DataFrame:
    out = restore(transform(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


#: Cuts by substr over code points; what is restored is the text itself.
ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
lot AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
formed AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM lot),
parts AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1, n - q) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
