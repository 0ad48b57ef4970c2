"""Packing into windows: every id once, no gaps, no padding; the planner alone on odd histograms."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import packing, tokens, windows

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    more = ["row", "part", "length", "start", "ids", "sequence_id", "offset", "doc_tokens"]
    return spark.createDataFrame([(*r, *["x"] * len(more)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in more))


def odd_rows():
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [None, "", " ", "a", "漢字😀" * 900, "x" * 300_000, words(20_000), *(words(rng.randint(1, 400)) for _ in range(150)), *["a repeated text"] * 90]
    return [*enumerate(texts), (None, "no id"), (3, "an id again"), (3, "an id again"), (1 << 60, "far")]


def check(rows, got, capacity):
    """Of each (doc_id, text): its pieces in the order of start hold its ids. Returns the padding."""
    encoder = tokens.Encoder.at(packing.default_tokenizer())
    want = Counter()
    of = {}
    for (i, t), raw in zip(rows, encoder.encode([t or "" for _, t in rows]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
        ids = np.frombuffer(raw + packing.END, "<u4")
        want[i, len(ids)] += len(ids)
        of.setdefault(i, []).append(ids)
    seen = Counter()
    for r in got:
        assert 0 < r["length"] <= capacity and 0 <= r["start"] and r["start"] + r["length"] <= r["doc_tokens"]
        part = {zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for ids in of[r["doc_id"]] if len(ids) == r["doc_tokens"]}
        assert r["ids_crc32"] in part
        seen[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert seen == want
    once = {i for i, _ in rows if len(of[i]) == 1}
    by_doc, by_sequence = {}, {}
    for r in got:
        if r["doc_id"] in once:
            by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in [*by_doc.values(), *by_sequence.values()]:
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
    for parts in by_sequence.values():
        n = sum(x for _, x in parts)
        assert n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
    return padding


@pytest.mark.parametrize("capacity", [1024, 64])
def test_odd_rows(spark, capacity):
    rows = odd_rows()
    got = windows.pack(frame(spark, rows), packing.default_tokenizer(), capacity).collect()
    assert check(rows, got, capacity) == 0


def test_empty_table(spark):
    assert windows.pack(frame(spark, []), packing.default_tokenizer()).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = windows.op11_windows(spark, SF).collect()
    assert check(rows, got, 1024) == 0
    assert len(got) < sum(-(-r["doc_tokens"] // 1024) for r in {r["doc_id"]: r for r in got}.values()) + 120


def test_combinations_against_brute_force():
    lengths = np.array([1, 2, 3, 5, 8, 9, 12])
    index, count = windows.combinations(lengths, 12)
    made = Counter(tuple(sorted((int(lengths[i]), int(c)) for i, c in zip(a, b, strict=True) if c)) for a, b in zip(index, count, strict=True))
    want = {((a, 12 // a),) for a in (1, 2, 3, 12)}
    for a in lengths.tolist():
        for b in lengths.tolist():
            want |= {((a, i), (b, j)) for i in range(1, 13) for j in range(1, 13) if a < b and a * i + b * j == 12}
            want |= {((a, 1), (b, 1), (c, 1)) for c in lengths.tolist() if a < b < c and a + b + c == 12}
    assert set(made) == want and max(made.values()) == 1


def test_counts_are_solved_for():
    """Where combinations can use up every length, the squares vanish."""
    lengths = np.array([100, 200, 300, 412, 512, 612, 724])
    index, count = windows.combinations(lengths, 1024)
    true = np.arange(len(index)) * 10.0
    demand = np.bincount(index.ravel(), (count * true[:, None]).ravel(), minlength=len(lengths))
    x = windows.solve(index, count, demand, np.ones(len(lengths)), 3000)
    assert (x >= 0).all() and np.bincount(index.ravel(), (count * x[:, None]).ravel(), minlength=len(lengths)) == pytest.approx(demand, rel=1e-3, abs=1e-2)


def test_plans_of_odd_histograms():
    rng = np.random.default_rng(0)
    wide = Counter(rng.integers(1, 1024, 20_000).tolist())
    for h in ({}, {1024: 7}, {512: 3}, {1: 5}, {50: 10_000}, dict(wide), dict(wide) | {700: 20_000}):
        made = windows.plan(h)
        assert all(made.whole.get(n, 0) <= c for n, c in h.items())
        for n in made.plan.starts:
            sequence, offset = made.plan.place(n, np.arange(made.whole[n]))
            assert (offset + n <= 1024).all() and (sequence < made.base).all()
        assert made.tail[-1] == sum(n * (c - made.whole.get(n, 0)) for n, c in h.items() if n < 1024)


def test_what_counts_cannot_place_is_little():
    rng = np.random.default_rng(0)
    wide = {n: 1000 * c for n, c in Counter(rng.integers(1, 1024, 20_000).tolist()).items()}
    made = windows.plan(wide)
    assert sum(n * (c - made.whole.get(n, 0)) for n, c in wide.items()) < 0.12 * sum(n * c for n, c in wide.items())
