"""What op2 computes for each byte: texts are hashed in lots, and transforms get only what may recur."""

import random

import numpy as np
import pytest

from tallyforge.llm import suffixes

LENGTH, K, W = suffixes.LENGTH, suffixes.K, suffixes.W


@pytest.fixture(autouse=True)
def wrapping():
    with np.errstate(over="ignore"):
        yield


def line(rng, n):
    return bytes(rng.randrange(97, 123) for _ in range(n))


def test_transforms_get_few_symbols_of_texts_that_share_less_than_a_window(monkeypatch):
    rng = random.Random(1)
    shared = line(rng, 380)
    raws = [line(rng, 50) + shared + line(rng, 50) for _ in range(100)]
    seen = []
    of = suffixes.Transform.of.__func__
    monkeypatch.setattr(suffixes.Transform, "of", classmethod(lambda cls, symbols, ends: seen.append(len(symbols)) or of(cls, symbols, ends)))
    assert not any(w.any() for w in suffixes.repeated_windows(raws))
    few = 100 * (480 - suffixes.SYMBOL + 1) // 20
    assert sum(seen) < few
    # Two of them share a window more.
    raws[3] = raws[3][:30] + raws[70][30:]
    found = suffixes.repeated_windows(raws)
    assert [k for k, w in enumerate(found) if w.any()] == [3, 70]
    assert 0 < sum(seen) < 2 * few


def test_texts_are_hashed_in_lots(monkeypatch):
    rng = random.Random(2)
    made = []
    init = suffixes.Hashes.__init__
    monkeypatch.setattr(suffixes.Hashes, "__init__", lambda self, data: made.append(len(data)) or init(self, data))
    rows = [(line(rng, 500),) for _ in range(400)]
    for lot in suffixes.lots(iter(rows), lambda row: len(row[0])):
        suffixes.Texts([raw for raw, in lot]).own()
    assert sum(made) == 200_000 and len(made) <= 5


def test_anchors_inside_windows_do_not_depend_on_neighbouring_texts():
    rng = random.Random(3)
    raws = [line(rng, rng.choice([400, 401, 777, 2000])) for _ in range(20)] + [b"a" * 900]
    of, at, h = suffixes.Texts(raws).own()
    for k, raw in enumerate(raws):
        _, alone, own = suffixes.Texts([raw]).own()
        inner = lambda x, y, raw=raw: [(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if W - 1 <= i <= len(raw) - K - W + 1]
        assert inner(alone, own) == inner(at[of == k], h[of == k])
        hashes = (suffixes.Hashes(np.frombuffer(raw, np.uint8)).each(K) >> np.uint64(32)).tolist()
        least = {i for p in range(len(hashes) - W + 1) for i in range(p, p + W) if hashes[i] == min(hashes[p : p + W])}
        assert set(alone.tolist()) == least


def test_segments_of_equal_windows_have_equal_keys_wherever_the_text_is_cut():
    rng = random.Random(4)
    raw = line(rng, 3000)
    cuts = [(0, 3000), (100, 700), (137, 537), (900, 2500), (1000, 1400)]
    key = {}
    for i, j in cuts:
        of, a, count, k, *_ = suffixes.Texts([line(rng, 450), raw[i:j], line(rng, 410)]).segments()
        own = of == 1
        assert count[own].sum() == j - i - LENGTH + 1
        for start, n, x in zip(a[own].tolist(), count[own].tolist(), k[own].tolist(), strict=True):
            for s in range(i + start, i + start + n):
                assert key.setdefault(s, x) == x


@pytest.mark.parametrize("once", [[], [0], [50], [200], [390], [700, 250], [972], [120, 130, 140, 900]])
def test_candidates_are_windows_without_an_anchor_found_once_inside(once):
    n = 1000
    a, b = suffixes.candidates(n, np.array(once, np.int64))
    got = [any(i <= s < j for i, j in zip(a.tolist(), b.tolist(), strict=True)) for s in range(n - LENGTH + 1)]
    assert got == [not any(s + W - 1 <= p <= s + LENGTH - K - W + 1 for p in once) for s in range(n - LENGTH + 1)]
    assert not (b[:-1] >= a[1:]).any()


def test_a_lot_is_bounded():
    rows = [(b"x" * 40_000,) for _ in range(50)]
    assert max(len(lot) for lot in suffixes.lots(iter(rows), lambda row: len(row[0]))) == 2


def test_planted_passages_go_from_the_contracts_length_on_and_clean_texts_stay(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    at_length = lambda n: (fresh(51) + " " + fresh(n))[:n]
    long, short = at_length(400), at_length(399)
    # Bytes beside a passage differ, so that nothing longer is shared by chance.
    marks = iter("0123456789ABCDEFGHIJ")
    texts = [(p, f"{fresh(60)} {next(marks)}{p}{next(marks)} {fresh(60)}") for p in (long, short) for _ in range(3)]
    texts += [(None, fresh(200)) for _ in range(5)]
    got = suffixes.deduplicate(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got} == {i: (400, 1) if p == long else (0, 0) for i, (p, _) in enumerate(texts)}
    assert all(len(p.split()) > 50 for p in (long, short))
