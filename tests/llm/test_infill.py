"""Fill-in-the-middle against slices of Python's strings, and the automaton against plain readings of its bytes."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tallyforge.llm import infill

SF = "/root/testdata/sf0.001"
MARK = re.compile("<[PSM]>")


def odd_texts():
    rng = random.Random(8)
    mixed = lambda n: "".join(rng.choice("ab <>PSMé漢😀\n\t") for _ in range(n))
    edge = [f"{'x' * k}<P>tail" for k in range(infill.LANE - 4, infill.LANE + 2)]
    return [None, "", "a", "<", "<P", "<<P>", "<P>", "<S<M", "<p>", "漢" * 700, "😀" * 513, "é", " \n ", "x" * 300_000, "<P" * 2000, *edge, *(mixed(n) for n in (3, 30, 600, 5000)), "same", "same"]


def frame(spark, rows):
    more = ["n", "form", "output", "restored", "prefix_chars", "h"]
    return spark.createDataFrame([(*r, *["x"] * len(more)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in more))


def plain(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or MARK.search(text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = text[:p], text[p:q], text[q:]
    return (doc_id, n, "spm", p, q - p, f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else (doc_id, n, "psm", p, q - p, f"<P>{a}<S>{c}<M>{b}")


def test_odd_rows_against_slices(spark):
    rows = [*enumerate(odd_texts()), (None, "no id"), (None, None), (-5, "below"), (1 << 62, "far"), (9, "漢" * 700)]
    made = infill.transform(frame(spark, rows))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert sorted((r["restored"], r["doc_id"]) for r in infill.restore(made).collect() if r["doc_id"] is not None) == sorted((t or "", i) for i, t in rows if i is not None)
    assert {f for _, _, f, *_ in (plain(*r) for r in rows)} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.restore(infill.transform(frame(spark, []))).count() == 0


def test_query_equals_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = sorted(duckdb.sql(infill.ORACLE).fetchall())
    assert len(want) == 200 and sorted(map(tuple, infill.op12_infill(spark, SF).collect())) == want


def scanned(texts, made):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return data, offsets, infill.scan(data, offsets, made)


@pytest.mark.parametrize("unit, pattern", [("codepoint", r"(?s)."), ("word", r"^\s+|\S+\s*"), ("line", r"[^\n]*\n|[^\n]+")])
def test_units_start_where_a_plain_reading_has_them(unit, pattern):
    texts = [t or "" for t in odd_texts()]
    if unit == "word":  # its spaces are the six of ASCII
        texts = [t for t in texts if re.sub(r"\s", "", t).isprintable()]
    made = infill.automaton(unit)
    data, offsets, seen = scanned([t.encode() for t in texts], made)
    for k, t in enumerate(texts):
        starts = [len(t[: m.start()].encode()) for m in re.finditer(pattern, t)]
        assert seen.units[k] == len(starts) and (seen.found[k] > 0) == bool(MARK.search(t))
        asked = np.arange(len(starts) + 1)[:: max(1, len(starts) // 50)]
        got = infill.locate(data, offsets, made, seen, np.full(len(asked), k), asked)
        assert got.tolist() == [[*starts, len(t.encode())][u] for u in asked]


def test_all_sentinels_are_counted_across_lanes():
    made = infill.automaton(sentinels=("<fim_prefix>", "<fim_suffix>", "<fim_middle>"))
    text = "x<fim_prefix><fim_fim_suffix>" + "é" * 300 + "<fim_suffix><<fim_middle>" * 100
    assert scanned([text.encode()], made)[2].found.tolist() == [len(re.findall("<fim_(?:prefix|suffix|middle)>", text))]


def test_bytes_that_are_no_utf8_are_units():
    _, _, seen = scanned([b"a\xff\x80b", b"\xe6\xbc", b"\xc3(", b"\xf0\x9f\x98\x80"], infill.automaton())
    assert seen.units.tolist() == [4, 1, 2, 1]


def test_other_units_and_sentinels_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    marks = ("<fim_prefix>", "<fim_suffix>", "<fim_middle>")
    for unit in ("word", "line"):
        back = infill.restore(infill.transform(frame(spark, rows), seed=7, percent=100, spm_percent=50, unit=unit, sentinels=marks), marks)
        assert sorted((r["doc_id"], r["restored"]) for r in back.collect()) == [(i, t or "") for i, t in rows]
    with pytest.raises(ValueError):
        infill.transform(frame(spark, rows), sentinels=("aba", "x", "y"))
