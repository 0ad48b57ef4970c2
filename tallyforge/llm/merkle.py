"""Merkle fingerprints of documents over paragraphs and sections.

A paragraph is a line with its line end; a section is a run of paragraphs that ends where a paragraph's digest says so
(one in eight), so that an edit moves no later section's bounds. Paragraph node = BLAKE2b-256 of its bytes, section node =
BLAKE2b-256 of its paragraph nodes, root = SHA-256 of the section nodes and nothing else: equal roots mean equal texts, as
far as 256 bits tell. Under each paragraph lie short leaves of a few words, cut likewise by content, as 24-bit hashes that
only serve likeness.

A fingerprint is ``root|section;section;...``, a section is ``paragraph,paragraph,...`` and a paragraph
``digest:leaves``, its digest the first 64 bits of its node. ``differences`` descends from unequal sections to the unequal paragraphs and gives their places;
``likeness`` is the share of common leaves (Dice over multisets, 1 for equal roots, 0 where nothing is common).

``with_next`` pairs each document with the next by ascending id. Ranges of ids are set by percentiles of the ids
alone; texts are dealt once by range, and the first document of each range is dealt to the range before it as well, so a
worker streams its sorted range with one text in hand. What the driver holds is one id for each range.

Defined results: null text is empty, with the root of no section; rows that repeat an id are ordered by text; a single
document is its own next; a null id sorts first; an empty table gives no row; other columns go.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch_of, ddl, partitions, pieces, ship, table, texts

RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: A leaf ends after a word whose CRC-32 is 0 modulo this; a section after a paragraph whose digest is.
LEAF_WORDS, SECTION_PARAGRAPHS = 4, 8


Node = tuple[bytes, str]


def paragraph_node(text: str) -> Node:
    """The node of a paragraph, and what the fingerprint shows of it: ``digest:leaves``."""
    raw = text.encode("utf-8", "surrogatepass")
    leaves, h, open_ = [], 0, False
    crc = zlib.crc32
    for word in raw.split():
        h, open_ = crc(word, h), True
        if not crc(word) % LEAF_WORDS:
            leaves.append(b"%06x" % (h & 0xFFFFFF))
            h, open_ = 0, False
    if open_:
        leaves.append(b"%06x" % (h & 0xFFFFFF))
    node = hashlib.blake2b(raw, digest_size=32).digest()
    return node, f"{node[:8].hex()}:{b''.join(leaves).decode()}"


def fingerprint(text: str, known: dict[str, Node] | None = None, used: dict[str, Node] | None = None) -> str:
    """``known`` holds nodes of paragraphs already computed; ``used`` receives those of this text."""
    sections: list[list[Node]] = []
    open_ = False
    for paragraph in text.split("\n"):
        node = known.get(paragraph) if known is not None else None
        if node is None:
            node = paragraph_node(paragraph)
        if used is not None:
            used[paragraph] = node
        if not open_:
            sections.append([])
        sections[-1].append(node)
        open_ = node[0][0] % SECTION_PARAGRAPHS != 0
    root = hashlib.sha256(b"".join(section_node([p for p, _ in s]) for s in sections)).hexdigest()
    return f"{root}|" + ";".join(",".join(shown for _, shown in s) for s in sections)


def section_node(paragraphs: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(paragraphs), digest_size=32).digest()


def leaves_of(print_: str) -> np.ndarray:
    _, _, body = print_.partition("|")
    joined = "".join(p.partition(":")[2] for s in body.split(";") for p in s.split(","))
    if not joined:
        return np.zeros(0, np.int32)
    digits = np.frombuffer(joined.encode(), np.uint8).astype(np.int32)
    digits = np.where(digits > 57, digits - 87, digits - 48).reshape(-1, 6)
    return np.sort(digits @ np.array([1 << 20, 1 << 16, 1 << 12, 1 << 8, 16, 1], np.int32))


def likeness(a: str, b: str, a_leaves: np.ndarray | None = None, b_leaves: np.ndarray | None = None) -> float:
    if a[:64] == b[:64]:
        return 1.0
    x = leaves_of(a) if a_leaves is None else a_leaves
    y = leaves_of(b) if b_leaves is None else b_leaves
    if not len(x) or not len(y):
        return 0.0
    number = lambda z: z.astype(np.int64) << 32 | (np.arange(len(z)) - np.searchsorted(z, z))  # noqa: E731  the k-th of equal leaves
    return 2.0 * len(np.intersect1d(number(x), number(y), assume_unique=True)) / (len(x) + len(y))


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places in ``b`` of nodes that ``a`` lacks; only unequal sections are descended."""
    if a[:64] == b[:64]:
        return []
    mine, theirs = ([s.split(",") for s in p.partition("|")[2].split(";")] for p in (a, b))
    same = {tuple(s) for s in mine}
    have = {p.partition(":")[0] for s in mine for p in s}
    return [(k, j) for k, s in enumerate(theirs) if tuple(s) not in same for j, p in enumerate(s) if p.partition(":")[0] not in have]


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of ``docs``."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch_of(schema, doc_id=batch.column(0), fingerprint=[fingerprint(t) for t in batch.column(1).to_pylist()])

    return texts(docs).mapInArrow(run, ddl(schema))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, peek, doc_id, text), sorted by them within partitions; a part is a range of ids, its last row (peek) the first of the next part."""
    ship(docs.sparkSession)
    lowest = -(1 << 63)
    ids = docs.select(F.coalesce("doc_id", F.lit(lowest)).alias("doc_id"))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    edges = np.array(sorted(set(bounds or [])), np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, first = np.searchsorted(edges, x := batch.column(0).to_numpy(zero_copy_only=False), "right"), {}
            for p in np.unique(part):
                first[int(p)] = int(x[part == p].min())
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int32()), pa.array(list(first.values()), pa.int64())], names=["part", "first"])

    least = sorted(tuple(r) for r in ids.mapInArrow(number, "part int, first long").groupBy("part").agg(F.min("first")).collect())
    parts, firsts = (np.array([r[k] for r in least], np.int64) for k in (0, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "peek", "doc_id", "text"]
        for batch in batches:
            x = batch.column(0).fill_null(lowest).to_numpy(zero_copy_only=False)
            part = np.searchsorted(edges, x, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(x), np.int32)), *batch.columns], names=names)
            # The first id of each part goes to the part before it too; that of the first to the last.
            at = np.searchsorted(firsts, x).clip(max=len(firsts) - 1)
            if len(again := np.flatnonzero(firsts[at] == x)):
                rows = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([pa.array(parts[at[again] - 1].astype(np.int32)), pa.array(np.ones(len(again), np.int32)), *rows.columns], names=names)

    return docs.mapInArrow(deal, "part int, peek int, doc_id long, text string").repartition(ranges, "part").sortWithinPartitions("part", "peek", "doc_id", "text")


def edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """RESULT's columns for each row of ``docs``, its edit made of it and the next document."""
    ship(docs.sparkSession)
    ordered = with_next(texts(docs), ranges or partitions(docs, 2 * docs.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, fingerprint, leaves, paragraphs) of the row that waits for its next
        peeked = None  # of rows that share the first id of the next part, only the first counts
        for batch in pieces(batches, "text", 1 << 20):
            out: dict[str, list] = {f.name: [] for f in RESULT}
            for part, peek, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if peek and peeked == part:
                    continue
                nodes: dict[str, Node] = {}
                print_ = fingerprint(text, None, nodes)
                now = (part, doc, text, print_, leaves_of(print_), nodes)
                if held and held[0] == part:
                    _, i, t, fp, leaves, known = held
                    changed = edited_text(t, text)
                    edited = fingerprint(changed, known | nodes)
                    row = {
                        "doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": fp,
                        "edited_fingerprint": edited, "near_edited": likeness(fp, edited, leaves), "near_next": likeness(fp, print_, leaves, now[4]),
                    }
                    for k, v in row.items():
                        out[k].append(v)
                held, peeked = (None, part) if peek else (now, None)
            yield batch_of(RESULT, **out)

    return ordered.mapInArrow(run, ddl(RESULT))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
