"""WARC archives: one gzip member per record, written, then read back sequentially.

``write`` turns (id, url, payload, type, refers_to) rows into archive segments: runs of whole gzip members of about
``segment_bytes`` each, in a binary column, so that they are stored through Spark's own committer on whatever store
the cluster shares and a lost executor leaves no half archive. ``read`` streams every segment: a small window of
bytes goes through an incremental zlib decompressor, a member's end starts the next record, the header block is parsed
line by line, Content-Length frames the block, and the payload's SHA-1 is checked against WARC-Payload-Digest.
``records`` does the same for any binary stream, such as a ``.warc.gz`` file.

``classify`` finds, among rows with equal payloads (SHA-1 and length) of at least ``min_bytes``, that with the smallest
id; it is the response and the others revisit it. Groups are found by map-side combined aggregation on digests and only
groups of two rows or more are joined back, so a payload that a third of all pages share costs one row per task, and the
join's large side can be split by adaptive execution.

Defined results: null payload is empty; a null id sorts after every other; rows that repeat the smallest id with the same
payload are all responses; null url is written as an empty target; an empty table gives empty archives; other columns go.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch_of, ddl, ship, table

SEGMENTS = pa.schema([("records", pa.int64()), ("segment", pa.binary())])
RECORDS = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RUN_IN = "urn:page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(rid: int | None, url: str, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP header and the payload's digest, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RUN_IN}{'' if rid is None else rid}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RUN_IN}{'' if refers_to is None else refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class _Members:
    """Bytes of consecutive gzip members, decompressed as they are asked for; never more than a window is ahead."""

    def __init__(self, read: Callable[[int], bytes], window: int = 1 << 16):
        self.read, self.window, self.raw, self.out, self.z = read, window, b"", bytearray(), None

    def start(self) -> bool:
        """At the next member, or False at the end of the stream."""
        if not self.raw:
            self.raw = self.read(self.window)
        self.z, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw and not (raw := self.read(self.window)):
            raise ValueError("the archive ends within a gzip member")
        elif not self.raw:
            self.raw = raw
        self.out += self.z.decompress(self.raw, 1 << 20)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        at = self.out.find(mark)
        while at < 0:
            if not self.more():
                raise ValueError("a header block has no end")
            at = self.out.find(mark)
        got = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return got

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError("a block is shorter than its Content-Length")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def finish(self) -> None:
        while self.more():
            pass
        if bytes(self.out) != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two line ends")


def records(read: Callable[[int], bytes], verify: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record that ``read(n)`` yields; bad framing or digests raise ValueError."""
    members = _Members(read)
    while members.start():
        lines = members.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = members.exactly(int(head["content-length"]))
        members.finish()
        if verify and (want := head.get("warc-block-digest")) and want != f"sha1:{digest_of(block)}":
            raise ValueError(f"block digest of {head.get('warc-record-id')} differs")
        yield head, block


def page_of(head: dict[str, str], block: bytes) -> dict:
    """A record of this module as a row; a response's payload is checked against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (length != len(payload) or digest_of(payload) != digest):
        raise ValueError(f"payload of {head.get('warc-record-id')} differs from its length or digest")
    number = lambda x: int(y) if (y := x.removeprefix(f"<{RUN_IN}").removesuffix(">")) else None
    return {
        "id": number(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": length, "payload_digest": digest, "record_type": head["warc-type"],
        "refers_to": number(head["warc-refers-to"]) if head["warc-type"] == "revisit" else None, "payload": payload if head["warc-type"] == "response" else None,
    }


def reader_of(data: bytes) -> Callable[[int], bytes]:
    at = 0

    def read(n: int) -> bytes:
        nonlocal at
        at += n
        return data[at - n : at]

    return read


def classify(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``rows`` (id, url, payload) with record_type and refers_to."""
    keyed = rows.select("id", "url", "payload", F.sha1("payload").alias("sha"), F.length("payload").alias("n"))
    firsts = keyed.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    firsts = firsts.where("rows > 1").select("sha", "n", F.struct("first").alias("found"))
    joined = keyed.join(firsts, ["sha", "n"], "left")
    revisit = F.col("found").isNotNull() & ~F.col("id").eqNullSafe(F.col("found.first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return joined.select("id", "url", "payload", kind.alias("record_type"), F.when(revisit, F.col("found.first")).alias("refers_to"))


def write(rows: DataFrame, segment_bytes: int = 1 << 20) -> DataFrame:
    """(records, segment): archive segments of whole gzip members."""
    ship(rows.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "url", "payload", "record_type", "refers_to")), strict=True):
                rid, url, payload, kind, to = (x.as_py() for x in row)
                held.append(record(rid, url or "", payload or b"", kind, to))
                size += len(held[-1])
                if size >= segment_bytes:
                    yield batch_of(SEGMENTS, records=[len(held)], segment=[b"".join(held)])
                    held, size = [], 0
        if held:
            yield batch_of(SEGMENTS, records=[len(held)], segment=[b"".join(held)])

    return rows.mapInArrow(segments, ddl(SEGMENTS))


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of (segment) rows, verified, in ``RECORDS``' columns."""
    ship(archives.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.column(batch.schema.get_field_index("segment")):
                found, held = [], 0
                for head, block in records(reader_of(segment.as_py())):
                    found.append(page_of(head, block))
                    if not payloads:
                        found[-1]["payload"] = None
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(found, schema=RECORDS)
                        found, held = [], 0
                yield pa.RecordBatch.from_pylist(found, schema=RECORDS)

    return archives.select("segment").mapInArrow(rows, ddl(RECORDS))


def store(archives: DataFrame) -> DataFrame:
    """``archives`` written to the shared folder and read back from there."""
    from ._common import cut

    return cut(archives)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload"))
    back = read(store(write(classify(rows, min_bytes=0))), payloads=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _oracle() -> str:
    """Base32 of a SHA-1: 160 bits are 32 groups of 5, from 40 hex digits taken 5 (4 groups) at a time."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = f"list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(0, 4), lambda j: substr('{alphabet}', CAST((CAST('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS BIGINT) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b)"
    return f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {group} AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM w"""


ORACLE = _oracle()
