"""Media columns: payloads stored as progressive JPEG files, read back, and turned into RGB tensors and features.

``stored`` gives each text's file; ``read_back`` decodes files of this kind (payload, tensor and features), and
``tensors`` any progressive or baseline file of a binary column. All are single passes without a shuffle; a worker holds
one file's coefficients at a time. The query writes the files as a table to the shared folder and reads them from there.

A feature is the tensor's size, mean and deviation of R, G and B, and a 64-bit average hash of an 8 x 8 luma thumbnail.

Defined results: null text is empty, a payload of 64 zero bytes; equal texts give equal files; repeated rows each give
their own; an empty table gives none; other columns stay where named in ``keep``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from ._common import batch_of, ddl, pieces, ship, table, texts, written

STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
TENSORS = pa.schema([("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])


def feature(tensor: np.ndarray) -> str:
    h, w, _ = tensor.shape
    n = h * w
    flat = tensor.reshape(n, 3)
    sums = flat.sum(0, dtype=np.int64)
    squares = np.einsum("ij,ij->j", flat.astype(np.float32), flat.astype(np.float32), dtype=np.float64)
    means = sums / n
    deviation = np.sqrt(np.maximum(squares / n - means**2, 0))
    luma = tensor.sum(2, dtype=np.int32).reshape(8, h // 8, 8, w // 8).sum((1, 3), dtype=np.int64) if not h % 8 and not w % 8 else tensor[:: max(1, h // 8), :: max(1, w // 8)][:8, :8].sum(2, dtype=np.int64)
    hashed = np.packbits((luma.ravel() > luma.mean())[:64]).tobytes().hex()
    return f"{h}x{w};" + ",".join(f"{m:.2f}" for m in means) + ";" + ",".join(f"{d:.2f}" for d in deviation) + f";{hashed}"


def stored(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=1 << 20):
            raw = [t.encode("utf-8") for t in batch.column(1).to_pylist()]
            yield batch_of(STORED, doc_id=batch.column(0), n_bytes=list(map(len, raw)), media=[jpeg.store(jpeg.padded(x)) for x in raw])

    return texts(docs).mapInArrow(run, ddl(STORED))


def read_back(media: DataFrame) -> DataFrame:
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in READ}
            for doc, n, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = file.as_py()
                image = jpeg.coefficients(data)
                payload = jpeg.restore(image)
                row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(jpeg.rgb(image)))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield batch_of(READ, **out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl(READ))


def tensors(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """id, height, width and the full-resolution RGB bytes of each file."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = None if file.as_py() is None else jpeg.decode(file.as_py())
                yield batch_of(TENSORS, id=[i], height=[None if x is None else x.shape[0]], width=[None if x is None else x.shape[1]], rgb=[None if x is None else x.tobytes()])

    return media.select(id_column, column).mapInArrow(run, ddl(TENSORS))


def op3_media(spark, sf_dir: str) -> DataFrame:
    return read_back(written(stored(table(spark, sf_dir, "documents")), "media"))
