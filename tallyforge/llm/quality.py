"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` words). Every passage is encoded: form features of its characters
and words, then a learned layer. Gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages, and a
logistic unit scores the weighted representation. All weights are learned from document labels by Adam on the logistic
loss, in numpy, from a bounded sample: the ``sample`` labelled documents that come first by a hash of their id.
Scoring covers every passage of every document, with nothing but the text as input.

Scale: labels are cut to the sample by a top-k before they meet the documents, and that bounded side is broadcast;
scoring is one pass without a shuffle. The driver holds the sample's features, about 100 bytes a passage.

Defined results: null and empty texts are one empty passage and get a score; repeated labels of an id count once (the
least); with no label, or labels of one class only, every score is the smoothed share of label 1; other columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ddl, pieces, ship, table, texts

PASSAGE = 64
SAMPLE = 4000
_UPPER, _LOWER, _DIGITS, _SPACES = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
_MARKS, _STOPS, _WIDE = b"#$%&*|<>{}[]=_~^@\\/", b".,;:?'\"()-", bytes(range(128, 256))
_CLASSES = (_UPPER, _LOWER, _DIGITS, _SPACES, _MARKS, _STOPS, b"!", b"|", _WIDE)
SIZE = len(_CLASSES) + 9


def passage_features(words: list[str]) -> list[float]:
    n = len(words)
    if not n:
        return [0.0] * SIZE
    raw = " ".join(words).encode("utf-8", "surrogatepass")
    total = len(raw)
    shares = [(total - len(raw.translate(None, c))) / total for c in _CLASSES]
    distinct, low = len(set(words)), {w.lower().strip(".,!?") for w in words}
    repeats = sum(map(str.__eq__, words, words[1:]))
    lengths = list(map(len, words))
    mean = sum(lengths) / n
    ends = sum(w[-1] in ".,;:?" for w in words)
    bare = sum(map(str.isalpha, words))
    capital = sum(map(str.isupper, words))
    pressed = len(raw) / (len(zlib.compress(raw, 1)) + 8.0)
    return [*shares, distinct / n, len(low) / n, repeats / n, mean / 10, max(lengths) / 40 if max(lengths) < 40 else 1.0, ends / n, bare / n, capital / n, pressed / 10]


def bag(text: str) -> np.ndarray:
    """(passages, SIZE) features of a whole text."""
    words = text.split()
    return np.array([passage_features(words[i : i + PASSAGE]) for i in range(0, max(1, len(words)), PASSAGE)], np.float32)


@dataclass
class Attention:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # encoder, its bias, V, U, w, output, its bias
    share: float | None = None  # the score of all, where there was nothing to learn

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags, one after another; starts: where each bag begins."""
        e, b, v, u, w, o, c = self.weights
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ e + b, 0)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -30, 30)))
        a = (t * s) @ w
        a = np.exp(a - np.maximum.reduceat(a, starts)[of])
        a /= np.add.reduceat(a, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "of": of, "p": 1 / (1 + np.exp(-np.clip(z @ o + c[0], -30, 30)))}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags or self.share is not None:
            return np.full(len(bags), self.share if self.share is not None else 0.5)
        sizes = np.array([len(b) for b in bags])
        return self.forward(np.concatenate(bags), np.concatenate([[0], np.cumsum(sizes)[:-1]]))["p"]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        e, b, v, u, w, o, c = self.weights
        f = self.forward(x, starts)
        d = (f["p"] - y) / len(y)
        dz = d[:, None] * o
        da = (dz[f["of"]] * f["h"]).sum(1)
        da = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["of"]])  # through the softmax
        g = da[:, None] * w
        dt, ds = g * f["s"] * (1 - f["t"] ** 2), g * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz[f["of"]] + dt @ v.T + ds @ u.T) * (f["h"] > 0)
        return [f["x"].T @ dh, dh.sum(0), f["h"].T @ dt, f["h"].T @ ds, ((f["t"] * f["s"]) * da[:, None]).sum(0), f["z"].T @ d, np.array([d.sum()])]


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 30, batch: int = 64, rate: float = 5e-3, decay: float = 1e-4, seed: int = 0) -> Attention:
    if not len(y) or y.min() == y.max():
        return Attention(np.zeros(SIZE), np.ones(SIZE), [], float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shape = [(SIZE, hidden), (hidden,), (hidden, gates), (hidden, gates), (gates,), (hidden,), (1,)]
    net = Attention(every.mean(0), every.std(0) + 1e-3, [rng.normal(0, (2 / s[0]) ** 0.5, s) * (len(s) > 1 or s[0] != hidden) for s in shape])
    net.weights[5] = rng.normal(0, 0.2, hidden)
    net.weights[6] = np.array([np.log(y.mean() / (1 - y.mean()))])
    first, second, t = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows, t = order[i : i + batch], t + 1
            own = [bags[k] for k in rows]
            starts = np.concatenate([[0], np.cumsum([len(b) for b in own])[:-1]])
            for k, g in enumerate(net.gradients(np.concatenate(own), starts, y[rows])):
                g = g + decay * net.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return net


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention:
    """The net of at most ``sample`` labelled documents outside the held-out fifth."""
    ship(docs.sparkSession)
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = texts(docs).join(F.broadcast(own), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([bag(t).tobytes() for t in batch.column(2).to_pylist()])], names=["doc_id", "quality", "bag"])

    got = sorted({r["doc_id"]: r for r in some.mapInArrow(run, "doc_id long, quality int, bag binary").collect()}.items())
    return train([np.frombuffer(r["bag"], np.float32).reshape(-1, SIZE) for _, r in got], np.array([float(r["quality"]) for _, r in got]))


def score(docs: DataFrame, net: Attention, column: str = "score") -> DataFrame:
    """``docs`` with the score in ``column``, in place of any of that name; all others stay."""
    ship(docs.sparkSession)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = net.score([bag(t or "") for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(texts(docs), net)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
