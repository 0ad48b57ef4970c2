"""A classifier of texts for the place behind the keywords: hashed word n-grams and logistic regression.

``fit`` turns each text into the buckets of its words and pairs of words, writes them once, a bit for each bucket, and then
goes down the gradient of the multinomial logistic loss: each round multiplies these bits by the weights within its tasks, and
one aggregation adds up what they give for each bucket, whatever the number of texts. ``predicted`` scores a text with
built-in expressions only: the weights are a literal of classes x buckets.

Texts that are null or empty have no bucket and weigh the bias alone; rows with a null or unknown label don't train; without
any row every class is as likely.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import let
from ..session import checkpointed, ship, spread

#: Buckets of the hash, rounds and step of the descent, and the pull toward no weight.
BUCKETS, ROUNDS, RATE, PULL = 1024, 20, 0.4, 1e-4
#: Texts that a task multiplies at once.
CHUNK = 1000


@dataclass
class Model:
    """``weights[class, bucket]``; the last bucket is the bias."""

    classes: list[str]
    weights: np.ndarray
    buckets: int = BUCKETS
    losses: list[float] = field(default_factory=list)


def buckets_of(text: Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of a text's words and pairs of neighbours, and the bias's."""

    def hashed(words: Column) -> Column:
        pairs = F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
        return F.array_distinct(F.transform(F.concat(words, pairs), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\d]+)"), 1)
    return F.concat(let(words, hashed), F.array(F.lit(buckets)))


def _chances(model: Model, buckets: Column) -> Column:
    """Probabilities of the classes. A text's weights are averaged over the root of its buckets, so that long ones don't drown the bias."""
    # One text for each class: as many literals as weights would keep the driver busy for longer than the texts do.
    rows = F.array(*[F.split(F.lit(",".join(f"{w:.9g}" for w in row)), ",").cast("array<double>") for row in model.weights.tolist()])
    scores = F.transform(rows, lambda w: F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(w, b)) / F.sqrt(F.size(buckets).cast("double")))

    def softmax(z: Column) -> Column:
        raised = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
        return let(F.aggregate(raised, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.transform(raised, lambda v: v / total))

    return let(scores, softmax)


def _packed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_y, _b) to (_y, _x), the buckets as bits."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                lists = part.column("_b")
                bits = np.zeros((len(lists), buckets + 1), bool)
                bits[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
                yield pa.RecordBatch.from_arrays([part.column("_y"), pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())], ["_y", "_x"])

    return packed


def _slopes(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_y, _x) to a row for each bucket of a task: its part of each class's gradient, and of the loss beside the bias."""
    classes, width = weights.shape

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, loss = np.zeros_like(weights), 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                y, n = part.column("_y").to_numpy(), part.num_rows
                x = np.unpackbits(np.frombuffer(b"".join(part.column("_x").to_pylist()), np.uint8).reshape(n, -1), axis=1, count=width).astype(float)
                x /= np.sqrt(x.sum(1, keepdims=True))
                z = x @ weights.T
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                loss -= np.log(p[np.arange(n), y]).sum()
                p[np.arange(n), y] -= 1.0
                gradient += p.T @ x
        met = np.flatnonzero(gradient.any(0) | (np.arange(width) == width - 1))
        losses = np.where(met == width - 1, loss, 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *[pa.array(row[met]) for row in gradient], pa.array(losses)], ["_i", *[f"_{k}" for k in range(classes)], "_l"])

    return slopes


def fit(rows: DataFrame, text: str, label: str, classes: list[str], buckets: int = BUCKETS, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """A model of ``label`` by ``text``, learned from all rows of known label."""
    own = spread(rows.select(F.col(text).alias("_t"), F.col(label).alias("_l"))).where(F.col("_l").isin(*classes))
    return fitted(own.select("_l", buckets_of(F.col("_t"), buckets).alias("_b")), "_b", "_l", classes, buckets, rounds, rate)


def fitted(rows: DataFrame, places: str, label: str, classes: list[str], buckets: int = BUCKETS, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """``fit`` of rows whose texts' ``buckets_of`` are known, in ``places``."""
    ship(rows.sparkSession)
    model = Model(classes, np.zeros((len(classes), buckets + 1)), buckets)
    known = rows.where(F.col(label).isin(*classes)).select((F.array_position(F.lit(classes), F.col(label)) - 1).cast("int").alias("_y"), F.col(places).alias("_b"))
    known = checkpointed(known.mapInArrow(_packed(buckets), "_y int, _x binary"))
    n = known.count()
    squares = np.full_like(model.weights, 1e-12)
    parts = "_i int, " + ", ".join(f"_{k} double" for k in range(len(classes))) + ", _l double"
    for _ in range(rounds if n else 0):
        sums = known.mapInArrow(_slopes(model.weights), parts)
        gradient = np.zeros_like(model.weights)
        for row in sums.groupBy("_i").agg(*[F.sum(f"_{k}") for k in range(len(classes))], F.sum("_l").alias("_l")).collect():  # one for each bucket
            gradient[:, row["_i"]] = row[1 : len(classes) + 1]
            if row["_i"] == buckets:
                model.losses.append(row["_l"] / n)
        gradient = gradient / n + PULL * model.weights
        squares += gradient * gradient
        model.weights -= rate * gradient / np.sqrt(squares)
    return model


def predicted(model: Model, text: Column) -> Column:
    """(label, confidence): the likeliest class and its probability."""
    return let(buckets_of(text, model.buckets), lambda buckets: likeliest(model, buckets))


def likeliest(model: Model, buckets: Column) -> Column:
    """``predicted`` of a text whose ``buckets_of`` are known."""
    best = lambda p: F.struct(F.get(F.lit(model.classes), (F.array_position(p, F.array_max(p)) - 1).cast("int")).alias("label"), F.array_max(p).alias("confidence"))
    return let(_chances(model, buckets), best)
