"""The learned classifier: its descent against numpy's, its score against its weights, and held-out texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import categorize, etl, learned


def texts_of(n, seed=1):
    rng, kinds = random.Random(seed), {"belanja": "toko baju sepatu tas".split(), "hiburan": "film konser tiket musik".split(), "tagihan": "air gas sewa pajak".split()}
    common = "di ke yang dan untuk hari ini besok".split()
    out = []
    for _ in range(n):
        label = rng.choice(list(kinds))
        out.append((" ".join(rng.choice(kinds[label] if rng.random() < 0.4 else common) for _ in range(rng.randint(4, 12))), label))
    return out


def test_descent_against_numpy(spark):
    rows = texts_of(40) + [(None, "belanja"), ("", "hiburan"), ("toko", None), ("toko", "no such")]
    frame, classes, n = spark.createDataFrame(rows, "text string, label string"), ["belanja", "hiburan", "tagihan"], 64
    model = learned.fit(frame, "text", "label", classes, buckets=n, rounds=4)
    own = [(r["b"], classes.index(r["label"])) for r in frame.where(F.col("label").isin(*classes)).select(learned.buckets_of(F.col("text"), n).alias("b"), "label").collect()]
    x, y = np.zeros((len(own), n + 1)), np.eye(3)[[k for _, k in own]]
    for i, (b, _) in enumerate(own):
        x[i, b] = 1 / np.sqrt(len(b))
    w, squares, losses = np.zeros((3, n + 1)), np.full((3, n + 1), 1e-12), []
    for _ in range(4):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log((p * y).sum(1)).mean())
        g = (p - y).T @ x / len(own) + learned.PULL * w
        squares += g * g
        w -= learned.RATE * g / np.sqrt(squares)
    assert len(own) == 42 and np.allclose(model.weights, w, atol=1e-6) and model.losses == pytest.approx(losses)


def test_held_out_texts_and_the_place_behind_keywords(spark):
    frame = spark.createDataFrame(texts_of(300), "text string, label string")
    model = learned.fit(frame, "text", "label", ["belanja", "hiburan", "tagihan"])
    held = spark.createDataFrame([*texts_of(100, 2), (None, "belanja"), ("", "belanja")], "text string, label string").withColumn("p", learned.predicted(model, F.col("text")))
    assert etl.scores(held.where("text <> ''").select("label", F.col("p.label").alias("said")), "label", "said").first()["accuracy"] > 0.9
    assert all(r["p"]["label"] and 1 / 3 - 1e-9 <= r["p"]["confidence"] <= 1 for r in held.collect())
    got = held.select(categorize.classify(F.lit("zzyzx"), F.col("p"))["source"].alias("s"), F.col("p.confidence").alias("c")).collect()
    assert {(r["s"], r["c"] >= 0.55) for r in got} <= {("ml_classifier", True), ("ml_low_confidence", False)}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nothing_to_learn_from(spark):
    model = learned.fit(spark.createDataFrame([], "text string, label string"), "text", "label", ["a", "b"])
    assert spark.createDataFrame([("x",)], "text string").select(learned.predicted(model, F.col("text"))["confidence"]).first()[0] == 0.5
