"""Hard negatives against brute force over Python's integers, with odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import negatives

SF = "/root/testdata/sf0.001"


def brute(rows, k=5, n=10, lower=30, upper=90):
    part = []
    for at, (i, label, vector) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            part.append((at, i, label, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in vector]))
    key, out = (lambda x: (-x[0], x[1] is None, x[1] or 0)), []
    for at, i, label, vector in part:
        if i is None or i % 100:
            continue
        scored = [(max(-(1 << 56), min(1 << 56, sum(a * b for a, b in zip(vector, v)))), j, kind) for b, j, kind, v in part if b != at]
        for score, j, _ in sorted((x for x in scored if x[2] == label), key=key)[:k]:
            hard = sorted((x for x in scored if x[2] != label and lower * score <= 100 * x[0] <= upper * score), key=key)[:n]
            out += [(i, j, rank, h, score, s) for rank, (s, h, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(2)
    vector = lambda d=6: [rng.choice([-1, 1]) * rng.random() * 2 for _ in range(d)]
    common = vector()
    rows = [(i, rng.randint(0, 3), common if i % 3 == 0 else vector()) for i in range(230)]
    rows += [(100, 1, common), (100, 1, common), (7, 2, vector()), (None, 1, common), (None, 2, vector()), (300, None, common), (400, 1, None), (401, 1, [0.5, None, 1.0]), (402, 1, [0.5, math.nan, 1.0]), (403, 1, [0.5, math.inf, 1.0])]
    rows += [(500, 9, vector()), (600, 1, []), (601, 1, vector(3)), (700, 1, [1e30, -1e30] + [0.0] * 4), (701, 2, [3e9] * 6), (-100, 2, vector())]
    return rows


def frame(spark, rows):
    extra = ["row", "id", "side", "pair", "score", "anchor", "place", "rank", "wanted"]
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "vec_id long, label int, embedding array<double>, " + ", ".join(f"{c} string" for c in extra))


@pytest.mark.parametrize("block, group", [(1 << 16, 1 << 10), (20, 2)])
def test_odd_rows_against_brute_force(spark, block, group):
    rows = odd_rows()
    got = negatives.mine(frame(spark, rows), F.col("id") % 100 == 0, block=block, group=group)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert negatives.mine(frame(spark, []), F.col("id") % 100 == 0).count() == 0


def test_query_equals_sql(spark):
    duckdb.sql(f"create or replace view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(duckdb.sql(negatives.ORACLE).fetchall())
    assert want and sorted(map(tuple, negatives.op13_negatives(spark, SF).collect())) == want


def test_scores_are_exact_beyond_doubles():
    a, b = np.array([[(1 << 26) + 1, 3]]), np.array([[(1 << 27) + 1, 1], [1 << 62, 1 << 62]])
    assert negatives.scores(a, b).tolist() == [[((1 << 26) + 1) * ((1 << 27) + 1) + 3, negatives.MOST]]


def test_no_side_is_broadcast(spark):
    plan = negatives.op13_negatives(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "RepartitionByExpression" in plan
