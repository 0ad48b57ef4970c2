"""Rows that stand for the odd cases, through every operator and through the pipeline's stages as chained."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import licences, media, merkle, minhash, mixing, packing, pii, quality, suffixes

NAMES = ("_score", "_copy", "_copies", "_id", "mixed_id", "copies", "copy", "score", "uid", "part", "peek", "h", "id", "n", "c", "size", "skey", "rank", "digest", "component", "length", "offset", "a", "b", "bits", "bands", "passages")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [(1, base), (2, base), (3, base.replace("a", "a", 1) + " more"), (4, None), (5, ""), (6, " \n "), (None, prose(rng, 50)), (None, base), (7, prose(rng, 30_000)), (8, "x" * 300_000), (9, "call +49 30 1234567 now"), (9, "call +49 30 1234567 now"), (10, prose(rng, 40)), (10, prose(rng, 60)), (-1, "é漢字😀"), (1 << 60, "one")]
    return texts


@pytest.fixture(scope="module")
def docs(spark, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", [None, "", "web"][k % 3], None if t is None else len(t), *[f"{c}{k}" for c in NAMES]) for k, (i, t) in enumerate(rows)], kind)


def test_every_row_has_its_result(docs, rows):
    ids = Counter(i for i, _ in rows)
    results = {
        "suffixes": suffixes.deduplicate(docs), "media": media.read_back(media.stored(docs)), "quality": quality.score(docs, quality.train([], np.zeros(0))), "minhash": minhash.link(docs)[0], "licences": licences.scan(docs),
        "pii": pii.detect(docs), "merkle": merkle.edits(docs, 3), "mixing": mixing.mix(docs), "packing": packing.pack(packing.pieces_of(docs, packing.default_tokenizer())).where("piece = 0"),
    }
    for name, out in results.items():
        assert Counter(r["doc_id"] for r in out.collect()) == ids, name


def test_near_duplicates_of_odd_rows(docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.link(docs, width=4)[0].collect()), key=repr)
    by = {i: (n, c, k) for i, n, c, k in got}
    assert by[1][1:] == (1, True) and by[2][1:] == by[3][1:] == (1, False) and by[4] == (0, 4, True) and by[6] == (0, 6, True)
    assert {(c, k) for i, _, c, k in got if i is None} == {(None, True), (1, False)}  # the second has the text of 1


def test_stages_as_chained(spark, docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1), (2, 1), (5, 0), (4, 0), (3, 1), (10, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    now, counts = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/{k}")
        out = spark.read.parquet(f"{sf}/{k}")
        counts.append(out.count())
        if k < 4:
            assert out.columns == docs.columns, name
            # What a row has beside its text goes with it.
            kept = {tuple(r[c] for c in NAMES) for r in out.collect()}
            assert kept <= {tuple(r[c] for c in NAMES) for r in now.collect()}, name
        if name == "near-duplicates":
            assert now.where("doc_id is null").count() == out.where("doc_id is null").count()
            assert out.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "personal data":
            assert not [r for r in out.collect() if "1234567" in (r["text"] or "")]
        now = out
    assert all(counts) and {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(now.columns)


def test_stages_on_an_empty_table(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0, name
        assert k == 4 or now.columns == docs.columns


def test_scores_against_a_plain_net(spark):
    """The forward pass written again, passage by passage, without arrays of bags."""
    rng = random.Random(5)
    bags = [quality.bag(prose(rng, n)) for n in (5, 100, 400)] + [quality.bag("WIN!! " * 90)]
    net = quality.train(bags, np.array([1.0, 1.0, 1.0, 0.0]), epochs=5)
    e, b, v, u, w, o, c = net.weights

    def plain(bag):
        encoded, weights = [], []
        for row in bag:
            h = [max(0.0, sum((row[i] - net.mean[i]) / net.scale[i] * e[i, j] for i in range(len(row))) + b[j]) for j in range(len(b))]
            gate = [np.tanh(sum(h[i] * v[i, k] for i in range(len(h)))) / (1 + np.exp(-sum(h[i] * u[i, k] for i in range(len(h))))) for k in range(len(w))]
            encoded.append(h)
            weights.append(np.exp(sum(g * x for g, x in zip(gate, w, strict=True))))
        z = [sum(a * h[j] for a, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(len(b))]
        return 1 / (1 + np.exp(-(sum(x * y for x, y in zip(z, o, strict=True)) + c[0])))

    assert net.score(bags) == pytest.approx([plain(x) for x in bags], rel=1e-4)


def test_scores_do_not_see_labels(spark, docs):
    net = quality.train([quality.bag("a b c"), quality.bag("WIN!! " * 90)], np.array([1.0, 0.0]), epochs=2)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz"), "doc_id": F.lit(0)})
    assert sorted(r["score"] for r in quality.score(docs, net).collect()) == sorted(r["score"] for r in quality.score(other, net).collect())
