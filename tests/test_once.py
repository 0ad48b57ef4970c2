"""What a row costs is paid once, however often its result is named and filtered."""

import json

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import anomaly, categorize, learned, ledger
from tallyforge.sources import ledgers, loaders, sinks


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_menu_is_parsed_once(spark):
    gt = {"gt_parse": {"menu": [{"nm": ["kopi", "susu"], "cnt": "2 x", "price": "5,000"}, {"nm": " "}], "total": {"total_price": "5.000"}}}
    rows = spark.createDataFrame([(json.dumps({"file_name": "a", "ground_truth": json.dumps(gt)}),)], "line string")
    got = loaders.cord(rows)
    assert [(r["path"], r["text"], r["total"], [tuple(i) for i in r["items"]]) for r in got.collect()] == [("a", "kopi susu", 5000.0, [("kopi susu", 2.0, None, 5000.0)])]
    plan = optimized(got.select("path", F.explode("items").alias("i")).select("path", "i.name", "i.total_price"))
    assert plan.count("parseJson") + plan.count("parse_json") == 1


def parses(df):
    return optimized(df).count("parseJson") + optimized(df).count("parse_json")


def test_a_record_is_parsed_once(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"id": 1, "amount": "2"}, 3]')
    assert parses(ledgers.read(spark, str(tmp_path / "l.json"))) == 1


def test_an_update_reads_the_ledger_once(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"id": 1, "merchant": "a"}, {"id": 1, "merchant": "b"}, {"merchant": "c"}, {"merchant": "d"}, {"id": 2}]')
    changes = spark.createDataFrame([(1, "hiburan"), (3, "belanja"), (None, "tagihan")], "id long, category string")
    got = ledger.update_category(ledgers.read(spark, str(tmp_path / "l.json")), changes)
    assert [(r["id"], r["merchant"], r["category"]) for r in got.orderBy("place").collect()] == [(1, "a", "hiburan"), (1, "b", None), (None, "c", None), (None, "d", None), (2, None, None)]
    assert parses(got) == 1


def test_an_amendment_parses_the_ledger_once(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"id": 1, "merchant": "a"}, 3, {"id": 2, "merchant": "b"}]')
    seen = []

    def change(rows):
        seen.append(parses(rows))
        return ledger.delete(rows, rows.where("id = 1").select("id"))

    sinks.amend_ledger(spark, str(tmp_path / "l.json"), change)
    assert seen == [0] and [(r["id"], r["bad"]) for r in ledgers.scan(spark, str(tmp_path / "l.json")).orderBy("place").collect()] == [(None, "3"), (2, None)]


def test_a_scored_text_is_cut_into_words_once(spark):
    model = learned.Model(["a", "b"], np.arange(10.0).reshape(2, 5), 4)
    got = spark.createDataFrame([("x y",)], "t string").select(learned.predicted(model, F.col("t")).alias("p"))
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1 and got.first()["p"]["label"] == "b"


def test_a_known_keyword_is_not_looked_for(spark):
    rows = spark.createDataFrame([("x", "belanja"), ("x", None), ("", None)], "t string, w string")
    got = rows.select(categorize.classify(F.col("t"), F.struct(F.lit("hiburan").alias("label"), F.lit(0.9).alias("confidence")), F.col("w")).alias("c"))
    assert [r["c"]["source"] for r in got.collect()] == ["keyword", "ml_classifier", "empty_input"] and "regexp" not in optimized(got)


def test_what_chose_a_forests_rows_is_asked_once(spark):
    rows = spark.range(40).select("id", F.lit("m").alias("merchant"), (F.col("id") + 1.0).alias("amount"), F.lit("2024-01-02").alias("date"), F.lit("belanja").alias("category"), F.lit("manual").alias("source"), F.lit("").alias("saved_at"))
    for by_category in (True, False):
        assert "RLIKE" not in optimized(anomaly.detect(rows.where(F.col("date").rlike("^2024-01")), by_category=by_category)).upper()
