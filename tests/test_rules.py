"""Tables of hand-derived expectations."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates, money, text
from tallyforge.operators import anomaly, budget, extract, insights, ledger
from tallyforge.sources import ledgers
from tallyforge.streaming import spend

HISTORY = [
    (makes, amount)
    for makes, amounts in {
        "makanan_minuman": (25000, 32000, 28000, 45000, 350000, 30000, 60000, 75000), "transportasi": (20000, 15000, 50000, 22000, 60000, 100000), "belanja": (135000,),
        "hiburan": (100000, 80000, 850000), "tagihan": (350000, 150000, 100000), "kesehatan": (85000,), "pendidikan": (125000,),
    }.items()
    for amount in amounts
]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def ledger_of(spark, rows):
    return spark.createDataFrame([(i + 1, "m", float(a), "2024-01-05", c, "manual", "", "2024-01-05T00:00:00") for i, (c, a) in enumerate(rows)], ledgers.SCHEMA)


def test_money_tokens_of_compact_screens(spark):
    wanted = {
        "IDR 10.00000": 10000, "IDR 26.00009": 26000, "IDR 33.50000": 33500, "IDR 94.80009": 94800, "IDR 12.00000": 12000, "Rp 15.000": 15000, "IDR 10.000": 10000, "-Rp320.000": 320000, "Rp78.750": 78750,
        "Rp 117.657": 117657, "IDR 64.000": 64000, "IDR 120.960": 120960, "IDR 820.000": 820000, "IDR 260.009": 26000, "IDR 948.009": 94800,
    }
    assert column(spark, list(wanted), lambda x: money.token(x, F.lit(True), F.lit(True))) == list(map(float, wanted.values()))


def test_money_tokens_of_other_currencies(spark):
    assert column(spark, ["46.15", "1,234.50", "12", "x", "", None], lambda x: money.token(x, F.lit(False), F.lit(False))) == [46.15, 1234.5, 12.0, None, None, None]


def test_dates(spark):
    wanted = {
        "18.7.2024 08:49": "18/07/2024", "4 January 2026, 17.59": "04/01/2026", "11 Apr 2026 - 19:03:20 WIB": "11/04/2026", "April 9, 2026": "09/04/2026", "2026-04-11": "11/04/2026", "12/25/2024": "25/12/2024",
        "31/02/2024": "", "11042026": "11/04/2026", "13 Agustus 25": "13/08/2025", "text": "", "1/1/1999": "",
    }
    assert column(spark, list(wanted), dates.parsed) == list(wanted.values())


def test_normalised_dates(spark):
    wanted = {"2024-01-05": "2024-01-05", "2024/01/05": "2024-01-05", "05/01/2024": "2024-01-05", "05-01-2024 10:00": "2024-01-05", "1/2/2026": "1/2/2026", "99/99/2024": "2024-99-99", "": ""}
    assert column(spark, list(wanted), dates.normalised) == list(wanted.values())


def test_merchants(spark):
    assert column(spark, ["QR Bayar TOKO A QRIS,", "  indo maret ", "BCA", None], text.clean_merchant) == ["TOKO A", "Indomaret", "BCA", ""]
    assert column(spark, ["Toko Roti", "12/01/2024", "GoPay Saldo", "Rp 5.000", "ABC123X", "bcdfghj", ""], text.valid_merchant) == [True] + [False] * 6


def test_budget_and_advice(spark):
    rows = ledger_of(spark, [("makanan_minuman", 600), ("hiburan", 400), ("lainnya", -5)])
    total = budget.totals(rows, 1250.0).first()
    assert (total["kebutuhan"], total["keinginan"], total["tabungan"]) == (600.0, 400.0, 250.0)
    assert [r["rule"] for r in budget.advice(rows, 1250.0).collect()] == ["savings_good"]
    assert [r["rule"] for r in budget.advice(rows, 900.0).collect()] == ["over_income", "needs_high", "wants_high"]
    assert budget.totals(rows, 0.0).count() == 0 and budget.advice(rows, 0.0).count() == 0


def test_rule_anomalies_and_medians(spark):
    rows = ledger_of(spark, [("a", x) for x in (1, 2, 3, 10)])
    base = anomaly.baselines(rows).first()
    assert (base["median"], base["upper_median"]) == (2.5, 3.0)
    assert anomaly.by_rule(rows).count() == 0  # fewer than ten


def test_forest_flags_the_outlier_only(spark):
    amounts = (25000, 27000, 30000, 28000, 26000, 24000, 29000, 31000, 23000, 250000)
    found = [r["amount"] for r in anomaly.by_forest(ledger_of(spark, [("makanan_minuman", x) for x in amounts]), min_samples=4).collect()]
    assert 250000.0 in found and min(found) >= 28000.0
    assert anomaly.detect(ledger_of(spark, [("a", 2.4e6), ("a", 3e7), ("a", 1.9e7)])).count() == 0


def test_ledger_batches(spark):
    rows = ledger_of(spark, HISTORY)
    grown = ledger.insert(rows, rows.limit(2).drop("id"))
    assert sorted(r["id"] for r in grown.collect())[-2:] == [len(HISTORY) + 1, len(HISTORY) + 2]
    assert ledger.insert(rows.limit(0), rows.limit(1).drop("id")).first()["id"] == 1
    assert ledger.delete(rows, spark.createDataFrame([(1,), (99,)], "id long")).count() == len(HISTORY) - 1


def test_empty_month(spark):
    none = insights.month_of(ledger_of(spark, HISTORY), "2030-01")
    row = insights.summary(none, 10.0).first()
    assert (row["transaction_count"], row["total_expense"], row["top_category"]) == (0, 0.0, "")
    assert insights.by_category(none).count() == 0 and insights.daily(none).count() == 0


DOCUMENTS = {
    "qr": (["QR Bayar", "-IDR 26.00009", "ke WARUNG TEST QR", "Transaksi berhasil"], ("screenshot", "compact_qr_card", "WARUNG TEST QR", 26000.0, "")),
    "receipt": (
        ["Alfamart", "Jl. Merdeka 10", "18.07.2024 08:49", "SUSU UHT 2 x 6.500", "ROTI TAWAR 12.000", "SUBTOTAL 38.000", "TOTAL 38.000", "TUNAI 50.000", "KEMBALI 12.000"],
        ("receipt", "photo_receipt", "Alfamart", 38000.0, "18/07/2024"),
    ),
    "detail": (
        ["Transaction Details", "Rp105.000", "TOKO SEJAHTERA", "Payment Method", "QRIS", "Reference Number", "1234567890123", "Date and Time", "11 Apr 2026 19:03:20"],
        ("screenshot", "mbanking_transaction_detail", "TOKO SEJAHTERA", 105000.0, "11/04/2026"),
    ),
    "nothing": ([], ("receipt", "other_unknown", extract.NOT_FOUND, 0.0, "")),
}


def test_extraction(spark):
    rows = spark.createDataFrame([(k, lines) for k, (lines, _) in DOCUMENTS.items()], "k string, lines array<string>")
    got = {r["k"]: (r["route"], r["document_type"], r["merchant"], r["amount"], r["date"]) for r in extract.extract(rows).collect()}
    assert got == {k: want for k, (_, want) in DOCUMENTS.items()}


def test_streamed_days(spark, tmp_path):
    rows = spark.sql("select * from values (1L, 'a', 2.0D, timestamp'2024-01-01 10:00:00'), (2L, 'a', 3.0D, timestamp'2024-01-01 11:00:00'), (3L, 'b', 1.0D, timestamp'2024-01-09 00:00:00') as t(id, category, amount, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spend.daily_totals(spend.files(spark, str(tmp_path / "in"), rows.schema)).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert [(r["day"], r["category"], r["total"], r["count"]) for r in spark.table("days").collect()] == [("2024-01-01", "a", 5.0, 2)]


@pytest.mark.parametrize("path", ["missing", "bad.json"])
def test_ledger_reader_tolerates(spark, tmp_path, path):
    (tmp_path / "bad.json").write_text("{not json")
    assert ledgers.read(spark, str(tmp_path / path)).count() == 0


def test_forest_against_plain_trees():
    """Paths through explicit trees, with the same draws in the same order."""
    import numpy as np

    x = np.sort(np.random.default_rng(1).gamma(2.0, 50.0, 700))
    m = 256
    samples = [np.sort(np.random.default_rng(k).choice(x, m, replace=False)) for k in range(20)]
    forest, rng = anomaly.Forest(samples, 7), np.random.default_rng(7)

    def bound(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    def grow(points, depth):
        if len(points) <= 1 or depth >= 8 or points[0] == points[-1]:
            return depth + bound(len(points))
        cut = rng.uniform(points[0], points[-1])
        return cut, grow([p for p in points if p <= cut], depth + 1), grow([p for p in points if p > cut], depth + 1)

    def path(tree, v):
        return tree if not isinstance(tree, tuple) else path(tree[1] if v <= tree[0] else tree[2], v)

    trees = [grow(list(x), 0) for x in samples]
    probe = [*x[::50], 0.0, 1e6]
    want = [-(2.0 ** -(np.mean([path(t, v) for t in trees]) / bound(m))) for v in probe]
    assert forest.score(np.array(probe)) == pytest.approx(want)


def test_medians_of_groups(spark):
    from tallyforge.operators import ranks

    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0), ("c", 4.0), ("c", 4.0), ("c", None), ("d", None)], "g string, x double")
    assert {r["g"]: (r["median"], r["upper_median"]) for r in ranks.medians(rows, "x", "g").collect()} == {"a": (2.5, 3.0), "b": (5.0, 5.0), "c": (4.0, 4.0)}
    one = ranks.medians(rows, "x").first()
    assert (one["median"], one["upper_median"]) == (4.0, 4.0) and ranks.medians(rows.limit(0), "x").first()["median"] is None


def test_medians_that_a_sketch_brackets(spark, monkeypatch):
    import random
    import statistics

    from tallyforge.operators import ranks

    monkeypatch.setattr(ranks, "ACCURACY", 1000)
    rng = random.Random(3)
    groups = {"even": [rng.random() for _ in range(20_000)], "odd": [rng.gauss(0, 1) for _ in range(9_999)], "same": [5.0] * 7_000, "two": [1.0] * 3_000 + [2.0] * 3_000, "tail": [2.0**rng.randint(-500, 500) for _ in range(5_000)], "few": [3.0, 1.0]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").repartition(7)
    got = {r["g"]: (r["median"], r["upper_median"]) for r in ranks.medians(rows, "x", "g").collect()}
    assert got == {g: (statistics.median(xs), sorted(xs)[len(xs) // 2]) for g, xs in groups.items()}
    every = sorted(x for xs in groups.values() for x in xs)
    assert ranks.medians(rows, "x").first()["upper_median"] == every[len(every) // 2]


def test_forest_finds_against_brute_force(spark):
    """Samples are the least hashes of all rows; finds are those of plain trees grown on them, below the exact percentile, above the median."""
    import statistics

    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [("belanja", float(x)) for x in rng.gamma(2.0, 50.0, 1500).round(2)] + [("tagihan", 5000.0), ("tagihan", 10.0)] + [("hiburan", 90_000.0)] * 2
    ledger = ledger_of(spark, rows)
    own = anomaly.scoped(ledger.where("amount > 0"))
    counts = anomaly.scopes(own)
    drawn = {}
    for r in anomaly.samples(own, counts).collect():
        drawn.setdefault((r["scope"], r["tree"]), []).append(r["amount"])
    hashed = own.select("scope", "id", "amount", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda t: F.xxhash64("id", t)).alias("h")).collect()
    for (scope, tree), got in drawn.items():
        mine = sorted((r["h"][tree], r["id"], r["amount"]) for r in hashed if r["scope"] == scope)[:256]
        assert sorted(got) == sorted(x for _, _, x in mine)
    assert {s for s, _ in drawn} == {"category:belanja", "global_fallback"} and len(drawn) == 200
    want = set()
    for scope in ("category:belanja", "global_fallback"):
        forest = anomaly.Forest([np.sort(drawn[scope, t]) for t in range(100)], 42)
        mine = [(r["id"], r["amount"]) for r in hashed if r["scope"] == scope]
        scores = forest.score(np.array([x for _, x in mine]))
        limit = np.percentile(scores, 100 * min(0.49, max(0.1, 1 / len(mine))))
        middle = statistics.median(x for _, x in (rows_ if scope == "global_fallback" else mine)) if (rows_ := [(r["id"], r["amount"]) for r in hashed]) else 0
        want |= {i for (i, x), s in zip(mine, scores, strict=True) if s < limit and x > middle}
    assert want and {r["id"] for r in anomaly.by_forest(ledger).collect()} == want
    alone = anomaly.detect(ledger, by_category=False)
    assert {r["baseline_scope"] for r in alone.collect()} == {"global"}


def test_keywords_by_tree_against_each_by_itself(spark):
    """First category and counts, over texts made of keywords that touch, begin alike and hide in words."""
    import random
    import re

    from tallyforge.domain import KEYWORDS
    from tallyforge.operators import categorize

    rng, every = random.Random(9), sorted({k for ks in KEYWORDS.values() for k in ks})
    texts = [None, "", "Kopi", "xkopix", "mi", "émi", "mi_", "bills", "k24", "by.u", "cuci "] + ["".join(rng.choice(every) + rng.choice(("", " ", "x", "é ", "s ", ". ")) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    texts += [t[:-1].upper() for t in texts[20:60]]

    def alone(k, low):
        return len(re.findall(rf"\b{re.escape(k)}\b", low))

    def counts(low):
        # Short keywords are tried as one pattern, the longest first where several begin alike.
        short = sorted({k for k in every if len(k) <= 4}, key=lambda k: -len(k))
        seen = re.findall(rf"\b(?:{'|'.join(map(re.escape, short))})\b", low)
        return [sum(k in low for k in ks if len(k) > 4) + sum(seen.count(k) for k in ks if len(k) <= 4) for ks in KEYWORDS.values()]

    def first(low):
        return next((c for c, ks in KEYWORDS.items() if any(k in low if len(k) > 4 else alone(k, low) for k in ks)), None)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", categorize.by_keyword(F.col("x")).alias("first"), categorize.hybrid(F.col("x")).alias("most")).collect()
    for r in rows:
        low = (texts[r["i"]] or "").lower()
        n = counts(low)
        assert r["first"] == first(low), low
        assert r["most"] == (list(KEYWORDS)[n.index(max(n))] if max(n) else None), low
