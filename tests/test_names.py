"""Likeness and merchant names against the standard library and hand-written tables."""

import difflib
import random

from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import extract


def test_likeness_equals_difflib(spark):
    rng, keys, pairs = random.Random(1), list(text.POPULAR_KEYS), {("", ""), ("", "a"), ("é漢😀", "漢é😀")}
    while len(pairs) < 10_000:
        k = list(rng.choice(keys))
        for _ in range(rng.randint(0, 5)):
            i, c = rng.randrange(len(k) + 1), rng.choice("aelmrt01")
            k[i : i + rng.randint(0, 1)] = [c] * rng.randint(0, 1)
        few = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        pairs |= {("".join(k), rng.choice(keys)), (rng.choice(["".join(k), few]), "".join(rng.choice("ab") for _ in range(rng.randint(0, 14))))}
    rows = spark.createDataFrame(sorted(pairs), "a string, b string").repartition(4)
    a, b = F.col("a"), F.col("b")
    for r in rows.select("a", "b", text.likeness(a, b).alias("r"), text.may_be_like(a, b).alias("may"), text.may_be_like(a, b, 0.5).alias("half")).collect():
        want = difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=False).ratio()
        assert abs(r["r"] - want) < 1e-12, r
        assert (r["may"] or want < 0.88) and (r["half"] or want < 0.5), r


def test_cleaned_names(spark):
    wanted = {
        "Kopi Kenangan Jl. Melati 5": "Kopi Kenangan", "Toko Maju Ruko Blok B": "Toko Maju", "Kopi Susu Kec. Tebet": "Kopi Susu", "The Harvest Cakes, Daan Mogot Jl. Tampak Siring": "The Harvest Cakes, Daan Mogot",
        "Mixue, Patriot Jakasampurna; Kec. Bekasi Barat": "Mixue, Patriot Jakasampurna", "indomaretpoint": "indomaretpoint", "1ndomaret": "Indomaret", "Tokopedla": "Tokopedia", "Mie Gacoam": "Mie Gacoan", "mixu": "mixu", "Kotak No. 5": "Kotak",
        "Atfamardt": "Atfamardt", "A,Jl B": "A", "No. 7": "No. 7", "QR": "QR", "x" * 40 + " " + "y" * 30: "x" * 40, "": "", "  ;;": "",
    }
    rows = spark.createDataFrame([(k,) for k in [*wanted, None]], "x string")
    got = {r["x"]: r["y"] for r in rows.select("x", text.clean_merchant(F.col("x")).alias("y")).collect()}
    assert got == wanted | {None: ""}


def test_names_of_no_merchant(spark):
    bad = ["Pembayaran Berhasil", "selesai", "Total Belanja", "Kirim to Ani", "Reference Number 5", "ok", "Bandung, ID"]
    good = ["Toko Roti", "Tokotal", "Selesaikan Kopi", "Indomarett"]
    rows = spark.createDataFrame([(x,) for x in bad + good], "x string")
    assert {r["x"] for r in rows.where(text.valid_merchant(F.col("x"))).collect()} == set(good)
    best = spark.createDataFrame([(["Total 5", "Kopi Jl. Melati 5", "Toko Roti Jl. 1"],), (["ok"],), ([],), (None,)], "c array<string>").select(text.best_merchant(F.col("c")).alias("b")).collect()
    assert [r["b"] for r in best] == ["Toko Roti", "", "", ""]


def test_misread_names_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["Atfamardt", "Lazzzada", "zzyzx road", "Shopee", None, ""])], "id int, merchant string")
    got = extract.corrected(rows)
    assert {r["id"]: r["corrected"] for r in got.collect()}[0] == "Alfamart" and got.where("id = 1").first()["corrected"] == "Lazada" and got.where("id = 2").first()["corrected"] == "zzyzx road"
    read = extract.extract(rows.select(F.array("merchant").alias("lines")))
    assert "Python" not in read._jdf.queryExecution().executedPlan().toString() and "Arrow" not in read._jdf.queryExecution().executedPlan().toString()
