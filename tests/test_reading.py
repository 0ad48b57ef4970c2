"""Reading of documents: the asserted fixtures of FIXTURES.md (F5) as they are written, and what surrounds them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import categorize, etl, extract, insights, screens
from tallyforge.sources import ledgers, loaders, sinks

NONE = extract.NOT_FOUND
ALFAMART = ["Atfamardt", "Jl. Contoh No. 1", "18.7.2024 08:49", "No Struk 123456", "Susu UHT 10.000", "Roti 8.000", "TOTAL", "Rp38.000", "TUNAI 40.000", "KEMBALI 2.000"]
COMPACT = [
    "QR Bayar", "Pembayaran QR", "- IDR 120.960", "ke QRIS IDM TGT9 SUKABIRUS", "936000123456789", "Customer PAN", "9360 **** **** 1234", "Terminal ID", "A1234567", "Acquirer Name", "Bank Test",
    "Rincian Pembayaran", "Bagikan", "Selesai", "OK", "Info tambahan",
]
PAYMENT = ["Transaction Details", "Pembayaran Berhasil", "Bayar ke", "TOKO SEJAHTERA", "Nominal", "-Rp105.000", "Reference Number", "ABC123456789", "Date and time", "13 May 2026, 11:18"]
PAN = ["Rincian Pembayaran", "QRIS", "Merchant PAN", "936000123456789012", "Customer PAN", "936000987654321012", "Terminal ID", "A1234567", "Merchant Name", "WARUNG QR TEST", "Total", "Rp20.000"]
#: key: lines, forced route, wanted (merchant, amount, date), each None where nothing is asserted.
FIXTURES = {
    "qr_amount": (["QR Bayar", "Pembayaran QR", "- IDR 260.009", "ke WARUNG TEST QR", "936000123456789"], "screenshot", (None, 26000.0, None)),
    "qr_merchant": (["QR Bayar", "Pembayaran QR", "- IDR 26.00009", "ke WARUNG TEST QR", "936000123456789"], "screenshot", ("WARUNG TEST QR", None, None)),
    "qr_compact": (COMPACT, "screenshot", ("QRIS IDM TGT9 SUKABIRUS", 120960.0, "")),
    "receipt_fuzzy": (ALFAMART, None, ("Alfamart", 38000.0, "18/07/2024")),
    "payment_detail": (PAYMENT, None, ("TOKO SEJAHTERA", 105000.0, None)),
    "qris_pan": (PAN, None, ("WARUNG QR TEST", 20000.0, None)),
    "keep_existing": (["From", "Transaction ID", "260104-RWBR-DBAXWB", "Date and time", "IDR 64.000"], "screenshot", ("TOKO VALID JAYA", None, None)),
    "trim_inline": (["Rincian Transaksi", "Merchant Name", "KEDAI KOPI NYAMAN, Jl. Melati No. 8 Bandung", "IDR 64.000"], "screenshot", ("KEDAI KOPI NYAMAN", None, None)),
    "bad_date": (["Transaction Details", "-Rp20.000", "21 Mar 2026", "Transaction ID", "260303-DHM8-X6ACYO"], "screenshot", (NONE, None, None)),
    "bad_id": (["Transaction Details", "-Rp20.000", "Merchant Name", "260303-DHM8-X6ACYO", "Date and time"], "screenshot", (NONE, None, None)),
    "amount_not_pan": (["Transaction Details", "Merchant PAN", "936000123456789012", "Customer PAN", "936000987654321012", "Terminal ID", "A1234567", "Nominal", "Rp20.000"], "screenshot", (None, 20000.0, None)),
    "receipt_header": (["TOKO ROTI INDAH", "Jl. Melati No. 8", "ROTI COKLAT 15.000", "TOTAL 15.000"], "receipt", ("TOKO ROTI INDAH", None, None)),
} | {
    f"trim_{k}": (["Transaction Details", "-Rp154.000", "Merchant Name", raw, "Transaction ID"], "screenshot", (want, None, None))
    for k, (raw, want) in enumerate([
        ("The Harvest Cakes, Daan Mogot Jl. Tampak Siring Blok KJ No. 78 Jakarta", "The Harvest Cakes, Daan Mogot"), ("Mixue, Patriot Jakasampurna; Kec. Bekasi Barat", "Mixue, Patriot Jakasampurna"),
        ("Martabak Legit Group, Tebet Jl. Albarkah 1 No. 8, Tebet, Jakarta", "Martabak Legit Group, Tebet"), ("Mie Gacoan, Bojongsoang Jl. Bojongsoang No. 12 Bandung", "Mie Gacoan, Bojongsoang"),
    ])
}
EXISTING = {"qr_compact": "QRIS IDM TGT9 SUKABIRUS", "keep_existing": "TOKO VALID JAYA"}


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(k, lines, by, EXISTING.get(k), 64000.0 if k == "keep_existing" else 0.0, "") for k, (lines, by, _) in FIXTURES.items()], "k string, lines array<string>, forced string, m string, a double, d string")

    def by(lines):
        own = extract.route(lines)
        return F.struct(F.coalesce("forced", own["route"]).alias("route"), own["confidence"].alias("confidence"))

    return {r["k"]: r for r in extract.extract(rows, by=by, existing=("m", "a", "d")).collect()}


@pytest.mark.parametrize("key", FIXTURES)
def test_asserted_fixtures(read, key):
    row, wanted = read[key], FIXTURES[key][2]
    assert [w for w, got in zip(wanted, (row["merchant"], row["amount"], row["date"]), strict=True) if w is not None and got != w] == [], row


def test_asserted_confidences_types_and_status(read):
    assert 0.45 <= read["qr_amount"]["amount_confidence"] <= 0.90 and read["qr_merchant"]["merchant_confidence"] >= 0.70 and read["amount_not_pan"]["amount_confidence"] >= 0.70 and read["receipt_header"]["merchant_confidence"] >= 0.70
    assert all(read[f"trim_{k}"]["merchant_confidence"] >= 0.70 for k in range(4))
    assert read["qr_compact"]["document_type"] == "compact_qr_card"
    assert (read["receipt_fuzzy"]["route"], read["payment_detail"]["route"], read["qris_pan"]["route"]) == ("receipt", "screenshot", "screenshot")
    assert read["receipt_fuzzy"]["status"] in ("extracted", "needs_review") and read["receipt_fuzzy"]["category"] == "belanja"
    assert "Tanggal tidak terdeteksi. Isi manual." in read["qr_compact"]["warnings"] and extract.REVIEW in read["bad_id"]["warnings"]


def test_whole_reading(spark):
    split = PAYMENT[:5] + ["-Rp105", ".000"] + PAYMENT[6:] + ["Category", "Food & Drink"]
    rows = spark.createDataFrame([(1, split), (2, ALFAMART), (3, []), (4, None)], "k int, lines array<string>")
    got = {r["k"]: r for r in extract.read_all(rows).collect()}
    assert (got[1]["merchant"], got[1]["amount"], got[1]["date"]) == ("TOKO SEJAHTERA", 105000.0, "13/05/2026")
    assert (got[2]["merchant"], got[2]["amount"]) == ("Alfamart", 38000.0)
    assert all((got[k]["merchant"], got[k]["amount"], got[k]["status"]) == (NONE, 0.0, "failed") for k in (3, 4))


def test_first_reading_of_screens(spark):
    rows = {
        "keyword": (["Transaction Details", "Penerima", "BCA", "1234567890", "WARUNG KOPI", "Total", "Rp 25.000"], "WARUNG KOPI", 25000.0), "token": (["GoBills - PLN Token - 123456789012", "Tagihan", "Rp103.ooo", "Biaya Admin Rp3.000"], "GoBills PLN Token", 103000.0),
        "transfer": (["Transfer ke GoFood Indonesia PT", "Rp50.000"], "GoFood Indonesia PT", 50000.0), "low": (["Saldo Rp9.000.000"], None, None), "nothing": (["x"], None, None), "none": (None, None, None),
    }
    got = screens.parse(spark.createDataFrame([(k, lines) for k, (lines, *_) in rows.items()], "k string, lines array<string>")).collect()
    assert {r["k"]: (r["recipient"], r["amount"]) for r in got if r["k"] != "low"} == {k: (m, a) for k, (_, m, a) in rows.items() if k != "low"}
    dates = {"11 Apr 2O26": "11/04/2026", "12.04.23": None, "tanggal 12.04.23": "12/04/2023", "April 9, 2026": "09/04/2026", "25/13/2026": None, "13/25/2026": None, "12/25/2026": "25/12/2026", "2026-O4-11": "11/04/2026"}
    frame = spark.createDataFrame([(k,) for k in dates], "x string")
    assert {r["x"]: r["d"] for r in frame.select("x", screens.date(F.array("x")).alias("d")).collect()} == dates


def test_currency_and_categories(spark):
    from tallyforge.functions import money

    one = spark.range(1)
    assert one.select(money.currency(F.lit("TOTAL $12.50")).alias("c")).first()["c"] == "USD"
    named = {"Indomaret": "belanja", "Alfamart": "belanja", "Mie Gacoan": "makanan_minuman", "Mixue, Patriot Jakasampurna": "makanan_minuman"}
    rows = spark.createDataFrame([(k,) for k in named], "m string").select("m", categorize.by_keyword(F.col("m")).alias("c")).collect()
    assert {r["m"]: r["c"] for r in rows} == named


def test_first_of_repeated_ids_changes(spark):
    from tallyforge.operators import ledger

    rows = spark.createDataFrame([(1, "a", 1.0, "", "belanja", "manual", "", "2024-01-02"), (1, "b", 2.0, "", "belanja", "manual", "", "2024-01-01"), (2, "c", 3.0, "", "belanja", "manual", "", "2024-01-01")], ledgers.SCHEMA)
    got = ledger.update_category(rows, spark.createDataFrame([(1, "tagihan"), (9, "tagihan")], "id long, category string")).collect()
    assert sorted((r["merchant"], r["category"]) for r in got) == [("a", "belanja"), ("b", "tagihan"), ("c", "belanja")]


def test_income_of_an_object_is_none(spark):
    rows = spark.createDataFrame([('{"id": 1, "amount": 5}',), (' [{"id": 2, "amount": 6}]',), ("x",), (None,)], "entries string")
    assert [(r["id"], r["amount"]) for r in insights.income_entries(rows).collect()] == [(2, 6.0)]


def test_months(spark):
    now = dt.datetime(2026, 6, 5)
    assert [insights.month_or_current(m, now) for m in ("2024-01", "2024-1", "", None)] == ["2024-01", "2026-06", "2026-06", "2026-06"]
    assert insights.current_month_label(now) == "Juni 2026"


def test_ledger_is_swapped_in_place(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(i, "m", 1.0, "", "belanja", "manual", "", "") for i in range(5)], ledgers.SCHEMA)
    sinks.replace_ledger(rows, path)
    sinks.replace_ledger(ledgers.read(spark, path).where("id > 2"), path)
    assert sorted(r["id"] for r in ledgers.read(spark, path).collect()) == [3, 4] and [p.name for p in tmp_path.iterdir()] == ["ledger.versions"]


def test_listing_of_roots(spark, tmp_path):
    for name in ("a/1.png", "a/b/2.JPG", "c/3.txt", "c/4.webp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    roots = [str(tmp_path / "a"), str(tmp_path / "c")]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in loaders.listing(spark, roots).collect()) == ["1.png", "2.JPG", "4.webp"]
    assert loaders.listing(spark, roots, limit=2).count() == 2


def test_split_of_strata(spark):
    rows = spark.createDataFrame([(i, "a" if i < 95 else None if i < 99 else "c") for i in range(100)], "id long, source string")
    got = {(r["source"], r["split"]): r["count"] for r in etl.stratified_split(rows).groupBy("source", "split").count().collect()}
    assert got == {("a", "train"): 76, ("a", "val"): 9, ("a", "test"): 10, (None, "train"): 3, (None, "test"): 1, ("c", "test"): 1}


def test_tags_of_targets():
    tokens = etl.special_tokens()
    assert len(tokens) == 24 and tokens[:2] == ["<s_source>", "</s_source>"] and tokens[-2:] == ["<s_price>", "</s_price>"]


def test_days_count_on(spark):
    from tallyforge.functions import dates

    days = {"2024-01-05": "5 Jan", "2024-02-31": "2 Mar", "2024-13-01": "1 Jan", "2024-05": "2024-05", "2024-00-10": "2024-00-10", "x": "x"}
    rows = spark.createDataFrame([(k,) for k in days], "d string")
    assert {r["d"]: r["t"] for r in rows.select("d", dates.tick_label(F.col("d")).alias("t")).collect()} == days


def test_traces_add_up(spark):
    """Over lines of every kind: a score is the sum of its reasons, and the one taken is the amount that is read."""
    from tallyforge.plans import reading

    rows = reading.noisy(spark, "/root/testdata/sf0.001").limit(300).unionByName(spark.createDataFrame([(-1, None), (-2, [])], "id long, lines array<string>"))
    taken = {}
    for r in extract.amount_traces(rows).collect():
        assert r["score"] == sum(int(x.rpartition(" ")[2]) for x in r["reasons"]), r
        if r["taken"]:
            taken[r["id"]] = r["value"]
    f = extract.features(F.coalesce(F.col("lines"), F.array().cast("array<string>")), F.lit(False), F.lit(False), F.array().cast("array<string>"))
    read = {r["id"]: r["v"] for r in rows.select("id", extract.receipt_amount(f)["value"].alias("v")).collect()}
    assert len(taken) > 100 and {i: v for i, v in read.items() if v} == {i: v for i, v in taken.items() if v}
