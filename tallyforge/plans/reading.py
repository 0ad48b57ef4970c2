"""Queries of document reading, data-set sinks and reports, with their SQL; registered beside those of ``catalog``.

Line rules run over documents put together from ``POOL``, whose lines are of every kind that receipts and screens have; their
SQL states the rules again. Readings run over documents rendered from the tables in several layouts, with lines that must
not be taken (balances, fees, card numbers, advertisements); their SQL is what the tables hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import CATEGORY_DISPLAY
from ..functions import dates, money, text
from ..functions.dates import let
from ..operators import etl, evaluation, extract, screens
from ..session import new_folder, spread
from ..sources import loaders, sinks
from .catalog import OR, query, sql_display, t

POOL = (
    "Transaction Details", "Rincian Transaksi", "QR Bayar", "Pembayaran QR", "Pembayaran Berhasil", "Merchant Name", "Merchant PAN", "936000123456789012", "Customer PAN", "Terminal ID", "A1234567",
    "Reference Number", "ABC123456789", "260104-RWBR-DBAXWB", "TXN202401011234", "Source of Fund", "GoPay Saldo", "bagikan", "Kategori", "Food & Drink", "TOKO SEJAHTERA", "Warung Kopi Nyaman", "PT Sumber Makmur",
    "Alfamart", "Jl. Merdeka 10", "Ruko Permai Blok A", "Bandung", "BANDUNG, 40267, ID", "SUBTOTAL 38.000", "GRAND TOTAL Rp 41.800", "PPN 3.800", "TUNAI 50.000", "KEMBALI 8.200", "Susu Segar 2 x 6.500",
    "Roti Tawar 12.000", "1 Nasi Goreng 25.000", "Kopi Hitam 0", "Qty 3 pcs", "Kasir Ani", "TERIMA KASIH", "Discount 5.000", "Service Charge 2.000", "Total", "Nominal", "-Rp105.000", "IDR 64.000", "Rp",
    "18/07/2024 08:49", "11 Apr 2026", "12.04.23", "19:03:20", "89%", "33.3 KB/s", "bcdfg hjklm", "Instagram tokoku", "www.tokoku.com", "Telp 0812345678", "Bayar ke", "transfer", "ok", "",
)
SIZE = 12


def noisy(spark, sf: str, table: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """(id, lines): twelve lines of the pool for each row of a table, picked by its key."""
    pool = F.array(*map(F.lit, POOL))
    place = lambda k: (F.col(key) * 31 + k * (F.col(key) % 17 * 2 + 1) + k * k) % len(POOL) + 1
    return spread(t(spark, sf, table).select(key)).select(F.col(key).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda k: F.element_at(pool, place(k).cast("int"))).alias("lines"))


def by_line(spark, sf: str) -> DataFrame:
    return noisy(spark, sf).select("id", F.posexplode("lines").alias("k", "line"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def _noisy_sql(table: str = "orders", key: str = "o_orderkey") -> str:
    return f"WITH n AS (SELECT {key} AS id, list_transform(range(0, {SIZE}), lambda k: {_list(POOL)}[({key} * 31 + k * ({key} % 17 * 2 + 1) + k * k) % {len(POOL)} + 1]) AS lines FROM {table}), x AS (SELECT id, CAST(unnest(range(0, {SIZE})) AS INTEGER) AS k, unnest(lines) AS line FROM n), l AS (SELECT *, trim(line) AS s, lower(trim(line)) AS low FROM x)"


LINES = _noisy_sql()
DIGITS = r"length(regexp_replace(s, '\D', '', 'g'))"
LETTERS = r"length(regexp_replace(s, '\P{L}', '', 'g'))"


# -- rules of lines ---------------------------------------------------------------------------------------------------
@query(LINES + f" SELECT id, k, CASE WHEN {_has('low', extract.TIER3)} THEN 3 WHEN {_has('low', extract.TIER1)} THEN 1 WHEN {_has('low', extract.TIER2)} THEN 2 ELSE 0 END AS tier FROM l")
def line_tiers(spark, sf):
    return by_line(spark, sf).select("id", "k", extract.tier(F.lower("line")).alias("tier"))


_LABEL = f"(list_contains({_list(screens.LABELS)}, low) OR (len(list_filter(string_split(low, ' '), lambda w: w <> '')) <= 2 AND list_has_any(string_split(low, ' '), {_list([x for x in screens.LABELS if ' ' not in x])})) OR len(list_filter({_list([x for x in screens.LABELS if ' ' in x])}, lambda w: contains(low, w))) > 0)"
_ID = rf"(NOT contains(s, ' ') AND regexp_matches(s, '\p{{L}}') AND regexp_matches(s, '(?i)^([A-Z0-9]{{3,12}}-[A-Z0-9]{{3,8}}-[A-Z0-9]{{3,12}}|[A-Z0-9]{{3,10}}-[A-Z0-9]{{3,12}}|[A-Z]{{2,5}}\d{{8,18}})$'))"
_ACCOUNT = f"({_ID} OR ({DIGITS} >= 10 AND {DIGITS} / greatest(length(s), 1) > 0.7))"


@query(LINES + rf""" SELECT id, k, {_LABEL} AS label, {_ID} AS transaction_id, {_ACCOUNT} AS account, {LETTERS} >= 3 AND {LETTERS} / greatest(length(s), 1) > 0.3 AS lettered,
 regexp_matches(s, '^\d{{1,2}}[.:]\d{{1,2}}[.:]\d{{1,4}}$') AND coalesce(try_cast(regexp_extract(s, '^(\d{{1,2}})', 1) AS INTEGER), 99) <= 23 AND coalesce(try_cast(regexp_extract(s, '^\d+[.:](\d+)', 1) AS INTEGER), 99) <= 59 AND coalesce(try_cast(regexp_extract(s, '(\d+)$', 1) AS INTEGER), 99) <= 59 AS clock FROM l""")
def line_kinds(spark, sf):
    x = F.col("line")
    return by_line(spark, sf).select("id", "k", screens.label_line(x).alias("label"), screens.transaction_id(x).alias("transaction_id"), screens.account_number(x).alias("account"), screens.has_letters(x).alias("lettered"), screens.likely_time(x).alias("clock"))


_FINAL_PRICE = r"\b(grand\s+total|total|amount\s+due|total\s+due|balance\s+due|due|bayar|tunai)\b"


@query(LINES + rf""" SELECT id, k, {_has('low', extract.QUANTITY)} OR regexp_matches(line, '^\s*\d+\s+[A-Za-z]') OR (regexp_matches(low, '\b\d{{1,3}}[.,]\d{{3}}\b') AND NOT {_has('low', _FINAL_PRICE)})
 OR regexp_matches(low, '[a-z]{{3,}}.*\b\d{{1,3}}[.,]\d{{3}}\s*$') OR regexp_matches(low, '[a-z]{{3,}}.*\s+0(?:\.0+)?\s*$') OR ({_has('low', extract.ITEM_WORD)} AND NOT {_has('low', extract.CUE)} AND len(regexp_extract_all(low, '[a-z]+')) <= 5) AS item FROM l""")
def item_lines(spark, sf):
    return by_line(spark, sf).select("id", "k", extract.item_line(F.col("line")).alias("item"))


def _bad_name_sql() -> str:
    cities = text.CITIES
    tests = [
        extract.ADDRESS, rf"^(?:{cities}|solo|palembang|balikpapan|banjarmasin|pontianak|manado|pekanbaru|padang|makassar|cimahi|tasikmalaya|cilegon|serang|jambi|id|idn|indonesia)$",
        r"https?://|www\.|\.com\b|\.co\.id\b|\.id\b|@[a-z0-9.-]+\.[a-z]{2,}", r"^\+?\d[0-9\s-]{7,}$", extract.FOOTER, extract.DAY, r"\b\d{1,2}[:.]\d{2}(:\d{2})?\b",
        r"\b(rp|idr)\s*[0-9.,o]+\b|^[-–—]?\s*(rp|idr)\b", rf"^(?:{cities})\s*,?\s*id$", r"^[a-z][a-z\s]+,\s*\d{4,6}\s*,?\s*(?:[a-z]{2})?\s*$", r"\b(kb/?s|kbis|mb/?s|mbps)\b|\d+\s*%\s*$|^\d[0-9.,]+\s*kb",
        extract.WRITTEN_DAY,
    ]
    coded = rf"(regexp_matches(low, '^[a-z0-9]{{3,12}}(?:-[a-z0-9]{{2,12}}){{1,4}}$') AND {LETTERS} > 0 AND {DIGITS} > 0) OR (regexp_matches(s, '^[A-Z0-9]{{6,}}$') AND {DIGITS} > 0) OR regexp_matches(s, '^[A-Z]{{1,3}}\d{{1,4}}$')"
    few = f"({LETTERS} >= 6 AND length(regexp_replace(low, '[^aeiou]', '', 'g')) <= 1)"
    return f"(length(s) < 2 OR list_contains({_list(extract.LABELS)}, low) OR {_has('s', extract.REF)} OR {coded} OR {few} OR ({DIGITS} >= 10 AND {DIGITS} / greatest(length(s), 1) > 0.55) OR " + " OR ".join(_has("low", p) for p in tests) + r" OR (regexp_matches(low, '^\d+\s+') AND regexp_matches(low, '\b(qr\s+bayar|pembayaran|berhasil)\b')))"


@query(LINES + f" SELECT id, k, {_bad_name_sql()} AS bad FROM l")
def bad_names(spark, sf):
    return by_line(spark, sf).select("id", "k", extract.bad_merchant(F.col("line")).alias("bad"))


def _bad_recipient_sql() -> str:
    mixed = rf"regexp_matches(s, '\p{{L}}') AND {DIGITS} > 0"
    months = r"(?:jan|feb|mar|apr|mei|may|jun|jul|agu|ags|aug|sep|okt|oct|nov|des|dec)[a-z]*"
    tests = [
        r"^(jl\.|jl |jalan|alamat|ruko|komplek)", r"^[-–—]?\s*(rp|idr)\b", r"(rp|idr)\.?\s*\d{1,3}[.,]\d{3}", r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}", rf"\b\d{{1,2}}\s+{months}\.?\s+\d{{2,4}}",
        r"\b\d{1,2}[:.]\d{2}(:\d{2})?\b", r"^[a-z][a-z\s]+,\s*\d{4,6}\s*,\s*[a-z]{2}$", r"^[a-z]{1,3}\d{1,4}$", r"\b(kb/?s|kbis|mb/?s|mbps)\b|\d+\s*%\s*$|^\d[0-9.,]+\s*kb",
    ]
    names = _list([*screens.INSTITUTIONS, *screens.CITIES, *screens.ALONE])
    return (
        f"(s = '' OR list_contains({names}, low) OR {_LABEL} OR {_ACCOUNT} OR (regexp_matches(low, '^[a-z0-9]{{3,12}}(?:-[a-z0-9]{{2,12}}){{1,4}}$') AND {mixed}) OR ({DIGITS} >= 6 AND NOT regexp_matches(s, '[A-Za-z]{{4,}}'))"
        f" OR (regexp_matches(low, '^[a-z0-9]{{6,}}$') AND {mixed}) OR ({LETTERS} >= 5 AND length(regexp_replace(low, '[^aeiou]', '', 'g')) <= 1) OR " + " OR ".join(_has("low", p) for p in tests) + ")"
    )


@query(LINES + f" SELECT id, k, {_bad_recipient_sql()} AS bad FROM l")
def bad_recipients(spark, sf):
    return by_line(spark, sf).select("id", "k", screens.bad_recipient(F.col("line")).alias("bad"))


def _hits(words) -> str:
    return f"len(list_filter({_list(words)}, lambda p: contains(full_, p)))"


_TYPES = LINES + rf""", f AS (SELECT id, lower(string_agg(line, chr(10) ORDER BY k)) AS full_, count(*) AS n, count(*) FILTER ({_has('lower(line)', extract.QUANTITY + r"|[a-z]{3,}.*(\d{1,3}[.,]\d{3}|\d+[.,]\d{2})\s*$")}) AS items FROM l GROUP BY id),
 a AS (SELECT *, regexp_matches(full_, '\b(alfamart|alfamidi|indomaret|minimarket|supermarket)\b') AS brand, regexp_matches(full_, '\b(total|grand\s+total|subtotal|tunai|kembali|kembalian|kasir|cashier|ppn|terima\s+kasih)\b') AS paid,
  regexp_matches(full_, '\b(merchant\s+pan|customer\s+pan|terminal\s+id|reference\s+number|transaction\s+id|source\s+of\s+fund|acquirer\s+name)\b') AS strong, regexp_matches(full_, '\b(qr\s+bayar|pembayaran\s+qris|pembayaran\s+qr)\b') AS hint,
  {_hits(extract.DETAIL)} AS d, {_hits(extract.WALLET)} AS w, {_hits(extract.RECEIPT)} AS rec, {_hits(extract.COMPACT)} > 0 AS compact,
  len(regexp_extract_all(full_, '\b(subtotal|sub total|grand total|total due|amount due|balance due|nett?|tax|vat|service|discount|cash|tunai|change|kembali|kembalian)\b')) AS words FROM f),
 b AS (SELECT *, rec + least(6, words) + least(6, items) + CASE WHEN paid AND items >= 2 THEN 4 ELSE 0 END + CASE WHEN brand AND paid THEN 5 ELSE 0 END AS r,
  2 * d + 2 * w + CASE WHEN regexp_matches(full_, '\b(customer pan|merchant pan|terminal id|reference|rrn|stan|source of fund)\b') THEN 4 ELSE 0 END + CASE WHEN hint AND (d > 0 OR w > 0 OR n <= 20) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(full_, '\b(share|bagikan|category|kategori|main pocket|saldo)\b') THEN 2 ELSE 0 END AS s0 FROM a),
 c AS (SELECT *, CASE WHEN hint AND r >= s0 AND NOT strong THEN greatest(0, s0 - 2) ELSE s0 END AS sc FROM b),
 e AS (SELECT *, CASE WHEN brand AND paid AND NOT strong THEN 'photo_receipt' WHEN compact THEN 'compact_qr_card' WHEN sc >= 4 AND sc - r >= 2 THEN CASE WHEN d >= w THEN 'mbanking_transaction_detail' ELSE 'ewallet_receipt_screen' END WHEN r >= 4 AND r - sc >= 2 THEN 'photo_receipt' ELSE 'other_unknown' END AS document_type,
  2 * (d + w) + 3 * len(regexp_extract_all(full_, '\b(customer\s+pan|merchant\s+pan|terminal\s+id|reference|transaction\s+id|rrn|stan)\b')) - 2 * rec - 2 * len(regexp_extract_all(full_, '\b(total|grand\s+total|subtotal|tunai|kembali|kembalian|kasir|ppn)\b')) - 2 * len(regexp_extract_all(full_, {_q(extract.QUANTITY)})) AS gap FROM c)"""


@query(_TYPES + """ SELECT id, document_type, CASE document_type WHEN 'photo_receipt' THEN 'receipt' WHEN 'other_unknown' THEN CASE WHEN gap > 0 THEN 'screenshot' ELSE 'receipt' END ELSE 'screenshot' END AS route,
 round(CASE document_type WHEN 'photo_receipt' THEN 0.85 WHEN 'other_unknown' THEN CASE WHEN gap = 0 THEN 0.45 ELSE least(0.92, 0.56 + abs(gap) * 0.035) END ELSE 0.9 END, 4)::DOUBLE AS confidence FROM e""")
def document_types(spark, sf):
    n, by = noisy(spark, sf), extract.route(F.col("lines"))
    return n.select("id", extract.document_type(F.col("lines")).alias("document_type"), by.alias("r")).select("id", "document_type", "r.route", F.round("r.confidence", 4).alias("confidence"))


@query(_TYPES + f""" SELECT id, n + 8 * len(regexp_extract_all(full_, '\\b(rp|idr)\\s*[0-9.,oilsb]{{4,}}')) + 5 * {_hits(("transaction details", "rincian transaksi", "qr bayar", "pembayaran qr", "source of fund", "merchant pan", "customer pan", "terminal id", "total", "nominal", "jumlah", "bayar ke", "payment to"))}
 + CASE WHEN regexp_matches(full_, '\\bke\\s+[a-z][a-z0-9 .,&''-]{{2,}}') THEN 8 ELSE 0 END AS score FROM e""")
def evidence_scores(spark, sf):
    return noisy(spark, sf).select("id", evaluation.evidence(F.col("lines")).cast("long").alias("score"))


@query(LINES + r""" SELECT id, k, list_transform(regexp_extract_all(line, '(?i)(?:rp|idr)\.?\s*(\d{1,3}(?:[.,]\d{3})+|\d{4,})', 1), lambda x: regexp_replace(x, '\D', '', 'g'))[1]::DOUBLE AS prefixed,
 list_transform(regexp_extract_all(line, '\b(\d{1,3}(?:[.,]\d{3})+)\b', 1), lambda x: regexp_replace(x, '\D', '', 'g'))[1]::DOUBLE AS grouped FROM l""")
def line_amounts(spark, sf):
    return by_line(spark, sf).select("id", "k", F.get(money.prefixed_amounts(F.col("line")), F.lit(0)).alias("prefixed"), F.get(money.grouped_amounts(F.col("line")), F.lit(0)).alias("grouped"))


_ENDS = r"'^[ ,.;:-]+|[ ,.;:-]+$', '', 'g'"
_CUTS = (
    r"(?i)(\s+J[lI]\.?\s+|\s+Ji\.?\s+|\s+Jalan\s+|,\s*J[lI]\b|\s+Kec\.\s+|\s+Kecamatan\s+|\s+Kota\s+|\s+Kabupaten\s+|\s+RT\b|\s+RW\b|\s+No\.\s+|\s+Blok\s+|\s+Ruko\s+).*$",
    r"(?i)[,\s]+(jl|ji|jalan|kec|kel|kab|rt|rw|no|lt|blok|gedung|ruko|komplek|perumahan)\b.*$",
)
#: Lines as names are cleaned: ends, words of payment apps, then the two cuts at an address.
_CLEAN = LINES + rf""", a AS (SELECT id, k, regexp_replace(regexp_replace(line, '^[ ,.;:\-!()\[\]{{}}]+|[ ,.;:\-!()\[\]{{}}]+$', '', 'g'), '(?i)^(?:fmi\s*qr|qr\s*pay|pembayaran\s*qr|bayar\s*qr|qr\s*bayar|qris|qr)\s+', '') AS raw FROM l),
 b AS (SELECT id, k, regexp_replace(regexp_replace(raw, '(?i)\s+(?:qris|qr|q)\s*$', ''), {_ENDS}) AS whole FROM a),
 c AS (SELECT id, k, regexp_replace(regexp_replace(regexp_replace(whole, {_q(_CUTS[0])}, ''), {_ENDS}), {_q(_CUTS[1])}, '') AS cut FROM b),
 l2 AS (SELECT id, k, regexp_replace(cut, {_ENDS}) AS s, lower(regexp_replace(cut, {_ENDS})) AS low FROM c)"""


@query(_CLEAN + rf""" SELECT id, k, NOT (length(s) < 2 OR regexp_matches(low, '^(pembayaran berhasil|transaksi berhasil|transaction details?|rincian (transaksi|pembayaran)|payment success|berhasil|success|selesai|completed|done|ok)$')
 OR regexp_matches(low, '\b(berhasil|success|selesai|transaction details?|from|to|source of fund|payment method|acquirer|reference no|reference number|transaction id|id transaksi|customer pan|merchant pan|terminal id|total|jumlah|nominal|kategori|detail transaksi|rincian transaksi|rincian pembayaran)\b') OR regexp_matches(low, '^(xendit|midtrans|doku|nicepay|faspay|ipaymu|tripay)\b') OR regexp_matches(low, '^(gopay|ovo|dana|shopeepay|linkaja|blu|jenius|flip|livin|bca\s+mobile|mandiri\s+livin|bri\s+mo|bni\s+mobile|mobile\s+banking|m-?banking)\b')
 OR list_contains(['bank', 'bank bca', 'bank mandiri', 'bank bni', 'bank bri'], low) OR regexp_matches(low, '\b(rp|idr)\s*[0-9.,o]+\b|^[\s-]*(rp|idr)\b') OR regexp_matches(s, '\b\d{{1,2}}[/.\-]\d{{1,2}}[/.\-]\d{{2,4}}\b|\b\d{{1,2}}[:.]\d{{2}}(:\d{{2}})?\b')
 OR regexp_matches(low, 'https?://|www\.|\.com\b|\.co\.id\b|\.id\b') OR regexp_matches(s, '^\+?\d[0-9\s-]{{7,}}$') OR regexp_matches(s, '^\d+$') OR ({DIGITS} >= 8 AND {DIGITS} / greatest(length(s), 1) > 0.45)
 OR (regexp_matches(s, '(?i)^[A-Z0-9]{{6,}}$') AND {DIGITS} > 0 AND {LETTERS} > 0) OR regexp_matches(s, '(?i)^[A-Z0-9]{{3,12}}(?:-[A-Z0-9]{{2,12}}){{1,4}}$') OR ({LETTERS} >= 6 AND length(regexp_replace(low, '[^aeiou]', '', 'g')) <= 1)) AS valid FROM l2""")
def valid_names(spark, sf):
    return by_line(spark, sf).select("id", "k", text.valid_merchant(F.col("line")).alias("valid"))


# -- payment screens --------------------------------------------------------------------------------------------------
@query("""SELECT id, array_to_string(joined, '|') AS lines FROM (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN ['a', '-Rp' || (c_custkey % 900 + 100) || '.000', 'b'] WHEN 1 THEN ['Rp' || (c_custkey % 900 + 100) || '.500', 'b']
 WHEN 2 THEN ['Rp' || (c_custkey % 900 + 100), '.000'] WHEN 3 THEN ['IDR-' || (c_custkey % 900 + 100), 'x'] WHEN 4 THEN ['7', 'x 12.500', '1234'] ELSE ['12.000', '34,000'] END AS joined FROM customer)""")
def merged_lines(spark, sf):
    n = (F.col("c_custkey") % 900 + 100).cast("string")
    kinds = [
        F.array(F.lit("a"), F.concat(F.lit(" -Rp"), n), F.lit(".000"), F.lit("b")), F.array(F.concat(F.lit("Rp"), n), F.lit(" 500 "), F.lit("b")), F.array(F.lit("Rp"), n, F.lit(".000")),
        F.array(F.lit("IDR"), F.concat(F.lit("-"), n), F.lit("x")), F.array(F.lit("7"), F.lit("x 12"), F.lit("500"), F.lit("1234")), F.array(F.lit("12.000"), F.lit("34"), F.lit(",000")),
    ]
    lines = kinds[5]
    for k in range(5):
        lines = F.when(F.col("c_custkey") % 6 == k, kinds[k]).otherwise(lines)
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(screens.merged(lines), "|").alias("lines"))


_FORMS = (("{a}.{b}", "ab"), ("{a}.{b},00", "ab"), ("{a},{b}.50", "ab"), ("{a}{b}", "ab"), ("{a}.{b}00", "ab"), ("{a},{b}00", "ab00"), ("{a}.5", "a"), ("{a}.00{d}", "stray"))


@query("WITH x AS (SELECT o_orderkey AS id, CAST(o_orderkey % 900 + 100 AS VARCHAR) AS a, CAST(o_custkey % 900 + 100 AS VARCHAR) AS b, CAST(o_custkey % 9 + 1 AS VARCHAR) AS d FROM orders) SELECT id, CAST(CASE id % 8 " + " ".join(
    f"WHEN {k} THEN " + {"ab": "a || b", "ab00": "a || b || '00'", "a": "a", "stray": "a || '00'"}[want] for k, (_, want) in enumerate(_FORMS)) + " END AS DOUBLE) AS amount FROM x")
def screen_tokens(spark, sf):
    part = {"a": (F.col("o_orderkey") % 900 + 100).cast("string"), "b": (F.col("o_custkey") % 900 + 100).cast("string"), "d": (F.col("o_custkey") % 9 + 1).cast("string")}
    raw = F.lit("")
    for k, (form, _) in enumerate(_FORMS):
        made = F.lit(form)
        for name, value in part.items():
            made = F.replace(made, F.lit("{" + name + "}"), value)
        raw = F.when(F.col("o_orderkey") % 8 == k, made).otherwise(raw)
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), money.screen_token(raw, F.lit(True), F.lit(True)).alias("amount"))


NAMES = ("TOKO SEJAHTERA JAYA", "Warung Kopi Nyaman", "KEDAI ROTI INDAH", "PT Sumber Makmur", "Martabak Legit Group")
_NAME = "CASE id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(NAMES)) + " END"


def screens_of(spark, sf) -> DataFrame:
    """(id, lines): payment screens of all orders in six layouts, with status bars, advertisements, fees, balances, card numbers and split amounts.

    On compact QR screens a group 00x after three digits is a misreading, so such amounts lose their last digit."""
    key = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (key % 5 + 1).cast("int"))
    whole = F.floor("o_totalprice") + 10_000
    amount = F.translate(F.format_number(whole, 0), ",", ".")
    day = F.add_months("o_orderdate", 12 * 18)
    lit, say = F.lit, F.concat
    layouts = [
        F.array(lit("89%"), lit("Transaction Details"), say(lit("-Rp"), amount), name, lit("Merchant PAN"), lit("936000123456789012"), lit("Reference Number"), lit("ABC123456789"), lit("Date and Time"), F.date_format(day, "d MMM yyyy HH:mm")),
        F.array(lit("Pembayaran Berhasil"), lit("Rp"), amount, say(lit("Transfer ke "), name), lit("Biaya Admin Rp2.500"), lit("Saldo akhir Rp999.000.000"), lit("Kategori"), lit("Food & Drink"), F.date_format(day, "dd/MM/yyyy")),
        F.array(lit("QR Bayar"), say(lit("- IDR "), amount), say(lit("ke "), name), lit("936000123456789"), F.date_format(day, "yyyy-MM-dd")),
        F.array(lit("Rincian Pembayaran"), lit("Bayar ke"), lit("Voucher diskon paling hemat"), say(name, lit(", Jl. Melati No. 8 Bandung")), lit("Nominal"), say(lit("IDR "), amount), lit("No. Ref 260104"), lit("Tanggal"), F.date_format(day, "dd-MM-yyyy"), lit("Shopping")),
        F.array(lit("33.3 KB/s"), lit("Transfer Berhasil"), lit("Nama Penerima"), lit("BCA"), name, lit("1234567890"), lit("Total"), say(lit("Rp "), amount), lit("Waktu"), F.date_format(day, "MMMM d, yyyy")),
        F.array(lit("QRIS"), F.upper(name), lit("BANDUNG, 40267, ID"), say(lit("Rp"), amount, lit(",00")), lit("Token 123456789012"), F.date_format(day, "dd.MM.yyyy")),
    ]
    lines = layouts[5]
    for k in range(5):
        lines = F.when(key % 6 == k, layouts[k]).otherwise(lines)
    return t(spark, sf, "orders").select(key.alias("id"), lines.alias("lines"))


_SCREENS = f"WITH o AS (SELECT o_orderkey AS id, floor(o_totalprice)::DOUBLE + 10000 AS amount, strftime(o_orderdate + INTERVAL 18 YEAR, '%d/%m/%Y') AS date FROM orders), s AS (SELECT id, CASE WHEN id % 6 = 5 THEN upper({_NAME}) ELSE {_NAME} END AS recipient, amount, date, CASE id % 6 WHEN 1 THEN 'makanan_minuman' WHEN 3 THEN 'belanja' END AS screenshot_category FROM (SELECT id, date, CASE WHEN id % 6 = 2 AND amount >= 100000 AND amount < 1000000 AND amount::BIGINT % 1000 BETWEEN 1 AND 9 THEN floor(amount / 10) ELSE amount END AS amount FROM o))"


@query(_SCREENS + " SELECT * FROM s")
def parsed_screens(spark, sf):
    return screens.parse(screens_of(spark, sf)).select("id", "recipient", "amount", "date", "screenshot_category")


@query(_SCREENS + " SELECT id, amount AS largest, date AS first_date FROM s")
def largest_amounts(spark, sf):
    """The older rules: the largest amount near a word for it, not a balance's, and the first date as it is written (here read again)."""
    joined = spread(screens_of(spark, sf)).withColumn("lines", screens.merged(F.col("lines")))
    return joined.select("id", screens.largest_amount(F.col("lines")).alias("largest"), screens.date_value(screens.first_date_text(F.array_join("lines", "\n"))).alias("first_date"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Gudang Utama Sentosa' ELSE 'TOKO SEJAHTERA JAYA' END AS merchant, CASE WHEN s_suppkey % 3 = 0 THEN 64000.0 WHEN s_suppkey % 3 = 1 THEN 105000.0 ELSE 25000.0 END::DOUBLE AS amount, CASE WHEN s_suppkey % 3 = 2 THEN '13/05/2026' ELSE '01/02/2026' END AS date FROM supplier")
def kept_readings(spark, sf):
    """What an earlier reading gave stands where this one finds none."""
    k = F.col("s_suppkey") % 3
    nameless = F.array(*map(F.lit, ("From", "Transaction ID", "260104-RWBR-DBAXWB", "Date and time", "IDR 64.000")))
    dateless = F.array(*map(F.lit, ("Transaction Details", "Pembayaran Berhasil", "Bayar ke", "TOKO SEJAHTERA JAYA", "Nominal", "-Rp105.000")))
    amountless = F.array(*map(F.lit, ("Transaction Details", "Bayar ke", "TOKO SEJAHTERA JAYA", "Reference Number", "ABC123456789", "Date and time", "13 May 2026, 11:18")))
    was = F.when(k == 0, "Gudang Utama Sentosa").otherwise("x1")
    rows = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(k == 0, nameless).when(k == 1, dateless).otherwise(amountless).alias("lines"), was.alias("m"), F.lit(25000.0).alias("a"), F.lit("01/02/2026").alias("d"))
    return extract.extract(rows, existing=("m", "a", "d")).select("id", "merchant", "amount", "date")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Alfamart' WHEN 1 THEN 'Indomaret' ELSE 'TOKO ROTI INDAH' END AS merchant, 38000.0::DOUBLE AS amount, '18/07/2024' AS date, CASE WHEN s_suppkey % 3 = 2 THEN 'makanan_minuman' ELSE 'belanja' END AS category FROM supplier")
def misread_receipts(spark, sf):
    k = F.col("s_suppkey") % 3
    shop = F.when(k == 0, "Atfamardt").when(k == 1, "1ndomaret").otherwise("TOKO ROTI INDAH")
    lines = F.array(shop, *map(F.lit, ("Jl. Contoh No. 1", "18.7.2024 08:49", "No Struk 123456", "Susu UHT 10.000", "Roti 8.000", "TOTAL", "Rp38.000", "TUNAI 40.000", "KEMBALI 2.000")))
    return extract.extract(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), lines.alias("lines"))).select("id", "merchant", "amount", "date", "category")


# -- forms, types and model results -----------------------------------------------------------------------------------
@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN CAST(CAST(floor(c_acctbal + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) ELSE '' END AS form, least(1.0, greatest(0.0, coalesce(try_cast(CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE CAST(c_acctbal / 5000 AS VARCHAR) END AS DOUBLE), 0.0)))::DOUBLE AS clamped,
 CASE c_custkey % 3 WHEN 0 THEN '69.000' WHEN 1 THEN '105,000' ELSE '7.500' END AS no_cents, CASE c_custkey % 3 WHEN 0 THEN 1250.5 WHEN 1 THEN 0.0 ELSE CAST(c_custkey AS DOUBLE) END::DOUBLE AS income,
 'Rp ' || CASE WHEN c_custkey * 12345 >= 1000000 THEN printf('%.1f', c_custkey * 12345 / 1e6) || 'jt' WHEN c_custkey = 0 THEN '0' ELSE printf('%.0f', c_custkey * 12345 / 1e3) || 'rb' END AS short_form, CASE WHEN c_custkey % 5 = 0 THEN 'Belum terbaca' WHEN c_custkey % 5 = 1 OR c_custkey % 7 = 0 THEN 'Perlu dicek' ELSE 'Terbaca' END AS shown FROM customer""")
def form_values(spark, sf):
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    written = F.when(k % 3 == 0, " 69.000,00 ").when(k % 3 == 1, "105,000.00").otherwise("7.500")
    typed = F.when(k % 3 == 0, "Rp 1250.5,").when(k % 3 == 1, "1.2.3").otherwise(F.concat(F.lit("Rp"), k.cast("string")))
    status = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "needs_review").otherwise("extracted")
    return t(spark, sf, "customer").select(
        k.alias("id"), money.form_amount(x).alias("form"), money.clamped(F.when(k % 4 == 0, "x").otherwise((x / 5000).cast("string"))).alias("clamped"), money.without_cents(written).alias("no_cents"), money.income_input(typed).alias("income"),
        money.short_rupiah(k * 12345).alias("short_form"), etl.status_label(status, F.when(k % 7 == 0, "").otherwise("m"), F.lit("1")).alias("shown"),
    )


_INTERNAL = ("photo_receipt", " Compact_QR_Card ", "other_unknown", "", "qris", "shopping_receipt")
_GROUPS = ("data/qris/1.png", "data/mbanking/gopay/2.png", "data/cord/3.png", "data/other/IMG_4.png", "data/other/5.png")


@query("WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'photo_receipt' WHEN 1 THEN 'compact_qr_card' WHEN 2 THEN 'other_unknown' WHEN 3 THEN '' WHEN 4 THEN 'qris' ELSE 'shopping_receipt' END AS internal, p_partkey % 4 AS f, p_partkey % 5 AS g FROM part), y AS (SELECT *, CASE WHEN internal IN ('photo_receipt', 'shopping_receipt') THEN 'receipt' WHEN internal IN ('compact_qr_card', 'qris') THEN 'screenshot' WHEN f = 0 THEN 'receipt' WHEN f = 1 THEN 'screenshot' ELSE 'unknown' END AS public FROM x), z AS (SELECT *, CASE g WHEN 0 THEN 'compact_qr_screenshots' WHEN 1 THEN 'mbanking_detail_screenshots' WHEN 4 THEN 'unknown_difficult' ELSE 'receipt_photos' END AS path_group FROM y) SELECT id, internal, public, CASE public WHEN 'receipt' THEN 'Struk Belanja' WHEN 'screenshot' THEN 'Screenshot Pembayaran' ELSE 'Perlu dicek manual' END AS label, path_group, CASE WHEN internal = 'photo_receipt' THEN 'receipt' WHEN internal = 'compact_qr_card' OR g <= 1 THEN 'screenshot' WHEN g = 4 THEN 'uncertain' ELSE 'receipt' END AS chosen FROM z")
def public_types(spark, sf):
    k = F.col("p_partkey")
    internal = F.element_at(F.array(*map(F.lit, _INTERNAL)), (k % 6 + 1).cast("int"))
    group = evaluation.path_group(F.element_at(F.array(*map(F.lit, _GROUPS)), (k % 5 + 1).cast("int")))
    made = extract.public_type(internal, F.when(k % 4 == 0, "receipt").when(k % 4 == 1, "screenshot").when(k % 4 == 2, "other"))
    return t(spark, sf, "part").select(k.alias("id"), made["internal"].alias("internal"), made["public"].alias("public"), made["label"].alias("label"), group.alias("path_group"), evaluation.chosen_route(made["internal"], group).alias("chosen"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN '{"a":' || p_partkey || '}' WHEN 1 THEN '{"total":{"total_price":"' || p_partkey || '"}}' WHEN 2 THEN '{"a":1}' WHEN 3 THEN '{}' WHEN 4 THEN '{"raw_text":"x ' || p_partkey || '"}' WHEN 5 THEN '{}' ELSE '{}' END AS result,
 CASE p_partkey % 7 WHEN 1 THEN CASE WHEN p_partkey >= 1 THEN CAST(p_partkey AS DOUBLE) ELSE 0.0 END ELSE 0.0 END::DOUBLE AS amount, CASE p_partkey % 7 WHEN 1 THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM part""")
def model_results(spark, sf):
    k = F.col("p_partkey")
    n, say, lit = k.cast("string"), F.concat, F.lit
    raw = F.when(k % 7 == 0, say(lit('{"a":'), n, lit("}"))).when(k % 7 == 1, say(lit('[{"a":1},{"total":{"total_price":"'), n, lit('"}}]'))).when(k % 7 == 2, lit('[3,{"a":1},{"b":2}]')).when(k % 7 == 3, lit("[]")).when(k % 7 == 4, say(lit('"x '), n, lit('"'))).when(k % 7 == 5, lit("7"))
    read = t(spark, sf, "part").select(k.alias("id"), extract.parsed_result(raw).alias("result"))
    made = extract.with_model_total(F.lit(0.0), F.lit(0.3), F.get_json_object("result", "$.total.total_price"))
    return read.withColumn("m", made).select("id", "result", F.col("m.value").alias("amount"), F.col("m.confidence").alias("confidence"))


@query("SELECT id, name FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Warung ' || s_suppkey || ', Tebet' ELSE 'Toko Roti Indah' END AS name FROM supplier)")
def best_merchants(spark, sf):
    k = F.col("s_suppkey")
    tried = F.array(F.lit("GoPay Saldo"), F.lit("18/07/2024"), F.lit("Toko Roti Indah"), F.when(k % 2 == 0, F.concat(F.lit("Warung "), k.cast("string"), F.lit(", Tebet"))).otherwise("X1"))
    return t(spark, sf, "supplier").select(k.alias("id"), text.best_merchant(tried).alias("name"))


@query("SELECT p_partkey AS id, CAST(p_partkey % 40 AS BIGINT) AS place FROM part WHERE p_partkey % 3 <> 0 AND p_size <= 25 ORDER BY p_partkey LIMIT 3")
def upload_limits(spark, sf):
    files = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), F.when(F.col("p_partkey") % 3 == 0, "text/plain").otherwise("image/png").alias("mime"), (F.col("p_size") * 419_430).alias("length"))
    return etl.allowed_uploads(files).select("id", (F.col("place") % 40).alias("place"))


# -- data sets, sinks and reports -------------------------------------------------------------------------------------
def _loaded(spark, sf) -> list[DataFrame]:
    """Three sources of one size class each: customers, suppliers and parts."""
    null = F.lit(None).cast("string")
    c = t(spark, sf, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("path"), F.lit("kaggle").alias("source"), F.lit("en").alias("language"), null.alias("merchant"), null.alias("date"), F.lit(None).cast("double").alias("total"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("text"))
    s = t(spark, sf, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("path"), F.lit("mbanking").alias("source"), F.lit("id").alias("language"), F.col("s_name").alias("merchant"), null.alias("date"), (F.col("s_suppkey") * 1000).cast("double").alias("total"), null.alias("category"), F.lit("").alias("text"))
    p = t(spark, sf, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("path"), F.lit("cord").alias("source"), F.lit("id").alias("language"), null.alias("merchant"), null.alias("date"), F.col("p_retailprice").alias("total"), null.alias("category"), F.col("p_name").alias("text"))
    return [c, p, s]


_UNIFIED = """WITH u AS (SELECT 'k' || c_custkey AS image_path, 'kaggle' AS source, 'en' AS language, CAST(NULL AS VARCHAR) AS merchant, CAST(NULL AS DOUBLE) AS total_amount, c_mktsegment AS category, c_name AS text_for_classification FROM customer
 UNION ALL SELECT 'm' || s_suppkey, 'mbanking', 'id', s_name, s_suppkey * 1000.0::DOUBLE, NULL, '' FROM supplier UNION ALL SELECT 'c' || p_partkey, 'cord', 'id', NULL, p_retailprice, NULL, p_name FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || image_path), image_path) AS k, count(*) OVER (PARTITION BY source) AS n FROM u),
 w AS (SELECT * EXCLUDE (k, n), CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query(_UNIFIED + " SELECT image_path, source, language, merchant, total_amount, category, text_for_classification, 'IDR' AS currency, CAST(0 AS BIGINT) AS n_items, split FROM w")
def unified_files(spark, sf):
    """Three sources unified, split, encoded, written as JSON lines by split, and read back."""
    path = new_folder(spark, "unified")
    sinks.write_unified(etl.build(*_loaded(spark, sf)), path)
    kind = "image_path string, donut_target string, source string, language string, category string, merchant string, transaction_date string, total_amount double, currency string, text_for_classification string, n_items bigint, split string"
    return spark.read.schema(kind).json(path).select("image_path", "source", "language", "merchant", "total_amount", "category", "text_for_classification", "currency", "n_items", "split")


@query(_UNIFIED + f" SELECT category_label, count(*) AS n FROM (SELECT CASE category WHEN 'BUILDING' THEN 'tagihan' ELSE 'lainnya' END AS category_label FROM w) GROUP BY category_label UNION ALL SELECT unnest({_list([c for c in CATEGORY_DISPLAY if c not in ('tagihan', 'lainnya')])}), 0")
def labelled_files(spark, sf):
    """Labels written with their rows and counted as they are: the counts of the write against those of what was written."""
    path = new_folder(spark, "labelled")
    counts = sinks.write_labelled(etl.build(*_loaded(spark, sf)), path, F.when(F.col("category") == "BUILDING", "tagihan").otherwise("lainnya"))
    written = spark.read.json(path).groupBy("category_label").agg(F.count(F.lit(1)).alias("n"))
    said = spark.createDataFrame([(k, v) for k, v in counts.items()], "category_label string, said bigint")
    return said.join(written, "category_label", "left").select("category_label", F.when(F.col("said") == F.coalesce("n", F.lit(0)), F.col("said")).alias("n"))


@query("SELECT count(*) AS records, 3.0::DOUBLE AS average_items, count(*) FILTER (p_partkey % 4 <> 0) AS with_total FROM part")
def item_stats(spark, sf):
    p, item = t(spark, sf, "part"), F.struct(F.lit("a").alias("name"))
    return etl.item_stats(p.select(F.array(item, item, item).alias("items"), F.when(F.col("p_partkey") % 4 != 0, 1.0).otherwise(0.0).alias("total")))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL) SELECT doc_id, source FROM r WHERE (source = 'src0' AND k <= 1) OR (source = 'src3' AND k <= 2)")
def quota_sample(spark, sf):
    return etl.sample_by_quota(t(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", {"src0": 1, "src3": 2}).select("doc_id", "source")


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"note\":null}' AS record FROM nation")
def json_records(spark, sf):
    return etl.as_json(t(spark, sf, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("note")))


@query("SELECT p_partkey || '.png' AS image, CASE WHEN p_partkey % 2 = 0 THEN 'easyocr+regex' ELSE 'donut' END AS method, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN '' END AS merchant, 'a|b|c' AS items_preview, CAST(4 AS INTEGER) AS n_items, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN substr(repeat(p_name || ' ', 20), 1, 200) ELSE 'a b c d' END AS text FROM part")
def end_records(spark, sf):
    k = F.col("p_partkey")
    items = F.array(*[F.struct(F.lit(n).alias("name"), *[F.lit(None).cast("double").alias(c) for c in ("quantity", "unit_price", "total_price")]) for n in ("a", "b", "", "c", "d")])
    rows = t(spark, sf, "part").select(F.concat(F.lit("x/"), k.cast("string"), F.lit(".png")).alias("path"), F.when(k % 2 == 0, "screenshot").otherwise("receipt").alias("route"), F.when(k % 4 == 0, F.col("p_name")).otherwise("").alias("merchant"), items.alias("items"), F.expr("repeat(p_name || ' ', 20)").alias("raw"))
    return etl.end_record(rows)


@query("SELECT 'in/' || p_partkey || '.jpg' AS path FROM part WHERE p_partkey % 3 <> 0")
def unprocessed_files(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"))
    return loaders.unprocessed(p.select(F.concat(F.lit("in/"), "k", F.lit(".jpg")).alias("path")), p.where("k % 3 = 0").select(F.concat(F.lit("out/a/"), "k", F.lit(".png")).alias("path")))


@query("SELECT 'in/' || p_partkey || '.jpg' AS path, 'out/' || p_partkey || '.png' AS file FROM part WHERE p_partkey % 3 = 0")
def records_with_files(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"))
    files = p.where("k % 3 = 0").select(F.explode(F.array(F.concat(F.lit("out/"), "k", F.lit(".png")), F.concat(F.lit("z/"), "k", F.lit(".png")))).alias("path"))
    return loaders.with_files(p.select(F.concat(F.lit("in/"), "k", F.lit(".jpg")).alias("path")), files)


@query("SELECT count(*) FILTER (c_custkey % 5 <> 0) AS good, count(*) FILTER (c_custkey % 5 = 0) AS bad FROM customer")
def counted_records(spark, sf):
    line = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("file_name"), F.lit("{}").alias("ground_truth")))
    rows = t(spark, sf, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "{broken").otherwise(line).alias("line"))
    path = new_folder(spark, "lines")
    rows.unionByName(rows.limit(1).select(F.lit(" ").alias("line"))).write.text(path)
    return loaders.counted(loaders.lines(spark, path))


_RESULTS = "WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS f, o_totalprice AS s FROM orders), r AS (SELECT id, s, CASE f WHEN 0 THEN 'ocr_unavailable' WHEN 1 THEN 'empty_ocr' WHEN 2 THEN 'no_useful_fields' WHEN 3 THEN 'merchant_missing' WHEN 4 THEN 'amount_missing' WHEN 5 THEN 'date_missing' ELSE CASE WHEN id % 2 = 0 THEN 'low_confidence' ELSE 'ok' END END AS e, CASE WHEN f <= 2 THEN 'failed' WHEN f = 6 AND id % 2 = 0 THEN 'needs_review' ELSE 'extracted' END AS status FROM o)"


def results_of(spark, sf) -> DataFrame:
    """Report rows in which each fault occurs."""
    k = F.col("o_orderkey")
    f, review = k % 7, (k % 7 == 6) & (k % 2 == 0)
    status = F.when(f <= 2, "failed").when(review, "needs_review").otherwise("extracted")
    rows = t(spark, sf, "orders").select(
        F.concat(F.lit("a/"), k.cast("string")).alias("path"), k.alias("id"), F.when(f == 0, "x").otherwise("").alias("ocr_error"), F.when(f == 1, "").otherwise("line\nline").alias("raw_ocr_preview"), status.alias("status"),
        F.when(f == 3, extract.NOT_FOUND).otherwise("m").alias("merchant"), F.when(f == 4, 0.0).otherwise(5.0).alias("amount"), F.when(f == 5, "").otherwise("01/02/2026").alias("date"),
        F.when(review, F.array(F.lit(extract.REVIEW))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.col("o_totalprice").alias("processing_time"),
        F.lit("receipt").alias("predicted_document_type"), F.lit("Struk Belanja").alias("document_type_label"), F.lit("receipt").alias("route_used"), F.lit("lainnya").alias("category"), F.lit("t").alias("debug_trace_preview"),
    )
    made = evaluation.fault(*[F.col(c) for c in ("ocr_error", "raw_ocr_preview", "status", "merchant", "amount", "date", "warnings")])
    return rows.withColumn("e", made).withColumns({"suspected_error_type": F.col("e.type"), "suggested_fix": F.col("e.fix")}).drop("e")


@query(_RESULTS + " SELECT id, e AS error FROM r")
def faults(spark, sf):
    return results_of(spark, sf).select("id", F.col("suspected_error_type").alias("error"))


@query(_RESULTS + " SELECT 'a/' || id AS path, s AS processing_time, status, e AS suspected_error_type FROM r ORDER BY s DESC, 'a/' || id LIMIT 10")
def slowest_samples(spark, sf):
    return evaluation.slowest(results_of(spark, sf))


@query(_RESULTS + " SELECT e AS suspected_error_type, count(*) AS n, (SELECT count(*) FROM r) AS total_samples FROM r WHERE e <> 'ok' GROUP BY e UNION ALL SELECT 'failure log', count(*), (SELECT count(*) FROM r) FROM r WHERE status <> 'extracted'")
def report_files(spark, sf):
    """A report written and its faults, totals and failure log read back."""
    rows, path = results_of(spark, sf), new_folder(spark, "report")
    sinks.write_report(rows, path)
    sinks.write_failures(rows.withColumn("status", F.when(F.col("status") == "extracted", "ok").otherwise(F.col("status"))), f"{path}/failed")
    found = spark.read.option("header", True).option("multiLine", True).csv(f"{path}/faults").groupBy("suspected_error_type").agg(F.count(F.lit(1)).alias("n"))
    log = spark.read.option("sep", "\t").csv(f"{path}/failed").agg(F.count(F.lit(1)).alias("n")).select(F.lit("failure log").alias("suspected_error_type"), "n")
    return found.unionByName(log).crossJoin(F.broadcast(spark.read.json(f"{path}/summary").select("total_samples")))


@query(_RESULTS + " SELECT 'results' AS part, status AS value, count(*) AS n FROM r GROUP BY status UNION ALL SELECT 'slowest', '', least(10, count(*)) FROM r UNION ALL SELECT 'summary.md', status, count(*) FROM r GROUP BY status UNION ALL SELECT 'summary.md', 'total_samples', count(*) FROM r")
def report_parts(spark, sf):
    """The other parts of a report as they are read back: results by status, the slowest, and the counts of its text."""
    rows, path = results_of(spark, sf), new_folder(spark, "report")
    sinks.write_report(rows, path)
    results = spark.read.json(f"{path}/results").groupBy(F.lit("results").alias("part"), F.col("status").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    slow = spark.read.json(f"{path}/slowest").select(F.lit("slowest").alias("part"), F.lit("").alias("value")).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    text = spark.read.text(f"{path}/summary.md", wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(## status\n.*?)\n\n|(- total_samples: \d+)"), 0)).alias("x"))
    said = text.select(F.explode(F.regexp_extract_all("x", F.lit(r"- (\w+: \d+)"), 1)).alias("x")).select(F.lit("summary.md").alias("part"), F.split("x", ": ")[0].alias("value"), F.split("x", ": ")[1].cast("long").alias("n"))
    return results.unionByName(slow).unionByName(said)


@query(OR + f"SELECT id, merchant, amount, date, category, {sql_display('category')} AS category_display FROM o WHERE id % 3 = 0")
def swapped_ledger(spark, sf):
    """A ledger rewritten from what it holds itself, in place."""
    from ..operators import ledger as changes
    from ..sources import ledgers

    path = new_folder(spark, "ledger")
    sinks.replace_ledger(ledgers.orders(spark, sf), path)
    sinks.replace_ledger(ledgers.read(spark, path).where("id % 3 = 0"), path)
    return changes.view(ledgers.read(spark, path)).select("id", "merchant", "amount", "date", "category", "category_display")


@query("SELECT s_suppkey || '.png' AS filename, CASE WHEN s_suppkey % 2 = 0 THEN 'receipt' ELSE 'screenshot' END AS predicted_document_type, CASE WHEN s_suppkey % 2 = 0 THEN 'TOKO ROTI INDAH' ELSE 'TOKO SEJAHTERA' END AS merchant, CASE WHEN s_suppkey % 2 = 0 THEN 15000.0 ELSE 105000.0 END::DOUBLE AS amount, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '13/05/2026' END AS date, CASE WHEN s_suppkey % 2 = 0 THEN 'date_missing' ELSE 'ok' END AS suspected_error_type FROM supplier")
def evaluated_documents(spark, sf):
    receipt = F.array(*map(F.lit, ("TOKO ROTI INDAH", "Jl. Melati No. 8", "ROTI COKLAT 15.000", "TOTAL 15.000", "TUNAI 20.000")))
    screen = F.array(*map(F.lit, ("Transaction Details", "Pembayaran Berhasil", "Bayar ke", "TOKO SEJAHTERA", "Nominal", "-Rp105", ".000", "Reference Number", "ABC123456789", "Date and time", "13 May 2026, 11:18")))
    k = F.col("s_suppkey")
    rows = t(spark, sf, "supplier").select(F.concat(F.lit("x/"), k.cast("string"), F.lit(".png")).alias("path"), F.when(k % 2 == 0, receipt).otherwise(screen).alias("lines"))
    return evaluation.evaluated(rows).select("filename", "predicted_document_type", "merchant", "amount", "date", "suspected_error_type")


# -- traces and model totals ------------------------------------------------------------------------------------------
#: Two receipts with {} for thousands: what is asked for stands below its word on the first, is paid by card on the second.
TRACED = (
    ("TOKO ROTI", "Jl. Melati 8", "18/07/2024", "Susu UHT 12.000", "2 x 6.500", "SUBTOTAL {}.000", "PPN 2.500", "GRAND TOTAL", "{}.500", "TUNAI 950.000", "KEMBALI 22.500", "No Struk 12345678"),
    ("TOKO ROTI", "Susu {}.000", "DEBIT {}.000", "Ref 123456"),
)
#: Receipt, line, value (in hundreds of {}, or as it stands), whether a word names it, whether it is taken, and the tests that hold.
TRACES = (
    (0, 2, "2024.0", False, False, ("its own line +30", "url -900", "date -100")), (0, 3, "12000.0", False, False, ("its own line +30", "after url -650", "words -70")),
    (0, 4, "6500.0", False, False, ("its own line +30", "after url -650", "quantity -150", "item -120")), (0, 5, "n * 1000.0", False, False, ("its own line +30", "part -150")), (0, 6, "2500.0", False, False, ("its own line +30", "part -150")),
    (0, 8, "n * 1000.0 + 500", False, False, ("its own line +30", "low down +25")), (0, 8, "n * 1000.0 + 500", True, True, ("line above +60", "low down +25")),
    (0, 9, "950000.0", False, False, ("its own line +30", "paid +15", "only paid -180", "cash -200", "low down +25")), (0, 10, "22500.0", False, False, ("its own line +30", "below change -200", "part -150", "change -500", "low down +25")),
    (0, 11, "12345678.0", False, False, ("its own line +30", "below change -200", "noise -900", "words -70", "low down +25")), (1, 1, "n * 1000.0", False, False, ("its own line +30", "words -70")),
    (1, 2, "n * 1000.0", False, True, ("its own line +30", "paid, no total +50", "low down +25")), (1, 3, "123456.0", False, False, ("its own line +30", "noise -900", "words -70", "low down +25")),
)


def _traced(spark, sf: str) -> DataFrame:
    n = (F.col("c_custkey") % 900 + 100).cast("string")
    lines = [F.array(*[F.replace(F.lit(x), F.lit("{}"), n) for x in receipt]) for receipt in TRACED]
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, lines[0]).otherwise(lines[1]).alias("lines"))


_TRACE_ROWS = " UNION ALL ".join(
    f"SELECT id, {line} AS line, CAST({value} AS DOUBLE) AS value, {sum(int(r.rpartition(' ')[2]) for r in reasons)} AS score, {named} AS explicit, {taken} AS taken, unnest([{', '.join(map(_q, reasons))}]) AS reason FROM x WHERE id % 2 = {kind}"
    for kind, line, value, named, taken, reasons in TRACES
)


@query(f"WITH x AS (SELECT c_custkey AS id, c_custkey % 900 + 100 AS n FROM customer) {_TRACE_ROWS}")
def amount_traces(spark, sf):
    """Why each amount of a receipt scored as it did: a row for each test that held."""
    found = extract.amount_traces(_traced(spark, sf))
    return found.select("id", "line", "value", "score", "explicit", "taken", F.explode("reasons").alias("reason"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN n * 1000.0 + 500 ELSE n * 1000.0 END::DOUBLE AS amount, CASE c_custkey % 4 WHEN 0 THEN 0.70 WHEN 1 THEN 0.60 WHEN 2 THEN 0.82 ELSE 0.45 END::DOUBLE AS confidence, 'receipt' AS public_type, 'Struk Belanja' AS type_label
 FROM (SELECT *, c_custkey % 900 + 100 AS n FROM customer)""")
def model_totals(spark, sf):
    """Whole readings beside a vision model's total: it stands in for none, supports a weak amount that it agrees with, and changes neither a sure nor another one."""
    k, n = F.col("c_custkey") % 4, (F.col("c_custkey") % 900 + 100).cast("string")
    lines = lambda *xs: F.array(*[F.replace(F.lit(x), F.lit("{}"), n) for x in xs])
    none, weak, sure = lines("TOKO ROTI INDAH", "Kasir Ani", "Struk", "Terima kasih"), lines("TOKO ROTI", "Susu {}.000", "Kasir Ani", "Qty 1 pcs"), lines("TOKO ROTI", "TOTAL {}.000", "Kasir Ani")
    total = F.when(k == 0, F.concat(F.lit("Rp "), n, F.lit(".500"))).when(k == 1, F.concat(n, F.lit(".000"))).when(k == 2, F.concat(n, F.lit(".000"))).otherwise("5.000")
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 0, none).when(k == 2, sure).otherwise(weak).alias("lines"), total.alias("total"))
    return extract.read_all(rows, model_total="total").select("id", "amount", F.col("amount_confidence").alias("confidence"), "public_type", "type_label")
