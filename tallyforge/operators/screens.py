"""First reading of payment screens: ordered text lines to recipient, amount, date and the app's own category label.

Lines that a scanner split are joined by one fold. Like ``extract``, a document stays in its row: what each line holds is
computed once into an array column, candidates are structs that ``array_max`` compares, ordered strategies are a coalesce.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions.dates import let
from ..functions.patterns import any_of, has, led
from ..functions.text import choice
from ..session import spread
from .extract import below, total_of, trimmed_amount

#: Words beside which the amount of a payment stands, and such as only fees and balances have.
AMOUNT_WORDS = ("total", "nominal", "jumlah", "amount", "bayar", "pembayaran", "transfer", "dibayar", "sukses", "berhasil", "qris", "debit", "kredit", "transaksi", "tagihan", "harga", "charge", "dana")
FEE_WORDS = ("biaya", "saldo")
#: Words after which a recipient stands.
MERCHANT_WORDS = ("bayar ke", "bayar kepada", "payment to", "pembayaran ke", "merchant", "nama merchant", "nama toko", "nama usaha", "penerima", "kepada", "tujuan", "recipient")
RECIPIENT_WORDS = (
    "penerima", "kepada", "tujuan", "merchant", "nama penerima", "recipient", "to:", "ke:", "nama:", "kepada:", "bayar ke", "bayar kepada", "nama toko", "nama merchant", "merchant name",
    "tujuan transfer", "beneficiary", "nama usaha", "diterima oleh", "pembayaran ke", "payment to", "transfer ke", "kirim ke", "nama rekening", "atas nama", "nama akun", "pemilik rekening",
)
#: Labels of screens, which are no recipients.
LABELS = (
    "customer pan", "merchant pan", "reference number", "terminal id", "acquirer name", "source of fund", "main pocket", "transaction id", "transaction details", "transaction detail", "date and time",
    "fee", "category", "share", "from", "to", "details", "status", "payment details", "payment method", "transfer details", "nama pengakuisisi", "acquirer", "shopping", "groceries", "grocery", "food",
    "beverage", "food & drink", "food and drink", "food & beverage", "transport", "transportation", "travel", "makanan & minuman", "makanan dan minuman", "makanan", "minuman", "belanja",
    "belanja & retail", "retail", "lainnya", "other", "pendidikan", "education", "kesehatan", "health", "healthcare", "hiburan", "entertainment", "tagihan", "bills", "utilities", "rincian transaksi",
    "metode pembayaran", "id transaksi", "id transaksi gojek", "bagikan resi", "lihat resi", "lihat bukti transaksi", "lihat bukti bayar", "bagikan bukti transaksi", "bagikan bukti bayar", "kategori",
    "no. ref", "tipe", "selesai", "success", "free", "split", "tutup", "no. ref blu", "transaksi", "qris", "atur jumlah", "bagi bukti bayar", "detail transaksi", "rincian pembayaran",
    "informasi transaksi", "sumber dana", "dari rekening", "ke rekening", "total", "subtotal", "grand total", "bayar", "nominal", "berhasil dikirim", "transfer berhasil", "pembayaran berhasil", "kode qr",
    "qr bayar", "qr code", "scan qr", "nama bank", "nama rekening", "no rekening", "nomor rekening", "nama merchant", "saldo akhir", "biaya admin", "biaya transfer", "rincian pesanan", "transaction sn",
    "order sn", "merchant ref id", "merchant location", "total payment", "date", "tanggal", "amount", "pembayaran qr", "pembayaran qris berhasil", "qris payment successful", "transfer", "debit", "kredit",
    "tabungan", "deposito", "giro", "rekening", "simpanan", "notifikasi", "beranda", "home", "mutasi", "history", "transfer uang", "bayar tagihan", "isi ulang", "tarik tunai", "info rekening", "profil",
    "pengaturan", "settings", "menunggu", "pending", "gagal", "failed", "expired",
)
#: Banks, wallets, gateways and states that stand alone on a line; and whole lines that are never a recipient.
INSTITUTIONS = (
    "bca", "bank bca", "bank jago", "jago", "seabank", "bank mandiri", "bni", "bri", "btn", "cimb", "permata", "maybank", "ocbc", "danamon", "bsi", "bank bsi", "bank neo", "neo commerce", "krom",
    "krom bank", "motion bank", "amar bank", "tunaiku", "bank ina", "bank raya", "bank muamalat", "muamalat", "bank mega", "mega", "bank bukopin", "bukopin", "bank panin", "panin", "jenius", "btpn",
    "shopeepay", "gopay", "dana", "ovo", "linkaja", "blu", "sakuku", "flip", "payfazz", "qris payment successful", "pembayaran berhasil", "transaction details", "rincian pembayaran",
    "rincian transaksi", "xendit", "midtrans", "doku", "nicepay", "faspay", "ipaymu", "tripay", "espay", "finpay",
)
CITIES = (
    "bandung", "jakarta", "surabaya", "medan", "semarang", "makassar", "denpasar", "malang", "bogor", "depok", "bekasi", "tangerang", "bali", "jogja", "yogyakarta", "solo", "palembang", "balikpapan",
    "banjarmasin", "pontianak", "manado", "pekanbaru", "padang", "id", "idn", "indonesia",
)
ALONE = ("success", "berhasil", "selesai", "detail", "salin", "share", "free", "qris", "qr", "rincian pesanan")
#: Category labels as apps show them.
SHOWN = {
    "belanja": ("shopping", "retail", "fashion", "clothing", "belanja", "belanja & retail", "belanja dan retail"),
    "makanan_minuman": (
        "groceries", "grocery", "food", "food & drink", "food and drink", "food & drinks", "food & beverage", "food & beverages", "food and beverage", "restaurant", "dining", "makanan", "makan & minum",
        "makanan & minuman", "makanan dan minuman",
    ),
    "transportasi": ("transport", "transportation", "travel", "transport & travel", "transport & mobility", "transportasi"),
    "tagihan": ("bill", "bills", "utilities", "bills & utilities", "bill payment", "tagihan", "tagihan & utilitas", "tagihan dan utilitas"),
    "hiburan": ("entertainment", "entertainment & leisure", "leisure", "hiburan", "hiburan & wisata", "hiburan dan wisata"),
    "kesehatan": ("health", "healthcare", "health & beauty", "wellness", "kesehatan"),
    "pendidikan": ("education", "pendidikan"),
    "lainnya": ("other", "others", "uncategorized", "lainnya"),
}
#: Month words as dates have them, longest first; dates by form (pattern, places of day, month and year).
MONTHS = "januari|februari|maret|april|mei|juni|juli|agustus|september|oktober|november|desember|january|february|march|may|june|july|august|october|december|jan|feb|mar|apr|jun|jul|ags|agu|sep|okt|nov|des|aug|oct|dec"
FORMS = (
    (rf"(?i)(\d{{1,2}})\s+({MONTHS})\.?\s+(\d{{2,4}})", 1, 2, 3), (rf"(?i)({MONTHS})\.?\s+(\d{{1,2}}),?\s+(\d{{2,4}})", 2, 1, 3),
    (r"\b(\d{4})[/.\-_|](\d{1,2})[/.\-_|](\d{1,2})\b", 3, 2, 1), (r"\b(\d{1,2})[/.\-_|](\d{1,2})[/.\-_|](\d{2,4})\b", 1, 2, 3),
)
#: Patterns of lines, by what they tell of an amount.
NOT_FINAL = r"\b(sub\s*total|subtotal|tax|pajak|ppn|pb1|service\s*charge|service|discount|diskon|potongan|change|kembalian|kembali|cash|tunai|tender)\b"
NUMBERED = r"\b(id transaksi|transaction id|reference|referensi|no\.?\s*ref|merchant pan|customer pan|terminal id|token|source of fund|sumber dana|rekening|account|phone|telepon|tanggal|date|time|rrn|stan|trace|auth|approval|invoice|order\s*(?:sn|no|id)|transaction\s*sn|merchant\s*ref)\b"
MONTH_YEAR = r"\b(jan|feb|mar|apr|mei|may|jun|jul|aug|agu|ags|sep|okt|oct|nov|des|dec)[a-z]*\.?\s+\d{2,4}\b"
CURRENCY = r"\b(rp|idr)\b"
DONE = ("berhasil", "sukses", "payment successful", "pembayaran qris", "qr bayar", "rincian pembayaran")
COMPACT = ("compact_qr_card", "qr bayar", "pembayaran qr", "pembayaran qris")
#: Words that make a date of a number near them, and numbers that are none.
DATE_WORDS = "tanggal|date|waktu|time|jam|transaksi|transaction|payment|pembayaran|selesai|berhasil|detail|rincian"
NEAR_DATE = "tanggal|date|selesai pada|paid at"
NO_DATE = r"\b(transaction id|reference|no\.?\s*ref|pan|terminal|rrn|stan)\b"
#: Places that trail a recipient's name.
_PLACE = r"(?:jl\.?|jalan|ruko|komplek|perumahan|blok|rt\.?|rw\.?|kel\.?|kec\.?|kecamatan|kelurahan|kota|kab\.?|kabupaten|kode\s+pos|no\.?|lt\.?|lantai)"
_NUMBERED_PLACE = _PLACE.replace(r"no\.?", r"no\.?\s+\d")
_STREET = r"(?:jl\.?|jalan|rt\.?|rw\.?|kec\.?|kel\.?|kecamatan|kelurahan|kode\s+pos)"
_TOWNS = r"(?:jakarta|bandung|bekasi|tangerang|surabaya|depok|bogor|semarang|yogyakarta|jogja|medan|malang|denpasar|bali)"
ADS = ("voucher", "tukar poin", "emas", "paling hemat", "waktu selesai", "berhasil", "detail transaksi")
_SKIP = (
    r"(?i)^\s*([0-9:.,\s]+(wib|wita|wit|am|pm)?|[-–—]?\s*(?:rp|idr)\.?\s*[0-9.,o]+|[0-9.,]+\s*(?:kb/?s|kbis|mb/?s|mbps|%)|\d+\s+(?:qr\s+bayar|pembayaran)|qris\s*$|qr\s+bayar|qr\s*code"
    r"|pembayaran(\s+berhasil)?[!.]?|transaksi(\s+berhasil)?|detail\s+transaksi|transaction\s+details?|rincian(?:\s+pembayaran|\s+transaksi)?|x|0|@|ok|done)\s*$"
)
_LOCATION = r"(?i)^[A-Z][A-Z\s]+,\s*\d{4,6}(\s*,\s*[A-Z]{2})?$"


def repaired(text: Column) -> Column:
    """Letters read for digits, also B before a digit that stands apart."""
    return dates.fixed_digits_and(text, ((r"(?<=\d)[Bb](?=\s\d)", "8"),))


def merged(lines: Column) -> Column:
    """Trimmed lines, an amount that was split over two put together; a merged pair takes no third line.

    A fold: the accumulator holds the lines that are settled and one that may still take the next.
    """
    digits, group, cents = r"\d$", r"^\d{3}$", r"^[.,]\d{2,3}$"

    def joined(a: Column, b: Column) -> Column:
        return (
            F.when(has(a, digits) & has(b, cents), F.concat(a, b)).when(has(a, digits) & has(b, group), F.concat(a, F.lit("."), b))
            .when(has(a, r"(?i)(?:rp|idr)\s*$") & has(b, r"^[0-9–—-]"), F.concat(a, b))
        )

    kind = "struct<out:array<string>,held:string>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        return let(joined(s["held"], x), lambda both: taken(s, x, both))

    def taken(s: Column, x: Column, both: Column) -> Column:
        return (
            F.when(s["held"].isNull(), F.struct(s["out"].alias("out"), x.alias("held"))).when(both.isNotNull(), F.struct(F.concat(s["out"], F.array(both)).alias("out"), F.lit(None).cast("string").alias("held")))
            .otherwise(F.struct(F.concat(s["out"], F.array(s["held"])).alias("out"), x.alias("held"))).cast(kind)
        )

    of = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    folded = lambda of: F.aggregate(of, start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))
    # Most screens have no line that another could end or begin.
    part = r"(?i)^(?:[.,]\d{2,3}|\d{3})$|(?:rp|idr)\s*$"
    return let(of, lambda of: F.when(F.exists(of, lambda x: x.rlike(part)), folded(of)).otherwise(of))


# -- amounts ----------------------------------------------------------------------------------------------------------
def _plausible(found: Column, with_currency: bool, compact: Column) -> Column:
    values = F.transform(found, lambda r: money.screen_token(r, F.lit(with_currency), compact))
    return F.filter(values, lambda v: v.between(1000, 1e9))


def _strict(shown: Column, compact: Column) -> Column:
    return _plausible(F.regexp_extract_all(shown, F.lit(led(r"(?i)(?:rp\.?|idr)\s*([0-9oilsb.,\s]+)")), 1), True, compact)


def _loose(shown: Column, compact: Column) -> Column:
    return _plausible(F.regexp_extract_all(shown, F.lit(led(r"\b(\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?)\b")), 1), False, compact)


def strict_amounts(text: Column, compact: Column) -> Column:
    """Amounts of 1000 to 1e9 after Rp or IDR, in order."""
    return _strict(repaired(trimmed_amount(text)), compact)


def loose_amounts(text: Column, compact: Column) -> Column:
    """Numbers of 1000 to 1e9 with groups of thousands, in order."""
    return _loose(repaired(trimmed_amount(text)), compact)


_POINTS = "array<struct<score:int,value:double>>"


def amount(lines: Column) -> Column:
    """The likeliest amount of a screen, or null below 45 points."""

    def pick(d: Column) -> Column:
        f, n, full, compact = d["f"], F.greatest(d["n"], F.lit(1)), d["full"], d["compact"]
        power, success = any_of(full, ("pln", "gobills")), any_of(full, ("berhasil", "sukses", "payment successful", "pembayaran qris", "qr bayar", "rincian pembayaran", "transaction details"))

        def scored(i: Column, base: int, line: Column, values: Column) -> Column:
            made = F.struct(F.lower(line).alias("low"), repaired(F.lower(line)).alias("norm"))
            return F.when(F.size(values) > 0, let(made, lambda t: of_line(i, base, line, values, t["low"], t["norm"]))).otherwise(F.array().cast(_POINTS))

        def of_line(i: Column, base: int, line: Column, values: Column, low: Column, norm: Column) -> Column:
            currency, fee, numbered = has(norm, CURRENCY), any_of(low, ("biaya admin", "fee", "saldo")), has(low, NUMBERED)
            # What each test weighs.
            fixed = base + total_of([
                (fee, -55), (has(low, NOT_FINAL), -50), (numbered, -90), (low.contains("token") & ~currency, -90), (has(norm, r"^[\s\-–—]*(?:rp|idr)\b"), 45), (has(norm, r"[\-–—]\s*(?:rp|idr)\b"), 30),
                (i <= F.greatest(F.lit(3), F.floor(n / 3)), 35), ((i <= F.greatest(F.lit(5), F.floor(n / 2))) & success, 18), (any_of(low, ("total", "nominal", "jumlah", "amount", "tagihan")), 55), (any_of(low, DONE), 35),
                ((i <= F.greatest(F.lit(6), F.floor(n / 2))) & has(repaired(line), "(?i)" + CURRENCY) & ~fee & ~numbered, 20),
            ])
            year = lambda v: v.between(1990, 2100)
            of = lambda s: F.transform(values, lambda v: F.struct((s["s"] + total_of([(year(v) & ~s["c"], -90), (year(v) & s["m"], -80), ((v >= 50_000) & power, 55)])).alias("score"), v.alias("value")))
            return F.coalesce(let(F.struct(fixed.alias("s"), currency.alias("c"), has(low, MONTH_YEAR).alias("m")), of), F.array().cast(_POINTS))

        same = F.flatten(F.transform(f, lambda x, i: scored(i, 90, x["line"], x["strict"])))
        # After a word for the amount, the first of three lines that has one.
        either = lambda j: F.when(F.size(F.get(f, j)["strict"]) > 0, F.get(f, j)["strict"]).otherwise(F.get(f, j)["loose"])
        first = lambda i: F.coalesce(*[F.when(F.size(either(i + k)) > 0, i + k) for k in (1, 2, 3)])
        ahead = F.flatten(F.transform(f, lambda x, i: F.when(x["asks"], F.coalesce(let(first(i), lambda j: F.when(j.isNotNull(), scored(j, 70, F.get(f, j)["line"], either(j)))), F.array().cast(_POINTS))).otherwise(F.array().cast(_POINTS))))
        whole = F.array_join(F.transform(f, lambda x: x["line"]), "\n")
        far = lambda base, values: scored(F.lit(0), base, F.substring(whole, 1, 120), values)
        near = F.concat(same, ahead)
        fallback = F.when(F.size(strict_amounts(whole, compact)) > 0, far(45, strict_amounts(whole, compact))).otherwise(far(25, loose_amounts(whole, compact)))
        best = let(near, lambda c: F.array_max(F.when(F.size(c) > 0, c).otherwise(fallback)))
        return let(best, lambda b: F.when(b["score"] >= 45, b["value"]))

    return let(_numbers(lines), pick)


def _numbers(lines: Column) -> Column:
    """The lines with their amounts, their number, the whole text in lower case and whether it is a compact QR card."""
    of = F.coalesce(lines, F.array().cast("array<string>"))
    full = F.lower(F.array_join(of, "\n"))
    compact = lambda full: any_of(full, COMPACT) & (F.size(of) <= 20)

    def numbers(d: Column) -> Column:
        held = lambda x, r, shown: F.struct(x.alias("line"), _strict(shown, d["compact"]).alias("strict"), _loose(shown, d["compact"]).alias("loose"), any_of(F.lower(r), AMOUNT_WORDS).alias("asks"), any_of(F.lower(x), FEE_WORDS).alias("fees"))
        line = lambda x: let(repaired(x), lambda r: let(repaired(trimmed_amount(r)), lambda shown: held(x, r, shown)))
        return F.struct(F.transform(of, line).alias("f"), F.size(of).alias("n"), d["full"].alias("full"), d["compact"].alias("compact"))

    return let(let(full, lambda x: F.struct(x.alias("full"), compact(x).alias("compact"))), numbers)


def largest_amount(lines: Column) -> Column:
    """The older rule: the largest amount on or within two lines after a word for it; else beside fees; else of all."""

    def pick(d: Column) -> Column:
        f = d["f"]
        own = lambda j: F.when(F.size(F.get(f, j)["strict"]) > 0, F.get(f, j)["strict"])
        either = lambda j: F.coalesce(own(j), F.when(F.size(F.get(f, j)["loose"]) > 0, F.get(f, j)["loose"]))
        near = lambda flag: F.array_max(F.flatten(F.transform(f, lambda x, i: F.when(flag(x), F.coalesce(own(i), either(i + 1), either(i + 2), F.array().cast("array<double>"))).otherwise(F.array().cast("array<double>")))))
        every = lambda k: F.array_max(F.flatten(F.transform(f, lambda x: x[k])))
        return F.coalesce(near(lambda x: x["asks"]), near(lambda x: x["fees"]), every("strict"), every("loose"))

    return let(_numbers(lines), pick)


#: What a text has that holds a digit once it is repaired; and what a repaired one has wherever one of FORMS is found in it.
_DIGITS = r"\d|[.,][Oo]"
_DATED = r"\d(?:[/.\-_|]\d{1,2}[/.\-_|]\d|\s+[A-Za-z]{3,}\.?\s+\d)|[A-Za-z]{3}\.?\s+\d{1,2},?\s+\d"


# -- dates ------------------------------------------------------------------------------------------------------------
def repaired_date(text: Column) -> Column:
    """A line with digits repaired, also beside date separators, and no space around these."""
    rules = [
        (r"(\d{1,2}[/.\-_]\d{1,2}[/.\-_]\d{2})\|(?=\d)", r"$1\1"), (r"(\d{4}[/.\-_]\d{1,2}[/.\-_]\d)\|(?=\d)", "$1"), (r"(?<=\d)[Oo](?=[0-9/.\-_|])", "0"), (r"(?<=[/.\-_|])[Oo](?=\d)", "0"),
        (r"(?<=\d)S(?=[0-9/.\-_|])", "5"), (r"(?<=\d)[Il](?=[0-9/.\-_|])", "1"), (r"(?<=\d)\s*([/.\-_|])\s*(?=\d)", "$1"),
    ]
    blanks = lambda s: F.trim(let(s, lambda s: F.when(s.rlike(r"\s{2}|[\t-\r]"), F.regexp_replace(s, r"\s+", " ")).otherwise(s)))

    def fixed(s: Column) -> Column:
        out = repaired(s)
        for pattern, to in rules:
            out = F.regexp_replace(out, pattern, to)
        return F.when(s.rlike(_DIGITS), blanks(out)).otherwise(blanks(s))

    return let(F.coalesce(text, F.lit("")), fixed)


def likely_time(raw: Column) -> Column:
    """Whether three numbers are a clock time rather than a date."""
    form = r"^\s*(\d{1,2})[.:](\d{1,2})[.:](\d{1,4})\s*$"
    part = lambda k: F.regexp_extract(raw, form, k).try_cast("int")
    return F.coalesce(has(raw, form) & part(1).between(0, 23) & part(2).between(0, 59) & part(3).between(0, 59), F.lit(False))


def date_value(raw: Column) -> Column:
    """DD/MM/YYYY of a matched date, day and month turned where only that can be; null if there is no such day."""

    def form(raw: Column, pattern: str, day: int, month: int, year: int) -> Column:
        at = "(?i)^" + pattern.replace("(?i)", "")
        part = lambda k: F.regexp_extract(raw, at, k)
        named = "|jan|" in pattern
        d, m = part(day).try_cast("int"), dates.month_number(F.substring(part(month), 1, 3)) if named else part(month).try_cast("int")
        turned = lambda p: (p["m"] > 12) & p["d"].between(1, 12) & (p["m"] <= 31)
        of = lambda p: dates.valid_day(F.when(turned(p), p["m"]).otherwise(p["d"]), F.when(turned(p), p["d"]).otherwise(p["m"]), p["y"])
        return F.when(has(raw, at), let(F.struct(d.alias("d"), m.alias("m"), let(part(year), dates.expanded_year).alias("y")), of))

    return let(raw, lambda x: F.coalesce(*[form(x, *f) for f in FORMS]))


def date_candidates(lines: Column) -> Column:
    """(score, line, place, value) of each date of the lines that aren't blank, best by array_max."""
    of = F.transform(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), repaired_date)

    def every(f: Column) -> Column:
        n = F.size(f)

        def of_line(x: Column, i: Column) -> Column:
            window = F.lower(F.array_join(F.slice(f, F.greatest(i - 1, F.lit(0)) + 1, F.least(i + 2, n) - F.greatest(i - 1, F.lit(0))), " "))
            found = _written(x)
            near = has(window, NEAR_DATE)
            # What each test weighs.
            score = 60 + total_of([(has(window, DATE_WORDS), 50), (i <= F.greatest(F.lit(5), F.floor(n / 2)), 20), (has(x, r"\b\d{1,2}[:.]\d{2}(?::\d{2})?\b"), 8), (has(window, NO_DATE), -70)])
            made = lambda found, s: F.transform(found, lambda r, k: F.struct(s["s"].alias("score"), (-i).alias("line"), (-k).alias("place"), F.when(~likely_time(r) | s["n"], date_value(r)).alias("value")))
            every = lambda found: F.filter(let(F.struct(score.alias("s"), near.alias("n")), lambda s: made(found, s)), lambda c: c["value"].isNotNull())
            return let(found, lambda r: F.when(F.size(r) > 0, every(r)).otherwise(F.array().cast("array<struct<score:int,line:int,place:int,value:string>>")))

        return F.flatten(F.transform(f, of_line))

    return let(of, every)


def _written(x: Column) -> Column:
    """What looks like a date in a repaired line."""
    return F.when(has(x, _DATED), F.concat(*[F.regexp_extract_all(x, F.lit(p), 0) for p, *_ in FORMS])).otherwise(F.array().cast("array<string>"))


def has_date(line: Column) -> Column:
    """Whether a line on its own holds a date."""
    of = lambda x: F.exists(_written(x), lambda r: (~likely_time(r) | F.lower(x).rlike(NEAR_DATE)) & date_value(r).isNotNull())
    return has(line, _DIGITS) & let(repaired_date(line), of)


def date(lines: Column) -> Column:
    return F.array_max(date_candidates(lines))["value"]


def first_date_text(text: Column) -> Column:
    """The first date as it is written, named months before numbers; null if none."""
    return let(repaired(text), lambda s: F.coalesce(*[F.nullif(F.regexp_extract(s, p, 0), F.lit("")) for p, *_ in FORMS]))


# -- recipients -------------------------------------------------------------------------------------------------------
def transaction_id(text: Column) -> Column:
    s = F.trim(text)
    form = r"(?i)^([A-Z0-9]{3,12}-[A-Z0-9]{3,8}-[A-Z0-9]{3,12}|[A-Z0-9]{3,10}-[A-Z0-9]{3,12}|[A-Z]{2,5}\d{8,18})$"
    return ~s.contains(" ") & has(s, r"\p{L}") & has(s, form)


def account_number(text: Column) -> Column:
    """A card or account number, or a transaction's id."""
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    return transaction_id(text) | (has(text, r"\d(?:\D*\d){9}") & (digits / F.greatest(F.length(text), F.lit(1)) > 0.7))


def has_letters(text: Column, least: int = 3) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return (letters >= least) & (letters / F.greatest(F.length(text), F.lit(1)) > 0.3)


def _several(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words if " " in w)


def label_line(text: Column) -> Column:
    """A label as a whole, as one of at most two words, or if it has several words anywhere in the line."""
    low = F.lower(F.trim(text))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return low.isin(*LABELS) | ((F.size(words) <= 2) & F.exists(words, lambda w: w.isin(*[x for x in LABELS if " " not in x]))) | has(low, _several(LABELS))


def clean_recipient(raw: Column) -> Column:
    """A recipient without prefixes, numbers and places; at most 55 characters, cut at a word."""
    ends = r"^[ ,.;:-]+|[ ,.;:-]+$"
    c = F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), "^[ :;-]+|[ :;-]+$", "")
    rules = [
        r"(?i)^(?:ke|to)\s+", r"(?i)^(?:merchant|nama\s+merchant|bayar\s+ke)\s*[:\-]?\s+", r",\s*\d{6,}.*$", r"\s+\d{8,}.*$", rf"(?i)\s*(?:;|\||/|\s-\s)\s*(?={_PLACE}\b).*$", r"(?i),\s*(babakan|bandung|jakarta|surabaya|kota|kab\.?).*$",
        rf"(?i)\s*,\s*{_NUMBERED_PLACE}\b.*$", rf"(?i)\s+\b{_STREET}\s+[A-Za-z0-9].*$", rf"(?i)\s*,\s*{_TOWNS}(?:\s+(?:barat|timur|utara|selatan|pusat))?\b.*$", r",\s*\d{4,6}(?:\s*,?\s*[A-Z]{2})?\s*$", ends,
    ]
    for pattern in rules:
        c = F.regexp_replace(c, pattern, "")
    short = lambda c: F.regexp_replace(F.regexp_replace(F.substring(c, 1, 55), r"\s+\S*$", ""), ends, "")
    return let(c, lambda c: F.when((F.length(c) > 55) & (F.length(short(c)) >= 8), short(c)).otherwise(c))


def service(name: Column) -> Column:
    """Electricity tokens by their plain name."""
    plain = lambda low, x: F.when(low.contains("gobills") & low.contains("pln"), "GoBills PLN Token").when(low.contains("pln token"), "PLN Token").otherwise(F.trim(x))
    return let(name, lambda x: plain(F.lower(x), x))


def bad_recipient(text: Column) -> Column:
    """Blank, labels, institutions, places, numbers, codes, amounts, dates, times, network speeds and unpronounceable text."""

    def judge(s: Column) -> Column:
        low = F.lower(s)
        letters, digits = F.length(F.regexp_replace(s, r"\P{L}", "")), F.length(F.regexp_replace(s, r"\D", ""))
        mixed = has(s, r"\p{L}") & (digits > 0)
        patterns = [
            r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}", rf"^\d{{1,2}}\s+({MONTHS})\.?\s+\d{{2,4}}$", r"\b\d{1,2}[:.]\d{2}(:\d{2})?\b", r"^[a-z][a-z\s]+,\s*\d{4,6}\s*,\s*[a-z]{2}$", r"^[a-z]{1,3}\d{1,4}$", r"\d+\s*%\s*$|^\d[0-9.,]+\s*kb",
        ]
        # Asked only where a digit is.
        so = (
            (has(low, r"^[a-z0-9]{3,12}(?:-[a-z0-9]{2,12}){1,4}$") & mixed) | ((digits >= 6) & ~has(s, "[A-Za-z]{4,}")) | (has(low, "^[a-z0-9]{6,}$") & mixed)
            | (has(low, r"^\d+\s+") & has(low, r"\b(qr\s+bayar|pembayaran|berhasil)\b"))
        )
        for p in patterns:
            so = so | has(low, p)
        return (
            (s == "") | low.isin(*INSTITUTIONS, *LABELS, *CITIES, *ALONE) | account_number(s) | (has(s, r"\d") & so) | ((letters >= 5) & (F.length(F.regexp_replace(low, "[^aeiou]", "")) <= 1))
            | ((F.length(s) > 65) & has(low, r"\b(jl\.?|jalan|rt\.?|rw\.?|kec\.?|kel\.?|kota|kab\.?|kode\s+pos|no\.?)\b")) | has(low, r"^(jl\.|jl |jalan|alamat|ruko|komplek)") | has(low, r"\b(kb/?s|kbis|mb/?s|mbps)\b")
            | (has(low, "rp|idr") & (has(low, r"^[-–—]?\s*(rp|idr)\b") | has(low, r"\b(rp|idr)\s*[0-9.,o]+\b") | (F.size(strict_amounts(s, F.lit(False))) > 0))) | label_line(s) | has_date(s)
        )

    return let(F.trim(F.coalesce(text, F.lit(""))), judge)


def _good(raw: Column) -> Column:
    return let(service(clean_recipient(F.trim(raw))), lambda c: F.when((F.length(c) >= 2) & ~bad_recipient(c), c))


_WITHIN = (r"(?i)(?:pembayaran\s+qr|qr\s+bayar)\s+ke\s+(.+)", r"(?i)payment\s+to\s+(.+)", r"(?i)(?:transfer|kirim(?:\s+uang)?)\s+ke\s+([A-Za-z][A-Za-z0-9\s&.,'\-]{2,})")


#: The place of tokens among the strategies.
TOKEN = 3


def recipient(lines: Column) -> Column:
    """Whom a payment went to, by the first strategy that finds a name: within a line, after a label, after a QR title, tokens, after a recipient's label, free lines.

    A strategy gives the texts to try, in order; they are judged until one is a name, and later strategies aren't asked.
    """
    label = lambda x: x["low"].isin(*LABELS)
    token = lambda x: F.when(has(x["low"], r"pln\s*token"), service(F.regexp_replace(x["s"], r"\s*-\s*\d{6,}.*$", "")))

    def free(x: Column) -> Column:
        s, low = x["s"], x["low"]
        return (
            (s != "") & ~low.isin(*INSTITUTIONS, *LABELS, *CITIES) & has_letters(s, 4) & ~any_of(low, ("berhasil", "successful", "transaction details", "rincian")) & ~repaired(s).rlike(_SKIP) & ~account_number(s) & ~label_line(s)
            & ~s.rlike(_LOCATION)
        )

    def named(x: Column) -> Column:
        return (x["s"] != "") & ~account_number(x["s"]) & ~label(x) & ~has(x["low"], _several(LABELS)) & ~any_of(x["low"], RECIPIENT_WORDS) & has_letters(x["s"])

    def tried(f: Column, k: Column) -> Column:
        """What the ``k``-th strategy tries, in order."""
        within = F.flatten(F.transform(f, lambda x: F.array_compact(F.array(*[F.when(has(x["x"], p), F.regexp_extract(x["x"], p, 1)) for p in _WITHIN]))))
        labelled = below(f, lambda x, _: any_of(x["low"], MERCHANT_WORDS), 9, lambda y: F.when(~(any_of(y["low"], ADS) | label_line(y["s"])), y["s"]))
        titled = below(f, lambda x, _: any_of(x["low"], ("pembayaran qr", "qr bayar")), 5, lambda y: F.regexp_replace(y["s"], r"(?i)^\s*ke\s+", ""))
        wanted = below(f, lambda x, _: any_of(x["low"], RECIPIENT_WORDS), 7, lambda y: F.when(named(y), y["s"]))
        capital = lambda lines: F.get(F.filter(lines, lambda s: has(s, "[A-Z]") & (F.upper(s) == s)), F.lit(0))
        alone = let(F.transform(F.filter(f, free), lambda x: x["s"]), lambda lines: F.array_compact(F.array(capital(lines), F.get(lines, F.lit(0)))))
        said = F.slice(F.array_compact(F.transform(f, token)), 1, 1)
        return F.when(k == 0, within).when(k == 1, labelled).when(k == 2, titled).when(k == TOKEN, said).when(k == 4, wanted).otherwise(alone)

    def pick(f: Column) -> Column:
        def judged(raw: Column, k: Column) -> Column:
            # A token stands as it is, and where it is no name there is none.
            name = F.when(k == TOKEN, raw).otherwise(service(clean_recipient(F.trim(raw))))
            return let(name, lambda c: F.when(((k == TOKEN) | (F.length(c) >= 2)) & ~bad_recipient(c), c).otherwise(F.when(k == TOKEN, "")))

        none = F.lit(None).cast("string")
        one = lambda k: F.aggregate(tried(f, k), none, lambda found, raw: F.when(found.isNull(), judged(raw, k)).otherwise(found))
        return F.aggregate(F.sequence(F.lit(0), F.lit(5)), none, lambda found, k: F.when(found.isNull(), one(k)).otherwise(found), lambda found: F.when(found != "", found))

    line = lambda x: F.struct(x.alias("x"), F.trim(x).alias("s"), F.lower(F.trim(x)).alias("low"))
    return let(F.transform(F.coalesce(lines, F.array().cast("array<string>")), line), pick)


def shown_category(lines: Column) -> Column:
    """The category of the first line that is a known label, or that names one after a marker or within two lines; null if none."""
    table = {label: c for c, labels in SHOWN.items() for label in labels}
    key = lambda x: F.regexp_replace(F.trim(F.lower(x)), r"\s+", " ")
    named = lambda x: F.when(x.isin(*table), choice(x, table, F.lit(None).cast("string")))
    inline = lambda x: named(F.regexp_replace(x["low"], r"^(category|kategori|type|tipe)\s*[:\-]?\s*", ""))

    def pick(f: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            marked = F.when(has(x["low"], "category|kategori|type|tipe"), F.coalesce(inline(x), F.get(f, i + 1)["own"], F.get(f, i + 2)["own"]))
            return F.coalesce(x["own"], marked)

        return F.get(F.filter(F.transform(f, of), lambda v: v.isNotNull()), F.lit(0))

    line = lambda x: let(key(x), lambda low: F.struct(low.alias("low"), named(low).alias("own")))
    return let(F.transform(F.coalesce(lines, F.array().cast("array<string>")), line), pick)


def parse(documents: DataFrame, lines: str = "lines") -> DataFrame:
    """``documents`` with merged lines in place of ``lines``, and recipient, amount, date, screenshot_category and n_lines."""
    of = F.col(lines)
    return spread(documents).withColumn(lines, merged(of)).withColumns({"recipient": recipient(of), "amount": amount(of), "date": date(of), "screenshot_category": shown_category(of), "n_lines": F.size(of)})
