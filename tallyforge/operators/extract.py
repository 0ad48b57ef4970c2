"""Fields of scanned receipts and payment screens: ordered text lines to document type, date, amount and merchant.

A document never leaves its row: ``features`` computes what each line holds once, in an array column; each candidate's
score is a sum over a table of (test, weight) rules, and the best is an ``array_max`` over structs whose fields are the
tie-breakers. Rows are dealt over the cores once; no other shuffle, no window, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import DOCUMENT_LABELS, POPULAR_MERCHANTS, RECEIPT_TYPES, SCREENSHOT_TYPES
from ..functions import dates, money
from ..functions.dates import fixed_digits, let
from ..functions.patterns import has, led
from ..functions.text import CITIES, POPULAR_KEYS, by_distinct, choice, merchant_key, misread_popular, words
from ..session import spread


NOT_FOUND = "Merchant tidak terdeteksi"
#: Phrases that tell document types apart.
COMPACT = ("qr bayar", "pembayaran qr", "pembayaran qris")
DETAIL = ("transaction details", "merchant name", "date and time", "payment method", "source of fund", "terminal id", "rincian transaksi", "metode pembayaran", "nama merchant", "customer pan", "merchant pan", "reference number")
WALLET = ("gopay", "shopeepay", "ovo", "dana", "linkaja", "pembayaran berhasil", "bayar ke", "transaksi berhasil", "berhasil dikirim")
RECEIPT = ("subtotal", "kasir", "cashier", "kembalian", "kembali", "tunai", "struk", "nota", "ppn", "qty", "pcs", "receipt", "guest folio", "folio", "balance due", "charges", "credits", "room", "receipt no")
#: Patterns of lines.
REF = r"(?i)\b(transaction\s*id|id\s*transaksi|reference|referensi|no\.?\s*ref|customer\s*pan|merchant\s*pan|terminal\s*id|trace|rrn|stan|auth|approval|invoice|receipt\s*no|order\s*(sn|no|id)|transaction\s*sn|source\s*of\s*fund|account|rekening|phone|telp|token|merchant\s*ref\s*id)\b"
DUE = r"\b(amount\s+due|total\s+due|balance\s+due|due)\b"
TOTAL = r"\b(grand\s+total|final\s+total|total\s+belanja|total\s+bayar|jumlah\s+bayar|total\s+payment|total\s+paid|paid\s+amount|total\s+harga|net\s+amount|net\s+total|nett\s+amount|total|tl|ttl|net|nett)\b"
FINAL = r"\b(grand\s+total|final\s+total|total\s+bayar|total\s+due|amount\s+due|balance\s+due|due|total|bayar|tunai|jumlah)\b"
TIER1 = r"\b(due|total|jumlah|tagihan|amount|amt|bayar|tl|ttl|net|nett)\b|grand total|paid amount"
TIER2 = r"\b(tunai|cash|debit|credit|qris|payment|paid|lunas|tender|mastercard|visa|card)\b"
TIER3 = r"\b(subtotal|sub\s+total|service\s+charge|service|serv|svc|tax|ppn|pb1|vat|fee|discount|disc|diskon|promo|voucher|change|kembalian|kembali|sc)\b"
CHANGE, CASH = r"\b(change|kembalian|kembali)\b", r"\b(tunai|cash)\b"
NOISE = r"\b(http|https|www\.|\.com|\.co\.id|link|url|instagram|wifi|password|coupon|kupon|voucher|card|kartu|phone|telp|telepon|no\s*hp|hp|cashier|kasir|operator|receipt\s*no|rcpt|invoice|ref|reference|order\s*(?:id|no)|id\s*transaksi|no\.?\s*struk)\b"
URL = r"https?://|www\.|\.com|\.co\.id|link|url|/f/|/[a-z0-9]{4,}"
QUANTITY = r"\b\d+\s*x\b|\b\d+x\b|\bx\d+\b|\bqty\b|\bpcs\b|@"
DAY = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b"
WRITTEN_DAY = r"^\d{1,2}\s+(?:jan|feb|mar|apr|may|mei|jun|jul|aug|agu|ags|sep|okt|oct|nov|des|dec)[a-z]*\.?\s+\d{2,4}|^(?:jan|feb|mar|apr|may|mei|jun|jul|aug|agu|ags|sep|okt|oct|nov|des|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{2,4}|^\d{4}[/.\-_|]\d{1,2}[/.\-_|]\d{1,2}|^\d{8}$"
MAIN = r"\b(total|nominal|jumlah|amount|tagihan|bayar|harga|charge|transfer)\b"
SCREEN_REJECT = "transaction id|id transaksi|reference|referensi|no\\. ref|merchant pan|customer pan|terminal id|token|source of fund|sumber dana|rekening|account|phone|telepon|tanggal|date|time|waktu|rrn|stan|trace|auth|approval|invoice|order sn|transaction sn|merchant ref"
CUE = r"\b(warung|toko|shop|store|mart|resto|restaurant|cafe|coffee|kopi|bakery|dapur|kedai|rumah\s+makan|rm|pt|cv)\b"
ITEM_WORD = r"\b(nasi|ayam|mie|bakso|kopi|coffee|tea|water|roti|pasta|burger|rice|noodle|drink|chicken|beef|pork|fish|egg|seafood|shrimp|tofu|cheese|cream|chocolate|crispy|grilled|fried|steamed|baked|curry|soup|salad|sandwich|udon|ramen|spaghetti|sushi|dimsum|cakes?|cookies|donut|muffin|brownies|gelato|yogurt|milk|juice|smoothie|shake|matcha|latte|sundae)\b"
FOOTER = r"\b(thank\s*you|terima\s+kasih|instagram|wifi|password|kritik|saran|link|coupon|kupon|voucher|card|cashier|kasir|operator|lun[a4]s)\b"
ADDRESS = r"^(jl\.|jl |jalan|ruko|perumahan|komplek|alamat|telp|tel\.|phone|ph\.|no\.|lt\.|lantai|blok|kel\.|kec\.|kota|kab\.|\()"
#: Whole lines that label something, and so name no merchant.
LABELS = (
    "shopping", "groceries", "grocery", "food", "beverage", "food & drink", "food and drink", "food & beverage", "transportasi", "transport", "transportation", "travel", "makanan & minuman",
    "makanan dan minuman", "makanan", "minuman", "belanja", "belanja & retail", "belanja dan retail", "retail", "lainnya", "other", "others", "pendidikan", "education", "kesehatan", "health",
    "healthcare", "hiburan", "entertainment", "tagihan", "bills", "bill", "utilities", "category", "kategori", "tipe", "type", "success", "berhasil", "selesai", "successful", "done", "ok", "completed",
    "main pocket", "source of fund", "sumber dana", "dari rekening", "ke rekening", "acquirer name", "acquirer", "terminal id", "reference number", "transaction id", "id transaksi", "customer pan",
    "merchant pan", "transaction details", "rincian transaksi", "rincian pembayaran", "payment details", "detail transaksi", "informasi transaksi", "transfer details", "payment method",
    "metode pembayaran", "from", "to", "date and time", "reference", "referensi", "merchant name", "nama merchant", "merchant location", "bca", "bank bca", "bank jago", "seabank", "bank mandiri", "bni",
    "bri", "btn", "cimb", "permata", "maybank", "ocbc", "danamon", "shopeepay", "gopay", "dana", "ovo", "linkaja", "blu", "xendit", "midtrans", "free", "qris", "qr", "qris payment successful",
    "pembayaran berhasil", "merchant tidak terdeteksi", "qr bayar", "qr code", "scan qr", "bayar qr", "pembayaran qr", "pembayaran qris berhasil", "subtotal", "sub total", "total", "grand total", "tax",
    "ppn", "pb1", "service", "tunai", "cash", "debit", "kredit", "credit", "payment", "pembayaran", "change", "kembalian", "kembali", "diskon", "discount", "kasir", "cashier", "operator", "receipt", "rcpt",
    "table", "guest", "qty", "item",
)

Rule = tuple[Column, int]


def total_of(rules: list[Rule]) -> Column:
    out = F.lit(0)
    for test, weight in rules:
        out = out + F.when(test, weight).otherwise(0)
    return out


def hits(text: Column, phrases: tuple[str, ...]) -> Column:
    return let(text, lambda x: F.size(F.filter(words(phrases), lambda p: F.contains(x, p))))


def trimmed_amount(text: Column) -> Column:
    """A last group of four digits or more after a point keeps three: repeated zeros and noise of scanners."""
    return let(text, lambda x: F.when(x.rlike(r"\.\d{4}"), F.regexp_replace(x, r"(\d+)\.(\d{3})\d+(?!\d*\.)", "$1.$2")).otherwise(x))


def around(f: Column, i: Column, lo: int, hi: int) -> Column:
    """Lower-case lines from i + lo to i + hi, joined."""
    start = F.greatest(i + lo, F.lit(0))
    length = F.greatest(F.least(i + hi, F.size(f) - 1) - start + 1, F.lit(0))
    return F.array_join(F.transform(F.slice(f, start + 1, length), lambda x: x["low"]), " ")


def document_type(lines: Column) -> Column:
    """compact_qr_card, mbanking_transaction_detail, ewallet_receipt_screen, photo_receipt or other_unknown."""

    of = F.coalesce(lines, F.array().cast("array<string>"))
    ends = r"\d[.,]\d{2,3}\s*$"  # asked first: the pattern behind it is tried at each letter

    def item(x: Column) -> Column:
        return let(F.lower(fixed_digits(x)), lambda low: has(low, QUANTITY) | (has(low, ends) & low.rlike(r"[a-z]{3,}.*(\d{1,3}[.,]\d{3}|\d+[.,]\d{2})\s*$")))

    def told(full: Column) -> Column:
        brand = has(full, r"\b(alfamart|alfamidi|indomaret|minimarket|supermarket)\b")
        paid = has(full, r"\b(total|grand\s+total|subtotal|tunai|kembali|kembalian|kasir|cashier|ppn|terima\s+kasih)\b")
        return F.struct(full.alias("full"), brand.alias("brand"), paid.alias("paid"), has(full, r"\b(qr\s+bayar|pembayaran\s+qris|pembayaran\s+qr)\b").alias("hint"))

    def decide(d: Column) -> Column:
        full, brand, paid, hint, n = d["full"], d["brand"], d["paid"], d["hint"], F.size(of)
        strong = has(full, r"\b(merchant\s+pan|customer\s+pan|terminal\s+id|reference\s+number|transaction\s+id|source\s+of\s+fund|acquirer\s+name)\b")
        compact = (hits(full, COMPACT) > 0) & ((n <= 20) | (has(full, r"\b(?:rp|idr)\s*[0-9.,oilsb]{4,}") & has(full, r"(^|\n|\b)ke\s+[a-z0-9]")))
        said = F.regexp_count(full, F.lit(led(r"\b(subtotal|sub total|grand total|total due|amount due|balance due|nett?|tax|vat|service|discount|cash|tunai|change|kembali|kembalian)\b")))
        counted = F.struct(F.size(F.filter(of, item)).alias("items"), hits(full, DETAIL).alias("detail"), hits(full, WALLET).alias("wallet"))

        def points(c: Column) -> Column:
            items, detail, wallet = c["items"], c["detail"], c["wallet"]
            receipt = hits(full, RECEIPT) + F.least(F.lit(6), said) + F.least(F.lit(6), items) + F.when(paid & (items >= 2), 4).otherwise(0) + F.when(brand & paid, 5).otherwise(0)
            # What each test weighs.
            screen = 2 * detail + 2 * wallet + total_of([(has(full, r"\b(customer pan|merchant pan|terminal id|reference|rrn|stan|source of fund)\b"), 4), (hint & ((detail > 0) | (wallet > 0) | (n <= 20)), 3), (has(full, r"\b(share|bagikan|category|kategori|main pocket|saldo)\b"), 2)])
            return F.struct(screen.alias("s"), receipt.alias("r"), detail.alias("d"), wallet.alias("w"))

        def by_scores(s: Column) -> Column:
            screen = F.when(hint & (s["r"] >= s["s"]) & ~strong, F.greatest(F.lit(0), s["s"] - 2)).otherwise(s["s"])
            return (
                F.when((screen >= 4) & (screen - s["r"] >= 2), F.when(s["d"] >= s["w"], "mbanking_transaction_detail").otherwise("ewallet_receipt_screen"))
                .when((s["r"] >= 4) & (s["r"] - screen >= 2), "photo_receipt")
                .otherwise("other_unknown")
            )

        scored = let(let(counted, points), by_scores)
        return F.when(brand & paid & ~strong, "photo_receipt").when(compact, "compact_qr_card").otherwise(scored)

    return let(let(F.lower(F.array_join(of, "\n")), told), decide)


def route(lines: Column) -> Column:
    """(route, confidence): by document type, else by keyword and layout points."""
    return _route_of(document_type(lines), lines)


def _route_of(kind: Column, lines: Column) -> Column:
    """``route`` of lines whose document type is known."""

    def points(full: Column) -> Column:
        screen = 2 * hits(full, (*DETAIL, *WALLET)) + 3 * F.regexp_count(full, F.lit(led(r"\b(customer\s+pan|merchant\s+pan|terminal\s+id|reference|transaction\s+id|rrn|stan)\b")))
        receipt = 2 * hits(full, RECEIPT) + 2 * F.regexp_count(full, F.lit(led(r"\b(total|grand\s+total|subtotal|tunai|kembali|kembalian|kasir|ppn)\b"))) + 2 * F.regexp_count(full, F.lit(led(QUANTITY)))
        sure = lambda gap: F.least(F.lit(0.92), F.lit(0.56) + gap * 0.035)
        named = lambda r, c: F.struct(F.lit(r).alias("route"), c.alias("confidence"))
        return let(screen - receipt, lambda g: F.when(g > 0, named("screenshot", sure(g))).when(g < 0, named("receipt", sure(-g))).otherwise(named("receipt", F.lit(0.45))))

    fixed = lambda r, c: F.struct(F.lit(r).alias("route"), F.lit(c).alias("confidence"))
    by_type = lambda k: F.when(k == "photo_receipt", fixed("receipt", 0.85)).when(k != "other_unknown", fixed("screenshot", 0.90)).otherwise(let(F.lower(F.array_join(lines, "\n")), points))
    return let(kind, by_type)


_DATES = (
    r"(\d{1,2}\s+[A-Za-z]{3,}\.?\s+\d{2,4})", r"([A-Za-z]{3,}\.?\s+\d{1,2},?\s+\d{2,4})", r"\b(\d{4}[/.\-_|]\d{1,2}[/.\-_|]\d{1,2})\b",
    r"\b(\d{1,2}[/\-_|]\d{1,2}[/\-_|]\d{2,4})\b", r"\b(\d{1,2}\.\d{1,2}\.\d{2,4})\b", r"\b(\d{8})\b",
)
#: What a line has wherever one of _DATES is found in it.
_DATED = r"\d(?:\d{7}|\s*[/.\-_|]\s*\d{1,2}\s*[/.\-_|]\s*\d|\s+[A-Za-z]{3,}\.?\s+\d)|[A-Za-z]{3}\.?\s+\d{1,2},?\s+\d"


def best_date(f: Column) -> Column:
    """(value DD/MM/YYYY or '', confidence, score) of the likeliest date."""
    near = r"tanggal|date|waktu|time|selesai|berhasil"

    def pick(f: Column) -> Column:
        n = F.size(f)

        def of_line(x: Column, i: Column) -> Column:
            found = let(F.regexp_replace(x["norm"], r"(?<=\d)\s*([/.\-_|])\s*(?=\d)", "$1"), lambda s: F.concat(*[F.regexp_extract_all(s, F.lit(p), 1) for p in _DATES]))
            low = x["low"]
            skip = has(low, REF) & ~has(low, "tanggal|date|waktu|time")
            labelled = has(low, near)
            # What each test weighs.
            line_score = 50 + total_of([
                (labelled, 50), (~labelled & has(around(f, i, -2, 2), near + "|transaksi|transaction|payment|pembayaran"), 35), (i <= F.greatest(F.lit(3), F.floor(n / 4)), 15),
                ((i > F.greatest(F.lit(3), F.floor(n / 4))) & (i <= F.greatest(F.lit(6), F.floor(n / 2))), 8), (has(low, r"\b\d{1,2}[:.]\d{2}(:\d{2})?\b"), 8), (has(low, r"[a-z0-9]{5,}-[a-z0-9-]{4,}"), -60),
            ])
            made = lambda found: let(line_score, lambda s: F.transform(found, lambda r, k: F.struct((s + F.when(has(r, "[A-Za-z]{3,}"), 20).otherwise(0)).alias("score"), (-i).alias("line"), (-k).alias("place"), dates.parsed(r).alias("value"), has(r, "[A-Za-z]{3,}").alias("named"))))
            # Most lines have none, and then nothing else is asked of them.
            none = F.array().cast("array<struct<score:int,line:int,place:int,value:string,named:boolean>>")
            return F.when(has(x["norm"], _DATED), let(found, lambda r: F.when((F.size(r) == 0) | skip, none).otherwise(F.filter(made(r), lambda c: c["value"] != "")))).otherwise(none)

        best = F.array_max(F.flatten(F.transform(f, of_line)))
        sure = lambda b: F.when(b["named"], 0.92).when(b["score"] >= 90, 0.80).otherwise(0.65)
        none = F.struct(F.lit("").alias("value"), F.lit(0.0).alias("confidence"), F.lit(0).alias("score"))
        return let(best, lambda b: F.when(b.isNull(), none).otherwise(F.struct(b["value"].alias("value"), sure(b).alias("confidence"), b["score"].alias("score"))))

    return pick(f)


_MONEY = r"(?i)((?:\b(?:rp|idr|cad|usd|aud|sgd|eur|gbp)\b\.?\s*)?[$€£]?\s*(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+[.,]\d{1,2}|\d{4,}))"


def amounts(line: Column) -> Column:
    """Values of all amounts of a repaired line; those with a foreign currency and no rupiah keep decimals."""
    found = F.when(line.rlike(r"\d(?:[.,]\d|\d{3})"), F.regexp_extract_all(trimmed_amount(line), F.lit(_MONEY), 1)).otherwise(F.when(line.isNotNull(), F.array().cast("array<string>")))
    foreign = lambda r: has(r, r"(?i)\b(cad|usd|aud|sgd|eur|gbp)\b|[$€£]") & ~has(r, r"(?i)\b(rp|idr)\b")
    return F.filter(F.transform(found, lambda r: let(~foreign(r), lambda rupiah: money.token(r, rupiah, F.lit(False)))), lambda v: v.isNotNull())


def tier(low: Column) -> Column:
    return F.when(has(low, TIER3), 3).when(has(low, TIER1), 1).when(has(low, TIER2), 2).otherwise(0)


_CANDIDATE = "array<struct<score:int,line:int,value:double,explicit:boolean>>"
_TRACED = "array<struct<score:int,line:int,value:double,explicit:boolean,reasons:array<string>>>"


def _confident(best: Column, steps: tuple[tuple[int, float], ...], least: float) -> Column:
    out = F.lit(least)
    for score, c in reversed(steps):
        out = F.when(best["score"] >= score, c).otherwise(out)
    none = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("confidence"), F.lit(0).alias("score"))
    return F.when(best.isNull(), none).otherwise(F.struct(best["value"].alias("value"), out.alias("confidence"), best["score"].alias("score")))


def _receipt_candidates(f: Column, traced: bool = False) -> Column:
    """Every amount that a receipt may ask for, as _CANDIDATE; with ``traced``, each also has its ``reasons``: the tests that hold, with what they weigh."""
    n = F.size(f)
    kind_of = _TRACED if traced else _CANDIDATE

    def scored(i: Column, base: int, next_line: bool, total_there: Column) -> Column:
        x = F.get(f, i)
        low, kind = x["low"], x["tier"]

        def tests(near: Column) -> Column:
            """What holds of the line and of those around it, once for all of its amounts."""
            before, with_change = near["before"], near["with_change"]
            total, due, final, noise = has(low, TOTAL), has(low, DUE), has(low, FINAL), has(low, NOISE)
            digits = F.length(F.regexp_replace(x["norm"], r"\D", ""))
            only_paid = has(low, r"\b(tunai|cash|debit|credit|qris|payment|paid|lunas|tender|bayar)\b") & ~total & ~due & ~has(low, r"\b(total\s+bayar|jumlah\s+bayar|total\s+payment|total\s+paid|paid\s+amount)\b")
            cash = has(low, CASH) & has(around(f, i, -3, 3), CHANGE)
            one, two = F.coalesce(F.get(f, i - 2)["low"], F.lit("")), F.coalesce(F.get(f, i - 1)["low"], F.lit(""))
            flag = lambda t: F.when(has(t, CHANGE), -500).when(has(t, CASH) & with_change, -200).otherwise(0)
            back = F.when(flag(one) != 0, flag(one)).otherwise(flag(two))
            held = {
                "due": due, "total": total, "amount": has(low, r"\b(amount|jumlah|tagihan|nominal)\b"), "final": final, "change": has(low, CHANGE), "noise": noise, "url": has(low, URL), "after_url": has(before, URL),
                "after_noise": has(before, NOISE), "only_paid": only_paid, "cash": cash, "back": back, "ref": has(low, REF), "long": (digits > 8) & ~final, "very": digits > 10,
            }
            return F.struct(*[test.alias(name) for name, test in held.items()])

        def weighed(h: Column) -> Column:
            due, total, amount, final, change, noise, url, back_url = (h[k] for k in ("due", "total", "amount", "final", "change", "noise", "url", "after_url"))
            cash, back, ref, long, very = (h[k] for k in ("cash", "back", "ref", "long", "very"))
            # What each test weighs.
            rules = {
                "due": (due, 200), "total": (total, 120), "amount": (amount, 80), "paid, no total": ((kind == 2) & ~total_there, 50), "paid": ((kind == 2) & total_there, 15), "only paid": (total_there & h["only_paid"], -180),
                "part": ((kind == 3) & total_there, -150), "part, no total": ((kind == 3) & ~total_there, -60), "change": (change, -500), "noise, final": (noise & final, -120), "noise": (noise & ~final, -900),
                "after noise": (h["after_noise"] & ~has(low, r"\b(grand\s+total|total|amount\s+due|total\s+due|balance\s+due|due|bayar|tunai)\b"), -450), "url": (url, -900), "after url": (back_url, -650), "long": (long, -650),
                "very long": (very & ~final, -700), "very long, final": (very & final, -250), "cash": (cash, -200), "reference": (ref, -120), "quantity": (has(low, QUANTITY), -150), "item": (has(x["norm"], r"^\s*\d+\s+[A-Za-z]") & (kind == 0), -120),
                "words": (has(low, "[a-z]{3,}") & (kind == 0) & ~has(low, r"\b(rp|idr)\b"), -70), "date": (has(x["norm"], DAY), -100), "low down": (i >= F.floor(n * 0.6), 25),
            }
            named = (due | total | amount | F.lit(next_line)) & (kind != 3) & ~change & (back == 0) & ~cash & ~ref & ~(noise & ~final) & ~url & ~back_url & ~long & ~very
            lead = [F.lit(f"line above {base:+d}" if next_line else f"its own line {base:+d}"), F.when(back != 0, F.concat(F.lit("below change "), back.cast("string")))]
            said = [F.when(test, f"{name} {weight:+d}") for name, (test, weight) in rules.items()]
            reasons = [F.array_compact(F.array(*lead, *said)).alias("reasons")] if traced else []
            return F.struct((base + back + total_of(list(rules.values()))).alias("fixed"), named.alias("named"), final.alias("final"), *reasons)

        def each(s: Column) -> Column:
            small = lambda v: (v < 1000) & ~s["final"]
            more = (lambda v: [F.concat(s["reasons"], F.when(small(v), F.array(F.lit("small -250"))).otherwise(F.array().cast("array<string>"))).alias("reasons")]) if traced else (lambda _: [])
            return F.transform(x["values"], lambda v: F.struct((s["fixed"] + F.when(small(v), -250).otherwise(0)).alias("score"), i.cast("int").alias("line"), v.alias("value"), s["named"].alias("explicit"), *more(v)))

        near = F.struct(around(f, i, -2, -1).alias("before"), has(around(f, i, -4, 1), CHANGE).alias("with_change"))
        return F.when(F.size(x["values"]) == 0, F.array().cast(kind_of)).otherwise(let(let(let(near, tests), weighed), each))

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    same = lambda total_there: F.flatten(F.transform(places, lambda i: scored(i, 30, False, total_there)))

    def ahead(i: Column) -> Column:
        first = F.coalesce(*[F.when(F.size(F.get(f, i + k)["values"]) > 0, i + k) for k in range(1, 5)])
        alone = (F.get(f, i)["tier"] == 1) & (F.size(F.get(f, i)["values"]) == 0) & first.isNotNull()
        return F.when(alone, let(first, lambda j: scored(j, 60, True, F.lit(True)))).otherwise(F.array().cast(kind_of))

    return F.concat(let(F.exists(f, lambda x: x["tier"] == 1), same), F.flatten(F.transform(places, ahead)))


def _best_amount(candidates: Column) -> Column:
    """The highest of those that a word names, where there are any; else of all."""
    return let(F.filter(candidates, lambda x: x["explicit"]), lambda explicit: F.array_max(F.when(F.size(explicit) > 0, explicit).otherwise(candidates)))


def receipt_amount(f: Column) -> Column:
    """(value, confidence, score) of what a receipt asks to be paid."""
    sure = lambda c: _confident(_best_amount(c), ((200, 0.92), (100, 0.82), (50, 0.65)), 0.45)
    return let(f, lambda f: let(_receipt_candidates(f), sure))


def amount_traces(documents: DataFrame, lines: str = "lines", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep``, and for every candidate of a receipt's amount its line, text, value, score, reasons, and whether it is the one taken."""
    of = F.coalesce(F.col(lines), F.array().cast("array<string>"))
    line = lambda x: let(fixed_digits(x), lambda norm: F.struct(norm.alias("norm"), F.lower(norm).alias("low"), tier(F.lower(norm)).alias("tier"), amounts(norm).alias("values")))
    found = spread(documents.select(*keep, of.alias("_l"))).select(*keep, "_l", let(F.transform("_l", line), lambda f: _receipt_candidates(f, True)).alias("_c"))
    each = found.select(*keep, "_l", _best_amount(F.col("_c")).alias("_b"), F.explode("_c").alias("c"))
    return each.select(*keep, "c.line", F.get("_l", F.col("c.line")).alias("text"), "c.value", "c.score", "c.explicit", "c.reasons", (F.col("c") == F.col("_b")).alias("taken"))


def screen_amount(f: Column, kind: Column) -> Column:
    """(value, confidence, score) of a payment screen's amount."""
    n, compact = F.size(f), kind == "compact_qr_card"
    empty = F.array().cast(_CANDIDATE)

    def scored(i: Column, base: int, found: Column) -> Column:
        near = F.struct(around(f, i, -2, -1).alias("before"), around(f, i, -2, 2).alias("window"))
        return F.when(F.size(found) == 0, empty).otherwise(let(near, lambda w: beside(i, base, found, w["before"], w["window"])))

    def beside(i: Column, base: int, found: Column, before: Column, window: Column) -> Column:
        x = F.get(f, i)
        low = x["tlow"]
        rp = has(low, r"\b(rp|idr)")
        third, half = F.greatest(F.lit(3), F.floor(n / 3)), F.greatest(F.lit(5), F.floor(n / 2))
        artifact = has(x["raw"], r"\d+[.,]\d{4,}") | (compact & has(x["norm"], r"\b\d{3}[.,]00[1-9]\b"))
        # What each test weighs.
        fixed = base + total_of([
            (has(low, SCREEN_REJECT), -120), (has(before, SCREEN_REJECT) & ~has(window, MAIN), -140), (has(low, REF), -120),
            (has(window, r"\b(customer\s+pan|merchant\s+pan|terminal\s+id|reference|transaction\s+id|source\s+of\s+fund|rekening|account)\b") & ~has(window, r"\b(rp|idr|total|nominal|jumlah|amount|bayar)\b"), -100),
            (has(low, DAY + r"|\b\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}\b"), -100), (F.regexp_replace(low, "[.,]", "").rlike(r"\b\d{10,}\b"), -80),
            ((F.length(F.regexp_replace(low, r"\D", "")) >= 10) & ~rp, -220), (has(low, MAIN), 70), (~has(low, MAIN) & has(before, MAIN), 55), (has(low, r"(^|[\s(])\s*[-–—]?\s*(rp|idr)"), 50), (has(low, r"[-–—]\s*(rp|idr)"), 30),
            (has(low, r"\b(biaya\s+admin|admin\s+fee|saldo|balance)\b"), -60), (i <= third, 40), ((i > third) & (i <= half), 20), (compact & (i <= F.greatest(F.lit(4), F.floor(n / 2))), 30),
            (compact & has(low, r"\b(qr\s+bayar|pembayaran\s+qr|pembayaran\s+qris|total|jumlah|nominal)\b"), 35), (compact & rp, 20), (artifact, -10),
        ])
        return let(F.struct(fixed.alias("s"), artifact.alias("a")), lambda y: F.transform(found, lambda v: F.struct(y["s"].alias("score"), F.lit(0).alias("line"), v.alias("value"), y["a"].alias("explicit"))))

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    same = F.flatten(F.transform(places, lambda i: scored(i, 80, F.get(f, i)["rupiah"])))
    # After a word for the amount, the first of three lines with one: with a currency, else grouped digits.
    either = lambda j: F.when(F.size(F.get(f, j)["rupiah"]) > 0, F.get(f, j)["rupiah"]).otherwise(F.coalesce(F.get(f, j)["grouped"], F.array().cast("array<double>")))
    first = lambda i: F.coalesce(*[F.when(F.size(either(i + k)) > 0, i + k) for k in (1, 2, 3)])
    ahead = F.flatten(F.transform(places, lambda i: F.when(has(F.get(f, i)["tlow"], MAIN), F.coalesce(let(first(i), lambda j: F.when(j.isNotNull(), scored(j, 65, either(j)))), empty)).otherwise(empty)))
    rated = lambda b: let(_confident(b, ((150, 0.90), (90, 0.78), (40, 0.55)), 0.30), lambda r: F.struct(r["value"].alias("value"), F.when(b["explicit"], F.least(r["confidence"], F.lit(0.72))).otherwise(r["confidence"]).alias("confidence"), r["score"].alias("score")))
    return let(F.array_max(F.concat(same, ahead)), rated)


def trimmed_place(text: Column) -> Column:
    """A name without street, district and city tails; at most 55 characters, cut at a word."""
    mark = r"(?:jl\.?|ji\.?|jalan|ruko|komplek|perumahan|blok|rt\.?|rw\.?|kel\.?|kec\.?|kecamatan|kelurahan|kota|kab\.?|kabupaten|kode\s+pos|no\.?\s+\d|lt\.?|lantai)"
    ends = r"^[ ,.;:-]+|[ ,.;:-]+$"
    c = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), ends, "")
    c = F.regexp_replace(c, rf"(?i)\s*(?:;|\||/|\s-\s|,)\s*{mark}\b.*$", "")
    c = F.regexp_replace(c, r"(?i)\s+\b(?:jl\.?|ji\.?|jalan|rt\.?|rw\.?|kec\.?|kel\.?|kecamatan|kelurahan|kode\s+pos)\s+[A-Za-z0-9].*$", "")
    c = F.regexp_replace(c, rf"(?i)\s*,\s*(?:{CITIES})(?:\s+(?:barat|timur|utara|selatan|pusat))?\b.*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r",\s*\d{4,6}(?:\s*,?\s*[A-Z]{2})?\s*$", ""), ends, "")
    short = lambda c: F.regexp_replace(F.regexp_replace(F.substring(c, 1, 55), r"\s+\S*$", ""), ends, "")
    return let(c, lambda c: F.when((F.length(c) > 55) & (F.length(short(c)) >= 8), short(c)).otherwise(c))


def bad_merchant(text: Column) -> Column:
    """Labels, places, references, dates, times, amounts, codes and unpronounceable text."""

    def judge(s: Column) -> Column:
        low, numbered = F.lower(s), has(s, r"\d")
        letters, digits = F.length(F.regexp_replace(s, r"\P{L}", "")), F.length(F.regexp_replace(s, r"\D", ""))
        patterns = [
            ADDRESS, rf"^(?:{CITIES}|solo|palembang|balikpapan|banjarmasin|pontianak|manado|pekanbaru|padang|makassar|cimahi|tasikmalaya|cilegon|serang|jambi|id|idn|indonesia)$", r"https?://|www\.|\.com\b|\.co\.id\b|\.id\b|@[a-z0-9.-]+\.[a-z]{2,}",
            FOOTER, r"\b(rp|idr)\s*[0-9.,o]+\b|^[-–—]?\s*(rp|idr)\b", rf"^(?:{CITIES})\s*,?\s*id$", r"\b(kb/?s|kbis|mb/?s|mbps)\b",
        ]
        # Asked only where a digit is.
        with_digits = [WRITTEN_DAY, r"^\+?\d[0-9\s-]{7,}$", DAY, r"\b\d{1,2}[:.]\d{2}(:\d{2})?\b", r"^[a-z][a-z\s]+,\s*\d{4,6}\s*,?\s*(?:[a-z]{2})?\s*$", r"\d+\s*%\s*$|^\d[0-9.,]+\s*kb"]
        coded = (has(low, r"^[a-z0-9]{3,12}(?:-[a-z0-9]{2,12}){1,4}$") & (letters > 0) & (digits > 0)) | (has(s, "^[A-Z0-9]{6,}$") & (digits > 0)) | has(s, r"^[A-Z]{1,3}\d{1,4}$")
        few = (letters >= 6) & (F.length(F.regexp_replace(low, "[^aeiou]", "")) <= 1)
        so = coded | ((digits >= 10) & (digits / F.greatest(F.length(s), F.lit(1)) > 0.55)) | (has(low, r"^\d+\s+") & has(low, r"\b(qr\s+bayar|pembayaran|berhasil)\b"))
        for p in with_digits:
            so = so | has(low, p)
        out = (F.length(s) < 2) | low.isin(*LABELS) | has(s, REF) | (numbered & so) | few
        for p in patterns:
            out = out | has(low, p)
        return out

    return let(F.trim(F.coalesce(text, F.lit(""))), judge)


def item_line(line: Column) -> Column:
    low = F.lower(line)
    few_words = F.size(F.regexp_extract_all(low, F.lit("([a-z]+)"), 1)) <= 5
    return (
        has(low, QUANTITY) | has(line, r"^\s*\d+\s+[A-Za-z]") | (has(low, r"\b\d{1,3}[.,]\d{3}\b") & ~has(low, r"\b(grand\s+total|total|amount\s+due|total\s+due|balance\s+due|due|bayar|tunai)\b"))
        | (has(low, r"\d[.,]\d{3}\s*$") & low.rlike(r"[a-z]{3,}.*\b\d{1,3}[.,]\d{3}\s*$")) | (has(low, r"0\s*$") & low.rlike(r"[a-z]{3,}.*\s+0(?:\.0+)?\s*$")) | (has(low, ITEM_WORD) & ~has(low, CUE) & few_words)
    )


def canonical(name: Column) -> Column:
    """The popular merchant that a name's key, its first word's key or a part of it is, else the name; misread keys are for ``misread`` and ``corrected``."""
    def find(d: Column) -> Column:
        s, key, first, keys = d["s"], d["key"], d["first"], POPULAR_KEYS
        whole = lambda x: F.when(x.isin(*keys), choice(x, keys, F.lit(None).cast("string")))
        part = F.when(has(key, "|".join(k for k in keys if len(k) >= 5)), F.coalesce(*[F.when(F.contains(key, F.lit(k)), m) for k, m in keys.items() if len(k) >= 5]))
        return F.coalesce(whole(key), whole(first), part, s)

    keyed = lambda s: F.struct(s.alias("s"), merchant_key(s).alias("key"), merchant_key(F.element_at(F.split(F.concat(s, F.lit(" ")), " "), 1)).alias("first"))
    return let(let(trimmed_place(name), keyed), find)


def misread(names: Column) -> Column:
    """For each of an array of names the popular merchant that it likely misspells, else null: an array of nulls for most documents, told by lengths.

    Three digits that stand for no letter leave no name of at most nine letters as like as that.
    """
    longest = max(map(len, POPULAR_KEYS)) * 1.12 / 0.88
    tried = lambda p: let(merchant_key(p), lambda k: F.when(F.length(k).between(6, int(longest)) & ~k.rlike("[2-9](?:[^2-9]*[2-9]){2}") & ~canonical(p).isin(*POPULAR_MERCHANTS), misread_popular(k)))
    return F.transform(names, lambda x: let(trimmed_place(x), tried))


def is_known(name: Column) -> Column:
    return canonical(name).isin(*POPULAR_MERCHANTS)


def corrected(names: DataFrame, column: str = "merchant") -> DataFrame:
    """``names`` with ``corrected``: the popular merchant that a name is or is likely a misreading of, else the name. Distinct names are read once and joined back."""
    return by_distinct(names, column, "corrected", lambda x: F.coalesce(F.get(misread(F.array(x)), F.lit(0)), canonical(x)))


#: The most lines of a receipt's head; in them its name is looked for, also misspelled.
HEAD = 10


def _head(n: Column) -> Column:
    """How many of a receipt's ``n`` lines may hold its name."""
    return F.least(n, F.greatest(F.lit(3), F.least(F.lit(HEAD), F.floor((n + 3) / 4).cast("int"))))


def receipt_merchant(f: Column) -> Column:
    """(value, confidence) of the name above a receipt's items."""
    n = F.size(f)
    top = _head(n)
    kinds = F.transform(F.slice(f, F.lit(1), top + 2), lambda x, i: F.when(has(x["low"], "subtotal|sub total|total|tax|ppn|pb1|service|tunai|qty"), F.greatest(F.lit(0), i - 2)).when(has(x["low"], r"\b(item|price|amount)\b") | x["item"], i))
    start = F.coalesce(F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0)), n)
    heads = "subtotal|total|tax|ppn|pb1|service|tunai|payment|debit|qris|qty|cashier|kasir|operator|receipt|rcpt|table|guest|shopping|groceries|category|belanja|folio|account statement|your account|satisfaction|reservations|return policy|our pleasure|hope you|unhappy|important to us"
    function_word = r"\b(your|our|the|and|but|are|were|will|have|has|with|for|that|this|from|they|you|we|it|not|any|all|been|may|if|of|to|in|is|or)\b"

    def candidate(x: Column, i: Column) -> Column:
        s, low, name = F.trim(x["raw"]), F.lower(F.trim(x["raw"])), x["name"]
        said, many = F.regexp_count(low, F.lit(function_word)), F.size(F.regexp_extract_all(low, F.lit("([a-z]+)"), 1))
        sentence = ((said >= 3) & (many > 3)) | ((said >= 2) & (many <= 4))
        letters, digits, vowels = F.length(F.regexp_replace(s, r"\P{L}", "")), F.length(F.regexp_replace(s, r"\D", "")), F.length(F.regexp_replace(low, "[^aeiou]", ""))
        plain = ~x["known"] & ~has(low, CUE) & ((many == 1) | (letters <= 4) | has(low, ITEM_WORD))
        below = F.get(f, i + 1)
        price_below = F.coalesce(~has(below["raw"], "[A-Za-z]") & (F.size(below["values"]) > 0) & ~has(below["low"], DAY), F.lit(False))
        bad = (
            (F.length(s) < 3) | (F.length(s) > 60) | has(low, ADDRESS) | has(low, heads) | has(low, r"http|www\.|@|\.com|\brece\b|\breceip[a-z]{0,3}\b") | ~has(s, "[A-Za-z]{3,}") | s.endswith(":")
            | sentence | (x["bad"] & ~x["known"]) | (x["item"] & ~x["known"]) | plain | price_below
        )
        # What each test weighs.
        score = 100 - 8 * i + total_of([(i <= 2, 30), (digits > letters, -40), ((letters >= 5) & (vowels >= 2), 10)])
        return F.struct(F.when(bad, -1000).otherwise(score).alias("score"), (-i).alias("line"), name.alias("value"))

    best = F.array_max(F.transform(F.slice(f, F.lit(1), F.greatest(F.lit(0), F.least(top, start))), candidate))
    none = F.struct(F.lit(NOT_FOUND).alias("value"), F.lit(0.20).alias("confidence"))
    return let(best, lambda b: F.when(b.isNull() | (b["score"] < 30), none).otherwise(F.struct(b["value"].alias("value"), F.when(b["score"] >= 80, 0.88).when(b["score"] >= 50, 0.70).otherwise(0.45).alias("confidence"))))


def _good(raw: Column) -> Column:
    """A cleaned recipient, or null where it can't be one."""
    c = F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), r"^[ :;-]+|[ :;-]+$", "")
    c = F.regexp_replace(c, r"(?i)^(?:ke|to)\s+", "")
    c = F.regexp_replace(c, r"(?i)^(?:bayar\s+ke|pembayaran\s+ke|payment\s+to|paid\s+to|pembayaran\s+qr\s+ke|qr\s+bayar\s+ke|penerima)\s*[:\-]?\s*", "")
    c = F.regexp_replace(c, r"(?i)^(?:merchant|nama\s+merchant|nama\s+toko|nama\s+usaha|acquirer(?:\s+name)?|terminal\s+id|customer\s+pan|merchant\s+pan)\s*[:\-]\s*", "")
    c = F.regexp_replace(F.regexp_replace(c, r",\s*\d{6,}.*$", ""), r"\s+\d{8,}.*$", "")
    return let(trimmed_place(c), lambda c: F.when((F.length(c) >= 2) & ~bad_merchant(c), c))


#: Recipients named within a line, in the order in which they are tried.
_WITHIN = (r"(?i)^\s*ke\s+(.+)", r"(?i)(?:pembayaran\s+qr|qr\s+bayar)\s+ke\s+(.+)", r"(?i)payment\s+to\s+(.+)", r"(?i)(?:bayar\s+ke|kepada|penerima)\s*[:\-]?\s*(.+)")
_LABEL = r"\b(transaction|transaksi|details?|rincian|date|tanggal|time|waktu|payment method|metode pembayaran|source of fund|sumber dana|customer pan|merchant pan|terminal id|acquirer|status|share|bagikan)\b"
_ANCHOR = r"bayar ke|bayar kepada|payment to|pembayaran ke|merchant|nama toko|nama usaha|penerima|kepada|tujuan|recipient|paid to|store|diterima oleh"
_SKIP = r"^\s*([0-9:.,\s]+(wib|wita|wit|am|pm)?|[-–—]?\s*(?:rp|idr)\.?\s*[0-9.,o]+|[0-9.,]+\s*(?:kb/?s|kbis|mb/?s|mbps|%)|qris|qr\s+bayar|qr\s*code|pembayaran\s*(?:berhasil|qr)?|transaksi\s*berhasil|transaction\s*details?|rincian.*)\s*$"


def features(lines: Column, qr: Column, screen: Column, likely: Column) -> Column:
    """What each line holds: itself, repaired and in lower case; its amounts and their rank; in a receipt's head whether it names a merchant and which.

    likely: by place, the popular merchant that a line misspells, or null.

    qr: a compact QR text; screen: a payment screen. Fields that only receipts or only screens need are null for the other.
    """
    rupiah = r"(?i)(?:rp\.?|idr)\s*([0-9oilsb][0-9oilsb.,\s]*)"
    large = lambda found: F.filter(F.transform(found, lambda r: money.token(r, F.lit(True), qr)), lambda v: v.between(1000, 1e9))

    def of(y: Column, i: Column) -> Column:
        raw, norm, low, t = y["raw"], y["norm"], y["low"], y["t"]
        head = ~screen & (i < y["top"])
        return F.struct(
            raw.alias("raw"), norm.alias("norm"), low.alias("low"), F.lower(t).alias("tlow"), F.when(~screen, tier(low)).alias("tier"), F.when(~screen, amounts(norm)).alias("values"), F.when(screen, large(F.regexp_extract_all(t, F.lit(led(rupiah)), 1))).alias("rupiah"),
            F.when(screen, large(F.regexp_extract_all(t, F.lit(led(r"\b(\d{1,3}(?:[.,]\d{3})+)\b")), 1))).alias("grouped"), F.when(~screen & (i < y["top"] + 2), item_line(raw)).alias("item"), F.when(head, bad_merchant(raw)).alias("bad"), y["name"].alias("name"), F.when(head, F.get(likely, i).isNotNull() | y["name"].isin(*POPULAR_MERCHANTS)).alias("known"),
        )

    def basic(x: Column, i: Column, top: Column) -> Column:
        name = F.when(~screen & (i < top), F.coalesce(F.get(likely, i), canonical(x)))
        # Most lines have no surplus digits to lose.
        shown = lambda norm: F.when(screen, F.when(x.rlike(r"\.\d{4}"), fixed_digits(trimmed_amount(x))).otherwise(norm))
        return let(fixed_digits(x), lambda norm: F.struct(x.alias("raw"), norm.alias("norm"), F.lower(norm).alias("low"), shown(norm).alias("t"), name.alias("name"), top.alias("top")))

    every = F.coalesce(lines, F.array().cast("array<string>"))
    return F.transform(let(_head(F.size(every)), lambda top: F.transform(every, lambda x, i: basic(x, i, top))), of)


def first(a: Column) -> Column:
    """The first of an array that isn't null."""
    return F.get(F.filter(a, lambda v: v.isNotNull()), F.lit(0))


def below(f: Column, asks: Callable[[Column, Column], Column], k: int, value: Callable[[Column], Column]) -> Column:
    """The different texts that ``value`` makes of the ``k`` lines below each line of ``f`` that asks, in order; it is made once of a line, and only where one above it asks."""

    def made(flags: Column) -> Column:
        return let(_under(f, flags, k, value), lambda v: F.array_distinct(F.flatten(F.transform(flags, lambda t, i: F.when(t, F.array_compact(F.slice(v, i + 2, F.lit(k)))).otherwise(empty)))))

    empty = F.array().cast("array<string>")
    return let(F.transform(f, asks), lambda flags: F.when(F.exists(flags, lambda t: t), made(flags)).otherwise(empty))


def _under(f: Column, flags: Column, k: int, value: Callable[[Column], Column]) -> Column:
    """``value`` of each line with a flag on one of the ``k`` above it, else null."""
    asked = lambda j: F.exists(F.slice(flags, F.greatest(j - k, F.lit(0)) + 1, F.least(j, F.lit(k))), lambda t: t)
    return F.transform(f, lambda x, j: F.when(asked(j), value(x)))


def screen_merchant(f: Column, kind: Column) -> Column:
    """(value, confidence) of whom a payment went to: ordered strategies, the first that finds a name."""
    n, compact, detail = F.size(f), kind == "compact_qr_card", kind == "mbanking_transaction_detail"
    money = lambda x: has(x["low"], r"(rp|idr)\.?\s*[0-9.,oilsb]")
    label = lambda x: (F.trim(x["raw"]) == "") | F.lower(F.trim(x["raw"])).isin(*LABELS) | has(x["raw"], REF) | has(x["low"], _LABEL)
    readable = lambda x: F.when(~money(x) & (F.length(F.trim(x["raw"])) <= 70) & x["raw"].rlike("[A-Za-z]{3,}") & ~label(x), _good(x["raw"]))
    names = lambda a: F.filter(a, lambda v: v.isNotNull())
    named = lambda v, c: F.struct(v.alias("value"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    found = lambda column, c: let(column, lambda v: F.when(v.isNotNull(), named(v, c(v) if callable(c) else c)))

    # The title of a detail page: up to two readable lines after the first amount.
    opens = F.transform(f, lambda x, i: (i < F.greatest(F.lit(8), F.floor(n / 2))) & money(x))
    joined = lambda v: F.nullif(F.array_join(F.slice(names(v), 1, 2), " "), F.lit(""))
    title = let(opens, lambda o: let(_under(f, o, 4, readable), lambda v: first(F.transform(o, lambda t, i: F.when(t, joined(F.slice(v, i + 2, F.lit(4))))))))
    card = F.array_max(F.transform(names(F.transform(F.slice(f, 1, 10), readable)), lambda v: F.struct(F.size(F.split(v, " ")).alias("w"), F.length(v).alias("l"), v.alias("v"))))["v"]

    # What the other strategies try, in order: texts, how sure a name there is, and whether the text itself must be none that is bad.
    attempt = "array<struct<raw:string,sure:double,strict:boolean>>"
    as_tried = lambda texts, c, strict: F.transform(texts, lambda x: F.struct(x.alias("raw"), F.lit(c).alias("sure"), F.lit(strict).alias("strict")))

    def within(x: Column) -> Column:
        raw, said = x["raw"], F.lit(None)
        for p, c in reversed(list(zip(_WITHIN, (F.when(compact, 0.84).otherwise(0.76), F.lit(0.88), F.lit(0.88), F.lit(0.85)), strict=True))):
            said = F.when(has(raw, p), F.struct(F.regexp_extract(raw, p, 1).alias("raw"), c.alias("sure"), F.lit(False).alias("strict"))).otherwise(said)
        return said

    def tried(k: Column) -> Column:
        # A QR title, then an amount, then the name on a line of its own.
        opening = F.array_position(F.transform(f, lambda x: has(x["low"], r"\b(qr\s+bayar|pembayaran\s+qr)\b")), F.lit(True))
        after = lambda at: F.slice(f, F.greatest(at, F.lit(0)).cast("int") + 1, F.lit(5))
        alone = lambda x: ~has(x["low"], "rp|idr|qr|bayar|pembayaran|berhasil|transaksi|rincian|detail|^ke$|^to$") & x["raw"].rlike("[A-Za-z]{4,}")
        following = let(opening, lambda at: F.when(at > 0, F.transform(F.filter(after(at), alone), lambda x: x["raw"])).otherwise(F.array().cast("array<string>")))
        anchored = below(f, lambda x, _: has(x["low"], _ANCHOR), 7, lambda y: y["raw"])
        free = F.transform(F.filter(f, lambda x: ~has(x["low"], _SKIP) & x["raw"].rlike("[A-Za-z]{3,}")), lambda x: x["raw"])
        caps = lambda texts: F.filter(texts, lambda x: (F.upper(x) == x) & x.rlike("[A-Z]"))
        last = let(free, lambda texts: F.concat(as_tried(caps(texts), 0.72, True), as_tried(texts, 0.55, True)))
        return (
            F.when(k == 0, F.array_compact(F.transform(f, within)).cast(attempt)).when(k == 1, as_tried(following, 0.80, False).cast(attempt)).when(k == 2, as_tried(anchored, 0.82, True).cast(attempt)).otherwise(last.cast(attempt))
        )

    def judged(c: Column) -> Column:
        return found(F.when(~(c["strict"] & bad_merchant(c["raw"])), _good(c["raw"])), lambda _: c["sure"])

    none = F.lit(None).cast("struct<value:string,confidence:double>")
    one = lambda k: F.aggregate(tried(k), none, lambda got, c: F.when(got.isNull(), judged(c)).otherwise(got))
    # Texts are judged until one is a name: most strategies aren't asked.
    others = F.aggregate(F.sequence(F.lit(0), F.lit(3)), none, lambda got, k: F.when(got.isNull(), one(k)).otherwise(got))
    return F.coalesce(
        F.when(detail, found(title, lambda v: F.when(F.size(F.split(v, " ")) >= 2, 0.86).otherwise(0.62))), F.when(detail, found(card, 0.74)), others, named(F.lit(NOT_FOUND), 0.20),
    )


def kept_merchant(found: Column, existing: Column, screen: Column) -> Column:
    """(value, confidence): the merchant found, or one that an earlier reading gave where that is valid and the found one invalid, weak or shorter."""
    name = trimmed_place(existing)
    count = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    valid = (F.coalesce(existing, F.lit("")) != "") & ~bad_merchant(existing) & (F.coalesce(name, F.lit("")) != "") & ~bad_merchant(name)
    fuller = (found["confidence"] < 0.72) & (count(name) > count(found["value"])) & (F.length(name) >= F.length(found["value"]))
    weak = bad_merchant(found["value"]) | (found["value"] == NOT_FOUND) | (found["confidence"] < 0.55) | fuller
    return F.when(valid & weak, F.struct(name.alias("value"), F.greatest(found["confidence"], F.when(screen, 0.62).otherwise(0.50)).alias("confidence"))).otherwise(found)


#: What a reading warns of.
UNSURE = (("merchant", "Merchant belum terdeteksi. Periksa dan isi manual."), ("amount", "Nominal tidak yakin. Periksa kembali."), ("date", "Tanggal tidak terdeteksi. Isi manual."))
FOREIGN = ("Mata uang non-IDR terdeteksi (", "). Nominal ditampilkan dalam mata uang asli.")
REVIEW = "Beberapa data perlu diperiksa kembali."


def warnings(currency: Column, confidences: dict[str, Column]) -> Column:
    lowest = F.least(*confidences.values())
    return F.array_compact(F.array(
        F.when(currency != "IDR", F.concat(F.lit(FOREIGN[0]), currency, F.lit(FOREIGN[1]))), *[F.when(confidences[k] < 0.45, F.lit(text)) for k, text in UNSURE], F.when(lowest < 0.55, F.lit(REVIEW)),
    ))


def extract(documents: DataFrame, lines: str = "lines", by: Callable[[Column], Column] = route, existing: tuple[str, str, str] | None = None, app_label: str | None = None, model_total: str | None = None) -> DataFrame:
    """``documents`` with document_type, route, merchant, amount, date, currency, their confidences, warnings, status and category.

    existing: columns of an earlier reading (merchant, amount, date), which stand where this one finds nothing or less;
    app_label: a column of the category that the app itself shows; model_total: one of what a vision model read as a receipt's total.
    """
    return _extract(spread(documents), lines, by, existing, app_label, model_total)


def _extract(documents: DataFrame, lines: str, by: Callable[[Column], Column], existing: tuple[str, str, str] | None, app_label: str | None, model_total: str | None) -> DataFrame:
    """``extract`` of rows that are spread."""
    from .categorize import chain, status

    of = F.coalesce(F.col(lines), F.array().cast("array<string>"))
    low = F.lower(F.array_join(of, "\n"))
    read = documents.withColumns({"document_type": document_type(of), "_q": has(low, "qr bayar|pembayaran qr")}).withColumn("_r", _route_of(F.col("document_type"), of) if by is route else by(of))
    screen, kind = F.col("_r.route") == "screenshot", F.col("document_type")
    was, had, day = map(F.col, existing) if existing else (F.lit(None).cast("string"), F.lit(0.0), F.lit(""))
    # Receipts' heads and the earlier merchant; nothing of other documents.
    heads = F.concat(F.when(~screen, F.slice(of, F.lit(1), _head(F.size(of)))).otherwise(F.array().cast("array<string>")), F.array(was))
    read = read.withColumn("_g", misread(heads)).withColumn("_f", features(of, F.col("_q"), screen, F.when(~screen, F.slice("_g", F.lit(1), F.size("_g") - 1)).otherwise(F.array().cast("array<string>"))))
    f = F.col("_f")
    read = read.withColumns({
        "_m": F.when(screen, screen_merchant(f, kind)).otherwise(receipt_merchant(f)), "_a": F.when(screen, screen_amount(f, kind)).otherwise(receipt_amount(f)), "_d": best_date(f),
        "currency": F.when(screen, "IDR").otherwise(money.currency(F.array_join(of, " "))),
    })
    if existing:
        none, labelled = F.col("_a.value") <= 0, has(low, "tanggal|date|waktu|time")
        stays = (F.col("_d.value") == "") & (F.coalesce(day, F.lit("")) != "") & ((kind != "compact_qr_card") | labelled)
        same = lambda value, sure, score: F.struct(value.alias("value"), sure.alias("confidence"), score.alias("score"))
        read = read.withColumns({
            "_m": kept_merchant(F.col("_m"), F.coalesce(F.element_at("_g", -1), canonical(was)), screen),
            "_a": F.when(none & (F.coalesce(had, F.lit(0.0)) > 0), same(had.cast("double"), F.lit(0.40), F.col("_a.score"))).otherwise(F.col("_a")),
            "_d": F.when(stays, same(day, F.when(kind == "compact_qr_card", 0.40).otherwise(0.50), F.col("_d.score"))).otherwise(F.col("_d")),
        })
    single = (F.size(F.split(F.col("_m.value"), " ")) == 1) & (F.col("_m.value") != NOT_FOUND)
    capped = F.when(F.col("currency") != "IDR", F.least(F.col("_a.confidence"), F.lit(0.65))).when(kind == "compact_qr_card", F.least(F.col("_a.confidence"), F.lit(0.80))).otherwise(F.col("_a.confidence"))
    out = read.withColumns({
        "route": F.col("_r.route"), "route_confidence": F.col("_r.confidence"), "merchant": F.col("_m.value"), "merchant_confidence": F.when(single, F.least(F.col("_m.confidence"), F.lit(0.55))).otherwise(F.col("_m.confidence")),
        "amount": F.col("_a.value"), "amount_confidence": capped, "date": F.col("_d.value"), "date_confidence": F.col("_d.confidence"),
    }).drop("_r", "_m", "_a", "_d", "_f", "_q", "_g")
    if model_total:
        beside = with_model_total(F.col("amount"), F.col("amount_confidence"), F.when(F.col("route") == "receipt", F.col(model_total)))
        out = out.withColumn("_t", beside).withColumns({"amount": F.col("_t.value"), "amount_confidence": F.col("_t.confidence")}).drop("_t")
    known = F.when(F.col("merchant") == NOT_FOUND, "").otherwise(F.col("merchant"))
    label = F.col(app_label) if app_label else F.lit(None).cast("string")
    category = chain(known, label, F.array_join(lines, " "), F.col("route") == "receipt", F.lit(False))
    sure = {k: F.col(f"{k}_confidence") for k in ("merchant", "amount", "date")}
    state = status(known, F.col("amount"), F.col("date"), F.col("route_confidence"), *sure.values())
    return out.withColumns({"warnings": warnings(F.col("currency"), sure), "status": state, "category": category["label"], "category_source": category["source"]})


def read_all(documents: DataFrame, lines: str = "lines", model_total: str | None = None) -> DataFrame:
    """``extract`` after the first reading of payment screens, whose fields stand where the second finds none; receipts have the second alone.

    model_total: a column of a vision model's total, which stands in for a receipt's missing amount and supports a weak one.
    ``public_type`` and ``type_label`` are what users see of the document's type.
    """
    from . import screens

    of = F.coalesce(F.col(lines), F.array().cast("array<string>"))
    routed = spread(documents).withColumn("_by", route(of))
    is_screen = F.col("_by.route") == "screenshot"
    only = F.when(is_screen, screens.merged(of)).otherwise(F.array().cast("array<string>"))
    first = routed.withColumn("_s", only).withColumns({"_em": screens.recipient(F.col("_s")), "_ea": screens.amount(F.col("_s")), "_ed": screens.date(F.col("_s")), "_ec": screens.shown_category(F.col("_s"))})
    first = first.withColumn(lines, F.when(is_screen, F.col("_s")).otherwise(of))
    out = _extract(first, lines, lambda _: F.col("_by"), ("_em", "_ea", "_ed"), "_ec", model_total).drop("_by", "_s", "_em", "_ea", "_ed", "_ec")
    shown = public_type(F.col("document_type"), F.col("route"))
    return out.withColumns({"public_type": shown["public"], "type_label": shown["label"]})


def public_type(internal: Column, fallback: Column) -> Column:
    """(public, label, internal): receipt, screenshot or unknown, by the internal type, else by the route."""
    kind = F.lower(F.trim(F.coalesce(internal, F.lit(""))))
    public = F.when(kind.isin(*SCREENSHOT_TYPES), "screenshot").when(kind.isin(*RECEIPT_TYPES), "receipt").when(fallback.isin("receipt", "screenshot"), fallback).otherwise("unknown")
    return F.struct(public.alias("public"), choice(public, DOCUMENT_LABELS, "").alias("label"), kind.alias("internal"))


def parsed_result(raw: Column) -> Column:
    """The one object that a vision model's JSON result holds, as JSON: itself, the first of a list with a total, else its first; text as raw_text; else {}."""
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    listed = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    text = lambda v: F.to_json(v)
    total = lambda v: F.coalesce(F.to_json(F.try_variant_get(v, "$.total", "variant")), F.lit("null"))
    filled = F.filter(listed, lambda v: ~total(v).isin("null", '""', "0", "0.0", "false", "{}", "[]"))
    return F.coalesce(
        F.when(kind.startswith("OBJECT"), text(value)), F.when(kind.startswith("ARRAY"), F.coalesce(text(F.get(filled, F.lit(0))), text(F.get(listed, F.lit(0))))),
        F.when(kind == "STRING", F.to_json(F.struct(F.try_variant_get(value, "$", "string").alias("raw_text")))), F.lit("{}"),
    )


def with_model_total(amount: Column, confidence: Column, model_total: Column) -> Column:
    """(value, confidence) of a receipt beside a vision model's total: it stands in for none at 0.70, and where both agree within 5 % a weak confidence grows by 0.15."""
    total = F.coalesce(money.token(model_total, F.lit(True), F.lit(False)), F.lit(0.0))
    agree = (amount > 0) & (total > 0) & (confidence < 0.65) & (F.abs(amount - total) / F.greatest(amount, F.lit(1.0)) < 0.05)
    made = lambda v, c: F.struct(v.alias("value"), c.cast("double").alias("confidence"))
    return F.when((amount <= 0) & (total > 0), made(total, F.lit(0.70))).when(agree, made(amount, F.least(F.lit(0.95), confidence + 0.15))).otherwise(made(amount, confidence))
