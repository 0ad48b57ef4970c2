"""Merchant names and labels: Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import CATEGORY_DISPLAY, POPULAR_MERCHANTS, SOURCE_LABELS
from .dates import let

#: Cities that trail merchant names.
CITIES = "bandung|jakarta|bekasi|tangerang|surabaya|depok|bogor|semarang|yogyakarta|jogja|medan|malang|denpasar|bali"
POPULAR_KEYS = {"".join(c for c in m.lower() if c.isalnum()): m for m in POPULAR_MERCHANTS}
_TRIM = r"^[ ,.;:-]+|[ ,.;:-]+$"


def words(texts: tuple[str, ...]) -> Column:
    """A literal array, parsed at once: a list of literals costs the driver several calls for each."""
    return F.expr("array(" + ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in texts) + ")")


def choice(key: Column, table: dict[str, str], default: Column | str) -> Column:
    out = F.lit(default) if isinstance(default, str) else default
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def category_display(category: Column) -> Column:
    return choice(category, CATEGORY_DISPLAY, F.initcap(F.replace(category, F.lit("_"), F.lit(" "))))


def source_label(source: Column) -> Column:
    return choice(source, SOURCE_LABELS, F.coalesce(source, F.lit("-")))


def ellipsis(name: Column, most: int = 48) -> Column:
    return F.when(F.length(name) > most, F.concat(F.rtrim(F.substring(name, 1, most - 3)), F.lit("..."))).otherwise(name)


def merchant_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def by_distinct(rows: DataFrame, column: str, name: str, body: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``name``, ``body`` of their text ``column``: made once for each distinct text and joined back, for texts that repeat."""
    of = rows.select(F.col(column).alias("_text")).distinct().withColumn(name, body(F.col("_text")))
    return rows.join(of, rows[column].eqNullSafe(of["_text"]), "left").drop("_text")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, _TRIM, "")


#: Popular names with their keys, as a literal array.
POPULAR = "array(" + ", ".join(f"named_struct('key', '{k}', 'name', '{m}')" for k, m in POPULAR_KEYS.items()) + ")"
#: From this likeness on a key is taken for a popular one's, if it has so many letters.
LIKE, LEAST_KEY = 0.88, 6


def likeness(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp likeness of two texts: twice the characters of their matching blocks over all characters, 1 for two empty ones.

    The longest common block, of equal ones the first in ``a`` and then in ``b``, splits both texts; what lies left and right
    of it is matched likewise. A fold over an array of open pairs does it, so nothing leaves the JVM. The cost grows with the
    cube of the length: ``may_be_like`` should be asked first.
    """

    def longest(x: Column, y: Column) -> Column:
        """(size, minus the place in x): a substring is common to every length up to its longest, so those that are, are counted."""
        sizes = lambda i: F.sequence(F.lit(1), F.least(F.length(x) - i + 1, F.length(y)))
        return F.array_max(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.struct(F.size(F.filter(sizes(i), lambda n: F.contains(y, F.substring(x, i, n)))).alias("size"), (-i).alias("back"))))

    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    full = lambda p: (p["x"] != "") & (p["y"] != "")

    def step(state: Column, _: Column) -> Column:
        def matched(head: Column) -> Column:
            def parts(best: Column) -> Column:
                block = F.substring(head["x"], -best["back"], best["size"])
                at = F.instr(head["y"], block)
                left = pair(F.substring(head["x"], F.lit(1), -best["back"] - 1), F.substring(head["y"], F.lit(1), at - 1))
                right = pair(F.substring(head["x"], -best["back"] + best["size"], F.length(head["x"])), F.substring(head["y"], at + best["size"], F.length(head["y"])))
                rest = F.slice(state["open"], F.lit(2), F.size(state["open"]))
                found = F.struct(F.concat(rest, F.filter(F.array(left, right), full)).alias("open"), (state["same"] + best["size"]).alias("same"))
                return F.when(best["size"] > 0, found).otherwise(F.struct(rest.alias("open"), state["same"].alias("same")))

            return let(longest(head["x"], head["y"]), parts)

        return F.when(F.size(state["open"]) > 0, let(F.get(state["open"], F.lit(0)), matched)).otherwise(state)

    both = F.length(a) + F.length(b)
    start = F.struct(F.filter(F.array(pair(a, b)), full).alias("open"), F.lit(0).alias("same"))
    steps = F.sequence(F.lit(0), 2 * F.least(F.length(a), F.length(b)))  # a block more each time, or a pair less
    same = F.aggregate(steps, start, step, lambda state: state["same"])
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * same / both)


def may_be_like(a: Column, b: Column, least: float = LIKE) -> Column:
    """False only where ``likeness`` is below ``least``: by lengths, then by the characters of each that the other has."""
    both, known = F.length(a) + F.length(b), lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    enough = lambda n: 2.0 * n >= least * both - 1e-9
    return enough(F.least(F.length(a), F.length(b))) & enough(known(b, a)) & enough(known(a, b))


def popular(key: Column) -> Column:
    """The first popular merchant whose key this is, or is like; null if there is none."""
    like = lambda p: (F.length(key) >= LEAST_KEY) & may_be_like(key, p["key"]) & (likeness(key, p["key"]) >= LIKE)
    return F.get(F.filter(F.expr(POPULAR), lambda p: (key == p["key"]) | like(p)), F.lit(0))["name"]


#: Street and district words before which a merchant's name ends, after a blank or a comma.
_HARD_CUT = (
    r"(\s+J[lI]\.?\s+|\s+Jl\.?\s+|\s+Ji\.?\s+|\s+Jalan\s+|,\s*J[lI]\b|,\s*Jl\b|\s+Kec\.\s+|\s+Kecamatan\s+|"
    r"\s+Kota\s+|\s+Kabupaten\s+|\s+RT\b|\s+RW\b|\s+No\.\s+|\s+Blok\s+|\s+Ruko\s+)"
)
_ADDRESS_CUT = r"[,\s]+(?:jl|ji|jalan|kec|kel|kab|rt|rw|no|lt|blok|gedung|ruko|komplek|perumahan)\b"


def clean_merchant(text: Column) -> Column:
    """A merchant's name without payment prefixes and suffixes, addresses, place codes and tails; popular names, and names like them, as they are spelled."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    c = F.regexp_replace(c, r"^[ ,.;:\-!()\[\]{}]+|[ ,.;:\-!()\[\]{}]+$", "")
    # What payment apps put before and after a name.
    c = _stripped(F.regexp_replace(c, r"(?i)^(?:fmi\s*qr|qr\s*pay|pembayaran\s*qr|bayar\s*qr|qr\s*bayar|qris|qr)\s+", ""))
    c = _stripped(F.regexp_replace(c, r"(?i)\s+(?:qris|qr|q)\s*$", ""))

    def cut(c: Column) -> Column:
        # A name has no blank or comma at its start, so neither cut takes all of it.
        x = _stripped(F.element_at(F.split(c, ";"), 1))
        for pattern in (_HARD_CUT, _ADDRESS_CUT):
            x = _stripped(F.regexp_replace(x, rf"(?is){pattern}.*$", ""))
        x = _stripped(F.regexp_replace(x, rf"(?i)\s*,\s*(?:{CITIES})\s*,?\s*id\b.*$", ""))
        short = lambda y: _stripped(F.regexp_replace(F.substring(y, 1, 60), r"\s+\S*$", ""))
        return let(x, lambda y: F.when((F.length(y) > 60) & (F.length(short(y)) >= 8), short(y)).otherwise(y))

    return let(c, lambda c: F.coalesce(let(merchant_key(c), popular), cut(c)))


def valid_merchant(text: Column) -> Column:
    """False for labels, dates, times, amounts, numbers, codes, addresses of the web, wallets, gateways and unpronounceable names."""
    return let(clean_merchant(text), _valid)


#: Status texts, and words of labels that no merchant's name has.
_JUNK = r"^(pembayaran berhasil|transaksi berhasil|transaction details?|rincian (transaksi|pembayaran)|payment success|berhasil|success|selesai|completed|done|ok)$"
_LABEL_WORDS = (
    r"\b(pembayaran berhasil|transaksi berhasil|berhasil|success|selesai|transaction details?|from|to|source of fund|payment method|acquirer|reference no|reference number|transaction id|"
    r"id transaksi|customer pan|merchant pan|terminal id|total transaksi|total|jumlah|nominal|kategori|detail transaksi|rincian transaksi|rincian pembayaran)\b"
)


def _valid(c: Column) -> Column:
    low = F.lower(c)
    digits, letters = F.length(F.regexp_replace(c, r"\D", "")), F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    vowels = F.length(F.regexp_replace(low, "[^aeiou]", ""))
    # What no merchant's name is.
    bad = (
        (F.length(c) < 2)
        | low.rlike(_JUNK)
        | low.rlike(_LABEL_WORDS)
        | low.rlike(rf"^(?:{CITIES})\s*,?\s*id$")
        | low.rlike(r"^(xendit|midtrans|doku|nicepay|faspay|ipaymu|tripay)\b")
        | low.rlike(r"^(gopay|ovo|dana|shopeepay|linkaja|blu|jenius|flip|livin|bca\s+mobile|mandiri\s+livin|bri\s+mo|bni\s+mobile|mobile\s+banking|m-?banking)\b")
        | low.isin("bank", "bank bca", "bank mandiri", "bank bni", "bank bri")
        | low.rlike(r"\b(rp|idr)\s*[0-9.,o]+\b|^[\s-]*(rp|idr)\b")
        | c.rlike(r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{1,2}[:.]\d{2}(:\d{2})?\b")
        | low.rlike(r"https?://|www\.|\.com\b|\.co\.id\b|\.id\b|@[a-z0-9.-]+\.[a-z]{2,}")
        | c.rlike(r"^\+?\d[0-9\s-]{7,}$")
        | c.rlike(r"^\d+$")
        | ((digits >= 8) & (digits / F.greatest(F.length(c), F.lit(1)) > 0.45))
        | (c.rlike("(?i)^[A-Z0-9]{6,}$") & (digits > 0) & (letters > 0))
        | c.rlike("(?i)^[A-Z0-9]{3,12}(?:-[A-Z0-9]{2,12}){1,4}$")
        | ((letters >= 6) & (vowels <= 1))
    )
    return ~bad


def best_merchant(candidates: Column) -> Column:
    """The first of an array's names by 100 less its place, with points for two to five words and a comma, less for length; '' if none is valid."""
    words_of = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    points = lambda c: F.when(words_of(c).between(2, 5), 14).otherwise(0) + F.when(c.contains(","), 6).otherwise(0) - F.when(F.length(c) > 45, 10).otherwise(0)
    scored = lambda c, i: F.struct((100 - i + points(c)).alias("score"), F.length(c).alias("size"), (-i).alias("place"), c.alias("name"), valid_merchant(c).alias("ok"))
    best = F.array_max(F.filter(F.transform(F.transform(candidates, clean_merchant), scored), lambda s: s["ok"]))
    return F.coalesce(best["name"], F.lit(""))


def misread_variants(key: Column) -> Column:
    """A key and spellings that a scanner may have made of it: 0 and 1 for o and l, rn for m, tripled letters, each t for l."""
    digits = F.translate(key, "01", "ol")
    each = F.transform(F.filter(F.sequence(F.lit(1), F.length(key)), lambda i: F.substring(key, i, F.lit(1)) == "t"), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.lit("l"), F.substring(key, i + 1, F.length(key))))
    return F.array_distinct(F.concat(F.array(key, digits, F.replace(key, F.lit("rn"), F.lit("m")), F.regexp_replace(key, r"([a-z])\1{2,}", "$1$1")), F.when(F.length(key) > 0, each).otherwise(F.array().cast("array<string>"))))


def misread_popular(key: Column, least: float = LIKE) -> Column:
    """The popular merchant whose key is most like ``key`` or one of its variants, from ``least`` on; else null."""
    near = lambda v: F.transform(F.filter(F.expr(POPULAR), lambda p: may_be_like(v, p["key"], least)), lambda p: F.struct(likeness(v, p["key"]).alias("r"), p["name"].alias("name")))
    best = F.array_max(F.flatten(F.transform(F.filter(misread_variants(key), lambda v: v != ""), near)))
    return let(best, lambda b: F.when(b["r"] >= least, b["name"]))
