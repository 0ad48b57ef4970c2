"""Money: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import fixed_digits, fixed_digits_and, let


def coerced(x: Column) -> Column:
    """A number of at least 0; what is none counts 0."""
    return F.greatest(F.lit(0.0), F.coalesce(x.try_cast("double"), F.lit(0.0)))


def rupiah(x: Column) -> Column:
    """'Rp 1.234.567', halves to even."""
    return F.concat(F.lit("Rp "), F.translate(F.format_number(F.rint(x), 0), ",", "."))


def short_rupiah(x: Column, prefix: str = "Rp ") -> Column:
    """Millions with one decimal and 'jt', thousands whole and 'rb'; halves to even, as ``printf`` has it."""
    x = x.cast("double")
    number = F.when(x >= 1e6, F.concat(_tenths(x / 1e6), F.lit("jt"))).when(x >= 1e3, F.concat(F.format_string("%.0f", F.rint(x / 1e3)), F.lit("rb"))).otherwise(F.format_string("%.0f", F.rint(x)))
    return F.concat(F.lit(prefix), number)


def _tenths(x: Column) -> Column:
    """A number from 1 on with one decimal, rounded by its exact binary value: what is behind the point is a whole number of 52-bit parts."""
    one = 1 << 52

    def rounded(d: Column) -> Column:
        tenth = F.shiftright(d["parts"] * 10, 52)
        rest = d["parts"] * 10 - F.shiftleft(tenth, 52)
        return let(tenth + F.when((rest > one // 2) | ((rest == one // 2) & (tenth % 2 == 1)), 1).otherwise(0), lambda n: F.format_string("%d.%d", d["whole"] + F.when(n == 10, 1).otherwise(0), n % 10))

    parts = F.struct(F.floor(x).alias("whole"), ((x - F.floor(x)) * float(one)).cast("bigint").alias("parts"))
    return F.when(x >= float(one), F.format_string("%.1f", x)).otherwise(let(parts, rounded))


def digits_only(x: Column) -> Column:
    """A price of digits and minus alone: '75,000' is 75000, '75.50' is 7550; null if there is none."""
    return F.nullif(F.regexp_replace(x, "[^0-9-]", ""), F.lit("")).try_cast("double")


def quantity(x: Column) -> Column:
    """The first number, decimal comma or point; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(x, ",", "."), r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def currency(text: Column) -> Column:
    """The currency that a text names; rupiah if none."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\b(rp|idr)(\b|[0-9.,])"), "IDR").when(low.rlike(r"\bcad\b|c\$|ca\$"), "CAD").when(low.rlike(r"\busd\b|us\$"), "USD").when(low.rlike(r"\beur\b|€"), "EUR")
        .when(low.rlike(r"\baud\b|a\$|au\$"), "AUD").when(low.rlike(r"\bsgd\b|s\$"), "SGD").when(low.rlike(r"\bgbp\b|£"), "GBP").when(low.contains("$"), "USD").otherwise("IDR")
    )


def token(raw: Column, rupiah_context: Column, compact_qr: Column) -> Column:
    """The value of a written amount, or null outside 1 to 1e9.

    Which separators are of thousands and which decimal depends on their number, on the digits after the last and on the
    currency; in a compact QR text a group 00x after three digits has a stray last digit.
    """
    s = F.regexp_replace(fixed_digits(raw), r"(?i)rp|idr|[$€£+\s-]", "")
    s = F.regexp_replace(s, r"^\D+|\D+$", "")

    def value(d: Column) -> Column:
        s, digits, groups = d["s"], d["digits"], d["groups"]
        n, last, first = F.size(groups), F.element_at(groups, -1), F.element_at(groups, 1)
        both = s.contains(",") & s.contains(".")
        whole = F.regexp_replace(F.regexp_replace(s, r"[.,]\d*$", ""), "[.,]", "")
        decimal = F.concat(whole, F.lit("."), last)
        short = F.length(last).between(1, 2)
        stray = compact_qr & rupiah_context & (n == 2) & (F.length(first) == 3) & (F.length(last) == 3) & last.startswith("00") & (last != "000")
        chosen = (
            F.when(s.rlike("[^0-9.,]") | (digits == ""), F.lit(None))
            .when(n == 1, digits)
            .when(both & short & rupiah_context, whole)
            .when(both & short, decimal)
            .when(both, digits)
            .when(stray, F.substring(digits, F.lit(1), F.length(digits) - 1))
            .when((n > 2) | (F.length(last) == 3), digits)
            .when((F.length(last) > 3) & rupiah_context, F.concat(first, F.substring(last, 1, 3)))
            .when(short & rupiah_context, first)
            .when(short, decimal)
            .otherwise(digits)
        )
        return chosen.try_cast("double")

    return let(let(let(s, _parts), value), lambda v: F.when(v.between(1, 1e9), v))


def _parts(s: Column) -> Column:
    return F.struct(s.alias("s"), F.regexp_replace(s, r"\D", "").alias("digits"), F.split(s, "[.,]").alias("groups"))


def screen_token(raw: Column, rupiah_context: Column, compact_qr: Column) -> Column:
    """Whole rupiah of an amount on a payment screen, or null: like ``token``, but cents always go, and of surplus digits only those after a point."""
    s = F.regexp_replace(fixed_digits_and(raw, ((r"(?<=\d)[Bb](?=\s\d)", "8"),)), r"(?i)\b(rp\.?|idr)\b|[–—+\s-]", "")
    s = F.regexp_replace(s, r"^\D+|\D+$", "")

    def value(d: Column) -> Column:
        s, digits, groups = d["s"], d["digits"], d["groups"]
        n, first, last = F.size(groups), F.element_at(groups, 1), F.element_at(groups, -1)
        cents = F.length(last).between(1, 2) & ((n == 2) | (s.contains(",") & s.contains(".")))
        stray = compact_qr & rupiah_context & (n == 2) & (F.length(first) == 3) & (F.length(last) == 3) & last.startswith("00") & (last != "000")
        surplus = rupiah_context & (n == 2) & s.contains(".") & (F.length(last) > 3)
        chosen = (
            F.when(n == 1, digits).when(cents, F.regexp_replace(F.regexp_replace(s, r"[.,]\d*$", ""), r"\D", "")).when(stray, F.substring(digits, F.lit(1), F.length(digits) - 1))
            .when(surplus, F.regexp_replace(F.concat(first, F.substring(last, 1, 3)), r"\D", "")).otherwise(digits)
        )
        return chosen.try_cast("double")

    return let(let(s, _parts), value)


def without_cents(x: Column) -> Column:
    """A written amount without spaces and without one or two decimals at its end, after a point or a comma."""
    s = F.regexp_replace(x, r"\s+", "")
    return F.regexp_replace(F.regexp_replace(s, r"\.\d{1,2}$", ""), r",\d{1,2}$", "")


def income_input(x: Column) -> Column:
    """Typed income: its digits and points; 0 where these are no number."""
    return F.coalesce(F.nullif(F.regexp_replace(x, "[^0-9.]", ""), F.lit("")).try_cast("double"), F.lit(0.0))


def form_amount(x: Column) -> Column:
    """The amount that a form shows: whole, halves up; '' if not above 0."""
    return F.when(x > 0, F.floor(x + 0.5).cast("bigint").cast("string")).otherwise("")


def clamped(x: Column) -> Column:
    """A confidence within 0 and 1; 0 for what is no number."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x.try_cast("double"), F.lit(0.0))))


def prefixed_amounts(text: Column) -> Column:
    """Amounts of 1000 to 1e9 that follow Rp or IDR, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:rp|idr)\.?\s*(\d{1,3}(?:[.,]\d{3})+|\d{4,})"), 1)
    values = F.transform(found, lambda x: F.regexp_replace(x, r"\D", "").try_cast("double"))
    return F.filter(values, lambda v: v.between(1000, 1e9))


def grouped_amounts(text: Column) -> Column:
    """Numbers with thousands groups, with or without a currency, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{1,3}(?:[.,]\d{3})+)\b"), 1)
    values = F.transform(found, lambda x: F.regexp_replace(x, r"\D", "").try_cast("double"))
    return F.filter(values, lambda v: v.between(1000, 1e9))
