"""Patterns behind a look ahead match as they are written, and a line is judged once."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.functions.patterns import led
from tallyforge.operators import screens
from tallyforge.operators.extract import ADDRESS, CASH, CHANGE, CUE, DAY, DUE, FINAL, FOOTER, ITEM_WORD, MAIN, NOISE, QUANTITY, REF, SCREEN_REJECT, TIER1, TIER2, TIER3, TOTAL, URL, WRITTEN_DAY, extract
from tallyforge.plans import reading

PATTERNS = (
    ADDRESS, CASH, CHANGE, CUE, DAY, DUE, FINAL, FOOTER, ITEM_WORD, MAIN, NOISE, QUANTITY, REF, SCREEN_REJECT, TIER1, TIER2, TIER3, TOTAL, URL, WRITTEN_DAY, screens.NOT_FINAL, screens.NUMBERED, screens.MONTH_YEAR,
    screens.CURRENCY, screens.NO_DATE, screens._several(screens.LABELS), r"(?i)(?:rp\.?|idr)\s*([0-9oilsb.,\s]+)", r"a?b", r"[a-c]x|\.d", r"(?:q|\s*z)", "x*",
)


def test_first_characters():
    assert led(r"\b(total|net+)\b|@") == r"(?=[@nt])(?:\b(total|net+)\b|@)" and led("(?i)a?b|[x-z]1") == "(?i)(?=[abx-z])(?:a?b|[x-z]1)"
    assert [led(p) for p in ("x*", "^a", "a|.b", "[^a]", "(?=a)b", "a|")] == ["x*", "^a", "a|.b", "[^a]", "(?=a)b", "a|"]


def test_they_match_the_same(spark):
    odd = ["abx", "cx.d", "no hp", "NO. REF 7", "Sub  Total", "é x2", " z", "q", "", "İdr 5.000", "order\nid", "/f/ab"]
    rows = spark.createDataFrame([(x,) for x in (*reading.POOL, *odd)], "x string").select(F.explode(F.array("x", F.lower("x"), F.upper("x"))).alias("x"))
    for p in PATTERNS:
        assert rows.where(F.col("x").rlike(p) != F.col("x").rlike(led(p))).count() == 0, p


@pytest.mark.parametrize("said,want", [("x.oo", "x.00"), (".oS.oS", ".05.0S"), ("1O", "10"), ("aI5", "a15"), ("SOLO", "SOLO"), ("5B.000", "58.000"), (None, None)])
def test_digits_are_repaired_where_a_letter_stands_for_one(spark, said, want):
    assert spark.createDataFrame([(said,)], "x string").select(dates.fixed_digits(F.col("x")).alias("y")).first()["y"] == want


def test_days_that_exist(spark):
    days = {(29, 2, 2024): "29/02/2024", (29, 2, 2023): None, (31, 4, 2020): None, (31, 12, 2035): "31/12/2035", (1, 1, 2009): None, (0, 1, 2020): None, (1, 13, 2020): None, (None, 1, 2020): None, (5, 6, 2021): "05/06/2021"}
    rows = spark.createDataFrame([(*k, w) for k, w in days.items()], "d int, m int, y int, w string")
    assert rows.where(~dates.valid_day(F.col("d"), F.col("m"), F.col("y")).eqNullSafe(F.col("w"))).count() == 0


def test_a_null_line_costs_no_date(spark):
    rows = spark.createDataFrame([(["TOKO ROTI", None, "13/05/2026", "TOTAL 38.000"],)], "lines array<string>")
    assert extract(rows).first()["date"] == "13/05/2026"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_route_reuses_the_type(spark):
    rows = spark.createDataFrame([(["QR Bayar", "Rp38.000"],)], "lines array<string>")
    assert plan(extract(rows).select("document_type", "route")).count("minimarket") == 1


def test_strategies_share_one_judge(spark):
    rows = spark.createDataFrame([(["QR Bayar", "Rp38.000"],)], "lines array<string>")
    assert plan(rows.select(screens.recipient(F.col("lines")).alias("r"))).count("kode\\s+pos|no\\.?)\\b))") == 1
