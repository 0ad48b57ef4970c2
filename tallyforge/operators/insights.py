"""Month-scoped insights over a ledger."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import MONTH_NAMES
from ..functions.dates import in_month, normalised
from ..functions.text import category_display


def month_of(ledger: DataFrame, month: str) -> DataFrame:
    """Records of month YYYY-MM by their written date, or if that is blank by when they were saved."""
    return ledger.where(in_month(F.col("date"), F.col("saved_at"), month))


def month_range(ledger: DataFrame, month: str, column: str = "ts") -> DataFrame:
    """The same over a typed day, as a range that reaches the scan."""
    year, number = map(int, month.split("-"))
    first = dt.datetime(year, number, 1)
    after = first + dt.timedelta(days=calendar.monthrange(year, number)[1])
    stamp = lambda d: F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")
    return ledger.where((F.col(column) >= stamp(first)) & (F.col(column) < stamp(after)))


def by_category(ledger: DataFrame) -> DataFrame:
    """Total, count and share of each category."""
    sums = ledger.groupBy("category").agg(F.round(F.sum("amount"), 2).alias("total"), F.count(F.lit(1)).alias("count"))
    share = F.round(F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))) * 100, 1)
    return sums.select("category", category_display(F.col("category")).alias("category_display"), "total", "count", F.coalesce(share, F.lit(0.0)).alias("percentage"))


def summary(ledger: DataFrame, income: float = 0.0) -> DataFrame:
    """One row: totals, the category with the largest sum and the commonest merchant (ties: the one met first by id)."""
    categories = ledger.groupBy("category").agg(F.sum("amount").alias("s"), F.min("id").alias("first"))
    merchants = ledger.where(F.coalesce("merchant", F.lit("")) != "").groupBy("merchant").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    top_category = categories.agg(F.max_by("category", F.struct(F.round("s", 4), -F.col("first"))).alias("top_category"))
    top_merchant = merchants.agg(F.max_by("merchant", F.struct("n", -F.col("first"))).alias("top_merchant"))
    totals = ledger.agg(F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total_expense"), F.count(F.lit(1)).alias("transaction_count"), F.round(F.coalesce(F.avg("amount"), F.lit(0.0)), 2).alias("average_transaction"))
    earned = F.lit(float(max(income, 0.0)))
    out = totals.crossJoin(F.broadcast(top_category)).crossJoin(F.broadcast(top_merchant))  # one row each
    return out.select(
        "total_expense", "transaction_count", "average_transaction", F.coalesce("top_category", F.lit("")).alias("top_category"), F.coalesce(category_display(F.col("top_category")), F.lit("")).alias("top_category_display"),
        F.coalesce("top_merchant", F.lit("")).alias("top_merchant"), earned.alias("monthly_income"), F.when(earned > 0, F.round(F.greatest(F.lit(0.0), earned - F.col("total_expense")), 2)).otherwise(0.0).alias("remaining_balance"),
    )


def day(date: Column, saved_at: Column) -> Column:
    """The normalised date, or that of saving; '' if neither is there."""
    return normalised(F.when(F.coalesce(date, F.lit("")) == "", F.substring(F.coalesce(saved_at, F.lit("")), 1, 10)).otherwise(date))


def daily(ledger: DataFrame) -> DataFrame:
    days = ledger.withColumn("day", day(F.col("date"), F.col("saved_at"))).where("day <> ''")
    return days.groupBy("day").agg(F.round(F.sum("amount"), 2).alias("total"), F.count(F.lit(1)).alias("count"))


def trend(ledger: DataFrame, first: str, last: str) -> DataFrame:
    """Every day from first to last, zero where nothing was spent."""
    spine = ledger.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return spine.join(daily(ledger), "day", "left").select("day", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def trend_totals(series: DataFrame) -> DataFrame:
    return series.agg(F.round(F.sum("total"), 2).alias("total"), F.round(F.avg("total"), 2).alias("per_day"), F.count_if(F.col("total") > 0).alias("days_with_spend"))


def recent(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The n last saved; of equals the lower id first."""
    top = ledger.orderBy(F.col("saved_at").desc(), "id").limit(n)
    return top.select("id", "merchant", "amount", "date", "category", category_display(F.col("category")).alias("category_display"), "source")


def top_categories(ledger: DataFrame, n: int = 5) -> DataFrame:
    return by_category(ledger).orderBy(F.col("total").desc(), "category").limit(n)


def search(ledger: DataFrame, text: str = "", category: str = "", source: str = "") -> DataFrame:
    """History: merchant contains (in any case), category and source equal; blank is no filter."""
    out = ledger
    if text:
        out = out.where(F.lower("merchant").contains(text.lower()))
    if category:
        out = out.where(F.col("category") == category)
    return out.where(F.col("source") == source) if source else out


def history_totals(ledger: DataFrame, text: str = "", category: str = "", source: str = "") -> DataFrame:
    """Totals of all records, and how many pass the filters, in one pass."""
    hit = F.lit(True)
    for wanted, test in ((text, F.lower("merchant").contains(text.lower())), (category, F.col("category") == category), (source, F.col("source") == source)):
        hit = hit & test if wanted else hit
    return ledger.agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.avg("amount"), 2).alias("mean"), F.count_if(hit).alias("filtered"))


def income_use(ledger: DataFrame, income: float) -> DataFrame:
    """Share of income used (whole percent, halves up), the same capped at 100, and whether spending exceeds it."""
    used = F.when(F.lit(income) > 0, F.floor(F.col("spent") / income * 100 + 0.5)).otherwise(0).cast("long")
    spent = ledger.agg(F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("spent"))
    return spent.select("spent", F.lit(float(income)).alias("income"), used.alias("used_percent"), F.least(used, F.lit(100)).cast("long").alias("capped_percent"), (F.col("spent") > income).alias("over_budget"), F.round(F.greatest(F.lit(0.0), income - F.col("spent")), 2).alias("potential_saving"))


def income_entries(raw: DataFrame) -> DataFrame:
    """Entries (id, amount, label, date) of a JSON array in column ``entries``; what is no array, such as a single object, has none."""
    kind = "array<struct<id:bigint,amount:double,label:string,date:string>>"
    listed = F.when(F.ltrim("entries").startswith("["), F.from_json("entries", kind))
    return raw.select(F.explode(F.coalesce(listed, F.array().cast(kind))).alias("e")).where("e is not null").select("e.*")


def month_or_current(month: str, now: dt.datetime) -> str:
    """``month`` if it is written YYYY-MM, else that of ``now``, which callers give."""
    return month if re.fullmatch(r"\d{4}-\d{2}", month or "") else f"{now:%Y-%m}"


def current_month_label(now: dt.datetime) -> str:
    return f"{MONTH_NAMES[now.month - 1]} {now.year}"
