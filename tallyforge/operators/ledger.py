"""Ledger changes as batches: inserts, then updates, then deletes; ids are given once per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import CATEGORY_DISPLAY, DEFAULT_CATEGORY
from ..functions.money import coerced
from ..functions.text import by_distinct, category_display, clean_merchant
from .ranks import number

FIELDS = ("id", "merchant", "amount", "date", "category", "source", "notes", "saved_at")


def reject_reason(merchant: Column, amount: Column, category: Column, date: Column | None = None) -> Column:
    """Why a record can't be stored, or null; ``date`` given, it and a category must be there, as for manual entry."""
    out = F.when(amount < 0, "negative_amount").when(F.trim(F.coalesce(merchant, F.lit(""))) == "", "blank_merchant")
    if date is not None:
        out = out.when(F.trim(F.coalesce(date, F.lit(""))) == "", "blank_date").when(F.coalesce(category, F.lit("")) == "", "blank_category")
    return out.when(category.isNotNull() & (category != "") & ~category.isin(*CATEGORY_DISPLAY), "unknown_category")


def named(merchant: Column) -> Column:
    """A merchant's name as it is stored: cleaned, or as it was given where nothing is left of it."""
    return F.coalesce(F.nullif(clean_merchant(F.trim(merchant)), F.lit("")), F.trim(merchant))


def insert(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """``ledger`` with the valid rows of ``new``, numbered on from its greatest id in order of ``saved_at`` and merchant.

    Numbers come from one sort of the batch by range and a count for each part, so no task takes the whole batch.
    """
    ok = new.where(reject_reason(F.col("merchant"), F.col("amount"), F.col("category")).isNull())
    rows = by_distinct(ok, "merchant", "_name", named).select(
        F.col("_name").alias("merchant"), F.col("amount").cast("double").alias("amount"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce(F.nullif("category", F.lit("")), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit("receipt")).alias("source"), F.coalesce("notes", F.lit("")).alias("notes"), "saved_at",
    )
    numbered = number(rows, ["saved_at", "merchant", "amount"])
    top = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = numbered.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("number"))  # one row
    if "place" not in ledger.columns:
        return ledger.select(*FIELDS).unionByName(numbered.select(*FIELDS))
    return ledger.select(*FIELDS, "place").unionByName(numbered.select(*FIELDS), allowMissingColumns=True)  # new ones come last


def update_category(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """Categories by id from ``updates`` (id, category); ids that repeat in it take the greatest category.

    Of records that share an id only the first changes: by its ``place`` in the file where the ledger has one, else by when
    it was saved and the other fields.
    """
    u = updates.where(F.col("category").isin(*CATEGORY_DISPLAY)).groupBy("id").agg(F.max("category").alias("new"))
    placed = "place" in ledger.columns
    order, kept = (["place"], [*FIELDS, "place"]) if placed else (["saved_at", "merchant", "amount", "date", "category", "source", "notes"], list(FIELDS))
    # One reading of the ledger: a record without an update is a group of its own, so null ids are no large group.
    first = F.row_number().over(Window.partitionBy("id", F.when(F.col("new").isNull(), F.xxhash64(*order))).orderBy(*order)) == 1
    joined = ledger.select(*kept).join(u, "id", "left")
    return joined.withColumn("category", F.when(first & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("category"))).select(*kept)


def unmatched(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids of ``changes`` that the ledger lacks."""
    return changes.select("id").distinct().join(ledger.select("id"), "id", "left_anti")


def delete(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    return ledger.join(ids.select("id"), "id", "left_anti").select(*FIELDS, *(["place"] if "place" in ledger.columns else []))


def truncate(ledger: DataFrame) -> DataFrame:
    return ledger.select(*FIELDS).limit(0)


def view(ledger: DataFrame) -> DataFrame:
    """How a ledger reads: defaults in place of nulls, merchants cleaned again, categories displayed."""
    return by_distinct(ledger, "merchant", "_name", lambda x: F.coalesce(F.nullif(clean_merchant(x), F.lit("")), x, F.lit(""))).select(
        "id", F.col("_name").alias("merchant"), coerced(F.col("amount")).alias("amount"), F.coalesce("date", F.lit("")).alias("date"),
        F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category"), F.coalesce("source", F.lit("receipt")).alias("source"), F.coalesce("saved_at", F.lit("")).alias("saved_at"),
        category_display(F.coalesce("category", F.lit(DEFAULT_CATEGORY))).alias("category_display"),
    )


def save_report(rows: DataFrame) -> DataFrame:
    """One row of counts for saving all: rows (merchant, amount text, saved, fails) that are saved, failed, skipped (total less saved, so failures count too) and all."""
    amount = F.col("amount").try_cast("double")
    usable = (F.trim(F.coalesce("merchant", F.lit(""))) != "") & (F.coalesce(amount, F.lit(0.0)) > 0) & ~F.coalesce("saved", F.lit(False))
    good = usable & ~F.coalesce("fails", F.lit(False))
    return rows.agg(F.count_if(good).alias("saved"), F.count_if(usable & F.coalesce("fails", F.lit(False))).alias("failed"), (F.count(F.lit(1)) - F.count_if(good)).alias("skipped"), F.count(F.lit(1)).alias("total"))
