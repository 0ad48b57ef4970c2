"""Writers: ledgers committed whole by a manifest, data sets by split, and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..domain import CATEGORY_DISPLAY
from ..operators import etl, evaluation
from ..session import checkpointed
from .ledgers import PLACE, SCHEMA, _at, manifests, scan, versions_of

UNIFIED = ("image_path", "donut_target", "source", "language", "category", "merchant", "transaction_date", "total_amount", "currency", "text_for_classification", "n_items", "split")


def stage(ledger: DataFrame, path: str) -> str:
    """``ledger`` as JSON lines in a new version of ``path``'s; its name. Records keep their places, those without one follow; bad ones are written as they were read."""
    spark, name = ledger.sparkSession, f"v-{uuid.uuid4().hex}"
    record = F.to_json(F.struct(*SCHEMA.fieldNames()), {"ignoreNullFields": "true"})
    order = [F.col("place").isNull(), F.col("place"), F.col("id")] if "place" in ledger.columns else []
    text = F.coalesce("bad", record) if "bad" in ledger.columns else record
    rows = ledger.repartitionByRange(*order).sortWithinPartitions(*order) if order else ledger
    folder = f"{versions_of(path)}/{name}"
    rows.select(text.alias("value")).write.text(folder)
    done, fs = _at(spark, f"{folder}/_SUCCESS")
    if not fs.exists(done):
        raise OSError(f"{folder} was not written to its end")
    return name


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    (source, fs), target = _at(spark, old), _at(spark, new)[0]
    if fs.exists(target):
        raise FileExistsError(f"{new}: another commit came first")
    if not fs.rename(source, target):
        raise OSError(f"{old} could not be renamed to {new}")


def publish(spark: SparkSession, path: str, name: str, seen: list[str]) -> None:
    """The commit: a manifest that names version ``name``, renamed to the number after the last of ``seen``. Nothing that readers see changes before."""
    number = int(seen[-1].rpartition("/")[2]) + 1 if seen else 1
    beside = f"{versions_of(path)}/{name}.manifest"
    place, fs = _at(spark, beside)
    out = fs.create(place, False)
    out.write(bytearray(name.encode()))
    out.close()
    _renamed(spark, beside, f"{versions_of(path)}/{number:019d}")


def purge(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the last ``keep`` manifests and the versions that they name; a query may still read the one before the last."""
    for manifest in manifests(spark, path)[:-keep]:
        folder = f"{versions_of(path)}/{spark.read.text(manifest).first()[0]}"
        for old in (manifest, folder):  # first what points there
            place, fs = _at(spark, old)
            if not fs.delete(place, True) and fs.exists(place):
                raise OSError(f"{old} could not be deleted")


def replace_ledger(ledger: DataFrame, path: str) -> None:
    """``ledger`` in place of what ``path`` holds, which it may be read from: a new version is written whole, then a manifest names it.

    A failure before the manifest leaves the old ledger, one after it the new. What ``path`` itself held is not touched. Two
    writers that began from the same version end with one commit and one error.
    """
    spark = ledger.sparkSession
    seen = manifests(spark, path)
    publish(spark, path, stage(ledger, path), seen)
    purge(spark, path)


def amend_ledger(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], form: str | None = None) -> None:
    """``change`` of the records that fit, written back with those that don't, which stay as they are.

    What was read is kept typed, for a change asks for it several times, and so does the order in which it is written.
    """
    every = checkpointed(scan(spark, path, form))
    changed = change(every.where(F.col("bad").isNull()).drop("bad"))
    if "place" not in changed.columns:
        changed = changed.withColumn("place", F.lit(None).cast(PLACE))
    bad = every.where(F.col("bad").isNotNull())
    replace_ledger(changed.select(*SCHEMA.fieldNames(), "place", F.lit(None).cast("string").alias("bad")).unionByName(bad), path)


def unified_rows(rows: DataFrame) -> DataFrame:
    """Rows of ``etl.unified`` with ``split`` (and ``items``, where they are known) as training data has them."""
    items = F.col("items") if "items" in rows.columns else F.lit(None).cast(f"array<{etl.ITEM}>")
    target = etl.encoded(F.col("source"), F.col("merchant"), F.col("date"), F.col("total"), F.lit("IDR"), F.col("category"), items)
    return rows.select(
        F.col("path").alias("image_path"), target.alias("donut_target"), "source", "language", "category", "merchant", F.col("date").alias("transaction_date"), F.col("total").alias("total_amount"),
        F.lit("IDR").alias("currency"), F.col("text").alias("text_for_classification"), F.coalesce(F.size(items), F.lit(0)).alias("n_items"), "split",
    )


def write_unified(rows: DataFrame, path: str) -> None:
    """JSON lines of ``unified_rows``, a folder for each split; nulls are written."""
    unified_rows(rows).write.partitionBy("split").option("ignoreNullFields", False).json(path)


def write_labelled(rows: DataFrame, path: str, label: Column) -> dict[str, int]:
    """``rows`` with ``category_label`` as JSON lines by split; how many have each label, counted as they are written."""
    seen = Observation()
    labelled = rows.withColumn("category_label", label)
    labelled.observe(seen, *[F.count_if(F.col("category_label") == c).alias(c) for c in CATEGORY_DISPLAY]).write.partitionBy("split").option("ignoreNullFields", False).json(path)
    return dict(seen.get)


def write_report(rows: DataFrame, path: str) -> None:
    """Under ``path``: results (JSON), faults (CSV with a header), summary (one JSON row) and slowest; and a text of the totals as summary.md.

    Only the one row of totals and three short counts by status, type and fault come to the driver.
    """
    rows.write.json(f"{path}/results")
    evaluation.faulty(rows).write.option("header", True).option("quoteAll", True).csv(f"{path}/faults")
    top = evaluation.slowest(rows)
    top.write.json(f"{path}/slowest")
    summary = evaluation.totals(rows)
    summary.write.json(f"{path}/summary")
    counts = etl.counters(rows, "status", "predicted_document_type", "suspected_error_type").orderBy("field", "value").collect()
    text = ["# Parser Evaluation Summary", "", *[f"- {k}: {v}" for k, v in summary.first().asDict().items()]]
    for field in ("status", "predicted_document_type", "suspected_error_type"):
        text += ["", f"## {field}", *[f"- {r['value']}: {r['n']}" for r in counts if r["field"] == field]]
    text += ["", "## 10 Slowest Samples", *[f"- {r['processing_time']}s `{r['path']}` ({r['status']}, {r['suspected_error_type']})" for r in top.collect()]]
    rows.sparkSession.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.text(f"{path}/summary.md")


def write_failures(rows: DataFrame, path: str) -> None:
    """path and status of rows that didn't succeed, tab separated."""
    rows.where("status <> 'ok'").select("path", "status").write.option("sep", "\t").option("header", False).csv(path)
