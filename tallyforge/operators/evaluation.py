"""Quality reports over read documents: a row for each, its likeliest fault, and the totals that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import category_display
from .extract import NOT_FOUND, public_type, read_all
from .ranks import medians

#: Faults in the order in which they are looked for, with what to do.
FAULTS = {
    "ocr_unavailable": "Pastikan EasyOCR/model OCR tersedia di environment yang dipakai.",
    "empty_ocr": "Cek preprocessing gambar atau fallback OCR.",
    "no_useful_fields": "Periksa route auto dan fallback parser umum.",
    "merchant_missing": "Tambahkan kandidat merchant dari label/header yang valid.",
    "amount_missing": "Periksa regex nominal dan konteks Total/Nominal.",
    "date_missing": "Periksa regex tanggal dan konteks label tanggal.",
    "low_confidence": "Field sudah terbaca sebagian; tingkatkan confidence/context scoring.",
    "ok": "Tidak ada error utama yang terlihat dari heuristic report.",
}
FIELDS = (
    "path", "predicted_document_type", "document_type_label", "route_used", "merchant", "amount", "date", "category", "status", "warnings", "elapsed_seconds", "debug_trace", "raw_ocr_preview",
    "suspected_error_type", "suggested_fix",
)


def fault(error: Column, preview: Column, status: Column, merchant: Column, amount: Column, date: Column, warnings: Column) -> Column:
    """(type, fix) of the first fault that applies."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    tests = {
        "ocr_unavailable": ~blank(error), "empty_ocr": blank(preview), "no_useful_fields": status == "failed", "merchant_missing": blank(merchant) | (F.lower(merchant) == NOT_FOUND.lower()),
        "amount_missing": F.coalesce(amount, F.lit(0.0)) <= 0, "date_missing": blank(date), "low_confidence": F.lower(F.array_join(warnings, " ")).contains("perlu") | (status == "needs_review"),
    }
    made = lambda k: F.struct(F.lit(k).alias("type"), F.lit(FAULTS[k]).alias("fix"))
    return F.coalesce(*[F.when(test, made(k)) for k, test in tests.items()], made("ok"))


def evaluated(documents: DataFrame, path: str = "path", lines: str = "lines") -> DataFrame:
    """A report row for each of ``documents`` (path, lines, and ``ocr_error`` where it is known).

    The trace says how sure each field is and where the category is from; ``amount_traces`` has the candidates. A plan takes
    no time per row, so ``processing_time`` is null.
    """
    error = F.col("ocr_error") if "ocr_error" in documents.columns else F.lit("")
    read = read_all(documents.select(F.col(path).alias("path"), F.col(lines).alias("lines"), F.coalesce(error, F.lit("")).alias("ocr_error")))
    kind = public_type(F.col("document_type"), F.col("route"))
    preview = F.substring(F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"), 1, 900)
    sure = [F.concat(F.lit(f"{k}="), F.format_number(f"{k}_confidence", 2)) for k in ("route", "merchant", "amount", "date")]
    trace = F.concat_ws(" ", *sure, F.concat(F.lit("category="), F.col("category_source")))
    made = fault(F.col("ocr_error"), preview, F.col("status"), F.col("merchant"), F.col("amount"), F.col("date"), F.col("warnings"))
    return read.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "path", kind["public"].alias("predicted_document_type"), kind["label"].alias("document_type_label"), kind["internal"].alias("document_type_internal"),
        F.col("route").alias("route_used"), F.round("route_confidence", 3).alias("route_confidence"), "merchant", "amount", "date", "category", category_display(F.col("category")).alias("category_display"), "status",
        (F.col("status") != "failed").alias("success"), "warnings", preview.alias("raw_ocr_preview"), trace.alias("debug_trace_preview"), F.lit(None).cast("double").alias("processing_time"), "ocr_error",
        made["type"].alias("suspected_error_type"), made["fix"].alias("suggested_fix"),
    )


def totals(rows: DataFrame) -> DataFrame:
    """One row: samples, fields that are there and missing, and processing times."""
    has = {
        "merchant": (F.coalesce("merchant", F.lit("")) != "") & (F.lower("merchant") != NOT_FOUND.lower()), "amount": F.coalesce("amount", F.lit(0.0)) > 0, "date": F.coalesce("date", F.lit("")) != "",
        "category": (F.coalesce("category", F.lit("")) != "") & (F.col("category") != "lainnya"),
    }
    spent = F.coalesce("processing_time", F.lit(0.0))
    ends = rows.agg(
        F.count(F.lit(1)).alias("total_samples"), *[F.count_if(v).alias(f"with_{k}") for k, v in has.items()], *[F.count_if(~has[k]).alias(f"{k}_missing") for k in ("merchant", "amount", "date")],
        F.round(F.coalesce(F.avg(spent), F.lit(0.0)), 2).alias("average_seconds"), F.round(F.coalesce(F.max(spent), F.lit(0.0)), 2).alias("max_seconds"),
    )
    middle = medians(rows.select(spent.alias("spent")), "spent").select(F.round(F.coalesce("median", F.lit(0.0)), 2).alias("median_seconds"))
    return ends.crossJoin(F.broadcast(middle))  # one row each


def slowest(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n rows that took longest; of equals the first path."""
    return rows.orderBy(F.col("processing_time").desc(), "path").limit(n).select("path", "processing_time", "status", "suspected_error_type")


def faulty(rows: DataFrame) -> DataFrame:
    """The rows with a fault, as the report of faults lists them: lists and line ends folded into text."""
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" / "))
    changed = {"warnings": F.array_join("warnings", " | "), "elapsed_seconds": F.col("processing_time"), "debug_trace": flat("debug_trace_preview"), "raw_ocr_preview": flat("raw_ocr_preview")}
    return rows.where("suspected_error_type <> 'ok'").select(*[changed[c].alias(c) if c in changed else F.col(c) for c in FIELDS])


def evidence(lines: Column) -> Column:
    """How much a scan's lines hold: their number, points for amounts, for known words and for a recipient."""
    #: Words that payment screens have.
    words = ("transaction details", "rincian transaksi", "qr bayar", "pembayaran qr", "source of fund", "merchant pan", "customer pan", "terminal id", "total", "nominal", "jumlah", "bayar ke", "payment to")
    text = F.lower(F.array_join(lines, "\n"))
    known = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))
    named = F.when(text.rlike(r"\bke\s+[a-z][a-z0-9 .,&'-]{2,}"), 8).otherwise(0)
    return F.size(lines) + 8 * F.regexp_count(text, F.lit(r"\b(rp|idr)\s*[0-9.,oilsb]{4,}")) + 5 * known + named


def path_group(path: Column) -> Column:
    """What a path's words say that an image is."""
    low = F.lower(path)
    return (
        F.when(low.rlike("qris|qr|payment|pembayaran"), "compact_qr_screenshots").when(low.rlike("mbanking|m-banking|banking|ewallet|gopay|shopeepay|ovo|dana"), "mbanking_detail_screenshots")
        .when(low.rlike("dataset_hf|kaggle|receipt|struk|cord|nota") | F.element_at(F.split(low, "/"), -1).rlike("^(img_|000)"), "receipt_photos").otherwise("unknown_difficult")
    )


def chosen_route(document_type: Column, group: Column) -> Column:
    return (
        F.when(document_type.isin("compact_qr_card", "mbanking_transaction_detail", "ewallet_receipt_screen"), "screenshot").when(document_type == "photo_receipt", "receipt")
        .when(group.isin("compact_qr_screenshots", "mbanking_detail_screenshots"), "screenshot").when(group == "receipt_photos", "receipt").otherwise("uncertain")
    )
