"""Ledgers: the stored form, readers, and adapters of the test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import choice
from ..session import once

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("merchant", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("date", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("source", T.StringType()), T.StructField("notes", T.StringType()), T.StructField("saved_at", T.StringType()),
])
EVENT_CATEGORIES = {"click": "makanan_minuman", "error": "lainnya", "purchase": "belanja", "signup": "tagihan", "view": "hiburan"}
SEGMENT_CATEGORIES = {"AUTOMOBILE": "transportasi", "BUILDING": "tagihan", "FURNITURE": "belanja", "HOUSEHOLD": "kesehatan", "MACHINERY": "pendidikan"}


#: Where a record stands: file, first byte of the split that held it, and a number that grows within the split.
PLACE = "struct<file:string,block:long,row:long>"
_NUMBER = r"^\d{19}$"


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions_of(path: str) -> str:
    """The folder, beside a ledger, of its versions and of the numbered manifests that name them."""
    return f"{path.rstrip('/')}.versions"


def manifests(spark: SparkSession, path: str) -> list[str]:
    """Paths of a ledger's manifests, oldest first."""
    place, fs = _at(spark, versions_of(path))
    if not fs.exists(place):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return [f"{versions_of(path)}/{n}" for n in sorted(names) if re.match(_NUMBER, n)]


def live(spark: SparkSession, path: str) -> str | None:
    """The folder that a ledger's last manifest names; None if nothing was ever committed."""
    known = manifests(spark, path)
    return f"{versions_of(path)}/{spark.read.text(known[-1]).first()[0]}" if known else None


def _typed(records: DataFrame) -> DataFrame:
    """SCHEMA's columns, ``place`` and ``bad`` of (text, place): each record is parsed once and cast by itself, and one that can't be is kept as text.

    A record is bad if it is no object, its id no whole number, its amount no number or text of one, or another field no
    text. Fields that are missing or null are null.
    """
    names = SCHEMA.fieldNames()
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    parsed = once(records, "_v", F.try_parse_json("text"))
    apart = once(parsed, "_f", F.struct(*[F.try_variant_get("_v", f"$.{n}", "variant").alias(n) for n in names]))
    of = lambda f: F.try_variant_get(F.col(f"_f.{f.name}"), "$", f.dataType.simpleString())
    bad = ~F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT") | ~kind("_f.id").isin("BIGINT", "VOID") | ((kind("_f.amount") != "VOID") & of(SCHEMA["amount"]).isNull())
    for f in names:
        if f not in ("id", "amount"):
            bad = bad | ~kind(f"_f.{f}").isin("STRING", "VOID")
    told = once(apart, "_bad", bad)
    own = [F.when(~F.col("_bad"), of(f)).alias(f.name) for f in SCHEMA.fields]
    return told.select(*own, F.col("place").cast(PLACE).alias("place"), F.when(F.col("_bad"), F.coalesce("text", F.lit("null"))).alias("bad"))


def scan(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Every record of a ledger: SCHEMA's columns, its ``place``, and ``bad``, the text of one that doesn't fit them (else null).

    form: ``array``, files that each hold one JSON array (the default for a file; a text that is no array, or doesn't parse,
    holds no record); ``lines``, a record a line (for a folder); ``parquet`` (by name). What was committed with
    ``sinks.replace_ledger`` comes before what ``path`` holds itself; a missing path is an empty ledger.
    """
    if committed := live(spark, path):
        path, form = committed, "lines"
    place, fs = _at(spark, path)
    if not fs.exists(place):
        return spark.createDataFrame([], SCHEMA).withColumns({"place": F.lit(None).cast(PLACE), "bad": F.lit(None).cast("string")})
    form = form or ("parquet" if path.rstrip("/").endswith(".parquet") else "lines" if fs.getFileStatus(place).isDirectory() else "array")
    if form == "parquet":
        rows = spark.read.schema(SCHEMA).parquet(path)
        return rows.select(*SCHEMA.fieldNames(), F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row")).cast(PLACE).alias("place"), F.lit(None).cast("string").alias("bad"))
    if form == "array":
        whole = spark.read.text(path, wholetext=True).select(F.trim(F.translate("value", "\ufeff\r\n\t", "    ")).alias("ends"), "value", F.col("_metadata.file_path").alias("file"))
        whole = whole.where(F.col("ends").startswith("[") & F.col("ends").endswith("]"))
        each = whole.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("row", "text"))
        return _typed(each.select("text", F.struct("file", F.lit(0).cast("long").alias("block"), F.col("row").cast("long").alias("row")).alias("place")))
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    return _typed(lines.where(F.trim("text") != ""))


def read(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """SCHEMA's columns and ``place`` of the records that fit; those that don't are in ``scan``."""
    return scan(spark, path, form).where(F.col("bad").isNull()).drop("bad")


def write(ledger: DataFrame, path: str) -> None:
    """Parquet, in place of what was there; ``ledger`` must not read ``path`` itself."""
    ledger.select(*SCHEMA.fieldNames()).write.mode("overwrite").parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger; dates in four spellings, one in four blank, so that the month filter meets them all."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 4
    date = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd")).when(kind == 1, F.date_format("ts", "dd/MM/yyyy")).when(kind == 2, F.date_format("ts", "dd-MM-yyyy")).otherwise("")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("merchant_"), F.col("user_id").cast("string")).alias("merchant"), F.col("value").alias("amount"), date.alias("date"),
        choice(F.col("event_type"), EVENT_CATEGORIES, "lainnya").alias("category"), F.when(F.col("event_id") % 3 == 0, "receipt").when(F.col("event_id") % 3 == 1, "screenshot").otherwise("manual").alias("source"),
        F.lit("").alias("notes"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("saved_at"), F.col("ts"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger, the customer as merchant; the typed day stays, so that filters on it reach the scan."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("merchant"), F.col("o_totalprice").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        choice(F.col("c_mktsegment"), SEGMENT_CATEGORIES, "lainnya").alias("category"), F.lit("receipt").alias("source"), F.lit("").alias("notes"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("saved_at"), F.col("o_orderdate").alias("ts"),
    )


_CASE = lambda col, table: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE 'lainnya' END"
#: The adapters in SQL.
EVENTS_SQL = f"""SELECT event_id AS id, 'merchant_' || user_id AS merchant, value AS amount,
 CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d/%m/%Y') WHEN 2 THEN strftime(ts, '%d-%m-%Y') ELSE '' END AS date,
 {_CASE('event_type', EVENT_CATEGORIES)} AS category, CASE event_id % 3 WHEN 0 THEN 'receipt' WHEN 1 THEN 'screenshot' ELSE 'manual' END AS source,
 '' AS notes, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS saved_at, ts FROM events"""
ORDERS_SQL = f"""SELECT o_orderkey AS id, c_name AS merchant, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date,
 {_CASE('c_mktsegment', SEGMENT_CATEGORIES)} AS category, 'receipt' AS source, '' AS notes, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS saved_at, o_orderdate AS ts
 FROM orders JOIN customer ON o_custkey = c_custkey"""
