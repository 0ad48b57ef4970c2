"""Readers of labelled image data sets: JSON lines with a ground truth inside, and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import let
from ..functions.money import digits_only, quantity
from ..session import once


def listing(spark: SparkSession, root: str | list[str], extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "bmp"), limit: int | None = None) -> DataFrame:
    """Path and length of the image files under one root or several, each once; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}").load(root).select("path", "length").dropDuplicates(["path"])
    return files if limit is None else files.orderBy("path").limit(limit)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, record) of JSON lines as text; blank ones go."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"))


def counted(lines_: DataFrame) -> DataFrame:
    """One row: how many records parse as JSON objects with a ground truth, and how many are bad."""
    good = truth(F.col("line")).isNotNull() & F.get_json_object("line", "$.file_name").isNotNull()
    return lines_.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path) whose name without folder and extension isn't among those of ``done``."""
    stem = lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    return files.withColumn("stem", stem(F.col("path"))).join(done.select(stem(F.col("path")).alias("stem")).distinct(), "stem", "left_anti").drop("stem")


def truth(record: Column) -> Column:
    """The embedded ground truth as JSON text, without its wrapper if there is one; null where it doesn't parse."""
    inner = F.get_json_object(record, "$.ground_truth")
    return F.coalesce(F.get_json_object(inner, "$.gt_parse"), inner)


def category_table(spark: SparkSession, path: str) -> DataFrame:
    """file_name, category and ``row``, its place in the files, of CSV files with a header."""
    rows = spark.read.option("header", True).schema("file_name string, category string").csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # the last grows within a split
    return rows.select("file_name", F.coalesce("category", F.lit("")).alias("category"), place.alias("row"))


def kaggle(records: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Records of (line): metadata category and year, annotation texts joined; a table (file_name, category) overrides.

    Of repeated names the last row counts, by column ``row`` as ``category_table`` gives it; in a table without one, the greatest category.
    """
    gt = truth(F.col("line"))
    out = records.select(
        F.get_json_object("line", "$.file_name").alias("path"), F.nullif(F.get_json_object(gt, "$.metadata.category"), F.lit("")).alias("own"), F.get_json_object(gt, "$.metadata.year").alias("date"),
        F.array_join(F.filter(F.transform(F.from_json(F.get_json_object(gt, "$.annotations"), "array<struct<text:string>>"), lambda a: F.coalesce(a["text"], F.lit(""))), lambda t: t != ""), " ").alias("text"),
    )
    out = out.where(F.col("path").isNotNull())
    if categories is None:
        return out.select("path", F.lit("kaggle").alias("source"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("merchant"), "date", F.lit(None).cast("double").alias("total"), F.col("own").alias("category"), "text")
    last = F.max_by("category", "row") if "row" in categories.columns else F.max("category")
    named = categories.groupBy(F.col("file_name").alias("path")).agg(last.alias("given"))
    joined = out.join(named, "path", "left")
    return joined.select("path", F.lit("kaggle").alias("source"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("merchant"), "date", F.lit(None).cast("double").alias("total"), F.coalesce(F.nullif("given", F.lit("")), "own").alias("category"), "text")


def menu(gt: Column) -> Column:
    """Items of a menu that is a list or one object; fields may be text or lists of it; nameless items go. The text is parsed once."""
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    listed = lambda raw: let(kind(raw), lambda k: F.when(k.startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>")).when(k.startswith("OBJECT"), F.array(raw)))

    def flat(item: Column, name: str) -> Column:
        joined = lambda x: F.array_join(F.try_variant_get(x, "$", "array<string>"), " ")
        return let(F.try_variant_get(item, f"$.{name}", "variant"), lambda x: F.when(kind(x).startswith("ARRAY"), joined(x)).otherwise(F.try_variant_get(x, "$", "string")))

    number = lambda item, name, of: let(flat(item, name), of)
    one = lambda m: F.struct(flat(m, "nm").alias("name"), number(m, "cnt", quantity).alias("quantity"), number(m, "unitprice", digits_only).alias("unit_price"), number(m, "price", digits_only).alias("total_price"))
    each = let(F.try_variant_get(F.try_parse_json(gt), "$.menu", "variant"), listed)
    return F.filter(F.transform(each, one), lambda i: F.coalesce(F.trim(i["name"]), F.lit("")) != "")


def cord(records: DataFrame) -> DataFrame:
    """Records of (line): items of the menu and the total."""
    path = F.coalesce(F.get_json_object("line", "$.image_path"), F.get_json_object("line", "$.file_name"))
    read = once(records.withColumn("_gt", truth(F.col("line"))), "items", menu(F.col("_gt")))
    return read.select(
        path.alias("path"), F.lit("cord").alias("source"), F.lit("id").alias("language"), F.lit(None).cast("string").alias("merchant"),
        F.lit(None).cast("string").alias("date"), digits_only(F.get_json_object("_gt", "$.total.total_price")).alias("total"), F.lit(None).cast("string").alias("category"),
        F.array_join(F.transform("items", lambda i: i["name"]), " ").alias("text"), "items",
    )


def mbanking(records: DataFrame) -> DataFrame:
    """Records of (line): recipient, date, amount; the bank is the parent folder of a nested file."""
    gt = truth(F.col("line"))
    path = F.get_json_object("line", "$.file_name")
    return records.select(
        path.alias("path"), F.lit("mbanking").alias("source"), F.lit("id").alias("language"), F.get_json_object(gt, "$.recipient").alias("merchant"), F.get_json_object(gt, "$.date").alias("date"),
        digits_only(F.get_json_object(gt, "$.amount")).alias("total"), F.lit(None).cast("string").alias("category"), F.lit("").alias("text"), F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit("")).alias("bank"),
    )


def with_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose image is listed, by name without extension; of several, the first path."""
    stem = lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    known = files.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("file"))
    return records.withColumn("stem", stem(F.col("path"))).join(known, "stem").drop("stem")
