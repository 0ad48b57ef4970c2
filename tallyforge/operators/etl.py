"""Labelled data sets: unified, split, encoded, labelled; and metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .ranks import medians

UNIFIED = ("path", "source", "language", "merchant", "date", "total", "category", "text")
ITEM = "struct<name:string,quantity:double,unit_price:double,total_price:double>"


def unified(*loaded: DataFrame) -> DataFrame:
    out = loaded[0].select(*UNIFIED)
    for x in loaded[1:]:
        out = out.unionByName(x.select(*UNIFIED))
    return out


def stratified_split(rows: DataFrame, key: str = "id", stratum: str = "source", shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: str = "42") -> DataFrame:
    """``rows`` with split: within each stratum the first int(n * share) by a hash of the key are train, the next val, the rest test.

    Only stratum and hash move, dealt by range over both, so that a stratum with a third of all rows spreads over a third of
    the partitions. Ranks are those within a partition, and on from the counts of the partitions before; what joins back to
    the rows is the two hashes of each stratum at which its splits end, one row a stratum.
    """
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError("shares must add up to 1")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    keyed = rows.select(F.col(stratum).alias("_s"), order.alias("_o"), F.col(key).cast("string").alias("_i"))
    dealt = checkpointed(keyed.repartitionByRange("_s", "_o", "_i").withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("_s")
    starts = counts.select("_s", "_p", F.sum("c").over(by).alias("_n"), F.coalesce(F.sum("c").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_o", "_i")))
    placed = own.join(starts.withColumnsRenamed({"_s": "_s2", "_p": "_p2"}), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_p") == F.col("_p2"))).withColumn("_k", F.col("_k") + F.col("_b"))
    train, val = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * shares[1])
    last = lambda n: F.max(F.when(F.col("_k") == n, F.struct("_o", "_i")))
    ends = placed.groupBy("_s").agg(last(train).alias("_t"), last(train + val).alias("_v")).withColumnRenamed("_s", "_s2")
    at = F.struct(order.alias("_o"), F.col(key).cast("string").alias("_i"))
    out = rows.join(ends, rows[stratum].eqNullSafe(F.col("_s2")))
    return out.withColumn("split", F.when(at <= F.col("_t"), "train").when(at <= F.col("_v"), "val").otherwise("test")).drop("_s2", "_t", "_v")


def escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def number_text(x: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).when(x.isNotNull(), F.format_string("%.2f", x.cast("double")))


#: The tags of target texts, in their order: of a record, then of its items.
RECORD_TAGS, ITEM_TAGS = ("source", "merchant", "date", "total", "currency", "category", "items"), ("item", "name", "qty", "unit_price", "price")


def _tag(name: str, x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.lit(f"<s_{name}>"), x, F.lit(f"</s_{name}>")))


def encoded(source: Column, merchant: Column, date: Column, total: Column, currency: Column, category: Column, items: Column | None = None) -> Column:
    """Target text of a record: a tag around each field that is there, and around its items each with its own."""
    there = lambda x: F.nullif(x, F.lit(""))
    parts = [source, escaped(there(merchant)), escaped(there(date)), number_text(total), there(currency), escaped(there(category))]
    if items is not None:
        fields = lambda i: (escaped(i["name"]), number_text(i["quantity"]), number_text(i["unit_price"]), number_text(i["total_price"]))
        one = lambda i: _tag("item", F.concat_ws("", *[_tag(t, x) for t, x in zip(ITEM_TAGS[1:], fields(i), strict=True)]))
        parts.append(F.when(F.size(items) > 0, F.array_join(F.transform(items, one), "")))
    return F.concat_ws("", *[_tag(t, x) for t, x in zip(RECORD_TAGS, parts, strict=False)])


def special_tokens() -> list[str]:
    """The opening and the closing tag of each field."""
    return [f"<{slash}s_{t}>" for t in (*RECORD_TAGS, *ITEM_TAGS) for slash in ("", "/")]


def label_shares(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Count and percentage of each label in each split and OVERALL; labels that a split lacks count 0 there."""
    counts = rows.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    # Splits times labels: the side of the splits, which are three, goes with each label.
    grid = rows.select(label).distinct().crossJoin(F.broadcast(rows.select(split).distinct()))
    full = grid.join(counts, [split, label], "left").select(F.col(split).alias("split"), F.col(label).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
    both = full.unionByName(full.groupBy("label").agg(F.sum("n").alias("n")).select(F.lit("OVERALL").alias("split"), "label", "n"))
    return both.withColumn("percentage", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")) * 100, 1))


def stratified_sample(rows: DataFrame, label: str, key: str, n: int = 10, seed: str = "42") -> DataFrame:
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(order, key))).where(F.col("place") <= n)


def counters(rows: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) for each column, from one pass by grouping sets."""
    sets = rows.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, c in enumerate(columns):
        own = F.col("g") == (2 ** len(columns) - 1) - 2 ** (len(columns) - 1 - k)
        which, value = F.when(own, c).otherwise(which), F.when(own, F.col(c).cast("string")).otherwise(value)
    return sets.select(which.alias("field"), value.alias("value"), "n")


def confusion(rows: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    return rows.groupBy(F.col(truth).cast("string").alias("truth")).pivot(predicted, labels).agg(F.count(F.lit(1))).fillna(0).select("truth", *[F.col(str(x)).cast("long").alias(f"predicted_{x}") for x in labels])


def scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro F1 and weighted F1; a label never met or never predicted has F1 0."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")))).alias("s"), (F.col("t") == F.col("p")).alias("hit"))
    by = sides.groupBy("s.label").agg(F.sum("s.real").alias("real"), F.sum("s.said").alias("said"), F.sum(F.when(F.col("hit"), F.col("s.real")).otherwise(0)).alias("right"))
    f1 = F.when(F.col("real") + F.col("said") > 0, 2 * F.col("right") / (F.col("real") + F.col("said"))).otherwise(0.0)
    return by.agg(F.round(F.sum("right") / F.sum("real"), 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("macro_f1"), F.round(F.sum(f1 * F.col("real")) / F.sum("real"), 6).alias("weighted_f1"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c)."""
    every = Window.partitionBy(F.lit(1))
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", F.round(F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")), 6).alias("weight"))


def completeness(rows: DataFrame) -> DataFrame:
    """One row of how many records have a merchant, an amount and a date, and lack them."""
    has = {"merchant": F.trim(F.coalesce("merchant", F.lit(""))) != "", "amount": F.coalesce("amount", F.lit(0.0)) > 0, "date": F.trim(F.coalesce("date", F.lit(""))) != ""}
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(v).alias(f"with_{k}") for k, v in has.items()], *[F.count_if(~v).alias(f"without_{k}") for k, v in has.items()])


def times(rows: DataFrame, seconds: str) -> DataFrame:
    ends = rows.agg(F.round(F.avg(seconds), 2).alias("mean"), F.round(F.max(seconds), 2).alias("max"))
    return ends.crossJoin(F.broadcast(medians(rows, seconds).select(F.round("median", 2).alias("median"))))  # one row each


def suspected_error(error: Column, merchant: Column, amount: Column, date: Column, confidence: Column) -> Column:
    """The first diagnosis that applies."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "ocr_error").when(F.coalesce(amount, F.lit(0.0)) <= 0, "amount_missing").when(F.trim(F.coalesce(merchant, F.lit(""))) == "", "merchant_missing")
        .when(F.trim(F.coalesce(date, F.lit(""))) == "", "date_missing").when(confidence < 0.62, "low_confidence").otherwise("ok")
    )


def item_stats(rows: DataFrame) -> DataFrame:
    """One row: records, items each has on average, and how many have a total."""
    return rows.agg(F.count(F.lit(1)).alias("records"), F.round(F.avg(F.size("items")), 1).alias("average_items"), F.count_if(F.coalesce("total", F.lit(0.0)) != 0).alias("with_total"))


def as_json(rows: DataFrame, column: str = "record") -> DataFrame:
    """Each row as one JSON text, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def sample_by_quota(rows: DataFrame, group: str, order: str, quotas: dict[str, int]) -> DataFrame:
    """The first rows of each group, as many as its quota; groups without one give none."""
    most = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    ranked = rows.where(F.col(group).isin(*quotas)).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.where(F.col("place") <= F.try_element_at(most, F.col(group)))


def build(*loaded: DataFrame, key: str = "path") -> DataFrame:
    """Loaded sets unified and split, each source for itself."""
    return stratified_split(unified(*loaded), key=key)


def allowed_uploads(files: DataFrame, most: int = 3, bytes_: int = 10 * 1024 * 1024) -> DataFrame:
    """The first ``most`` files (place, mime, length) that are images of at most ``bytes_``."""
    return files.where(F.col("mime").startswith("image/") & (F.col("length") <= bytes_)).orderBy("place").limit(most)


def end_record(rows: DataFrame) -> DataFrame:
    """Read documents (path, route, merchant, items, raw) as one record each: method, a preview of three items, their number, and the text that a category is told by."""
    names = F.filter(F.transform(F.coalesce("items", F.array().cast(f"array<{ITEM}>")), lambda i: i["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    screen = F.col("route") == "screenshot"
    text = F.when(screen, F.coalesce(F.nullif("merchant", F.lit("")), F.substring(F.coalesce("raw", F.lit("")), 1, 200))).otherwise(F.array_join(names, " "))
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("image"), F.when(screen, "easyocr+regex").otherwise("donut").alias("method"), F.when(screen, F.col("merchant")).alias("merchant"),
        F.array_join(F.slice(names, 1, 3), "|").alias("items_preview"), F.size(names).alias("n_items"), text.alias("text"),
    )


def status_label(status: Column, merchant: Column, amount: Column) -> Column:
    """How a reading is shown: one without a merchant or an amount is to be checked too."""
    missing = (F.coalesce(merchant, F.lit("")) == "") | (F.coalesce(amount, F.lit("")) == "")
    return F.when(status == "failed", "Belum terbaca").when((status == "needs_review") | missing, "Perlu dicek").otherwise("Terbaca")


def first_of_group(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("place") <= k)
