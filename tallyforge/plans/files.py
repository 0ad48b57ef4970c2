"""Queries of files as users leave them: ledgers with records that don't fit, rows whose order is that of the file.

The files are written from the tables first; their SQL says from the tables alone what is to be read of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ledger
from ..session import new_folder
from ..sources import ledgers, loaders, sinks
from ..streaming import build
from .catalog import query, t

#: Events of a file.
FILE = 500


def ledger_files(spark, sf: str) -> str:
    """A folder of JSON arrays, FILE events each. Kinds of records go by the id modulo 13; every fifth file is one object, every seventh is cut off."""
    e = ledgers.events(spark, sf)
    k, i = F.col("id") % 13, F.col("id")
    own = F.when((k == 8) & (i % FILE > 8), i - 8).otherwise(i)  # the id of the record eight before
    record = lambda **other: F.to_json(F.struct(*[(other.get(c, own if c == "id" else F.col(c))).alias(c) for c in ledgers.SCHEMA.fieldNames()]), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    odd = [(0, record(amount=F.lit("12.5"))), (1, record(amount=F.lit("abc"))), (2, i.cast("string")), (3, record(merchant=i)), (4, record(date=none)), (5, record(id=F.lit("x"))), (6, record(notes=F.lit('a "note", [really]'))), (7, record(merchant=none))]
    text = record()
    for kind, x in odd:
        text = F.when(k == kind, x).otherwise(text)
    g = F.floor(F.col("id") / FILE)
    array = F.concat(F.lit(" ["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), ",\n"), F.lit("]"))
    files = e.withColumn("g", g).repartition("g").withColumn("text", text).groupBy("g").agg(array.alias("value"))  # texts are made where their file is written
    value = F.when(F.col("g") % 5 == 4, F.concat(F.lit('{"transactions":'), F.col("value"), F.lit("}"))).when(F.col("g") % 7 == 6, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    folder = new_folder(spark, "ledger-files")
    files.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


_FILES = f"""WITH e AS ({ledgers.EVENTS_SQL}), kinds AS (SELECT *, id % 13 AS k, id // {FILE} AS g, id % {FILE} AS place FROM e WHERE (id // {FILE}) % 5 <> 4 AND (id // {FILE}) % 7 <> 6),
 records AS (SELECT g, place, k, k IN (1, 2, 3, 5) AS odd, CASE WHEN k = 8 AND id % {FILE} > 8 THEN id - 8 ELSE id END AS id, CASE WHEN k <> 7 THEN merchant END AS merchant, CASE WHEN k = 0 THEN 12.5 ELSE amount END AS amount,
  CASE WHEN k <> 4 THEN date END AS date, category, source, CASE WHEN k = 6 THEN 'a "note", [really]' ELSE notes END AS notes FROM kinds)
"""


@query(_FILES + """ SELECT place, odd, CASE WHEN NOT odd THEN id END AS id, CASE WHEN NOT odd THEN merchant END AS merchant, CASE WHEN NOT odd THEN amount END AS amount, CASE WHEN NOT odd THEN date END AS date,
 CASE WHEN NOT odd THEN category END AS category, CASE WHEN NOT odd THEN notes END AS notes FROM records""")
def ledger_records(spark, sf) -> DataFrame:
    """Every record of the files, those that don't fit as odd ones."""
    rows = ledgers.scan(spark, ledger_files(spark, sf), "array")
    return rows.select(F.col("place.row").cast("long").alias("place"), F.col("bad").isNotNull().alias("odd"), "id", "merchant", "amount", "date", "category", "notes")


@query(_FILES + ", good AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g, place) AS nth FROM records WHERE NOT odd) SELECT id, place, CASE WHEN nth = 1 AND id % 2 = 0 THEN 'kesehatan' ELSE category END AS category FROM good")
def first_in_file(spark, sf) -> DataFrame:
    """An update of every second id, of which the record that the file has first changes."""
    rows = ledgers.read(spark, ledger_files(spark, sf), "array")
    changes = rows.where("id % 2 = 0").select("id", F.lit("kesehatan").alias("category"))
    return ledger.update_category(rows, changes).select("id", F.col("place.row").cast("long").alias("place"), "category")


@query(_FILES + " SELECT odd, CASE WHEN NOT odd THEN id END AS id, CASE WHEN NOT odd THEN merchant END AS merchant, CASE WHEN NOT odd THEN amount END AS amount FROM records WHERE odd OR id % 3 <> 0")
def amended_ledger(spark, sf) -> DataFrame:
    """Records deleted and the rest written back, twice, as versions; those that don't fit stay in the ledger."""
    folder = ledger_files(spark, sf)
    sinks.amend_ledger(spark, folder, lambda rows: ledger.delete(rows, rows.where("id % 6 = 0").select("id").distinct()), "array")
    sinks.amend_ledger(spark, folder, lambda rows: ledger.delete(rows, rows.where("id % 6 = 3").select("id").distinct()))
    return ledgers.scan(spark, folder).select(F.col("bad").isNotNull().alias("odd"), "id", "merchant", "amount")


@query("""WITH named AS (SELECT p_partkey % 50 AS k, max_by(CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END, p_partkey) AS given FROM part GROUP BY 1), records AS (SELECT DISTINCT p_partkey % 60 AS k FROM part)
SELECT 'f' || records.k || '.jpg' AS path, coalesce(nullif(given, ''), 'its own') AS category FROM records LEFT JOIN named USING (k)""")
def category_table(spark, sf) -> DataFrame:
    """Categories from a CSV file in which names repeat: the last row of the file counts."""
    p, folder = t(spark, sf, "part"), new_folder(spark, "categories")
    name = lambda n: F.concat(F.lit("f"), (F.col("p_partkey") % n).cast("string"), F.lit(".jpg"))
    rows = p.select("p_partkey", name(50).alias("file_name"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_type")).alias("category"))
    rows.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey").write.option("header", True).csv(folder)
    record = F.concat(F.lit('{"file_name": "'), name(60), F.lit('", "ground_truth": "{\\"gt_parse\\": {\\"metadata\\": {\\"category\\": \\"its own\\"}}}"}'))
    return loaders.kaggle(p.select(record.alias("line")).distinct(), loaders.category_table(spark, folder)).select("path", "category")


# -- names of a ledger ------------------------------------------------------------------------------------------------
#: A name as it is read, with {} for a number, and what is stored of it; the last two are no merchants.
NAMES = (
    ("Indomarett", "Indomaret"), ("Kopi {} Jl. Melati 5", "Kopi {}"), ("Toko {}, Ruko Blok B", "Toko {}"), ("QR Bayar Warung {}; Kec. Tebet", "Warung {}"), ("Kedai {} Kecamatan Coblong", "Kedai {}"), ("Rumah {} no 7", "Rumah {}"),
    ("(PT {}, Bandung, ID 40111)", "PT {}"), ("Alfamrt QRIS", "Alfamart"), ("Atfamardt", "Atfamardt"), ("Jl. Melati {}", "Jl. Melati {}"), ("  gedung   {} ", "gedung {}"), ("Total Belanja {}", "Total Belanja {}"), ("Kirim to {}", "Kirim to {}"),
)


def named_ledger(spark, sf: str) -> DataFrame:
    """Events as a ledger whose merchants are NAMES, by the id, with the user's number."""
    e, raw = ledgers.events(spark, sf).drop("ts"), F.lit("")
    for k, (name, _) in enumerate(NAMES):
        raw = F.when(F.col("id") % len(NAMES) == k, F.replace(F.lit(name), F.lit("{}"), F.element_at(F.split("merchant", "_"), 2))).otherwise(raw)
    return e.withColumn("merchant", raw)


_STORED = f"CASE id % {len(NAMES)} " + " ".join(f"WHEN {k} THEN replace('{want}', '{{}}', substr(merchant, 10))" for k, (_, want) in enumerate(NAMES)) + " END"


@query(f"WITH e AS ({ledgers.EVENTS_SQL}) SELECT id, {_STORED} AS merchant, id % {len(NAMES)} < {len(NAMES) - 2} AS valid, coalesce(amount, 0.0) AS amount FROM e")
def ledger_names(spark, sf) -> DataFrame:
    """Names without addresses and payment words, those like a popular merchant's as it is spelled; which of them are merchants."""
    rows = ledger.view(named_ledger(spark, sf))
    return rows.select("id", "merchant", text.valid_merchant(F.col("merchant")).alias("valid"), "amount")


@query(f"""WITH e AS ({ledgers.EVENTS_SQL}), n AS (SELECT {_STORED} AS stored, amount, saved_at FROM e WHERE id % 4 = 0 AND amount >= 0), x AS (SELECT max(id) AS top FROM e WHERE id % 4 <> 0)
 SELECT top + row_number() OVER (ORDER BY saved_at, stored, amount) AS id, stored AS merchant, amount FROM n CROSS JOIN x""")
def ledger_insert_names(spark, sf) -> DataFrame:
    """What is inserted has its names cleaned; numbers go on from the ledger's."""
    rows = named_ledger(spark, sf)
    held = rows.where("id % 4 <> 0")
    return ledger.insert(held, rows.where("id % 4 = 0").drop("id")).join(held.select("id"), "id", "left_anti").select("id", "merchant", "amount")


# -- a data set built from a stream of files --------------------------------------------------------------------------
@query("SELECT 'bank' || (p_partkey % 3) || '/' || (p_partkey % 700) || '.png' AS path, min(CAST(p_partkey % 2100 * 1000 AS DOUBLE)) AS total, 'bank' || (p_partkey % 3) AS bank FROM part GROUP BY p_partkey % 3, p_partkey % 700")
def streamed_build(spark, sf) -> DataFrame:
    """Records of payment screens as a stream of files, a few a batch; paths repeat within files and between them."""
    p, folder = t(spark, sf, "part"), new_folder(spark, "stream")
    path = F.concat(F.lit("bank"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), (F.col("p_partkey") % 700).cast("string"), F.lit(".png"))
    gt = F.to_json(F.struct(F.struct(F.lit("x").alias("recipient"), F.format_number(F.col("p_partkey") % 2100 * 1000, 0).alias("amount")).alias("gt_parse")))
    lines = p.select("p_partkey", F.to_json(F.struct(path.alias("file_name"), gt.alias("ground_truth"))).alias("value"))
    for k, part in enumerate((F.col("p_partkey") <= 700, F.col("p_partkey") > 700)):
        lines.where(part).sort("p_partkey").select("value").write.mode("append").text(f"{folder}/in/{k}")
        rows = build.records(spark, f"{folder}/in/*", files=3)
        build.build(loaders.mbanking(rows).select("path", "total", "bank"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return build.built(spark, f"{folder}/out").groupBy("path", "bank").agg(F.sum("total").alias("total")).select("path", "total", "bank")


# -- listings ---------------------------------------------------------------------------------------------------------
@query("SELECT 'k=' || (c_custkey % 7) AS folder, 1 AS files, CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes FROM customer GROUP BY c_custkey % 7")
def listed_files(spark, sf) -> DataFrame:
    """Files under roots that overlap, each once; those of other kinds are left out."""
    folder = new_folder(spark, "listing")
    c = t(spark, sf, "customer").select("c_name", (F.col("c_custkey") % 7).alias("k"))
    c.repartition("k").write.partitionBy("k").text(f"{folder}/all")
    c.select("k").write.json(f"{folder}/all/k=0/others")
    found = loaders.listing(spark, [f"{folder}/all", f"{folder}/all/k=3"], ("txt",))
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("length").alias("bytes"))
