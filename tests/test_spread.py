"""Rows that cost far more than their bytes are dealt over all cores, what a line holds is asked once, and short forms round as their SQL."""

from pyspark.sql import functions as F

from tallyforge.functions import money
from tallyforge.operators import extract, screens
from tallyforge.plans import reading


def one_task(spark, lines):
    return spark.createDataFrame([(k, lines) for k in range(8)], "id int, lines array<string>").coalesce(1)


def partitions(df):
    return df.rdd.getNumPartitions()


def test_short_forms_round_by_the_exact_value(spark):
    wanted = {617_250_000: "Rp 617.2jt", 617_350_000: "Rp 617.4jt", 123_450_000: "Rp 123.5jt", 999_960_000: "Rp 1000.0jt", 1_250_000: "Rp 1.2jt", 1_750_000: "Rp 1.8jt", 2_500: "Rp 2rb", 3_500: "Rp 4rb", 12: "Rp 12"}
    rows = spark.createDataFrame([(k, v) for k, v in wanted.items()], "x bigint, y string")
    assert rows.where(money.short_rupiah(F.col("x")) != F.col("y")).count() == 0
    assert all(wanted[k] == f"Rp {k / 1e6:.1f}jt" for k in wanted if k >= 1_000_000)


def test_traces_of_one_file_are_many_tasks(spark):
    assert partitions(extract.amount_traces(one_task(spark, ["TOKO ROTI", "TOTAL 38.000"]))) > 1


def test_documents_of_one_file_are_many_tasks(spark):
    rows = one_task(spark, ["TOKO ROTI", "TOTAL 38.000"])
    assert partitions(extract.extract(rows)) > 1 and partitions(extract.read_all(rows)) > 1


def test_screens_of_one_file_are_many_tasks(spark):
    assert partitions(screens.parse(one_task(spark, ["QR Bayar", "Rp38.000"]))) > 1


def test_lines_of_one_file_are_many_tasks(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert partitions(reading.noisy(spark, str(tmp_path))) > 1


def test_the_first_date_repairs_its_text_once(spark):
    rows = one_task(spark, ["Tanggal 5 Mei 2024"]).select(screens.date_value(screens.first_date_text(F.array_join("lines", "\n"))).alias("x"))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 20 and rows.first()["x"] == "05/05/2024"
