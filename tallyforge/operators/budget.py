"""The 50/30/20 rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import BUCKETS, DEFAULT_CATEGORY, IDEAL, NEEDS
from ..functions.money import rupiah


def bucket(category: Column) -> Column:
    return F.when(F.coalesce(category, F.lit(DEFAULT_CATEGORY)).isin(*NEEDS), "kebutuhan").otherwise("keinginan")


def totals(ledger: DataFrame, income: float) -> DataFrame:
    """One row of bucket sums, savings and shares of income; none if there is no income."""
    own = F.when(F.col("amount") > 0, F.col("amount"))
    need = bucket(F.col("category")) == "kebutuhan"
    sums = ledger.agg(F.coalesce(F.sum(F.when(need, own)), F.lit(0.0)).alias("kebutuhan"), F.coalesce(F.sum(F.when(~need, own)), F.lit(0.0)).alias("keinginan"))
    sums = sums.withColumn("spent", F.col("kebutuhan") + F.col("keinginan")).withColumn("tabungan", F.greatest(F.lit(0.0), income - F.col("spent")))
    shares = {f"{b}_ratio": F.round(F.col(b) / float(income or 1), 4) for b in BUCKETS}
    return sums.withColumns(shares).where(F.lit(income > 0))


def compare(ledger: DataFrame, income: float) -> DataFrame:
    """A row for each bucket: actual, its share, the ideal share, whether it is over (savings never are) and the bar's width."""
    row = totals(ledger, income)
    pairs = ", ".join(f"'{b}', {b}, {b}_ratio" for b in BUCKETS)
    out = row.select(F.expr(f"stack({len(BUCKETS)}, {pairs}) AS (bucket, actual, actual_ratio)"))
    ideal = F.lit(None).cast("double")
    for b, share in IDEAL.items():
        ideal = F.when(F.col("bucket") == b, share).otherwise(ideal)
    over = (F.col("bucket") != "tabungan") & (F.col("actual_ratio") > F.col("ideal_ratio"))
    out = out.withColumn("ideal_ratio", ideal).withColumn("actual", F.round("actual", 2))
    return out.select("bucket", "actual", "actual_ratio", "ideal_ratio", over.alias("is_over"), F.round(F.least(F.lit(100.0), F.col("actual_ratio") / F.col("ideal_ratio") * 100), 1).alias("width"))


def advice(ledger: DataFrame, income: float) -> DataFrame:
    """(position, rule, message): the rules that apply, in order, or the one for spending under control."""
    need, want, save = (F.col(f"{b}_ratio") * 100 for b in BUCKETS)
    percent = lambda x: F.concat(F.rint(x).cast("int").cast("string"), F.lit("%"))
    spent = F.col("spent")
    # Limits, and what the advice says.
    rules = [
        ("over_income", spent > income, F.concat(F.lit("Pengeluaran melebihi pemasukan sebesar "), rupiah(spent - income), F.lit(". Coba kurangi pengeluaran keinginan terlebih dahulu."))),
        ("needs_high", need > 55, F.concat(F.lit("Pengeluaran kebutuhan ("), percent(need), F.lit(") melebihi batas ideal 50%. Cek tagihan atau biaya transportasi yang bisa dihemat."))),
        ("wants_high", want > 35, F.concat(F.lit("Pengeluaran keinginan ("), percent(want), F.lit(") melebihi batas ideal 30%. Pertimbangkan untuk mengurangi belanja atau hiburan."))),
        ("savings_low", (save < 10) & (spent < income), F.concat(F.lit("Tabungan saat ini hanya "), percent(save), F.lit(" dari pemasukan. Idealnya sisihkan minimal 20% untuk tabungan atau investasi."))),
        ("savings_good", ~((save < 10) & (spent < income)) & (save >= 20), F.concat(F.lit("Bagus! Kamu berhasil menyisihkan "), percent(save), F.lit(" pemasukan untuk tabungan. Pertahankan kebiasaan ini."))),
    ]
    said = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("rule"), text.alias("message"))) for name, test, text in rules]))
    calm = F.concat(F.lit("Pengeluaran kamu terkontrol dengan baik ("), percent(spent / float(income or 1) * 100), F.lit(" dari pemasukan). Tetap pantau setiap kategori agar tetap sesuai rencana."))
    out = totals(ledger, income).select(F.when(F.size(said) > 0, said).otherwise(F.array(F.struct(F.lit("under_control").alias("rule"), calm.alias("message")))).alias("said"))
    return out.select(F.posexplode("said").alias("position", "s")).select((F.col("position") + 1).alias("position"), "s.rule", "s.message")
