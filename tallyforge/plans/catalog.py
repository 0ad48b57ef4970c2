"""Every query of the engine's own operators with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import CATEGORY_DISPLAY, KEYWORDS, MONTH_NAMES, NEEDS, SOURCE_LABELS
from ..functions import dates, money, text
from ..operators import anomaly, budget, categorize, etl, extract, insights, learned, ledger
from ..operators.ranks import medians
from ..session import checkpointed, once, spread
from ..sources import ledgers, loaders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MONTH, INCOME = "2024-01", 500_000.0
ORDERS_MONTH = "1997-03"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.month_of(ledgers.events(spark, sf_dir), MONTH)


def sql_display(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_DISPLAY.items()) + f" ELSE {c} END"


NORM = """CASE WHEN length(trim(date)) >= 10 AND regexp_matches(substr(trim(date), 1, 10), '^[^/-]{4}[/-][^/-]*[/-][^/-]*$') THEN replace(substr(trim(date), 1, 10), '/', '-')
 WHEN length(trim(date)) >= 10 AND regexp_matches(substr(trim(date), 1, 10), '^[^/-]{2}[/-][^/-]*[/-][^/-]{4}$') THEN regexp_replace(substr(trim(date), 1, 10), '^([^/-]{2})[/-]([^/-]*)[/-]([^/-]{4})$', '\\3-\\2-\\1')
 ELSE substr(trim(date), 1, 10) END"""
EV = f"""WITH e AS ({ledgers.EVENTS_SQL}), m AS (SELECT *, CASE WHEN trim(date) = '' THEN substr(saved_at, 1, 10) ELSE {NORM} END AS day FROM e
 WHERE CASE WHEN trim(date) = '' THEN substr(saved_at, 1, 7) ELSE substr({NORM}, 1, 7) END = '{MONTH}')
"""
OR = f"WITH o AS ({ledgers.ORDERS_SQL}) "


# -- insights ---------------------------------------------------------------------------------------------------------
@query(EV + f"SELECT category, {sql_display('category')} AS category_display, round(sum(amount), 2) AS total, count(*) AS count, round(round(sum(amount), 2) / sum(round(sum(amount), 2)) OVER () * 100, 1) AS percentage FROM m GROUP BY category")
def category_breakdown(spark, sf):
    return insights.by_category(month_events(spark, sf))


@query(OR + f"SELECT category, {sql_display('category')} AS category_display, round(sum(amount), 2) AS total, count(*) AS count, round(round(sum(amount), 2) / sum(round(sum(amount), 2)) OVER () * 100, 1) AS percentage FROM o WHERE ts >= TIMESTAMP '{ORDERS_MONTH}-01' AND ts < TIMESTAMP '{ORDERS_MONTH}-01' + INTERVAL 1 MONTH GROUP BY category")
def category_breakdown_range(spark, sf):
    return insights.by_category(insights.month_range(ledgers.orders(spark, sf), ORDERS_MONTH))


@query(EV + "SELECT id, merchant, amount, date, category, source, saved_at FROM m")
def month_filter(spark, sf):
    return month_events(spark, sf).select("id", "merchant", "amount", "date", "category", "source", "saved_at")


@query(EV + f""", c AS (SELECT category, sum(amount) AS s, min(id) AS f FROM m GROUP BY category), n AS (SELECT merchant, count(*) AS n, min(id) AS f FROM m WHERE merchant <> '' GROUP BY merchant)
SELECT round(sum(amount), 2) AS total_expense, count(*) AS transaction_count, round(avg(amount), 2) AS average_transaction, (SELECT category FROM c ORDER BY round(s, 4) DESC, f LIMIT 1) AS top_category,
 {sql_display('(SELECT category FROM c ORDER BY round(s, 4) DESC, f LIMIT 1)')} AS top_category_display, (SELECT merchant FROM n ORDER BY n DESC, f LIMIT 1) AS top_merchant, {INCOME}::DOUBLE AS monthly_income,
 round(greatest(0.0, {INCOME} - round(sum(amount), 2)), 2)::DOUBLE AS remaining_balance FROM m""")
def insight_summary(spark, sf):
    return insights.summary(month_events(spark, sf), INCOME)


@query(EV + "SELECT day, round(sum(amount), 2) AS total, count(*) AS count FROM m WHERE day <> '' GROUP BY day")
def daily_expenses(spark, sf):
    return insights.daily(month_events(spark, sf))


@query(EV + ", s AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(DATE '2024-01-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS d)), g AS (SELECT day, round(sum(amount), 2) AS total, count(*) AS count FROM m GROUP BY day) SELECT day, coalesce(total, 0.0)::DOUBLE AS total, coalesce(count, 0) AS count FROM s LEFT JOIN g USING (day)")
def daily_trend(spark, sf):
    return insights.trend(month_events(spark, sf), "2024-01-25", "2024-02-05")


@query(EV + ", s AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(DATE '2024-01-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS d)), g AS (SELECT day, round(sum(amount), 2) AS total FROM m GROUP BY day), f AS (SELECT coalesce(total, 0.0) AS total FROM s LEFT JOIN g USING (day)) SELECT round(sum(total), 2) AS total, round(avg(total), 2) AS per_day, count(*) FILTER (total > 0) AS days_with_spend FROM f")
def trend_totals(spark, sf):
    return insights.trend_totals(insights.trend(month_events(spark, sf), "2024-01-25", "2024-02-05"))


@query(EV + f"SELECT id, merchant, amount, date, category, {sql_display('category')} AS category_display, source FROM m ORDER BY saved_at DESC, id LIMIT 10")
def recent_transactions(spark, sf):
    return insights.recent(month_events(spark, sf))


@query(OR + f"SELECT category, {sql_display('category')} AS category_display, round(sum(amount), 2) AS total, count(*) AS count, round(round(sum(amount), 2) / sum(round(sum(amount), 2)) OVER () * 100, 1) AS percentage FROM o GROUP BY category ORDER BY total DESC, category LIMIT 3")
def top_categories(spark, sf):
    return insights.top_categories(ledgers.orders(spark, sf), 3)


@query(EV + "SELECT id, merchant, amount, category, source FROM e WHERE contains(lower(merchant), 'nt_1') AND category = 'belanja' AND source = 'manual'")
def history_search(spark, sf):
    return insights.search(ledgers.events(spark, sf), "NT_1", "belanja", "manual").select("id", "merchant", "amount", "category", "source")


@query(EV + "SELECT count(*) AS count, round(sum(amount), 2) AS total, round(avg(amount), 2) AS mean, count(*) FILTER (contains(lower(merchant), 'nt_1') AND category = 'belanja') AS filtered FROM e")
def history_totals(spark, sf):
    return insights.history_totals(ledgers.events(spark, sf), "NT_1", "belanja")


@query(EV + f", s AS (SELECT round(sum(amount), 2) AS spent FROM m) SELECT spent, {INCOME}::DOUBLE AS income, CAST(floor(spent / {INCOME} * 100 + 0.5) AS BIGINT) AS used_percent, least(100, CAST(floor(spent / {INCOME} * 100 + 0.5) AS BIGINT)) AS capped_percent, spent > {INCOME} AS over_budget, round(greatest(0.0, {INCOME} - spent), 2)::DOUBLE AS potential_saving FROM s")
def income_use(spark, sf):
    return insights.income_use(month_events(spark, sf), INCOME)


@query("SELECT c_custkey AS id, c_acctbal AS amount, c_mktsegment AS label, '2024-01-01' AS date FROM customer WHERE c_custkey % 3 <> 0")
def income_entries(spark, sf):
    """Of every third customer the entries are one object in place of an array, or no JSON; both have none."""
    c = t(spark, sf, "customer")
    entry = F.to_json(F.array(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("label"), F.lit("2024-01-01").alias("date"))))
    return insights.income_entries(c.select(F.when(F.col("c_custkey") % 6 == 0, ' {"id": 1, "amount": 5}').when(F.col("c_custkey") % 3 == 0, "x").otherwise(entry).alias("entries")))


# -- budget -----------------------------------------------------------------------------------------------------------
_NEEDS = ", ".join(f"'{x}'" for x in NEEDS)
_BUDGET = f""", b AS (SELECT coalesce(sum(amount) FILTER (category IN ({_NEEDS})), 0.0) AS kebutuhan, coalesce(sum(amount) FILTER (category NOT IN ({_NEEDS})), 0.0) AS keinginan FROM m WHERE amount > 0),
 c AS (SELECT *, kebutuhan + keinginan AS spent, greatest(0.0, {INCOME} - (kebutuhan + keinginan))::DOUBLE AS tabungan FROM b),
 d AS (SELECT *, round(kebutuhan / {INCOME}, 4)::DOUBLE AS kebutuhan_ratio, round(keinginan / {INCOME}, 4)::DOUBLE AS keinginan_ratio, round(tabungan / {INCOME}, 4)::DOUBLE AS tabungan_ratio FROM c) """


@query(EV + _BUDGET + "SELECT round(kebutuhan, 2) AS kebutuhan, round(keinginan, 2) AS keinginan, round(spent, 2) AS spent, round(tabungan, 2) AS tabungan, kebutuhan_ratio, keinginan_ratio, tabungan_ratio FROM d")
def budget_totals(spark, sf):
    out = budget.totals(month_events(spark, sf), INCOME)
    return out.withColumns({c: F.round(c, 2) for c in ("kebutuhan", "keinginan", "spent", "tabungan")})


@query(EV + _BUDGET + """, u AS (SELECT 'kebutuhan' AS bucket, kebutuhan AS actual, kebutuhan_ratio AS actual_ratio, 0.5::DOUBLE AS ideal_ratio FROM d UNION ALL SELECT 'keinginan', keinginan, keinginan_ratio, 0.3::DOUBLE FROM d UNION ALL SELECT 'tabungan', tabungan, tabungan_ratio, 0.2::DOUBLE FROM d)
SELECT bucket, round(actual, 2) AS actual, actual_ratio, ideal_ratio, bucket <> 'tabungan' AND actual_ratio > ideal_ratio AS is_over, round(least(100.0::DOUBLE, actual_ratio / ideal_ratio * 100), 1) AS width FROM u""")
def budget_comparison(spark, sf):
    return budget.compare(month_events(spark, sf), INCOME)


@query(EV + _BUDGET + f""", r AS (SELECT 1 AS k, 'over_income' AS rule, spent > {INCOME} AS ok FROM d UNION ALL SELECT 2, 'needs_high', kebutuhan_ratio * 100 > 55 FROM d UNION ALL SELECT 3, 'wants_high', keinginan_ratio * 100 > 35 FROM d
 UNION ALL SELECT 4, 'savings_low', tabungan_ratio * 100 < 10 AND spent < {INCOME} FROM d UNION ALL SELECT 5, 'savings_good', NOT (tabungan_ratio * 100 < 10 AND spent < {INCOME}) AND tabungan_ratio * 100 >= 20 FROM d)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, rule FROM r WHERE ok""")
def budget_advice(spark, sf):
    return budget.advice(month_events(spark, sf), INCOME).select("position", "rule")


# -- anomalies --------------------------------------------------------------------------------------------------------
@query(EV + ", b AS (SELECT count(*) AS n, avg(amount) AS mean, median(amount) AS median, quantile_disc(amount, 0.5 ORDER BY amount DESC) AS upper_median FROM m WHERE amount > 0) SELECT n, round(mean, 6) AS mean, median, upper_median FROM b")
def anomaly_baselines(spark, sf):
    return anomaly.baselines(month_events(spark, sf)).withColumn("mean", F.round("mean", 6))


@query(EV + ", b AS (SELECT count(*) AS n, avg(amount) AS mean FROM m WHERE amount > 0) SELECT id, merchant, amount, category, -0.6::DOUBLE AS anomaly_score, round(mean, 2) AS baseline_mean, 'tinggi' AS attention FROM m CROSS JOIN b WHERE n >= 10 AND amount > 3 * mean")
def rule_anomalies(spark, sf):
    out = anomaly.by_rule(month_events(spark, sf))
    return out.select("id", "merchant", "amount", "category", "anomaly_score", "baseline_mean", anomaly.attention(F.col("anomaly_score")).alias("attention"))


@query()
def forest_anomalies(spark, sf):
    return anomaly.detect(month_events(spark, sf))


@query()
def forest_global(spark, sf):
    """One forest for all rows, without the rule."""
    return anomaly.detect(month_events(spark, sf), by_category=False)


@query(f"WITH e AS ({ledgers.EVENTS_SQL}), u AS (SELECT id % 97 AS place, amount FROM e WHERE amount > 0) SELECT CAST(place AS BIGINT) AS place, median(amount) AS median, quantile_disc(amount, 0.5 ORDER BY amount DESC) AS upper_median FROM u GROUP BY place UNION ALL SELECT NULL, median(amount), quantile_disc(amount, 0.5 ORDER BY amount DESC) FROM u")
def group_medians(spark, sf):
    """Medians of 97 groups and of all rows, which the sketch brackets where they are many."""
    own = ledgers.events(spark, sf).where("amount > 0").select((F.col("id") % 97).alias("place"), "amount")
    return medians(own, "amount", "place").unionByName(medians(own, "amount"), allowMissingColumns=True)


@query(EV + ", p AS (SELECT *, count(*) OVER (PARTITION BY category) AS size FROM m WHERE amount > 0), s AS (SELECT CASE WHEN size >= 1990 THEN 'category:' || category ELSE 'global_fallback' END AS scope, amount FROM p) SELECT scope, count(*) AS n, round(avg(amount), 4) AS own_mean, median(amount) AS own_median FROM s GROUP BY scope HAVING count(*) >= 2")
def forest_scopes(spark, sf):
    """The groups that forests are fitted on, with the baselines that their finds are held against; small categories are one group."""
    own = month_events(spark, sf).where("amount > 0")
    return anomaly.scopes(anomaly.scoped(own, min_samples=1990)).withColumn("own_mean", F.round("own_mean", 4))


@query(EV + ", b AS (SELECT count(*) AS n, avg(amount) AS mean FROM m WHERE amount > 0), r AS (SELECT id, -0.6::DOUBLE AS anomaly_score, 'rule_based' AS baseline_scope FROM m CROSS JOIN b WHERE n >= 10 AND amount > 3 * mean), f AS (SELECT id, -0.7::DOUBLE AS anomaly_score, 'global' AS baseline_scope FROM m WHERE id % 3 = 0 AND amount > 100) SELECT * FROM f UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM f)")
def merged_anomalies(spark, sf):
    """Finds of a model, here by a plain rule, and the rule's anomalies that it lacks."""
    m = month_events(spark, sf)
    found = m.where("id % 3 = 0 and amount > 100").select(*anomaly.COLUMNS, F.lit(-0.7).alias("anomaly_score"), F.lit(0.0).alias("baseline_median"), F.lit(0.0).alias("baseline_mean"), F.lit("global").alias("baseline_scope"), F.lit("").alias("anomaly_reason"))
    return anomaly.with_rules(found, m).select("id", "anomaly_score", "baseline_scope")


@query("SELECT user_id, count(*) AS n, least(0.49, CASE WHEN count(*) >= 2 THEN greatest(0.1, 1.0::DOUBLE / count(*)) ELSE 0.1 END)::DOUBLE AS contamination FROM events WHERE event_type = 'error' GROUP BY user_id")
def contamination(spark, sf):
    """The share to flag among the errors of each user."""
    own = t(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", "n", anomaly.contamination(F.col("n")).alias("contamination"))


# -- ledger changes ---------------------------------------------------------------------------------------------------
@query(f"WITH e AS ({ledgers.EVENTS_SQL}), n AS (SELECT *, row_number() OVER (ORDER BY saved_at, merchant, amount) AS k FROM e WHERE id % 5 = 0 AND id % 10 <> 0), x AS (SELECT max(id) AS top FROM e WHERE id % 5 <> 0) SELECT id, merchant, amount, category FROM e WHERE id % 5 <> 0 UNION ALL SELECT top + k, merchant, amount, category FROM n CROSS JOIN x")
def ledger_insert(spark, sf):
    e = ledgers.events(spark, sf).drop("ts")
    bad = e.where("id % 10 = 0").drop("id").withColumn("amount", F.lit(-1.0))
    good = e.where("id % 5 = 0 and id % 10 <> 0").drop("id")
    return ledger.insert(e.where("id % 5 <> 0"), good.unionByName(bad)).select("id", "merchant", "amount", "category")


@query(f"WITH e AS ({ledgers.EVENTS_SQL}), r AS (SELECT *, id % 4000 AS k FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY saved_at, merchant, amount, date, category, source) AS place FROM r) SELECT k AS id, merchant, amount, CASE WHEN k % 7 = 0 AND place = 1 THEN 'kesehatan' ELSE category END AS category FROM s")
def ledger_update(spark, sf):
    """Ids repeat: only the first record of each changes."""
    e = ledgers.events(spark, sf).drop("ts").withColumn("id", F.col("id") % 4000)
    changes = e.where("id % 7 = 0").select("id", F.lit("kesehatan").alias("category")).unionByName(e.where("id % 11 = 0").select("id", F.lit("no_such").alias("category")))
    return ledger.update_category(e, changes).select("id", "merchant", "amount", "category")


@query(f"WITH e AS ({ledgers.EVENTS_SQL}) SELECT id, merchant, amount FROM e WHERE id % 7 <> 0")
def ledger_delete(spark, sf):
    e = ledgers.events(spark, sf)
    return ledger.delete(e, e.where("id % 7 = 0").select("id")).select("id", "merchant", "amount")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def ledger_unmatched(spark, sf):
    return ledger.unmatched(ledgers.events(spark, sf), t(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


@query(f"WITH e AS ({ledgers.EVENTS_SQL}) SELECT id, merchant, amount FROM e WHERE false")
def ledger_truncate(spark, sf):
    return ledger.truncate(ledgers.events(spark, sf)).select("id", "merchant", "amount")


@query(f"WITH e AS ({ledgers.EVENTS_SQL}) SELECT id, merchant, amount, date, category, source, saved_at, {sql_display('category')} AS category_display FROM e")
def ledger_view(spark, sf):
    return ledger.view(ledgers.events(spark, sf))


_REASON = "CASE WHEN c_acctbal < 0 THEN 'negative_amount' WHEN trim(CASE c_custkey % 9 WHEN 0 THEN ' ' ELSE c_name END) = '' THEN 'blank_merchant' {} WHEN c_mktsegment <> 'BUILDING' THEN 'unknown_category' END"


@query(f"SELECT c_custkey AS id, {_REASON.format('')} AS reason, {_REASON.format(chr(10) + ' WHEN c_custkey % 4 = 0 THEN ' + chr(39) + 'blank_date' + chr(39))} AS manual_reason FROM customer")
def ledger_validation(spark, sf):
    c = t(spark, sf, "customer")
    merchant = F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_name"))
    category = F.when(F.col("c_mktsegment") == "BUILDING", "tagihan").otherwise(F.col("c_mktsegment"))
    date = F.when(F.col("c_custkey") % 4 == 0, "").otherwise("2024-01-01")
    return c.select(F.col("c_custkey").alias("id"), ledger.reject_reason(merchant, F.col("c_acctbal"), category).alias("reason"), ledger.reject_reason(merchant, F.col("c_acctbal"), category, date).alias("manual_reason"))


@query("WITH r AS (SELECT CASE c_custkey % 9 WHEN 0 THEN ' ' ELSE c_name END AS merchant, c_acctbal AS amount, c_custkey % 5 = 0 AS saved, c_custkey % 13 = 0 AS fails FROM customer), u AS (SELECT *, trim(merchant) <> '' AND amount > 0 AND NOT saved AS ok FROM r) SELECT count(*) FILTER (ok AND NOT fails) AS saved, count(*) FILTER (ok AND fails) AS failed, count(*) - count(*) FILTER (ok AND NOT fails) AS skipped, count(*) AS total FROM u")
def save_report(spark, sf):
    c = t(spark, sf, "customer")
    return ledger.save_report(c.select(F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_name")).alias("merchant"), F.col("c_acctbal").cast("string").alias("amount"), (F.col("c_custkey") % 5 == 0).alias("saved"), (F.col("c_custkey") % 13 == 0).alias("fails")))


# -- categories -------------------------------------------------------------------------------------------------------
_EDGE = r"[^\p{L}\p{N}_]"


def _alone_sql(words: tuple[str, ...]) -> str:
    """Words of up to four letters between other characters, which the text has doubled so that neighbours don't share one."""
    double = lambda w: re.sub(r"([^a-z0-9])", r"\1\1", w).replace(".", r"\.")
    return rf"(?:^|{_EDGE})(?:{'|'.join(double(w) for w in words if len(w) <= 4)})(?:$|{_EDGE})"


def _keyword_sql(column: str) -> str:
    twice = rf"regexp_replace({column}, '({_EDGE})', '\1\1', 'g')"
    longer = lambda k: " OR ".join(f"contains({column}, '{w}')" for w in k if len(w) > 4)
    return "CASE " + " ".join(f"WHEN {longer(k)} OR regexp_matches({twice}, '{_alone_sql(k)}') THEN '{c}'" for c, k in KEYWORDS.items()) + " END"


@query(f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS x, text FROM documents), k AS (SELECT *, {_keyword_sql('x')} AS c FROM d) SELECT doc_id, coalesce(CASE WHEN trim(coalesce(text, '')) = '' THEN 'lainnya' END, c, 'lainnya') AS label, CASE WHEN trim(coalesce(text, '')) <> '' AND c IS NOT NULL THEN 0.68 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_input' WHEN c IS NOT NULL THEN 'keyword' ELSE 'ml_unavailable' END AS origin FROM k")
def keyword_category(spark, sf):
    got = categorize.classify(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", got["label"].alias("label"), got["confidence"].alias("confidence"), got["source"].alias("origin"))


@query(f"WITH p AS (SELECT p_partkey AS id, lower(p_name) AS x FROM part) SELECT id, {_keyword_sql('x')} AS label FROM p")
def part_category(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), categorize.by_keyword(F.col("p_name")).alias("label"))


def _hybrid_sql() -> str:
    parts = []
    for k, (c, words) in enumerate(KEYWORDS.items()):
        inside = " + ".join(f"CAST(contains(x, '{w}') AS INTEGER)" for w in words if len(w) > 4)
        parts.append(f"SELECT doc_id, {-k} AS o, '{c}' AS c, {inside} + len(regexp_extract_all(y, '{_alone_sql(words)}')) AS n FROM d")
    return rf"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS x, regexp_replace(lower(coalesce(text, '')), '({_EDGE})', '\1\1', 'g') AS y FROM documents), a AS (" + " UNION ALL ".join(parts) + ") SELECT doc_id, CASE WHEN max(n) > 0 THEN arg_max(c, (n, o)) END AS label FROM a GROUP BY doc_id"


@query(_hybrid_sql())
def hybrid_category(spark, sf):
    return t(spark, sf, "documents").select("doc_id", categorize.hybrid(F.col("text")).alias("label"))


@query("""WITH x AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_quantity > 10 THEN 'm' ELSE '' END AS m, l_discount AS a, CASE WHEN l_tax > 0.02 THEN 'd' ELSE '' END AS d, l_quantity / 50 AS q, l_discount * 10 AS ca, l_tax * 10 AS cd FROM lineitem)
SELECT id, line, CASE WHEN m = '' AND a <= 0 AND d = '' THEN 'failed' WHEN m <> '' AND a > 0 AND d <> '' AND q >= 0.55 AND ca >= 0.55 AND cd >= 0.55 AND q >= 0.62 THEN 'extracted' ELSE 'needs_review' END AS status FROM x""")
def record_status(spark, sf):
    q = F.col("l_quantity") / 50
    got = categorize.status(F.when(F.col("l_quantity") > 10, "m").otherwise(""), F.col("l_discount"), F.when(F.col("l_tax") > 0.02, "d").otherwise(""), q, q, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), got.alias("status"))


# -- scalar functions -------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey AS id, 'Rp ' || replace(format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)), ',', '.') AS long_form FROM orders")
def rupiah_format(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), money.rupiah(F.col("o_totalprice")).alias("long_form"))


@query("SELECT o_orderkey AS id, greatest(0.0, coalesce(try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_totalprice - 100000 AS VARCHAR) END AS DOUBLE), 0.0))::DOUBLE AS amount FROM orders")
def amount_coercion(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise((F.col("o_totalprice") - 100000).cast("string"))
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), money.coerced(raw).alias("amount"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, CAST(replace(replace('Rp ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.' || '500', 'Rp ', ''), '.', '') AS DOUBLE) AS price, l_quantity AS quantity FROM lineitem")
def price_digits(spark, sf):
    whole = F.col("l_quantity").cast("int").cast("string")
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), money.digits_only(F.concat(F.lit("Rp "), whole, F.lit(".500"))).alias("price"), money.quantity(F.concat(whole, F.lit(" x"))).alias("quantity"))


@query(f"WITH e AS ({ledgers.EVENTS_SQL}) SELECT id, {NORM} AS day FROM e")
def normalised_dates(spark, sf):
    return ledgers.events(spark, sf).select("id", dates.normalised(F.col("date")).alias("day"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, " + str(list(MONTH_NAMES)) + "[month(o_orderdate)] || ' ' || year(o_orderdate) AS label FROM orders")
def month_labels(spark, sf):
    return t(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct().select("month", dates.month_label(F.col("month")).alias("label"))


_WRITTEN = {0: ("yyyy-MM-dd", "%Y-%m-%d"), 1: ("dd/MM/yyyy", "%d/%m/%Y"), 2: ("dd.MM.yyyy HH:mm", "%d.%m.%Y %H:%M"), 3: ("d MMMM yyyy", "%-d %B %Y"), 4: ("MMM d, yyyy", "%b %-d, %Y"), 5: ("ddMMyyyy", "%d%m%Y")}


@query("SELECT event_id AS id, strftime(ts, '%d/%m/%Y') AS day FROM events")
def parsed_dates(spark, sf):
    e, raw = t(spark, sf, "events"), F.lit("")
    for k, (form, _) in _WRITTEN.items():
        raw = F.when(F.col("event_id") % 6 == k, F.date_format("ts", form)).otherwise(raw)
    return e.select(F.col("event_id").alias("id"), dates.parsed(raw).alias("day"))


@query("SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key, CASE WHEN length(c_name || c_name || c_name) > 48 THEN rtrim(substr(c_name || c_name || c_name, 1, 45)) || '...' ELSE c_name || c_name || c_name END AS short FROM customer")
def merchant_forms(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.merchant_key(F.col("c_name")).alias("key"), text.ellipsis(F.concat("c_name", "c_name", "c_name")).alias("short"))


@query(f"WITH e AS ({ledgers.EVENTS_SQL}) SELECT id, CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_LABELS.items()) + " ELSE source END AS label FROM e")
def source_labels(spark, sf):
    return ledgers.events(spark, sf).select("id", text.source_label(F.col("source")).alias("label"))


@query("SELECT s_suppkey AS id, 'TOKO ' || s_name AS name FROM supplier")
def cleaned_merchants(spark, sf):
    s = t(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), text.clean_merchant(F.concat(F.lit("  QR Bayar TOKO "), "s_name", F.lit(" QRIS,"))).alias("name"))


@query("SELECT o_orderkey AS id, floor(o_totalprice)::DOUBLE AS amount FROM orders WHERE floor(o_totalprice) >= 1")
def money_tokens(spark, sf):
    whole = F.concat(F.lit("Rp"), F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", "."))
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), money.token(whole, F.lit(True), F.lit(False)).alias("amount"))


@query("WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents) SELECT doc_id, CASE WHEN regexp_matches(x, '\\b(rp|idr)(\\b|[0-9.,])') THEN 'IDR' WHEN regexp_matches(x, '\\bcad\\b|c\\$|ca\\$') THEN 'CAD' WHEN regexp_matches(x, '\\busd\\b|us\\$') THEN 'USD' WHEN regexp_matches(x, '\\beur\\b|€') THEN 'EUR' WHEN regexp_matches(x, '\\baud\\b|a\\$|au\\$') THEN 'AUD' WHEN regexp_matches(x, '\\bsgd\\b|s\\$') THEN 'SGD' WHEN regexp_matches(x, '\\bgbp\\b|£') THEN 'GBP' WHEN contains(x, '$') THEN 'USD' ELSE 'IDR' END AS currency FROM d")
def currencies(spark, sf):
    return t(spark, sf, "documents").select("doc_id", money.currency(F.coalesce("text", F.lit(""))).alias("currency"))


# -- data sets --------------------------------------------------------------------------------------------------------
_SPLIT = "WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM p"


@query(_SPLIT)
def dataset_split(spark, sf):
    return etl.stratified_split(t(spark, sf, "documents").select("doc_id", "source"), key="doc_id")


@query(f"WITH s AS ({_SPLIT}), l AS (SELECT s.split, d.lang AS label FROM s JOIN documents d USING (doc_id)), c AS (SELECT g.split, g.label, count(l.label) AS n FROM (SELECT a.split, b.label FROM (SELECT DISTINCT split FROM l) a CROSS JOIN (SELECT DISTINCT label FROM l) b) g LEFT JOIN l ON l.split = g.split AND l.label = g.label GROUP BY ALL), u AS (SELECT * FROM c UNION ALL SELECT 'OVERALL', label, CAST(sum(n) AS BIGINT) FROM c GROUP BY label) SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split) * 100, 1) AS percentage FROM u")
def label_shares(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source", "lang")
    return etl.label_shares(etl.stratified_split(docs, key="doc_id"), "lang")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def counters(spark, sf):
    return etl.counters(t(spark, sf, "documents"), "lang", "source")


_PRED = "WITH p AS (SELECT l.quality AS truth, CASE WHEN d.n_chars > 600 THEN 1 ELSE 0 END AS said FROM labels l JOIN documents d USING (doc_id))"


def predictions(spark, sf):
    docs, labels = t(spark, sf, "documents").select("doc_id", "n_chars"), t(spark, sf, "labels")
    return labels.join(docs, "doc_id").select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("said"))


@query(_PRED + ", c AS (SELECT v AS label, count(*) FILTER (truth = v) AS r, count(*) FILTER (said = v) AS s, count(*) FILTER (truth = v AND said = v) AS h FROM p CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) GROUP BY v), f AS (SELECT *, CASE WHEN r + s > 0 THEN 2.0::DOUBLE * h / (r + s) ELSE 0 END AS f1 FROM c) SELECT round(sum(h) / sum(r), 6)::DOUBLE AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * r) / sum(r), 6) AS weighted_f1 FROM f")
def classification_scores(spark, sf):
    return etl.scores(predictions(spark, sf), "truth", "said")


@query(_PRED + " SELECT CAST(truth AS VARCHAR) AS truth, count(*) FILTER (said = 0) AS predicted_0, count(*) FILTER (said = 1) AS predicted_1 FROM p GROUP BY truth")
def confusion_matrix(spark, sf):
    return etl.confusion(predictions(spark, sf), "truth", "said", [0, 1])


@query("SELECT lang AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf):
    return etl.class_weights(t(spark, sf, "documents"), "lang")


@query("WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS place FROM documents) SELECT doc_id, lang, CAST(place AS INTEGER) AS place FROM p WHERE place <= 10")
def stratified_sample(spark, sf):
    return etl.stratified_sample(t(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"WITH e AS ({ledgers.EVENTS_SQL}) SELECT count(*) AS total, count(*) FILTER (trim(merchant) <> '') AS with_merchant, count(*) FILTER (amount > 0) AS with_amount, count(*) FILTER (trim(date) <> '') AS with_date, count(*) FILTER (trim(merchant) = '') AS without_merchant, count(*) FILTER (amount <= 0) AS without_amount, count(*) FILTER (trim(date) = '') AS without_date FROM e")
def completeness(spark, sf):
    return etl.completeness(ledgers.events(spark, sf))


@query("SELECT round(avg(value), 2) AS mean, round(median(value), 2) AS median, round(max(value), 2) AS max FROM events")
def processing_times(spark, sf):
    return etl.times(t(spark, sf, "events"), "value")


@query(f"WITH e AS ({ledgers.EVENTS_SQL}) SELECT id, CASE WHEN id % 17 = 0 THEN 'ocr_error' WHEN amount <= 0 THEN 'amount_missing' WHEN trim(merchant) = '' THEN 'merchant_missing' WHEN trim(date) = '' THEN 'date_missing' WHEN id % 100 < 62 THEN 'low_confidence' ELSE 'ok' END AS error FROM e")
def suspected_errors(spark, sf):
    e = ledgers.events(spark, sf)
    return e.select("id", etl.suspected_error(F.when(F.col("id") % 17 == 0, "x"), F.col("merchant"), F.col("amount"), F.col("date"), F.col("id") % 100 / 100).alias("error"))


@query("""SELECT c_custkey AS id, '<s_source>cord</s_source><s_merchant>' || c_name || '&lt;&amp;&gt;</s_merchant>' || CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '<s_total>' || c_custkey || '</s_total>' ELSE '<s_total>' || printf('%.2f', c_custkey + 0.25) || '</s_total>' END || '<s_currency>IDR</s_currency>'
 || CASE WHEN c_custkey % 2 = 0 THEN '<s_category>' || c_mktsegment || '</s_category>' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '<s_items><s_item><s_name>a&apos;b</s_name><s_qty>2</s_qty><s_unit_price>' || c_custkey || '.50</s_unit_price></s_item><s_item><s_name>c</s_name><s_price>' || c_custkey || '</s_price></s_item></s_items>' ELSE '' END AS target FROM customer""")
def encoded_targets(spark, sf):
    c, k, null = t(spark, sf, "customer"), F.col("c_custkey").cast("double"), F.lit(None).cast("double")
    item = lambda n, q, u, p: F.struct(F.lit(n).alias("name"), q.alias("quantity"), u.alias("unit_price"), p.alias("total_price"))
    items = F.when(k % 3 == 0, F.array(item("a'b", F.lit(2.0), k + 0.5, null), item("c", null, null, k))).otherwise(F.array().cast(f"array<{etl.ITEM}>"))
    total = F.when(k % 4 == 1, k).when(k % 4 != 0, k + 0.25)
    target = etl.encoded(F.lit("cord"), F.concat("c_name", F.lit("<&>")), F.lit(""), total, F.lit("IDR"), F.when(k % 2 == 0, F.col("c_mktsegment")), items)
    return c.select(F.col("c_custkey").alias("id"), target.alias("target"))


@query(f"WITH p AS (SELECT p_partkey AS id, lower(p_name) AS x, p_partkey % 100 / 100.0::DOUBLE AS c FROM part), k AS (SELECT *, {_keyword_sql('x')} AS w FROM p) SELECT id, coalesce(w, CASE WHEN c >= 0.55 THEN 'hiburan' ELSE 'lainnya' END) AS label, CASE WHEN w IS NULL THEN c ELSE 0.68 END::DOUBLE AS confidence, CASE WHEN w IS NOT NULL THEN 'keyword' WHEN c >= 0.55 THEN 'ml_classifier' ELSE 'ml_low_confidence' END AS origin FROM k")
def learned_category(spark, sf):
    """A learned classifier in its place behind the keywords; its label and confidence are given here by a rule."""
    got = categorize.classify(F.col("p_name"), F.struct(F.lit("hiburan").alias("label"), (F.col("p_partkey") % 100 / 100).alias("confidence")))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), got["label"].alias("label"), got["confidence"].alias("confidence"), got["source"].alias("origin"))


@query()
def trained_category(spark, sf):
    """Documents by keyword, else by a classifier that learned from four fifths of those that a keyword names; one in five is held out, and told apart."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    d = spread(t(spark, sf, "documents").select("doc_id", "text"))
    # What is asked of a text is kept, and its first character that is not blank.
    named = checkpointed(d.select("doc_id", held.alias("held_out"), F.substring(F.trim("text"), 1, 1).alias("begin"), categorize.by_keyword(F.col("text")).alias("word"), learned.buckets_of(F.col("text")).alias("buckets")))
    model = learned.fitted(named.where(~F.col("held_out")), "buckets", "word", list(KEYWORDS))
    said = once(named, "said", learned.likeliest(model, F.col("buckets"))).withColumn("got", categorize.classify(F.col("begin"), F.col("said"), F.col("word")))
    return said.select("doc_id", "held_out", "word", F.col("said.label").alias("learned"), F.round("said.confidence", 6).alias("learned_confidence"), F.col("got.label").alias("label"), F.col("got.source").alias("origin"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS later, day(o_orderdate) || ' ' || ['Jan', 'Feb', 'Mar', 'Apr', 'Mei', 'Jun', 'Jul', 'Agu', 'Sep', 'Okt', 'Nov', 'Des'][month(o_orderdate)] AS tick FROM orders")
def tick_labels(spark, sf):
    days = t(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    return days.select("day", F.date_format(F.date_add(dates.from_ymd(F.col("day")), 40), "yyyy-MM-dd").alias("later"), dates.tick_label(F.col("day")).alias("tick"))


@query("SELECT l_orderkey AS path, 'i' || l_linenumber AS name, l_quantity AS quantity, floor(l_extendedprice)::DOUBLE AS total_price FROM lineitem")
def cord_items(spark, sf):
    """Ground truth written from all line items of an order, the menu a list, or one object where an odd order has one item, and read back; some names are lists."""
    item = F.to_json(F.struct(F.array(F.concat(F.lit("i"), F.col("l_linenumber").cast("string"))).alias("nm"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" x")).alias("cnt"), F.format_number(F.floor("l_extendedprice"), 0).alias("price")))
    one = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    menu = F.when((F.size("items") == 1) & (F.col("l_orderkey") % 2 == 1), F.element_at("items", 1)).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    gt = F.concat(F.lit('{"menu": '), menu, F.lit(', "total": {"total_price": "1"}}'))
    line = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("file_name"), gt.alias("ground_truth")))
    got = loaders.cord(one.select(line.alias("line"))).select("path", F.explode("items").alias("i"))
    return got.select(F.col("path").cast("long").alias("path"), "i.name", "i.quantity", "i.total_price")


@query("SELECT 'bank' || (c_custkey % 3) || '/' || c_custkey || '.png' AS path, c_name AS merchant, CAST(c_custkey * 1000 AS DOUBLE) AS total, 'bank' || (c_custkey % 3) AS bank FROM customer")
def mbanking_records(spark, sf):
    c = t(spark, sf, "customer")
    path = F.concat(F.lit("bank"), (F.col("c_custkey") % 3).cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".png"))
    gt = F.to_json(F.struct(F.struct(F.col("c_name").alias("recipient"), F.format_number(F.col("c_custkey") * 1000, 0).alias("amount")).alias("gt_parse")))
    return loaders.mbanking(c.select(F.to_json(F.struct(path.alias("file_name"), gt.alias("ground_truth"))).alias("line"))).select("path", "merchant", "total", "bank")


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'given' END, c_mktsegment) AS category, 'a b' AS text FROM customer")
def kaggle_records(spark, sf):
    """Names repeat in the table of categories: the last row counts, not the greatest."""
    c = t(spark, sf, "customer")
    notes = F.array(*[F.struct(F.lit(x).alias("text")) for x in ("a", "", "b")])
    gt = F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("category")).alias("metadata"), notes.alias("annotations")))
    lines = c.select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("file_name"), gt.alias("ground_truth"))).alias("line"))
    named = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("file_name"), F.when(F.col("c_custkey") % 4 == 0, "given").otherwise("").alias("category"))
    named = named.select("*", F.lit(2).alias("row")).unionByName(named.select("file_name", F.lit("zzz").alias("category"), F.lit(1).alias("row")))
    return loaders.kaggle(lines, named).select("path", "category", "text")


@query("WITH p AS (SELECT p_partkey AS id, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part) SELECT id, p_brand, CAST(place AS INTEGER) AS place FROM p WHERE place <= 3")
def group_listing(spark, sf):
    return etl.first_of_group(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "p_brand", "id", 3)


# -- extraction: documents rendered from orders, read back ------------------------------------------------------------
SHOPS = ("TOKO SEJAHTERA JAYA", "WARUNG KOPI NYAMAN", "Alfamart", "APOTEK SUMBER WARAS STORE", "Indomaret")
_SHOP = "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(SHOPS)) + " END"


def rendered(spark, sf):
    """Receipts of even orders and payment screens of odd ones, as lines."""
    o = t(spark, sf, "orders")
    shop = F.element_at(F.array(*map(F.lit, SHOPS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    dots = lambda x: F.translate(F.format_number(F.floor(x), 0), ",", ".")
    amount, half = dots(F.col("o_totalprice")), dots(F.col("o_totalprice") / 2)
    day = F.add_months("o_orderdate", 12 * 18)
    receipt = F.array(shop, F.lit("Jl. Merdeka 10"), F.date_format(day, "dd/MM/yyyy"), F.concat(F.lit("SUSU SEGAR 1 x "), half), F.concat(F.lit("ROTI TAWAR "), half), F.concat(F.lit("SUBTOTAL "), half), F.lit("PPN 1.100"), F.concat(F.lit("GRAND TOTAL Rp "), amount), F.lit("TUNAI 9.000.000"), F.lit("KEMBALI 1.000"), F.lit("TERIMA KASIH"))
    screen = F.array(F.lit("Transaction Details"), F.concat(F.lit("Rp"), amount), shop, F.lit("Payment Method"), F.lit("QRIS"), F.lit("Reference Number"), F.lit("1234567890123"), F.lit("Date and Time"), F.date_format(day, "d MMMM yyyy"))
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, receipt).otherwise(screen).alias("lines"))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'photo_receipt' ELSE 'mbanking_transaction_detail' END AS document_type, CASE WHEN o_orderkey % 2 = 0 THEN 'receipt' ELSE 'screenshot' END AS route, {_SHOP} AS merchant, floor(o_totalprice)::DOUBLE AS amount, strftime(o_orderdate + INTERVAL 18 YEAR, '%d/%m/%Y') AS date, 'IDR' AS currency FROM orders")
def extracted_documents(spark, sf):
    return extract.extract(rendered(spark, sf)).select("id", "document_type", "route", "merchant", "amount", "date", "currency")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Alfamart' WHEN 1 THEN 'Indomaret' WHEN 2 THEN 'Mie Gacoan' ELSE 'zzyzx road' END AS corrected FROM part")
def corrected_merchants(spark, sf):
    p = t(spark, sf, "part")
    read = F.when(F.col("p_partkey") % 4 == 0, "Atfamardt").when(F.col("p_partkey") % 4 == 1, "1ndomaret").when(F.col("p_partkey") % 4 == 2, "MIE GACOAN").otherwise("zzyzx road")
    return extract.corrected(p.select(F.col("p_partkey").alias("id"), read.alias("merchant"))).select("id", "corrected")
