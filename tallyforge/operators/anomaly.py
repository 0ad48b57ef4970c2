"""Unusually high amounts: by rule, and by isolation forests."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import DEFAULT_CATEGORY
from ..functions.money import rupiah
from ..session import checkpointed, ship
from .ranks import medians

#: Fewer positive amounts than this give no anomaly at all.
LEAST_ROWS = 10
#: Points that a tree is grown on, and trees of a forest, after Liu, Ting and Zhou (2008).
SUBSAMPLE, TREES = 256, 100
PART_ROWS = 100_000
COLUMNS = ("id", "merchant", "amount", "date", "category", "source", "saved_at")


def baselines(ledger: DataFrame) -> DataFrame:
    """One row over positive amounts: n, mean, median, and the upper median (the element at place n // 2)."""
    own = ledger.where(F.col("amount") > 0)
    base = own.agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean"))
    return base.crossJoin(F.broadcast(medians(own, "amount")))  # one row each


def by_rule(ledger: DataFrame, times: float = 3.0, base: DataFrame | None = None) -> DataFrame:
    """Amounts above ``times`` the mean of all positive ones, if there are enough; ``base``: their ``baselines``, where they are known."""
    base = (baselines(ledger) if base is None else base).where(F.col("n") >= LEAST_ROWS)
    found = ledger.where(F.col("amount") > 0).crossJoin(F.broadcast(base)).where(F.col("amount") > times * F.col("mean"))  # the other side is one row
    reason = F.concat(F.lit("Nominal "), rupiah(F.col("amount")), F.lit(" jauh lebih tinggi dari rata-rata transaksi lain ("), rupiah(F.col("mean")), F.lit(")"))
    return found.select(*COLUMNS, F.lit(-0.6).alias("anomaly_score"), F.col("upper_median").alias("baseline_median"), F.round("mean", 2).alias("baseline_mean"), F.lit("rule_based").alias("baseline_scope"), reason.alias("anomaly_reason"))


def contamination(n: Column, requested: float = 0.1) -> Column:
    """The share to flag: within 2 and 20 percent, at least one row, at most 49 percent."""
    c = F.lit(max(0.02, min(0.2, requested)))
    return F.least(F.lit(0.49), F.when(n >= 2, F.greatest(c, 1.0 / n)).otherwise(c))


def _path_bound(m: int) -> float:
    """Mean path length of an unsuccessful search among m points."""
    return 0.0 if m <= 1 else 1.0 if m == 2 else 2.0 * (np.log(m - 1) + 0.5772156649015329) - 2.0 * (m - 1) / m


class Forest:
    """Isolation trees over one number, one for each of ``samples``, kept as sorted cells of the line with their path lengths."""

    def __init__(self, samples: list[np.ndarray], seed: int):
        rng = np.random.default_rng(seed)
        self.m = max(map(len, samples), default=0)
        most = int(np.ceil(np.log2(max(self.m, 2))))
        self.cells = []
        for sample in samples:
            points = np.sort(sample)
            bounds: list[tuple[float, float]] = []

            def grow(lo: int, hi: int, depth: int, end: float) -> None:
                if hi - lo <= 1 or depth >= most or points[lo] == points[hi - 1]:
                    bounds.append((end, depth + _path_bound(hi - lo)))
                    return
                cut = rng.uniform(points[lo], points[hi - 1])
                at = int(np.searchsorted(points[lo:hi], cut, "right")) + lo
                grow(lo, at, depth + 1, cut)
                grow(at, hi, depth + 1, end)

            grow(0, len(points), 0, np.inf)
            self.cells.append((np.array([b for b, _ in bounds]), np.array([d for _, d in bounds])))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus 2 to the minus mean path over its expectation: the lower, the more isolated."""
        paths = sum(depth[np.searchsorted(ends, x, "left")] for ends, depth in self.cells) / len(self.cells)
        return -(2.0 ** -(paths / max(_path_bound(self.m), 1e-9)))


def samples(own: DataFrame, counts: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """(scope, tree, amount): for each tree of a scope its ``subsample`` rows with the least hashes of id and tree, drawn from all of the scope's rows.

    A row goes on only for trees whose hash of it is below twice the share that is wanted, so what is dealt to a tree is
    some twice its sample, whatever the scope's size, and less than the sample with a chance below 1e-30.
    """
    share = F.least(F.lit(1.0), 2.0 * subsample / F.col("n"))
    below = lambda t: F.xxhash64("id", t).cast("double") <= (share - 0.5) * F.lit(2.0**64)
    taken = own.select("scope", "id", "amount").join(counts.select("scope", "n"), "scope").withColumn("trees", F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), below))
    dealt = taken.select("scope", "id", "amount", F.explode("trees").alias("tree"))
    first = Window.partitionBy("scope", "tree").orderBy(F.xxhash64("id", "tree"), "id", "amount")
    return dealt.withColumn("k", F.row_number().over(first)).where(F.col("k") <= subsample).select("scope", "tree", "amount")


def _fit(seed: int):
    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        by_tree = rows.sort_values(["tree", "amount"]).groupby("tree")["amount"]
        return pd.DataFrame({"scope": [key[0]], "forest": [pickle.dumps(Forest([x.to_numpy() for _, x in by_tree], seed))]})

    return fit


def _score(rows: pd.DataFrame, forests: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(forests):
        return pd.DataFrame({"id": [], "scope": [], "amount": [], "score": []})
    return rows[["id", "scope", "amount"]].assign(score=pickle.loads(forests["forest"].iloc[0]).score(rows["amount"].to_numpy()))


def scoped(own: DataFrame, min_samples: int = 5, by_category: bool = True) -> DataFrame:
    """``own`` with the scope of each row: its category's, that of all small categories together, or one for all."""
    if not by_category:
        return own.withColumn("scope", F.lit("global"))
    sizes = own.groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    large = F.when(F.col("size") >= min_samples, F.concat(F.lit("category:"), F.col("category"))).otherwise("global_fallback")
    return own.join(sizes, "category").withColumn("scope", large).drop("size")


def scopes(own: DataFrame) -> DataFrame:
    """(scope, n, own_mean, own_median) of scopes of two rows or more."""
    counts = own.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("own_mean")).where("n >= 2")
    return counts.join(medians(own, "amount", "scope").select("scope", F.col("median").alias("own_median")), "scope")


def by_forest(ledger: DataFrame, requested: float = 0.1, min_samples: int = 5, by_category: bool = True, seed: int = 42, base: DataFrame | None = None) -> DataFrame:
    """High amounts that isolation forests flag: one per category with enough rows, one for all rows of small categories together.

    Each tree is grown on ``samples`` of all rows of its group; all rows are scored in parts of about ``PART_ROWS``, so a
    category with a third of all rows spreads. A score is a step function of the amount with at most trees x subsample
    values, which bounds the exact percentile that sets its group's threshold. ``base``: the ledger's ``baselines``, where
    they are known.
    """
    ship(ledger.sparkSession)
    own = ledger.where(F.col("amount") > 0).withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY)))
    base = (baselines(own) if base is None else base).where(F.col("n") >= LEAST_ROWS)
    every = base.select(F.col("n").alias("all_n"), F.col("mean").alias("all_mean"), F.col("median").alias("all_median"))
    own = scoped(own, min_samples, by_category).crossJoin(F.broadcast(every))  # one row
    counts = scopes(own)
    forests = samples(own, counts).groupBy("scope").applyInPandas(_fit(seed), "scope string, forest binary")
    parts = F.ceil(F.col("n") / PART_ROWS)
    rows = own.select("id", "scope", "amount").join(counts.select("scope", "n"), "scope").select("id", "scope", "amount", F.pmod(F.xxhash64("id"), parts).alias("part"))
    dealt = forests.join(counts.select("scope", "n"), "scope").select("scope", "forest", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    scored = rows.groupBy("scope", "part").cogroup(dealt.groupBy("scope", "part")).applyInPandas(_score, "id long, scope string, amount double, score double")
    shares = [max(0.02, min(0.2, requested)), *(1.0 / n for n in range(2, 50))]
    limits = scored.groupBy("scope").agg(F.percentile("score", F.array(*map(F.lit, shares))).alias("limits"))
    place = F.when((F.col("n") < 50) & (1.0 / F.col("n") > shares[0]), F.col("n")).otherwise(1).cast("int")
    limits = limits.join(counts, "scope").withColumn("limit", F.element_at("limits", place)).drop("limits")
    flagged = scored.join(limits, "scope").where(F.col("score") < F.col("limit")).select("id", "scope", "score", "own_mean", "own_median")
    out = own.drop("scope").join(flagged, "id")
    whole = F.col("scope") == "global_fallback"
    median, mean = F.when(whole, F.col("all_median")).otherwise(F.col("own_median")), F.when(whole, F.col("all_mean")).otherwise(F.col("own_mean"))
    name = F.when(whole, "transaksi keseluruhan").otherwise(F.initcap(F.translate(F.element_at(F.split("scope", ":"), -1), "_", " ")))
    lead = F.when(F.col("amount") > 3 * median, "Nominal jauh lebih tinggi dari pola ").otherwise("Nominal di atas pola ")
    reason = F.concat(lead, name, F.lit(" (median "), rupiah(median), F.lit(")"))
    return out.where(F.col("amount") > median).select(*COLUMNS, F.col("score").alias("anomaly_score"), F.round(median, 2).alias("baseline_median"), F.round(mean, 2).alias("baseline_mean"), F.col("scope").alias("baseline_scope"), reason.alias("anomaly_reason"))


def detect(ledger: DataFrame, requested: float = 0.1, min_samples: int = 5, by_category: bool = True, seed: int = 42) -> DataFrame:
    """Forest anomalies, and those by rule that no forest flagged; ids must be set. Without categories, the forest's alone."""
    ledger = checkpointed(ledger)  # asked for by each baseline, sample and score: what chose its rows is not done again
    base = checkpointed(baselines(ledger))  # one row, asked for twice
    found = by_forest(ledger, requested, min_samples, by_category, seed, base)
    return with_rules(found, ledger, base) if by_category else found


def with_rules(found: DataFrame, ledger: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``found`` and the anomalies by rule whose ids it lacks."""
    return found.unionByName(by_rule(ledger, base=base).join(found.select("id"), "id", "left_anti"))


def attention(score: Column) -> Column:
    return F.when(score <= -0.5, "tinggi").when(score <= -0.3, "sedang").otherwise("rendah")
