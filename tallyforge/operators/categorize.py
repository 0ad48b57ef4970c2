"""Categories by ordered keywords, and the chain of sources that may name one."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import CATEGORY_DISPLAY, DEFAULT_CATEGORY, KEYWORDS
from ..functions.dates import let


#: Categories by keyword, in the order in which they are tried; a keyword may be of several.
_OF: dict[str, list[int]] = {}
for _place, _keywords in enumerate(KEYWORDS.values()):
    for _k in _keywords:
        _OF.setdefault(_k, []).append(_place)
#: Keywords of up to four letters must stand alone; longer ones count within words too.
_SHORT = 4


def alternation(keywords: Iterable[str]) -> str:
    """A pattern that matches the longest of the keywords, written as their tree of prefixes: a text is tried once for each letter, not for each keyword."""
    tree: dict = {}
    for k in keywords:
        node = tree
        for c in k:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        return (branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})") + ("?" if "" in node else "")

    return written(tree)


def alone(keywords: Iterable[str]) -> str:
    """A pattern for keywords that stand alone: letters of any script beside them count."""
    return rf"(?U)\b({alternation(keywords)})\b"


_LONG = [k for k in _OF if len(k) > _SHORT]
#: At each place of a text the longest long keyword there; those that it begins with are there as well.
_INSIDE = f"(?=({alternation(_LONG)}))"
_ALONE = alone(k for k in _OF if len(k) <= _SHORT)


def _places(table: dict[str, list[int]]) -> Column:
    """A literal map of texts to arrays of places."""
    keys = ", ".join("'" + k.replace("'", "\\'") + "'" for k in table)
    return F.expr(f"map_from_arrays(array({keys}), array({', '.join(f'array({", ".join(map(str, v))})' for v in table.values())}))")


def _found(low: Column) -> tuple[Column, Column]:
    """Places of the categories of all keywords in a text: of distinct long ones, and of all that stand alone. Two passes over the text, whatever the number of keywords."""
    numbered = {k: i for i, k in enumerate(_LONG)}
    begins = {k: [numbered[p] for p in _LONG if k.startswith(p)] for k in _LONG}
    there = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(_INSIDE), 1)), lambda k: F.element_at(_places(begins), k))))
    of_number = F.expr("array(" + ", ".join(f"array({', '.join(map(str, _OF[k]))})" for k in _LONG) + ")")
    inside = F.flatten(F.transform(there, lambda i: F.get(of_number, i)))
    short = {k: v for k, v in _OF.items() if len(k) <= _SHORT}
    single = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(_ALONE), 1), lambda k: F.element_at(_places(short), k)))
    return inside, single


def by_keyword(text: Column) -> Column:
    """The first category, in their order, of which a keyword occurs, longer ones within words too; null if none."""
    names = F.lit(list(KEYWORDS))
    first = lambda low: F.array_min(F.concat(*_found(low)))
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.get(names, first(low)))


def result(label: Column, confidence: Column | float, source: str) -> Column:
    return F.struct(label.alias("label"), F.lit(confidence).cast("double").alias("confidence") if isinstance(confidence, float) else confidence.alias("confidence"), F.lit(source).alias("source"))


def _classified(text: Column, word: Column, learned: Column | None = None) -> Column:
    """``classify`` of a text whose keyword's category is known."""
    other = F.lit(DEFAULT_CATEGORY)
    rest = result(other, 0.0, "ml_unavailable")
    if learned is not None:
        rest = F.when(learned["confidence"] >= 0.55, result(learned["label"], learned["confidence"], "ml_classifier")).otherwise(result(other, learned["confidence"], "ml_low_confidence"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", result(other, 0.0, "empty_input")).when(word.isNotNull(), result(word, 0.68, "keyword")).otherwise(rest)


def classify(text: Column, learned: Column | None = None, word: Column | None = None) -> Column:
    """(label, confidence, source): keyword at 0.68, else ``learned`` (a struct of label and confidence) from 0.55 on, else the default.

    word: the text's ``by_keyword``, where it is known; of the text itself only counts then whether it is blank.
    """
    return let(by_keyword(text) if word is None else word, lambda w: _classified(text, w, learned))


def by_merchant(merchant: Column) -> Column:
    """(label, confidence, source) of a merchant's own words at 0.78, or null."""
    return let(by_keyword(merchant), lambda word: F.when(word.isNotNull(), result(word, 0.78, "merchant_keyword")))


def chain(merchant: Column, app_label: Column, raw: Column, is_receipt: Column, timed_out: Column) -> Column:
    """The first that applies: merchant's words, the app's label, timeout, classifier, receipt's text (at most 0.42), screenshot's text (at most 0.55), none."""
    blank = F.trim(F.coalesce(merchant, F.lit(""))) == ""

    def first(w: Column) -> Column:
        receipt = let(_classified(raw, w["raw"]), lambda c: F.struct(c["label"].alias("label"), F.least(F.lit(0.42), c["confidence"]).alias("confidence"), F.lit("receipt_raw_text").alias("source")))
        return (
            F.when(w["merchant"].isNotNull(), result(w["merchant"], 0.78, "merchant_keyword"))
            .when(app_label.isin(*CATEGORY_DISPLAY), result(app_label, 0.72, "app_label"))
            .when(timed_out, result(F.lit(DEFAULT_CATEGORY), 0.0, "timeout"))
            .when(~blank, _classified(merchant, w["merchant"]))
            .when(is_receipt, receipt)
            .when(w["raw"].isNotNull(), result(w["raw"], 0.55, "screenshot_raw_keyword"))
            .otherwise(result(F.lit(DEFAULT_CATEGORY), 0.0, "screenshot_no_merchant"))
        )

    # The text counts only where the merchant is blank and so says nothing.
    return let(F.struct(by_keyword(merchant).alias("merchant"), by_keyword(F.when(blank, raw)).alias("raw")), first)


def hybrid(text: Column) -> Column:
    """Categories by how many of their keywords occur, all occurrences counting of those that stand alone; the most wins at 0.9, null if none."""

    def most(places: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(len(KEYWORDS) - 1)), lambda k: F.struct(F.size(F.filter(places, lambda p: p == k)).alias("n"), (-k).alias("order")))
        return let(F.array_max(counts), lambda best: F.when(best["n"] > 0, F.get(F.lit(list(KEYWORDS)), -best["order"])))

    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: let(F.concat(*_found(low)), most))


def status(merchant: Column, amount: Column, date: Column, document: Column, c_merchant: Column, c_amount: Column, c_date: Column) -> Column:
    """failed without any field, extracted if all three are there and sure (0.55) in a sure document (0.62), else needs_review."""
    has_m, has_a, has_d = F.trim(F.coalesce(merchant, F.lit(""))) != "", F.coalesce(amount, F.lit(0.0)) > 0, F.trim(F.coalesce(date, F.lit(""))) != ""
    sure = has_m & has_a & has_d & (c_merchant >= 0.55) & (c_amount >= 0.55) & (c_date >= 0.55) & (document >= 0.62)
    return F.when(~(has_m | has_a | has_d), "failed").when(sure, "extracted").otherwise("needs_review")


def categorised(ledger: DataFrame, column: str = "merchant") -> DataFrame:
    return ledger.withColumn("predicted", classify(F.col(column)))
