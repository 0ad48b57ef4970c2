"""Licence scans: a trained paragraph classifier, in DataFrame operations only.

Logistic regressions over binary word 1- and 2-grams, one for each licence family and one for ``unknown``, share their
grams, so a paragraph may be of several families. They are fitted on the driver from ``TEMPLATES``, varied by seeded
dropping, joining and padding of words, against ordinary and misleading paragraphs, other licences, and the families' names
outside of notices, which all are ``unknown``; a temperature fitted on held-out variants calibrates their probabilities. A
family is predicted where the paragraph holds a gram that only this family has, and its probability reaches ``LEAST`` and
that of ``unknown``. A prediction is confirmed by comparison with the family's templates: the paragraph holds at least
``ALIKE`` of one's grams, each weighed by how few other families (and misleading paragraphs) have it, so words that notices
share (licensed under the) count next to nothing. "|" stands in grams for the ends of paragraphs and sentences.

A paragraph is a run of lines up to one that is blank or ends on a sentence's or clause's mark (. ! ? : ;). They are split
by built-in functions; those that hold no family's own gram, as one regular expression made of these grams tells, are passed
over, for nothing can be predicted of them; of others, n-grams are looked up in a folded literal map of weights and summed
by higher-order functions: one pass, no shuffle, no Python. Every paragraph of every text is judged.

Defined results: null and empty texts have no paragraph and no licence; repeated rows each give their own; an empty
table gives no row; other columns go. A family that a paragraph denies (not licensed under ...) is named in it all the same.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

#: Short notices by which licences are commonly stated.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "gnu affero general public license as published by the free software foundation"],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy at http www.apache.org licenses license-2.0", "apache software license 2.0", "licensed under apache 2.0", "apache 2.0 license", "apache-2.0", "released under the apache license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the bsd license", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd 3-clause license", "bsd 2-clause license", "released under the bsd license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "licensed under the creative commons attribution license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "licensed under cc by-nc-sa 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "text is available under the creative commons attribution-sharealike license", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc0": ["cc0 1.0 universal public domain dedication", "released under cc0", "dedicated to the public domain under cc0 1.0", "cc0 1.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "licensed under the gpl", "released under the gnu gpl version 2"],
    "isc": ["permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "licensed under the isc license"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "gnu lesser general public license as published by the free software foundation", "released under the lgpl"],
    "mit": ["released under the mit license", "licensed under the mit license", "the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software", "mit licensed", "mit license", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0", "licensed under the mozilla public license version 2.0", "released under the mpl 2.0"],
    "proprietary": ["all rights reserved", "copyright all rights reserved no part may be reproduced without permission", "proprietary and confidential unauthorized copying of this file is strictly prohibited"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
}
#: Paragraphs that share words with licences and are none.
MISLEADING = [
    "the driver has a license to drive in the city", "poetic license was taken with the version of events", "the apache helicopter was released in may", "mit der version und ohne die",
    "they were released under pressure from the public", "the general public was not amused", "a creative work of the commons", "the terms of the conditions are met", "rights and wrongs of the work",
    "free software is a topic of debate", "the public domain is the land", "permission to land was granted", "this work is good and the people are free", "a copy of the file was sent to the person",
    "under the version of the law", "the license plate of the car", "cc the manager by mail", "all reserved seats were sold", "the unlicensed vendor was fined", "by the sea", "an mit professor spoke", "gnu herds cross the plain",
    "this song is licensed under the contract of the label", "we saw that all rights reserved by the hotel were lost", "all the rights they had reserved for the team were sold", "the software is provided by the company", "copyright is a matter of law",
    "creative commons is an organization", "the free software foundation was founded in 1985", "a driver license number of the person", "the film was released under a new name", "the license of the restaurant was revoked",
]
#: Licences that are of none of the families, and names of families as other texts use them.
OTHERS = ("eupl", "eclipse public license 2.0", "cddl", "wtfpl", "zlib license", "artistic license 2.0", "boost software license", "company terms", "agreement", "terms of the contract", "law of the state", "sil open font license", "postgresql license", "python license", "ms-pl", "epl", "odbl", "foo license")
NAMED = ("mit", "bsd", "isc", "apache", "gpl", "lgpl", "agpl", "mpl", "cc0", "gnu", "mozilla", "mit license", "bsd license", "apache license", "gnu general public license")
#: How names stand where nothing is licensed; {} is the name.
_BESIDE = ("the {} plate was found", "the {} was discussed at the meeting", "the {} was debated in court", "they mentioned the {} again", "he spoke about the {} for an hour", "a {} plate on the car", "the {} team won the game", "students of {} met", "the {} helicopter landed")
#: Words that name licences, and words of any text.
_NAMES = frozenset("affero apache bsd 2-clause 3-clause attribution attribution-noncommercial attribution-sharealike by-nc by-nc-sa by-sa cc cc0 gpl gnu isc lesser lgpl agpl mit mpl mozilla unencumbered unlicense".split())
_ORDINARY = frozenset("a all an and any are as at be but by can copy details file for form free from if in into is it kind may no not of on or out part provided said see shall text the this to under use used with without work you available".split())
FAMILIES = [*TEMPLATES, "unknown"]
_WORD = "[a-z0-9][a-z0-9.+/-]*[a-z0-9]|[a-z0-9]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a line that is not wrapped, and a sentence within one; what a word or an end is.
_ENDS, _STOP, _TOKEN = r"(^|[.!?:;])[ \t\r]*$", r"[.!?:;]+([ \t\r]|$)", rf"({_WORD}|\|)"
LEAST, ALIKE = 0.5, 0.6


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def marked(text: str) -> list[str]:
    return ["|", *text.split(), "|"]


def _negatives() -> list[str]:
    return [*MISLEADING, *(f"{how} under the {x}" for how in ("licensed", "released", "available") for x in OTHERS), *(f"this work is licensed under the {x}" for x in OTHERS), *(how.format(x) for how in _BESIDE for x in NAMED)]


@functools.lru_cache(maxsize=1)
def known_grams() -> dict[str, set[str]]:
    """The classes that have each gram of the vocabulary: families by their templates, ``unknown`` by ordinary words and what misleads."""
    out: dict[str, set[str]] = {}
    for family, texts_ in [*TEMPLATES.items(), ("unknown", MISLEADING)]:
        for t in texts_:
            for g in grams(marked(t)):
                out.setdefault(g, set()).add(family)
    for t in _negatives():
        for g in grams(marked(t)):
            out.setdefault(g, {"unknown"})
    # Single words of many classes tell nothing.
    return {g: c for g, c in out.items() if " " in g or len(c) <= 2}


@functools.lru_cache(maxsize=1)
def own_grams() -> dict[str, list[str]]:
    """By family, the grams that no other class has: words that name it, and pairs without an ordinary word."""
    ordinary = lambda w: w in _ORDINARY or not any(c.isalpha() for c in w.strip("|")) and w != "|"
    telling = lambda g: g in _NAMES if " " not in g else any(w in _NAMES for w in g.split()) or not any(map(ordinary, g.split()))
    return {f: sorted(g for g, c in known_grams().items() if c == {f} and telling(g)) for f in TEMPLATES}


def worth(gram: str) -> float:
    return round(1.0 / len(known_grams().get(gram, FAMILIES)) ** 2, 6)


@functools.lru_cache(maxsize=1)
def model(variants: int = 16, seed: int = 0, rounds: int = 400) -> tuple[dict[str, list[float]], list[float]]:
    """Weights by n-gram and the bias, per class, over the fitted temperature."""
    rng = random.Random(seed)
    fill = sorted({w for m in MISLEADING for w in m.split()} - {"license", "licensed", "copyright", "apache", "mit", "gnu", "cc", "rights", "reserved"})
    made: list[tuple[set[str], list[int]]] = []
    pad = lambda n: [rng.choice(fill) for _ in range(rng.randint(0, n))]
    dropped = lambda t: [w for w in t.split() if rng.random() > 0.05] or t.split()
    of = [(k, t) for k, texts_ in enumerate(TEMPLATES.values()) for t in texts_]
    for k, t in of:
        for _ in range(variants):
            made.append((grams(["|", *pad(4), *(["|"] if rng.random() < 0.3 else []), *dropped(t), "|", *pad(4), "|"]), [k]))
            j, other = rng.choice(of)
            made.append((grams(["|", *t.split(), *rng.choice((["but", "not"], ["or"], ["and"], ["|"])), *other.split(), "|"]), [k, j]))
    for t in _negatives():
        for _ in range(variants // 4):
            made.append((grams(["|", *pad(4), *dropped(t), *pad(4), "|"]), [len(TEMPLATES)]))
    made += [(grams(["|", *pad(14), "|"]), [len(TEMPLATES)]) for _ in range(variants * 10)]
    rng.shuffle(made)
    vocabulary = sorted(known_grams())
    at = {g: i for i, g in enumerate(vocabulary)}
    x, y = np.zeros((len(made), len(vocabulary)), np.float32), np.zeros((len(made), len(FAMILIES)), np.float32)
    for i, (gs, ks) in enumerate(made):
        x[i, [at[g] for g in gs if g in at]] = 1
        y[i, ks] = 1
    fit = np.arange(len(made)) % 4 != 0
    w, b = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.full(len(FAMILIES), -3.0, np.float32)
    b[-1] = 0.0
    chances = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    speed_w, speed_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):  # adaptive steps, for rare grams learn as fast as frequent ones
        d = (chances(x[fit] @ w + b) - y[fit]) / fit.sum()
        dw, db = x[fit].T @ d + 2e-5 * w, d.sum(0)
        speed_w += dw * dw
        speed_b += db * db
        w -= 0.3 * dw / np.sqrt(speed_w)
        b -= 0.3 * db / np.sqrt(speed_b)
    z = x[~fit] @ w + b
    right = lambda t: np.where(y[~fit] > 0, chances(z / t), 1 - chances(z / t))
    loss = {t: -float(np.log(right(t) + 1e-9).mean()) for t in (0.5, 0.7, 1.0, 1.4, 2.0)}
    t = min(loss, key=loss.get)
    return {g: [round(float(v), 6) for v in w[i] / t] for g, i in at.items()}, [round(float(v), 6) for v in b / t]


def compared() -> dict[str, list[list[str]]]:
    """By family, the grams of each template that a paragraph is compared with."""
    return {f: [sorted(g for g in grams(marked(t)) if g in known_grams()) for t in ts] for f, ts in TEMPLATES.items()}


def _filter() -> str:
    """A regular expression that every paragraph with a family's own gram matches: its words in a row, by first letters."""
    by_letter: dict[str, list[str]] = {}
    for g in sorted({g for gs in own_grams().values() for g in gs}):
        words = [re.escape(w) for w in g.split() if w != "|"]
        by_letter.setdefault(words[0][0], []).append("[^a-z0-9]+".join(words)[1:])
    return r"(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(sorted(set(rest)))})" for c, rest in sorted(by_letter.items())) + ")(?![a-z0-9])"


def paragraphs(text: Column) -> Column:
    """Paragraphs as lower-case text."""
    lines = F.split(F.translate(text, _UPPER, _LOWER), "\n")
    joined = F.array_join(F.transform(lines, lambda x: F.concat(x, F.when(x.rlike(_ENDS), "\n").otherwise(" "))), "")
    return F.split(joined, "\n")


def words_of(paragraph: Column) -> Column:
    """A paragraph's words, with its ends and its sentences'."""
    said = F.regexp_extract_all(F.regexp_replace(paragraph, _STOP, " | "), F.lit(_TOKEN), 1)
    return F.concat(F.array(F.lit("|")), said, F.array(F.lit("|")))


def _literal(x) -> str:
    """SQL text of a value, parsed at once: a list of literals costs the driver several calls for each."""
    if isinstance(x, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_literal(v)}" for k, v in x.items()) + ")"
    if isinstance(x, list):
        return "array(" + ", ".join(map(_literal, x)) + ")"
    return f"'{x}'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found: an array of (paragraph, family, probability, alike, confirmed) for each row of ``docs``."""
    weights, bias = model()
    vocabulary, unknown = F.expr(_literal(list(weights))), len(FAMILIES)
    table_, worths = (F.map_from_arrays(vocabulary, F.expr(_literal(x))) for x in (list(weights.values()), [worth(g) for g in weights]))
    families = F.expr(_literal([{"k": k, "family": f, "own": own} for k, (f, own) in enumerate(own_grams().items(), 1)]))
    templates = F.expr(_literal([{"k": k, "size": float(sum(map(worth, t))), "grams": t} for k, ts in enumerate(compared().values(), 1) for t in ts]))

    def known(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_intersect(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())), vocabulary)

    def scored(grams_: Column) -> Column:
        return F.aggregate(grams_, F.expr(_literal(bias)), lambda acc, g: F.zip_with(acc, F.element_at(table_, g), lambda s, v: s + v))

    def likeness(p: Column) -> Column:
        """(k, alike) of every template."""
        total = lambda gs: F.aggregate(gs, F.lit(0.0), lambda acc, g: acc + F.element_at(worths, g))
        return F.transform(templates, lambda t: F.struct(t["k"].alias("k"), F.round(total(F.array_intersect(p["known"], t["grams"])) / t["size"], 6).alias("alike")))

    def judged(p: Column) -> Column:
        chance = lambda k: 1 / (1 + F.exp(-F.element_at(p["z"], k)))
        here = lambda f: F.arrays_overlap(p["known"], f["own"]) & (chance(f["k"]) >= LEAST) & (chance(f["k"]) >= chance(F.lit(unknown)))
        alike = lambda f: F.array_max(F.transform(F.filter(p["likes"], lambda t: t["k"] == f["k"]), lambda t: t["alike"]))
        said = lambda f: F.struct(p["paragraph"].alias("paragraph"), f["family"].alias("family"), chance(f["k"]).alias("probability"), alike(f).alias("alike"))
        confirmed = lambda x: F.struct(x["paragraph"], x["family"], x["probability"], x["alike"], (x["alike"] >= ALIKE).alias("confirmed"))
        return F.transform(F.transform(F.filter(families, here), said), confirmed)

    lines = F.when(F.length("text") > 0, paragraphs(F.col("text"))).otherwise(F.array().cast("array<string>"))
    likely = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("paragraph"), x.alias("x"))), lambda p: p["x"].rlike(_filter()))
    told = F.transform(likely, lambda p: F.struct(p["paragraph"].alias("paragraph"), known(words_of(p["x"])).alias("known")))
    rated = F.transform(told, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["known"].alias("known"), scored(p["known"]).alias("z"), likeness(p).alias("likes")))
    return docs.select("doc_id", F.flatten(F.transform(rated, judged)).alias("found"))


def op6_licences(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    kept = F.filter("found", lambda x: x["confirmed"])
    families = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["family"]))))
    return found.select("doc_id", F.size("found").cast("long").alias("n_predicted"), F.size(kept).cast("long").alias("n_confirmed"), families.alias("families"))


def oracle() -> str:
    """The same classifier in DuckDB, its weights inlined; every paragraph's grams are looked up."""
    weights, bias = model()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quoted(g)}, {v}, {worth(g)})" for g, v in weights.items())
    own = ",\n".join(f"({k + 1}, {quoted(g)})" for k, gs in enumerate(own_grams().values()) for g in gs)
    templates = ",\n".join(f"({k + 1}, {k * 100 + j}, {quoted(g)}, {sum(map(worth, t))})" for k, ts in enumerate(compared().values()) for j, t in enumerate(ts) for g in t)
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""
WITH weight(gram, v, worth) AS (VALUES {rows}),
own(k, gram) AS (VALUES {own}),
template(k, template, gram, size) AS (VALUES {templates}),
docs AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN length(text) > 0 THEN string_split(array_to_string(list_transform(string_split({low}, chr(10)), lambda x: x || CASE WHEN regexp_matches(x, '{_ENDS}') THEN chr(10) ELSE ' ' END), ''), chr(10)) ELSE CAST([] AS VARCHAR[]) END AS lines FROM documents),
par AS (SELECT r, i, ['|'] || regexp_extract_all(regexp_replace(lines[i], '{_STOP}', ' | ', 'g'), '{_TOKEN}') || ['|'] AS w FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
known AS (SELECT r, i, gram, v, worth FROM (SELECT r, i, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])))) AS gram FROM par) JOIN weight USING (gram)),
asked AS (SELECT DISTINCT r, i, k FROM known JOIN own USING (gram)),
score AS (
  SELECT a.r, a.i, a.k, 1 / (1 + exp(-(CAST({bias} AS DOUBLE[])[a.k] + sum(g.v[a.k])))) AS p, 1 / (1 + exp(-(CAST({bias} AS DOUBLE[])[{len(FAMILIES)}] + sum(g.v[{len(FAMILIES)}])))) AS u
  FROM asked a JOIN known g ON g.r = a.r AND g.i = a.i GROUP BY a.r, a.i, a.k),
named AS (SELECT r, i, k FROM score WHERE p >= {LEAST} AND p >= u),
alike AS (SELECT r, i, k, round(max(n), 6) AS a FROM (SELECT n.r, n.i, n.k, t.template, sum(g.worth)::DOUBLE / any_value(t.size) AS n FROM named n JOIN template t USING (k) JOIN known g ON g.r = n.r AND g.i = n.i AND g.gram = t.gram GROUP BY ALL) GROUP BY r, i, k),
told AS (SELECT n.r, count(*) AS p, count(*) FILTER (coalesce(a, 0) >= {ALIKE}) AS c, string_agg(DISTINCT {FAMILIES}[n.k], ',' ORDER BY {FAMILIES}[n.k]) FILTER (coalesce(a, 0) >= {ALIKE}) AS f FROM named n LEFT JOIN alike USING (r, i, k) GROUP BY n.r)
SELECT doc_id, CAST(coalesce(p, 0) AS BIGINT) AS n_predicted, CAST(coalesce(c, 0) AS BIGINT) AS n_confirmed, coalesce(f, '') AS families FROM docs LEFT JOIN told USING (r)
"""
