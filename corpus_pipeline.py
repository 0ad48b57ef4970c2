"""Corpus preparation: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
``docs``. All but the last return the columns of ``documents``. What each decides takes effect: low quality goes, one
document of each near-duplicate group stays, personal data is replaced by its kind, documents repeat as often as the mix
takes them, and the last stage lays all of them out in sequences.

Odd rows, in every stage: a null or empty text is a document like any other (one empty passage, no shingle, size 0, its end
id alone); rows with a null doc_id stay through the first three stages, count as one document in mixing, and are packed;
rows that repeat an id are one document to near-duplicates, where one of them stays; an empty table gives an empty one; other
columns stay, whatever their names, until packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import minhash, mixing, packing, pii, quality
from tallyforge.llm._common import cut, deleted, shared_folder, table

#: A document stays if its score is at least this; the score is the learned chance of label 1.
LEAST_QUALITY = 0.3


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those that score at least LEAST_QUALITY."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality.score(docs, net, score).where(F.col(f"`{score}`") >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group at five words and a similarity of 0.8."""
    return minhash.keep_one(docs, width=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; texts move once, by id. Rows that repeat an id each count as its most taken one."""
    key, times, copy = (unused(docs, c) for c in ("mixed_id", "copies", "copy"))
    copies = mixing.mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(times))
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(copies[key])).select(*[docs[f"`{c}`"] for c in docs.columns], times)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(cut(packing.pieces_of(docs, packing.default_tokenizer())))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A learned classifier and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes once the next one is written whole; the last stays, for it is read from."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            deleted(spark, f"{folder}/{k - 1}")
    return docs
