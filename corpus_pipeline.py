"""The corpus pipeline: language ID, quality, near duplicates, decontamination, packing.

``STAGES`` lists (name, function) in order. A function takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of
``docs`` unchanged, so any table with ``doc_id`` and ``text`` passes through,
extra columns included. Each stage works on all rows its predecessor kept:

* ``language_id`` learns the language filters from the rows' ``lang`` (those not
  held out), predicts each text's language and drops the texts it rejects: those without
  a letter (null and empty ones too), and those of ``LONG_ENOUGH`` characters or more without a single known n-gram.
* ``quality`` learns from the labels that are not held out and drops texts whose score is under ``QUALITY_FLOOR``.
* ``near_duplicates`` keeps one document, the smallest id, of every group linked
  by a Jaccard similarity of at least 0.8 of five-word shingles; rows
  without words, and rows without an id, stay; of rows repeated under one id with equal sets one stays. Different
  texts under one id are judged each by itself.
* ``decontaminate`` drops documents that overlap a benchmark item.
* ``pack`` cuts and packs the rest into sequences; it returns the pieces.

Empty tables give empty results. A null label, text or language teaches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import decontaminate as seeds
from corpuslab.llm import langid, ngram_join, packing, quality, stage
from corpuslab.llm.queries import vocabulary_path

QUALITY_FLOOR = 0.25
LONG_ENOUGH = 50  # shorter texts say too little to be rejected for unknown n-grams
BROADCAST_IDS = 1_000_000  # ids of 8 bytes: 8 MB


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = docs.where(stage.id_remainder(F.col("doc_id"), 4) != 2)
    return _judged(docs, lambda d: langid.predict(d, langid.fit(learn)), lambda p: (p["lang_pred"] != langid.UNKNOWN) & ((p["score"] > 0) | (F.length(p["text"]) < LONG_ENOUGH)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, stage.read(spark, sf_dir, "labels"), stage.id_remainder(F.col("doc_id"), 3) != 1)
    return _judged(docs, lambda d: quality.predict(d, model), lambda p: p["score"] >= QUALITY_FLOOR)


def _judged(docs: DataFrame, predict, keep) -> DataFrame:
    """Rows of ``docs`` that a prediction keeps. The columns travel as one struct, so none can clash with the prediction's."""
    judged = predict(docs.select(F.struct(*_columns(docs)).alias("row"), F.col("text").alias("text")))
    return judged.where(keep(judged)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sets = stage.written(ngram_join.kept_sets(docs, n=5, percent=80).where("doc_id is not null"), "sets-of-documents")
    key = ["doc_id", "n_shingles", "d1", "d2"]
    of_id = sets.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n"), F.min("keeps").alias("keeps"), (F.min(F.struct(*key)) != F.max(F.struct(*key))).alias("mixed"))
    away = stage.written(of_id.where("n > 1 or not keeps"), "ids-of-copies")  # ids that not just all rows of stay
    again, mixed = away.where("n > 1 and keeps and not mixed").select("__id"), away.where("mixed").select("__id")
    several = mixed.count()
    small = F.broadcast if away.count() <= BROADCAST_IDS else (lambda df: df)  # beyond, a shuffle join
    on = F.col("doc_id") == F.col("__id")
    kept = docs.join(small(away.select("__id")), on, "left_anti")
    kept = kept.unionByName(docs.join(small(again), on, "left_semi").dropDuplicates(["doc_id"]))
    if several:  # ids under which different texts occur: each text stays or goes by itself
        rows = docs.join(small(mixed), on, "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*_columns(docs)).alias("row"))
        stay = sets.where("keeps").join(small(mixed), on, "left_semi").select(*key).distinct()
        kept = kept.unionByName(ngram_join.with_sets(rows, 5).join(stay, key, "left_semi").dropDuplicates(key).select("row.*"))
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return seeds.remove(docs, stage.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written and read again."""
    docs = stage.read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage.written(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Model fits and the tokenizer cannot be stated in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None
