"""The per-row cleansing functions on a streaming source.

The analysed script has no streams; the operators of the cleansing chain up
to the word filter are stateless per row, so they apply unchanged to a
``readStream`` DataFrame. Lexicon joins against a static lexicon are
stream-static joins; nothing here keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpuslab.functions import text as tx
from corpuslab.operators import cleanse
from corpuslab.sources.tables import ARTICLE_SCHEMA


def read_article_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 16) -> DataFrame:
    """Article Parquet files arriving in ``path`` as a stream (schema fixed, no inference)."""
    schema = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField("doc_id", T.LongType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def stream_words(articles: DataFrame, lexicon: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Dateline strip, tokens, cleaned words longer than 3 letters, and (if given) their lemma via a
    stream-static left join with a static lexicon."""
    t = articles.select(id_col, tx.dateline_strip("text").alias("text"))
    words = cleanse.word_table(t, id_col)
    if lexicon is not None:
        words = words.join(cleanse.checked_broadcast(lexicon.select("word", "lemma")), "word", "left")
    return words
