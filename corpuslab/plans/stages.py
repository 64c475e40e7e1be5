"""Stage builders shared by the registered queries: the fixture article table
and everything derived from it, with the fixture thresholds of FIXTURES.md.

Lineage is cut where a table is read more than once: the feature base (without texts), and
in the cleansing chain the feature table, the lexicon, the corpus with its
texts, and the processed / prepared document-term tables. Each cut is a Parquet
table under ``spark.checkpoint.dir`` (shared on a cluster), so a lost executor
re-reads files instead of recomputing, later aggregates still get column
pruning, and no plan grows by re-deriving its own inputs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import cleanse, dfm, features
from corpuslab.plans import sql as S
from corpuslab.sources import tables

SCOPE = features.ScopeParams(min_channel_rows=None, min_channel_share=S.CHANNEL_SHARE)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as a Parquet stage in the shared checkpoint folder."""
    return tables.stage_roundtrip(df, name)


def articles_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article input (built from documents/labels/orders/part), lazy: a query scans the columns it uses."""
    return tables.articles(spark, sf_dir)


def _feature_table(spark: SparkSession, sf_dir: str, tighten: bool, text: bool) -> DataFrame:
    return features.feature_table(articles_df(spark, sf_dir), SCOPE, tighten=tighten, stage=stage, text=text,
                                  narrow=tables.articles(spark, sf_dir, text=False), texts=tables.article_texts(spark, sf_dir))


def features_df(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """The feature table (tightened scope) without the topic flags, lazy over its written base; the texts only on demand."""
    return _feature_table(spark, sf_dir, True, text)


def features_first_scope_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table before the tightened scope rule (``top_OK`` as first defined), without texts."""
    return _feature_table(spark, sf_dir, False, False)


def scoped_df(spark: SparkSession, sf_dir: str, feats: DataFrame | None = None) -> DataFrame:
    return features.scoped_articles(features_df(spark, sf_dir, text=True) if feats is None else feats)


def lexicon_df(spark: SparkSession, sf_dir: str, arts: DataFrame | None = None) -> DataFrame:
    """Fixture lexicon, materialised so that it behaves like a lexicon file (cheap to count)."""
    return stage(cleanse.fixture_lexicon(tables.article_texts(spark, sf_dir) if arts is None else arts), "lexicon")


class Corpus:
    """Articles, features, lexicon and the scoped word table of one run, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.articles = articles_df(spark, sf_dir)  # lazy: its text is written with the scoped articles and with the corpus, nowhere else
        texts = tables.article_texts(spark, sf_dir)

        def made():
            feats = stage(features.narrow_features(tables.articles(spark, sf_dir, text=False), SCOPE, stage=stage), "features")
            return feats, stage(features.attach_text(feats.where(F.col("top_OK")), texts), "scoped")

        # the feature table and the lexicon depend only on the articles: their jobs are submitted from two
        # threads so that Spark runs them side by side on the free cores
        with ThreadPoolExecutor(max_workers=2) as pool:
            feats = pool.submit(made)
            lex = pool.submit(lambda: stage(cleanse.fixture_lexicon(texts), "lexicon"))
            (self.features, scoped), self.lexicon = feats.result(), lex.result()
        self.scoped = features.scoped_articles(scoped)
        self.chain = cleanse.Chain(self.scoped, self.lexicon, S.TOP_GROWTH)
        self.lex, self.words = self.chain.lexicon, self.chain.words

    def joined1(self, tokens: bool = False) -> DataFrame:
        return self.chain.joined(tokens)

    def growth(self) -> DataFrame:
        return self.chain.growth()

    def grown_lexicon(self) -> DataFrame:
        return self.chain.grown_lexicon()

    def joined2(self) -> DataFrame:
        return self.chain.rejoined()

    def attached(self) -> DataFrame:
        """Scoped articles with both texts attached, lazy: for a query that reads them once."""
        return self.scoped.join(self.chain.texts(), "my_id", "left")

    def corpus(self) -> DataFrame:
        """Scoped articles with both texts attached, materialised."""
        return stage(self.attached(), "corpus")

    def lemma_texts(self) -> DataFrame:
        """``(my_id, lemma_text)`` of every scoped article, materialised: what the counts and the topic model read."""
        return stage(self.attached().select("my_id", "lemma_text"), "lemma-texts")


def run(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(spark, sf_dir)


def words_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).words


def grown_lexicon_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).grown_lexicon()


def joined1_df(spark: SparkSession, sf_dir: str, tokens: bool = False) -> DataFrame:
    return run(spark, sf_dir).joined1(tokens)


def growth_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).growth()


def joined2_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).joined2()


def corpus_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).corpus()


def texts_df(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """``(my_id, clean_word_text, lemma_text)`` for the documents that kept at least one word."""
    if corpus is None:  # the texts themselves: nothing else of the articles is read, moved or written
        return run(spark, sf_dir).chain.texts()
    return corpus.where(F.col("clean_word_text").isNotNull()).select("my_id", "clean_word_text", "lemma_text")


def processed_df(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    c = run(spark, sf_dir).lemma_texts() if corpus is None else corpus
    return stage(dfm.process_corpus(c, S.CORPUS_SPARSITY), "processed")


def prepped_df(spark: SparkSession, sf_dir: str, processed: DataFrame | None = None) -> DataFrame:
    p = processed_df(spark, sf_dir) if processed is None else processed
    return stage(dfm.prep_documents(p, upper_share=S.CORPUS_UPPER_SHARE), "prepped")
