"""Sources and sinks: Parquet tables, the article view, stage round-trips."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import text as tx
from corpuslab.session import stage_dir

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("shares", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("topics", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("post_lead_type", T.StringType()),
        T.StructField("geo", T.StringType()),
        T.StructField("sourced_from", T.StringType()),
    ]
)
ARTICLE_COLUMNS = [f.name for f in ARTICLE_SCHEMA.fields]
LEXICON_SCHEMA = T.StructType([T.StructField("word", T.StringType()), T.StructField("lemma", T.StringType())])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article table stored as Parquet with the article schema (row 1)."""
    return spark.read.schema(ARTICLE_SCHEMA).parquet(path)


def load_lexicon(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Any two-column ``(word, lemma)`` table (row 2)."""
    reader = spark.read.schema(LEXICON_SCHEMA)
    if fmt == "csv":
        return reader.option("header", "true").option("escape", '"').csv(path)
    return reader.parquet(path)


def _article_text() -> Column:
    m7 = F.col("doc_id") % 7
    return (
        F.when(F.col("doc_id") % 14 == 4, F.concat(F.lit("Instagram iphone Reddit "), "text"))
        .when(m7 == 0, F.concat(F.lit("LAS VEGAS — "), "text"))
        .when(m7 == 1, F.concat(F.lit("AB\rC - http://x.example/y\tme.s@x.org "), "text"))
        .when(m7 == 2, F.concat(F.lit("Wi-Fi "), "text"))
        .otherwise(F.col("text"))
    )


def _article_url() -> Column:
    return F.concat(F.lit("http://example.com/"), "source", F.lit("/"), F.col("doc_id").cast("string"))


def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, url, text)`` of the article view: a scan of documents alone."""
    return read_table(spark, sf_dir, "documents").select("doc_id", _article_url().alias("url"), _article_text().alias("text"))


def text_digest(text="text") -> dict[str, Column]:
    """What stands for a text where it is not needed itself: its length and its hash."""
    return {"nb_char_text": tx.text_length(text), "_text": F.xxhash64(text)}


def articles(spark: SparkSession, sf_dir: str, keep_doc_id: bool = True, text: bool = True) -> DataFrame:
    """The article table built from the driver's tables (see FIXTURES.md section 2).

    The view is lazy, so a query reads only the columns it uses. ``orders`` and ``part``
    meet first, as narrow rows; documents, labels and those rows then join on the
    document key, so one hash partitioning by that key serves both joins at scale.
    Left joins keep every document. Without ``text`` its :func:`text_digest` stands at the end in
    its place, made in the scan of documents: no text then goes through the joins.
    """
    d = read_table(spark, sf_dir, "documents")
    digest = {} if text else text_digest(_article_text())
    d = d.select("doc_id", "lang", "source", *(["text"] if text else [c.alias(k) for k, c in digest.items()]))
    lab = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("l_doc_id"), "quality", "toxic"
    )
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    parts = p.agg(F.count(F.lit(1)).alias("_parts"))
    o = o.crossJoin(F.broadcast(parts)).join(p, F.col("o_orderkey") % F.col("_parts") == F.col("p_partkey"), "left")
    m6, m10, m3, m4 = (F.col("doc_id") % k for k in (6, 10, 3, 4))
    author = (
        F.when(m6 == 0, F.concat(F.lit("Ann "), "source", F.lit(" and Bob Ray")))
        .when(m6 == 1, F.concat(F.lit("Cy "), "source", F.lit(" & Di Fox, Ed Lee")))
        .when(m6 == 2, F.concat(F.lit("Flo "), "source", F.lit(", Gus Orr")))
        .when(m6 == 3, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Hal "), "source"))
    )
    lead = (
        F.when(F.col("toxic") == 1, F.lit("Longform"))
        .when(F.col("quality") == 0, F.lit("Full Width"))
        .when(F.col("l_doc_id").isNull() & (m3 == 0), F.lit(None).cast("string"))
        .when(m4 == 0, F.lit("Default Video"))
        .when(m4 == 1, F.lit("Default"))
        .otherwise(F.lit("Gallery"))
    )
    j = (
        d.join(lab, d.doc_id == lab.l_doc_id, "left")
        .join(o, d.doc_id == o.o_orderkey, "left")
    )
    cols = [
        _article_url().alias("url"),
        F.floor("o_totalprice").cast("long").alias("shares"),
        F.when(m4 == 3, F.concat("p_name", F.lit(" "), F.col("doc_id").cast("string"))).otherwise(F.col("p_name")).alias("title"),
        *([_article_text().alias("text")] if text else []),
        author.alias("author"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"),
        F.lower(F.concat("p_type", F.lit(","), F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(",uncategorized"))).alias("topics"),
        F.when(m10 == 9, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("channel"),
        F.lit("article").alias("content_type"),
        lead.alias("post_lead_type"),
        F.lit("us").alias("geo"),
        F.lit("src").alias("sourced_from"),
    ]
    if keep_doc_id:
        cols.append(F.col("doc_id"))
    return j.select(*cols, *digest)


def articles_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article table with every 50th document present twice (fixture for de-duplication)."""
    a = articles(spark, sf_dir)
    return a.unionByName(a.where(F.col("doc_id") % 50 == 0))


def stage_roundtrip(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as Parquet into a new folder under the shared checkpoint folder and read it back (row 3).

    This cuts the lineage: a lost executor re-reads the written files instead
    of recomputing the stage.
    """
    spark = df.sparkSession
    path = stage_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def list_columns(df: DataFrame) -> DataFrame:
    """``colnames(table)`` as data: position, name and non-null count of every column (row 4).

    One aggregate pass, then ``stack`` turns the single row into one row per column.
    """
    counts = df.agg(*[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    pairs = ", ".join(f"cast({i + 1} as bigint), '{c}', _c{i}" for i, c in enumerate(df.columns))
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) as (position, column_name, n_non_null)")


def preview_truncated(df: DataFrame, n: int = 10, width: int = 200, order_by: str = "url") -> DataFrame:
    """First ``n`` rows by ``order_by``, every cell cast to string and cut to ``width`` characters (row 5).

    ``orderBy().limit()`` is planned as a distributed top-k (TakeOrderedAndProject).
    """
    cols = [F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns]
    return df.orderBy(order_by).limit(n).select(*cols)
