"""Hand-made edge rows for the scalar functions and predicates."""

from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import features


def _one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"{col} {dtype}")


def test_coauthor_and_first_author(spark):
    df = spark.createDataFrame([("ann and bob",), ("cy & di, ed",), ("flo, gus",), (None,), ("hal",)], "author string")
    rows = df.select(tx.has_coauthor("author").alias("p"), tx.first_author("author").alias("f")).collect()
    assert [r.p for r in rows] == [True, True, True, False, False]
    assert [r.f for r in rows] == ["ann", "cy", "flo", None, "hal"]


def test_topic_count_minus_one(spark):
    df = spark.createDataFrame([("a,b,uncategorized",), ("nocomma",), (None,)], "topics string")
    assert [r[0] for r in df.select(tx.topic_count("topics")).collect()] == [1, -1, None]


def test_parse_date_and_min_date(spark):
    df = spark.createDataFrame([("01/02/2014", True), ("12/31/2013", True), ("13/45/2013", True), ("01/01/2000", False)],
                               "date string, top_OK boolean")
    m = features.min_date(df).first()
    assert m.date_min_lexicographic == "01/02/2014"
    assert m.date_min_chronological == "12/31/2013"
    assert df.select(tx.parse_date("date").alias("d")).collect()[2].d is None


def test_dateline_strip_and_flag(spark):
    rows = [("LAS VEGAS — Rest of text",), ("Wi-Fi works",), ("AB\rC - end of head and more",), ("plain text here",)]
    df = spark.createDataFrame(rows, "text string")
    out = df.select(tx.dateline_flag("text").alias("f"), tx.dateline_strip("text").alias("t")).collect()
    assert [r.f for r in out] == [True, False, True, False]
    assert out[0].t == " Rest of text"
    assert out[1].t == "Fi works"  # applied to every row: "Wi-" is lost, as in the script
    assert out[2].t == " end of head and more"  # "." crosses "\r" (PCRE semantics)
    assert out[3].t == "plain text here"


def test_token_cleaning(spark):
    toks = ["http://localhost", "https://x.org/page", "me@x.org", "Wi-Fi!", "café", "a@b", "<U+00E9>x"]
    df = spark.createDataFrame([(t,) for t in toks], "token string")
    words = [r[0] for r in df.select(tx.clean_word("token")).collect()]
    assert words[0] == "httplocalhost"  # no dot or slash after :// -> not a URL
    assert words[1] == ""
    assert words[2] == ""
    assert words[3] == "wifi"
    assert words[4] == "caf"
    assert words[5] == ""
    assert words[6] == "uex"  # code-point removal is dead code in the script's order
    first = [r[0] for r in df.select(tx.clean_word("token", codepoints_first=True)).collect()]
    assert first[6] == "x"


def test_pad_id_never_truncates(spark):
    df = spark.createDataFrame([(7,), (123456,)], "n long")
    assert [r[0] for r in df.select(tx.pad_id(F.col("n"), 5)).collect()] == ["00007", "123456"]


def test_lead_type_class_null_is_gallery(spark):
    df = spark.createDataFrame([("Default Video",), ("Default",), (None,), ("video",)], "post_lead_type string")
    assert [r[0] for r in df.select(tx.lead_type_class()).collect()] == ["Video", "Article", "Gallery", "Gallery"]


def test_scope_flag_null_safe(spark):
    rows = [("a", "x", "Default", "t"), ("b", "x", "Longform", "t"), ("c", None, "Default", "t"), ("d", None, "Default", "t"),
            ("e", "x", None, "t"), ("f", "x", "Default", ""), ("g", "x", "Default", None), ("h", "y", "Default", "t")]
    df = spark.createDataFrame(rows, "url string, channel string, post_lead_type string, text string")
    got = {r.url: r.top_OK for r in features.add_scope_flag(df, features.ScopeParams(min_channel_rows=1)).collect()}
    # channel x (5 rows) and the null channel (2 rows) are frequent; y (1 row) is not
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": False, "f": False, "g": False, "h": False}


def test_in_list_matches_null(spark):
    df = spark.createDataFrame([("t1",), (None,), ("t3",)], "title string")
    vals = spark.createDataFrame([(None,), ("t1",)], "title string")
    got = [r.hit for r in features.in_list(df, "title", vals, "title", "hit").orderBy(F.asc_nulls_first("title")).collect()]
    assert got == [True, True, False]


def test_loaders_read_what_was_written(spark, tmp_path):
    from corpuslab.sources import tables

    lex = spark.createDataFrame([("words", "word"), ("a,b", 'q"x'), ("none", None)], tables.LEXICON_SCHEMA)
    lex.write.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    lex.write.parquet(str(tmp_path / "parquet"))
    for fmt in ("csv", "parquet"):
        got = tables.load_lexicon(spark, str(tmp_path / fmt), fmt)
        assert got.schema == tables.LEXICON_SCHEMA and sorted(got.collect(), key=str) == sorted(lex.collect(), key=str)
    row = tuple(f"v{i}" if f.dataType.simpleString() == "string" else i for i, f in enumerate(tables.ARTICLE_SCHEMA.fields))
    spark.createDataFrame([row], tables.ARTICLE_SCHEMA).withColumn("other", F.lit(1)).write.parquet(str(tmp_path / "articles"))
    assert tables.load_articles(spark, str(tmp_path / "articles")).collect() == [row]
