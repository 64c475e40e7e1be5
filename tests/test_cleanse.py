"""Cleansing chain against a plain-Python re-statement on a tiny corpus, plus invariants."""

import re

from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import cleanse
from corpuslab.sources import tables

DOCS = [
    ("00001", "Running quickly, the runners ran http://a.b/c to me@x.org\tand waited\nwaited"),
    ("00002", "Nothing here but tiny of at"),
    ("00003", "Zebras zebras ZEBRAS grazing; walked walking talked"),
    ("00004", "Unknownword unknownword another unknownword"),
]
LEXICON = [("running", "run"), ("runners", "runner"), ("waited", "wait"), ("walked", "walk"), ("walking", "walk"),
           ("grazing", "graze"), ("quickly", "quick"), ("zebras", "zebra")]


def _py_words(text):
    out = []
    for tok in [t for t in re.sub(r"[\n\t\r]", " ", text).split(" ") if t]:
        w = re.sub(r" ?(f|ht)(tp)(s?)(://)(.*)[.|/](.*)", " ", tok)
        w = re.sub(r"[^\s]*@[^\s]*", " ", w)
        w = re.sub(r"[^a-zA-Z]", "", w).lower()
        if len(w) > 3:
            out.append(w)
    return out


def _py_corpus(top_n):
    lex = dict(LEXICON)
    words = {d: _py_words(t) for d, t in DOCS}
    oov = {}
    for ws in words.values():
        for w in ws:
            if w not in lex:
                oov[w] = oov.get(w, 0) + 1
    grow = sorted(oov.items(), key=lambda kv: (-kv[1], kv[0]))[:top_n]
    lex2 = dict(lex, **{w: w for w, _ in grow})
    out = {}
    for d, ws in words.items():
        if not ws:
            continue
        lem = [lex2[w] for w in ws if w in lex2 and len(lex2[w]) > 3]
        out[d] = (" ".join(ws), " ".join(lem) if lem else None)
    return out


def test_clean_corpus_matches_python(spark):
    scoped = spark.createDataFrame(DOCS, "my_id string, text string")
    lex = spark.createDataFrame(LEXICON, "word string, lemma string")
    got = {r.my_id: (r.clean_word_text, r.lemma_text) for r in cleanse.clean_corpus(scoped, lex, top_n=1).collect()}
    assert got == _py_corpus(1)


def test_growth_is_exactly_top_n_new_words(spark):
    scoped = spark.createDataFrame(DOCS, "my_id string, text string")
    lex = spark.createDataFrame(LEXICON, "word string, lemma string")
    words = cleanse.word_table(scoped)
    grown = cleanse.augment_lexicon(lex, words, top_n=2)
    assert grown.count() - lex.count() == 2
    added = grown.join(lex, "word", "left_anti")
    assert added.where(F.col("word") != F.col("lemma")).count() == 0
    before = cleanse.lemmatise(words, lex).where(F.length("lemma") > 3).count()
    after = cleanse.lemmatise(words, grown).where(F.length("lemma") > 3).count()
    assert after >= before  # growing the lexicon never loses tokens


def test_order_is_dense_and_idempotent_steps(spark):
    scoped = spark.createDataFrame(DOCS, "my_id string, text string")
    toks = cleanse.tokenise(scoped)
    orders = toks.groupBy("my_id").agg(F.max("order").alias("mx"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.mx == r.n for r in orders)
    w = toks.select(tx.letters_only("token").alias("w"))
    assert w.where(tx.letters_only("w") != F.col("w")).count() == 0
    n = scoped.select(tx.normalise_ws("text").alias("t"))
    assert n.where(tx.normalise_ws("t") != F.col("t")).count() == 0


def _zipf(spark, n=40_000):
    """Words with frequencies like 1 / rank, a third of them one word; a lexicon where some words have several lemmas."""
    rank = F.floor(F.exp(F.rand(7) * 8.0))
    word = F.when(F.rand(8) < 0.33, F.lit("word1")).otherwise(F.concat(F.lit("word"), rank.cast("string")))
    words = spark.range(0, n, 1, 6).select(F.col("id").cast("string").alias("my_id"), F.lit(1).alias("order"), word.alias("word"))
    lemmas = [(f"word{i}", f"lemma{i}_{j}") for i in range(1, 2000) if i % 5 for j in range(1 + (i % 3 == 1))] + [("word7", None)]
    return words, spark.createDataFrame(lemmas, "word string, lemma string")


def test_hot_words_are_joined_apart(spark, monkeypatch):
    words, lexicon = _zipf(spark)
    words = words.unionByName(spark.createDataFrame([("none", 1, None)], words.schema))
    words = tables.stage_roundtrip(words, "zipf-words")
    monkeypatch.setattr(cleanse, "MAX_BROADCAST_LEXICON_ROWS", 100)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = cleanse.hot_words(words)
        assert 1 <= hot.count() <= cleanse.HOT_SHARE * int(spark.conf.get("spark.sql.shuffle.partitions")) and hot.where("word = 'word1'").count() == 1
        joined = cleanse.lemmatise(words, lexicon, hot)
        plain = words.join(lexicon, "word", "left")
        cols = ["my_id", "order", "word", "lemma"]
        assert joined.select(cols).exceptAll(plain.select(cols)).count() == 0 and joined.count() == plain.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        seldom = words.join(hot.select("word"), "word", "left_anti").where("word is not null").join(lexicon, "word", "left")
        tasks = sorted(r["count"] for r in seldom.groupBy(F.spark_partition_id()).count().collect())
        assert tasks[-1] <= 2 * tasks[len(tasks) // 2]
        raw = sorted(r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect())
        assert raw[-1] > 2 * raw[len(raw) // 2]  # what the split is for
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chain_gives_the_same_texts_beyond_the_broadcast_bound(spark, monkeypatch):
    arts = tables.article_texts(spark, "/root/testdata/sf0.001").select(F.col("doc_id").cast("string").alias("my_id"), "text")
    lexicon = tables.stage_roundtrip(cleanse.fixture_lexicon(tables.article_texts(spark, "/root/testdata/sf0.001")), "lexicon")
    small = {tuple(r) for r in cleanse.clean_corpus(arts, lexicon, 30).collect()}
    monkeypatch.setattr(cleanse, "HOT_SHARE", 100)
    for least in (cleanse.MAX_BROADCAST_LEXICON_ROWS, 100):
        monkeypatch.setattr(cleanse, "MAX_BROADCAST_LEXICON_ROWS", least)
        assert {tuple(r) for r in cleanse.clean_corpus(arts, lexicon, 30).collect()} == small
    chain = cleanse.Chain(arts, lexicon, 30, exclude_entities=True)
    assert chain.large and chain.hot.count() > 0
    grown = {r.word for r in chain.growth().collect()}
    assert not grown & set(cleanse.ENTITY_EXCLUSIONS)  # the entity list applied



def test_collapsed_texts_with_fanned_out_words(spark):
    """One list holds both texts: places repeat where a word has several lemmas, short and missing lemmas leave no entry."""
    rows = [("1", 2, "walking", "walk"), ("1", 1, "house", "house"), ("1", 2, "walking", "walking"), ("1", 3, "cats", "cat"), ("1", 4, "unknown", None),
            ("1", 2, "walking", "amble"), ("2", 1, "cats", "cat"), ("2", 2, "other", None)]
    df = spark.createDataFrame(rows, "my_id string, order int, word string, lemma string")
    got = {r.my_id: (r.clean_word_text, r.lemma_text) for r in cleanse.collapse_texts(df).collect()}
    assert got == {"1": ("house walking walking walking cats unknown", "house amble walk walking"), "2": ("cats other", None)}
    schema = str(cleanse.collapse_texts(df)._jdf.queryExecution().optimizedPlan())
    assert schema.count("collect_list") == 1  # the words are shuffled once


def test_a_query_writes_only_the_texts_it_reads(spark, monkeypatch, tmp_path):
    """What the counts and the model read is written without the articles' other columns; the texts alone are not written at all."""
    from corpuslab.plans import stages as st

    sf = str(tmp_path)
    n = 40
    docs = [(i, " ".join(f"{w}{'abcde'[i % 5]} street" for w in ("walking", "houses", "painted") * (9 + i % 7)) if i % 9 else "12 " * 90, "en", "web") for i in range(1, n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, n)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    orders = spark.createDataFrame([(i, 100.5 + i, "1995-03-07") for i in range(1, n)], "o_orderkey long, o_totalprice double, o_orderdate string")
    orders.selectExpr("o_orderkey", "o_totalprice", "cast(o_orderdate as date) as o_orderdate").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(i, f"red part {i}", "BIG TIN") for i in range(1, 6)], "p_partkey long, p_name string, p_type string").write.parquet(f"{sf}/part.parquet")
    written = {}
    real = st.stage

    def kept(df, name):
        written[name] = df.columns
        return real(df, name)

    monkeypatch.setattr(st, "stage", kept)
    c = st.run(spark, sf)
    written.clear()
    narrow = c.lemma_texts()
    assert written == {"lemma-texts": ["my_id", "lemma_text"]}
    assert set(c.attached().columns) == {*c.scoped.columns, "clean_word_text", "lemma_text"} and "corpus" not in written
    assert narrow.count() == c.scoped.count() > 0  # articles without a word are counted too
    texts = st.texts_df(spark, sf)
    assert "corpus" not in written and texts.columns == ["my_id", "clean_word_text", "lemma_text"]
    whole = st.texts_df(spark, sf, c.corpus())
    assert sorted(map(str, texts.collect())) == sorted(map(str, whole.collect()))
