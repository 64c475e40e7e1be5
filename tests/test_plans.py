"""Physical-plan properties behind the scale claims in the README."""

import contextlib
import io
import re

from corpuslab.operators.ranking import add_row_number
from corpuslab.plans import stages as st
from corpuslab.operators import cleanse


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_flagship_plan(spark):
    c = st.run(spark, "/root/testdata/sf0.001")
    plan = _plan(cleanse.collapse_texts(c.joined2()))
    assert "BroadcastHashJoin" in plan  # lexicon side is broadcast after its row-count check
    assert "partial_collect_list" in plan  # per-document collapse is combined map-side
    assert "TakeOrderedAndProject" in plan  # growth list is a distributed top-k
    read = [set(x.split(",")) for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
    assert {"text:string", "top_OK:boolean", "my_id:string"} in read  # token branch reads 3 columns
    assert "PushedFilters: [IsNotNull(top_OK), EqualTo(top_OK,true)" in plan


def test_row_number_has_one_bounded_single_partition_step(spark):
    df = spark.range(0, 5000).selectExpr("cast(id * 7919 % 5000 as string) as k")
    plan = _plan(add_row_number(df, "k", "rn"))
    assert plan.count("SinglePartition") == 1  # only the per-bucket offsets (one row per bucket)
    assert "Window [row_number()" in plan and "_b" in plan


def test_counts_scan_only_their_columns(spark):
    from corpuslab.operators import explore

    df = explore.group_count(st.articles_df(spark, "/root/testdata/sf0.001"), "channel")
    assert "text" not in _plan(df).replace("context", "")


def test_article_view_keeps_every_document(spark):
    sf = "/root/testdata/sf0.001"
    a = st.articles_df(spark, sf)
    assert a.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert a.where("title is null or shares is null").count() == 0


def test_rejoin_broadcasts_the_grown_lexicon(spark):
    c = st.run(spark, "/root/testdata/sf0.001")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = _plan(cleanse.lemmatise(c.words, c.grown_lexicon()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the only exchange by word is the count of unmatched words
    assert "SortMergeJoin" not in joined


def test_features_choose_rows_on_narrow_keys(spark):
    """With auto broadcast off: no sort-based aggregate over the text, and the text moves with no key but the article's."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from corpuslab.operators import features

        df = spark.createDataFrame([("u1", "t", "long text", "a"), ("u2", "t", "other", None)], "url string, title string, text string, author string")
        plan = _plan(features.dedupe_by_key(df, "url", id_col="my_id"))
        assert "SortAggregate" not in plan and "min(struct" not in plan
        counted = _plan(features.key_counts(df.selectExpr("*", "xxhash64(url, title, text, author) as _h"), "url"))  # what is executed inside the written step
        assert "SortAggregate" not in counted and counted.count("HashAggregate") == 2
        feats = st.features_df(spark, "/root/testdata/sf0.001")
        plan = _plan(feats)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the written base is never shuffled again: the only shuffles are those of the length histogram
    assert not any(f"hashpartitioning({k}" in plan for k in ("title", "url", "my_id", "channel", "nb_char_text"))


def _tables(spark, sf, copies=()):
    n = 60
    docs = [(i, f"Word{i % 7} — " * 3 + "some plain text of words " * (9 + i % 5) if i % 11 else None, "en" if i % 4 else None, "web" if i % 9 else None) for i in range(1, n)]
    docs += [docs[k] for k in copies] + [(docs[k][0], "another text " * 30, *docs[k][2:]) for k in copies]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, n, 2)] + [(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    orders = spark.createDataFrame([(i, 100.5 + i, "1995-03-07") for i in range(1, n)], "o_orderkey long, o_totalprice double, o_orderdate string")
    orders.selectExpr("o_orderkey", "o_totalprice", "cast(o_orderdate as date) as o_orderdate").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(i, f"red part {i}", "BIG TIN") for i in range(1, 6)], "p_partkey long, p_name string, p_type string").write.parquet(f"{sf}/part.parquet")


def test_texts_move_only_when_they_are_attached(spark, tmp_path):
    """The article view without texts has their digests from the scan; features and scoped articles are those of the whole view, repeated and null keys included."""
    from corpuslab.operators import features
    from corpuslab.sources import tables

    sf = str(tmp_path)
    _tables(spark, sf, copies=(4, 8, 17))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        narrow = tables.articles(spark, sf, text=False)
        plan = _plan(narrow.drop("text"))
        shuffled = [x for x in plan.splitlines() if "Exchange" in x or "Sort " in x]
        assert shuffled and "xxhash64(" in plan
        below = plan[plan.index("Exchange"):]
        assert "xxhash64(" in below  # hashed below the joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    whole = tables.articles(spark, sf)
    want = features.without_text(whole)
    assert narrow.columns == want.columns and narrow.dtypes == want.dtypes
    assert sorted(map(str, narrow.collect())) == sorted(map(str, want.collect()))
    c = st.run(spark, sf)
    full = features.feature_table(whole, st.SCOPE)
    assert "text" not in c.features.columns  # no text is written out of scope
    scoped = features.scoped_articles(full)
    assert c.scoped.count() > 20
    rows = [sorted(map(str, t.select(*sorted(scoped.columns)).collect())) for t in (c.scoped, scoped, features.scoped_articles(st.features_df(spark, sf, text=True)))]
    assert rows[0] == rows[1] == rows[2]
