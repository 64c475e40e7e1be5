"""Distributed ranking forms against the textbook single-partition forms; partition-count invariance."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.operators.ranking import add_row_number, exact_quantiles, percent_rank_by_histogram, percent_rank_by_window


def _data(spark, n=500, seed=3):
    rng = np.random.default_rng(seed)
    vals = [int(x) if i % 17 else None for i, x in enumerate(rng.integers(0, 60, n))]
    return spark.createDataFrame([(f"u{i:04d}", v) for i, v in enumerate(vals)], "url string, v long")


def test_row_number_matches_window(spark):
    df = _data(spark)
    a = {r.url: r.rn for r in add_row_number(df, "url", "rn").collect()}
    b = {r.url: r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy("url"))).collect()}
    assert a == b


def test_percent_rank_histogram_equals_window(spark):
    df = _data(spark)
    a = {r.url: r.pr for r in percent_rank_by_histogram(df, "v", "pr").collect()}
    b = {r.url: r.pr for r in percent_rank_by_window(df, "v", "pr").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or abs(a[k] - b[k]) < 1e-12


def test_exact_quantiles_type7(spark):
    df = _data(spark).where(F.col("v").isNotNull())
    q = exact_quantiles(df, "v", {"q1": 0.25, "med": 0.5, "q3": 0.75, "p9": 0.9}).first()
    x = np.array([r.v for r in df.collect()], dtype=float)
    for name, p in (("q1", 0.25), ("med", 0.5), ("q3", 0.75), ("p9", 0.9)):
        assert abs(q[name] - np.percentile(x, p * 100)) < 1e-9


def test_partition_count_invariance(spark):
    df = _data(spark)
    results = []
    for n in (1, 4, 32):
        r = add_row_number(df.repartition(n), "url", "rn", num_partitions=n)
        r = percent_rank_by_histogram(r, "v", "pr")
        results.append(sorted((x.url, x.rn, x.pr) for x in r.collect()))
    assert results[0] == results[1] == results[2]


def test_dedupe_never_grows_and_is_idempotent(spark):
    from corpuslab.operators.features import dedupe_by_key

    rows = [("u1", 1, "a"), ("u1", 1, "a"), ("u2", 2, "b"), ("u2", 3, "c"), ("u3", 4, "d")] * 3
    df = spark.createDataFrame(rows, "url string, shares long, title string")
    once = dedupe_by_key(df, "url")
    twice = dedupe_by_key(once, "url")
    assert once.count() == 3 <= df.count()
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.url: r.shares for r in once.collect()}["u2"] == 2  # first by the remaining columns


def test_ranges_grow_with_the_rows_and_keep_key_order(spark):
    from corpuslab.operators.ranking import bucketed

    df = spark.range(0, 5000).selectExpr("cast(if(id % 50 = 0, null, id * 7919 % 600) as double) as v")
    b = bucketed(df, "v")
    assert b.count() == 5000
    rows = b.groupBy("_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_b").collect()
    assert len(rows) > 1 and all(x.hi < y.lo for x, y in zip(rows, rows[1:]))  # a key lies in one range
    assert b.where("v is null").select("_b").distinct().collect()[0][0] == rows[0]["_b"]
    assert bucketed(df.limit(0), "v").count() == 0


def test_row_number_of_a_null_key_and_of_equal_keys(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("b", 4)], "k string, x int")
    got = {(r.k, r.x): r.rn for r in add_row_number(df, "k", "rn").collect()}
    assert got == {(None, 1): 1, ("a", 3): 2, ("b", 2): 3, ("b", 4): 3}


def test_dedupe_numbers_the_kept_rows_and_keeps_null_keys(spark):
    from corpuslab.operators.features import dedupe_by_key

    rows = [("b", 2, "same")] * 500 + [("b", 1, "first"), ("a", 5, None), (None, 7, "x"), (None, 7, "x"), ("c", None, "n"), ("c", 3, "m")]
    df = spark.createDataFrame(rows, "url string, shares long, text string").repartition(7)
    got = sorted(dedupe_by_key(df, "url", id_col="my_id").collect(), key=lambda r: r.my_id)
    assert [(r.url, r.shares, r.text, r.my_id) for r in got] == [
        (None, 7, "x", "00001"), ("a", 5, None, "00002"), ("b", 1, "first", "00003"), ("c", None, "n", "00004")]
    by_most = dedupe_by_key(df, "url", order_cols=["text"]).collect()
    assert {r.url: r.text for r in by_most}["c"] == "m"
    assert dedupe_by_key(df.limit(0), "url", id_col="my_id").collect() == []


def test_series_flag_is_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    from corpuslab.operators import features

    rows = [(str(i), "hot", "x") for i in range(50)] + [("90", "rare", "x"), ("91", None, "x"), ("92", None, "x"), ("93", None, "x"), ("94", "hot", "y")]
    df = spark.createDataFrame(rows, "my_id string, title string, author string")
    few = sorted(features.add_series_flag(df, id_col="my_id").collect())
    monkeypatch.setattr(features, "SERIES_BROADCAST", 0)
    many = sorted(features.add_series_flag(df, id_col="my_id").select(*df.columns, "top_series").collect())
    assert few == many and {r.my_id for r in few if not r.top_series} == {"90"}
    both = {r.my_id: r.top_series for r in features.add_series_flag(df, by_author=True, id_col="my_id").collect()}
    assert both["0"] and both["91"] and not both["94"]


def test_feature_table_attaches_the_text_of_the_row_it_kept(spark):
    """Same rows with and without texts; repeated urls, exact copies, null urls and null texts keep one row with its own text."""
    from corpuslab.operators import features

    row = ("u1", 5, "t", "x" * 300, "Ann", "01/02/2015", "a,b", "en", "article", "Default", "us", "src")
    cols = ["url", "shares", "title", "text", "author", "date", "topics", "channel", "content_type", "post_lead_type", "geo", "sourced_from"]

    def like(**change):
        return tuple(change.get(c, v) for c, v in zip(cols, row))

    rows = [row, row, like(text="y" * 250), like(url="u2", text="z" * 280), like(url="u3", text=None), like(url=None, text="n" * 260), like(url=None, text="n" * 260), like(url="u4", shares=1, text="p"), like(url="u4", shares=2, text="q")]
    articles = spark.createDataFrame(rows, "url string, shares long, title string, text string, author string, date string, topics string, channel string, content_type string, post_lead_type string, geo string, sourced_from string")
    params = features.ScopeParams(min_channel_rows=1)
    wide = features.feature_table(articles, params, tighten=False, stage=lambda df, name: df if "text" not in df.columns else 1 / 0)
    narrow = features.feature_table(articles, params, tighten=False, text=False)
    got = {r.url: r for r in wide.collect()}
    assert wide.count() == 5 and set(got) == {"u1", "u2", "u3", "u4", None}
    assert "text" not in narrow.columns and sorted(wide.columns) == sorted([*narrow.columns, "text"])
    assert {(r.url, r.my_id, r.nb_char_text, r.top_OK) for r in wide.collect()} == {(r.url, r.my_id, r.nb_char_text, r.top_OK) for r in narrow.collect()}
    assert got["u1"].text in ("x" * 300, "y" * 250) and len(got["u1"].text) == got["u1"].nb_char_text
    assert got["u3"].text is None and not got["u3"].top_OK and got["u4"].text == "p" and got[None].text == "n" * 260
