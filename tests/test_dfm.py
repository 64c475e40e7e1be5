"""Document-feature matrix invariants: trims are monotone, flag names follow the script's rule."""

from pyspark.sql import functions as F

from corpuslab.operators import dfm


def _label(spark):
    rows = [("00001", "tech,mobile,apps,uncategorized"), ("00002", "tech,social media,uncategorized"),
            ("00003", "mobile,tv,uncategorized"), ("00004", "social media,tech"), ("00005", "mob,tv")]
    return dfm.label_dfm(spark.createDataFrame(rows, "my_id string, topics string"))


def test_label_dfm_splits_words_and_drops_removals(spark):
    d = _label(spark)
    terms = {r.term for r in d.select("term").distinct().collect()}
    assert "uncategorized" not in terms and "," not in terms and "" not in terms
    assert {"social", "media"} <= terms


def test_trims_monotone(spark):
    d = _label(spark)
    sizes = [dfm.trim_docfreq(d, t).count() for t in (1, 2, 3, 4)]
    assert sizes == sorted(sizes, reverse=True)
    tf = [dfm.trim_termfreq(d, t).count() for t in (1, 2, 3)]
    assert tf == sorted(tf, reverse=True)


def test_flag_names_and_collisions(spark):
    d = _label(spark)
    feats = {r.term: r.flag for r in dfm.flag_features(d, keep=9).collect()}
    assert feats["tv"] == "topic__tv"
    assert feats["mobile"] == "topic_mob" and feats["mob"] == "topic_mob_2"
    order = [r.term for r in dfm.flag_features(d, keep=9).orderBy("position").collect()]
    assert order[:3] == ["tech", "mobile", "apps"]  # first appearance


def test_topic_flags_wide(spark):
    d = _label(spark)
    docs = d.select("my_id").distinct()
    wide = dfm.topic_flags_wide(docs, d, keep=3)
    assert wide.count() == 5
    r = wide.where(F.col("my_id") == "00003").first()
    assert r["topic_mob"] is True and r["topic_tec"] is False


def test_ngrams(spark):
    df = spark.createDataFrame([("d1", "aaaa bbbb cccc")], "my_id string, lemma_text string")
    terms = sorted(r.term for r in dfm.text_dfm(df, ngrams=(1, 2, 3)).collect())
    assert terms == ["aaaa", "aaaa_bbbb", "aaaa_bbbb_cccc", "bbbb", "bbbb_cccc", "cccc"]


def test_vocabulary_joins_are_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    from corpuslab.operators import dfm

    rows = [(f"{i:03d}", t, 1 + i % 3) for i in range(60) for t in ["hot", f"w{i % 20}", f"x{i % 7}", f"once{i}"]]
    d = spark.createDataFrame(rows, "my_id string, term string, n long")
    words = spark.createDataFrame([("hot", "warm"), ("hot", "zeal"), ("w1", "w2"), ("x3", None), ("unused", "u"), (None, "n")], "word string, lemma string")

    def results():
        return [sorted(map(tuple, df.select(*sorted(df.columns)).collect())) for df in (
            dfm.trim_docfreq(d, 3), dfm.trim_termfreq(d, 6), dfm.prep_documents(d, upper_thresh=50), dfm.dictionary_map(d, words))]

    few = results()
    monkeypatch.setattr(dfm, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(dfm, "HOT_TERMS", 2)
    assert results() == few and all(few)
    assert ("000", 1, "warm") in few[3] and not any(t == "hot" for _, _, t in few[3])


def test_counts_inside_the_row_equal_a_shuffled_count(spark):
    rows = [("1", "b a b  a b c"), ("2", ""), ("3", None), ("4", "a"), ("5", "x y x y x y"), ("6", " ".join(f"w{i % 97}" for i in range(3000)))]
    df = spark.createDataFrame(rows, "my_id string, lemma_text string")
    for sizes in ((1,), (2,), (1, 2, 3)):
        got = dfm.text_dfm(df, ngrams=sizes)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = {}
        for i, t in rows:
            w = [x for x in (t or "").split(" ") if x]
            for n in sizes:
                for k in range(len(w) - n + 1):
                    g = "_".join(w[k : k + n])
                    want[i, g] = want.get((i, g), 0) + 1
        assert {(r.my_id, r.term): r.n for r in got.collect()} == want
    labels = {(r.my_id, r.term): (r.n, r.pos) for r in dfm.label_dfm(spark.createDataFrame([("1", "tv,mob, tv mob,uncategorized"), ("2", None), ("3", "")], "my_id string, topics string")).collect()}
    assert labels == {("1", "tv"): (2, 0), ("1", "mob"): (2, 1)}



def test_dictionary_map_shuffles_only_ids_of_several_places(spark, monkeypatch):
    """The counts met the dictionary row by row and were all shuffled by id and term (F12)."""
    from corpuslab.operators import words as wd

    def mapped(rows, bound=wd.BLOCK_ROWS):
        monkeypatch.setattr(wd, "BLOCK_ROWS", bound)
        d = spark.createDataFrame(rows, "my_id string, term string, n long").coalesce(1)
        return dfm.dictionary_map(d, words)

    def wanted(rows):
        to, want = {"hot": "warm", "w1": "w2", "same": "same"}, {}
        for i, t, n in rows:
            if t is not None:
                key = i, to.get(t, t)
                want[key] = want.get(key) if n is None else (want.get(key) or 0) + n
        return want

    words = spark.createDataFrame([("hot", "warm"), ("hot", "zeal"), ("w1", "w2"), ("x3", None), ("same", "same"), ("unused", "u"), (None, "n")], "word string, lemma string")
    once = [(f"{i:03d}", t, 1 + i % 3) for i in range(60) for t in ("hot", "warm", "same", f"w{i % 4}", "w2", f"x{i % 7}")]
    plain = mapped(once)
    assert {(r.my_id, r.term): r.n for r in plain.collect()} == wanted(once)
    assert "HashAggregate(keys=[my_id" not in plain._jdf.queryExecution().executedPlan().toString()
    odd = once + [("003", "hot", 5), (None, "hot", 1), (None, "warm", 2), ("new", None, 7), ("nil", "hot", None), ("nil", "warm", None), (None, "same", 3)] + once[:50]
    for bound in (wd.BLOCK_ROWS, 1, 7):
        got = mapped(odd, bound).collect()
        assert {(r.my_id, r.term): r.n for r in got} == wanted(odd) and len(got) == len(wanted(odd))


def test_growth_is_counted_once(spark):
    from corpuslab.operators import cleanse

    docs = spark.createDataFrame([(1, "often often seldom")], "my_id long, text string")
    chain = cleanse.Chain(docs, spark.createDataFrame([("seldom", "seldom")], "word string, lemma string"), 3)
    chain.write_growth()
    grown = chain.grown_lexicon()
    assert grown is chain.grown_lexicon() and "MapInArrow" not in grown._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, grown.collect())) == [("often", "often"), ("seldom", "seldom")]
