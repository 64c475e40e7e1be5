"""Words found in whole text columns: equal to the column expressions token by token, in rows, counts, blocks and n-grams."""

from pyspark.sql import functions as F

from corpuslab.operators import cleanse, dfm
from corpuslab.operators import words as wd

TEXTS = [
    (1, "a b  c http://x.y/z?me@you.org/foo ending\nftp://quit plain"), (2, None), (3, ""), (4, "   "), (5, "Ünïcode wörds—dash été naïveté"),
    (6, "abc@def@ghij klmn://opqr httpX://abcd.efgh/ijkl|mnop"), (7, "http://abcd\x85efgh.ijkl/mnop http://abcd efgh/ijkl a\x0bb\x0cdefgh@ijkl\x0bmnop"),
    (8, "tab\tseparated\r\nlines of words " * 50), (9, "@"), (10, "://"), (11, "xhttps://site.com/path@mail.com,word http://nodot"), (12, "x" * 5000 + " tail"),
    (13, "ending:"), (14, "//start http:/ /abc"), (15, "\U0001F600smile\U0001F600@abc defgh://\U0001F600.x"), (16, "e_mail a_b c a b_c d a_b c"),
    (1, "repeated identifier words"), (None, "null identifier words"), (None, "another words text"),
]
LEXICON = [("words", "word"), ("words", "wordy"), ("words", None), ("separated", "sep"), ("separated", "separate"), ("identifier", None), ("null", "null"), ("ending", "ends")]


def _rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def _docs(spark):
    return spark.createDataFrame(TEXTS, "my_id long, text string").repartition(2)


def _by_token(docs):
    return cleanse.drop_short(cleanse.add_words(cleanse.tokenise(docs)), "word", 3)


def test_words_of_a_column_equal_the_expressions(spark, monkeypatch):
    docs = _docs(spark)
    want = _by_token(docs)
    cols = ["my_id", "order", "token", "word"]
    assert _rows(cleanse.word_table(docs), *cols) == _rows(want, *cols)
    plan = cleanse.word_table(docs)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "Generate" not in plan
    counts = cleanse.word_counts(docs).groupBy("word").agg(F.sum("n").alias("n"))
    assert _rows(counts, "word", "n") == _rows(want.groupBy("word").agg(F.count("*").alias("n")), "word", "n")
    monkeypatch.setattr(wd, "SLICE_BYTES", 64)  # many slices, some of one longer text
    assert [x[:2] for x in wd.slices(__import__("pyarrow").array([t for _, t in TEXTS]), 64)][:3] == [(0, 4), (4, 1), (5, 1)]


def test_blocks_give_the_texts_and_rows_of_the_token_join(spark, monkeypatch):
    docs, lexicon = _docs(spark), spark.createDataFrame(LEXICON, "word string, lemma string")
    rows = _by_token(docs)
    grown = cleanse.augment_lexicon(lexicon, rows, 3)
    joined = cleanse.lemmatise(rows, grown)
    texts, cols = ["my_id", "clean_word_text", "lemma_text"], ["my_id", "order", "token", "word", "lemma"]
    want_texts, want_rows, first = _rows(cleanse.collapse_texts(joined), *texts), _rows(joined, *cols), _rows(cleanse.lemmatise(rows, lexicon), *cols)
    for bound in (cleanse.MAX_BROADCAST_LEXICON_ROWS, 1):
        monkeypatch.setattr(cleanse, "MAX_BROADCAST_LEXICON_ROWS", bound)
        chain = cleanse.Chain(docs, lexicon, 3)
        assert _rows(chain.texts(), *texts) == want_texts  # the ids that repeat too
        assert _rows(chain.joined(True), *cols) == first and _rows(chain.rejoined(True), *cols) == want_rows
        assert _rows(chain.rejoined(), "my_id", "word", "lemma") == _rows(joined, "my_id", "word", "lemma")


def test_only_distinct_words_of_a_block_meet_the_lexicon(spark):
    docs = spark.createDataFrame([(i, "often often often often seldom") for i in range(200)], "my_id long, text string").coalesce(1)
    blocks = cleanse.word_blocks(docs)
    assert blocks.count() == 1 and blocks.select(F.explode("vocab")).count() == 2
    assert blocks.select("counts").first()[0] == [800, 200]


def test_grams_that_read_alike_are_counted_together(spark):
    docs = spark.createDataFrame([(i, t) for i, t in TEXTS], "my_id long, text string")
    toks = F.filter(F.split("text", " "), lambda x: x != F.lit(""))
    for sizes in ((1,), (2,), (1, 2, 3)):
        grams = [F.when(F.size("_t") >= n, dfm.ngram_terms(F.col("_t"), n)).otherwise(F.array().cast("array<string>")) for n in sizes]
        base = docs.where("text is not null").select("my_id", toks.alias("_t")).select("my_id", F.concat(*grams).alias("_v"))
        assert _rows(dfm.text_dfm(docs, "my_id", "text", sizes), "my_id", "term", "n") == _rows(dfm.row_counts(base, "my_id", "_v"), "my_id", "term", "n")


def test_counted_words_and_grams_equal_their_plain_forms(monkeypatch):
    """Words without places are those with places; n-grams packed into one integer are those numbered size by size, in slices of any size."""
    from collections import Counter

    import pyarrow as pa

    col = pa.array([t for _, t in TEXTS] + ["", None, "last@mail.org", "http://a.bc/defg"], pa.string())
    ids = pa.array(range(len(col)), pa.int64())
    data, offsets = wd.column_bytes(col)
    want = Counter(wd.words(data, offsets, 3)[0].to_pylist())
    assert len(want) > 20 and Counter(wd.bare_words(col, 3).to_pylist()) == want
    assert wd.bare_words(pa.array([], pa.string()), 3).to_pylist() == []

    def grams():
        batches = [pa.RecordBatch.from_arrays([ids, col], ["my_id", "text"])]
        return sorted(tuple(r.values()) for b in wd.term_counts((1, 2, 3), "my_id")(batches) for r in b.to_pylist())

    plain = Counter()
    for i, text in enumerate(col.to_pylist()):
        w = [x for x in (text or "").split(" ") if x]
        plain.update((i, "_".join(w[k : k + n])) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    want = sorted((*k, n) for k, n in plain.items())
    assert grams() == want
    monkeypatch.setattr(wd, "GRAM_BYTES", 40)
    assert grams() == want
    monkeypatch.setattr(wd, "PACKED_BITS", 0)  # integers too short for any packing
    assert grams() == want


def test_workers_work_in_pieces_and_keep_no_memory(spark, monkeypatch):
    """Rows leave in small batches, blocks do not depend on the pieces, and every function gives its worker's memory back when its task ends."""
    import pyarrow as pa

    text = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(1000)) + " "
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([text * 25] * 40)], ["my_id", "text"])  # 8 MB
    freed = []
    monkeypatch.setattr(wd, "free_memory", lambda: freed.append(1))
    rows = list(wd.word_rows(3, True, "my_id")(iter([batch])))
    assert sum(r.num_rows for r in rows) == 40 * 25_000 and max(r.nbytes for r in rows) < 6 << 20 and freed == [1]
    counts = pa.Table.from_batches(wd.word_counts(3)(iter([batch.select(["text"])])))
    assert sum(counts["n"].to_pylist()) == 40 * 25_000 and freed == [1, 1]
    monkeypatch.undo()

    def chained():
        monkeypatch.setattr(cleanse, "MAX_BROADCAST_LEXICON_ROWS", 0)
        chain = cleanse.Chain(_docs(spark), cleanse.stage_roundtrip(spark.createDataFrame(LEXICON, "word string, lemma string"), "few"), 3)
        return _rows(chain.joined(tokens=True), "my_id", "order", "token", "word", "lemma"), _rows(chain.texts(), "my_id", "clean_word_text", "lemma_text")

    want = chained()
    monkeypatch.setattr(wd, "PIECE_BYTES", 64)
    monkeypatch.setattr(wd, "PIECE_TOKENS", 3)
    assert chained() == want
