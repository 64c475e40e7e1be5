"""Document-feature matrices in long form ``(doc, term, n)`` (rows 45, 55, 61, 88-99, 101).

A DFM is never materialised as a dense or positional matrix: trims are
aggregates over terms followed by a semi join with the kept vocabulary, and
the only per-document structure built is the ordered ``(term_id, n)`` list of
the corpus triple.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.lists import CUSTOM_STOPWORDS, LABEL_REMOVALS, SNOWBALL_ENGLISH
from corpuslab.operators import words as wd
from corpuslab.sources.tables import stage_roundtrip

BROADCAST_TERMS = 1_000_000  # a short string and two numbers a term: some tens of MB
HOT_TERMS = 10_000

LABEL_SPLIT_RE = r"[,\s]+"


# ---------------------------------------------------------------------------
# Building
# ---------------------------------------------------------------------------
def row_counts(df: DataFrame, id_col: str, values: str, term=lambda x: x, extra=lambda x: {}) -> DataFrame:
    """``(id, term, n)`` from an array column, counted inside the row: the array is sorted and its runs are measured, nothing is shuffled.

    ``term`` reads the term of an entry, ``extra`` further columns from the first (smallest) entry of a run. One row of ``df`` is one document.
    """
    ordered = df.select(id_col, F.sort_array(values).alias("_s")).where(F.size("_s") > 0)

    def at(i):
        return F.get(F.col("_s"), i)

    begins = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (term(at(i)) != term(at(i - 1))))
    runs = ordered.select(id_col, "_s", begins.alias("_b")).select(
        id_col, "_s", F.explode(F.transform("_b", lambda i, k: F.struct(i.alias("i"), (F.coalesce(F.get(F.col("_b"), k + 1), F.size("_s")) - i).alias("n")))).alias("_r"))
    first = at(F.col("_r.i"))
    return runs.select(id_col, term(first).alias("term"), F.col("_r.n").cast("long").alias("n"), *[c.alias(k) for k, c in extra(first).items()])


def label_dfm(df: DataFrame, id_col: str = "my_id", col: str = "topics", removals=LABEL_REMOVALS) -> DataFrame:
    """DFM of a comma-delimited label column: lower case, word tokens, removals dropped (row 88).

    Also returns ``pos`` of the first occurrence, which fixes the feature order. Counted in the row (:func:`row_counts`).
    """
    toks = F.transform(F.split(F.lower(F.col(col)), LABEL_SPLIT_RE), lambda x, i: F.struct(x.alias("term"), i.alias("pos")))
    kept = F.filter(toks, lambda x: (x["term"] != "") & ~x["term"].isin(*removals))
    return row_counts(df.select(id_col, kept.alias("_v")), id_col, "_v", lambda x: x["term"], lambda x: {"pos": x["pos"]})


def ngram_terms(tokens, n: int):
    """Array of ``_``-joined n-grams of an array column (row 92)."""
    if n == 1:
        return tokens
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))),
        lambda i: F.array_join(F.slice(tokens, i, n), "_"),
    )


def text_dfm(df: DataFrame, id_col: str = "my_id", col: str = "lemma_text", ngrams=(1,)) -> DataFrame:
    """DFM of a space-separated text column, for one or several n-gram sizes (rows 89, 92).

    The n-grams of all sizes are coded and counted in the row (:func:`corpuslab.operators.words.term_counts`), so the text is read and split once,
    strings are made only for what is returned, and nothing is shuffled.
    """
    texts = df.select(F.col(id_col), F.col(col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return texts.mapInArrow(wd.term_counts(tuple(ngrams), id_col), f"`{id_col}` {texts.schema[0].dataType.simpleString()}, term string, n long")


# ---------------------------------------------------------------------------
# Term statistics, trims, top features
# ---------------------------------------------------------------------------
def term_stats(dfm: DataFrame, id_col: str = "my_id") -> DataFrame:
    """``(term, total, docfreq)`` (partial aggregate per term)."""
    return dfm.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docfreq"))


def join_terms(dfm: DataFrame, vocab: DataFrame, weight: str = "docfreq") -> DataFrame:
    """``dfm`` joined with ``vocab`` (one row for each ``term`` to keep) on the term; ``weight`` (the rows of a term) is dropped.

    The vocabulary is written and counted. Up to ``BROADCAST_TERMS`` terms it is broadcast. Beyond, its
    ``HOT_TERMS`` most frequent terms are, and only the rows of the other terms are shuffled by term, so no frequent term lands in one task.
    """
    vocab = stage_roundtrip(vocab, "vocabulary")
    n = vocab.count()
    if n <= BROADCAST_TERMS:
        return dfm.join(F.broadcast(vocab.drop(weight)), "term")
    hot = stage_roundtrip(vocab.orderBy(F.desc(weight), "term").limit(HOT_TERMS), "hot-terms")
    names = F.broadcast(hot.select("term"))
    often = dfm.join(F.broadcast(hot.drop(weight)), "term")
    seldom = dfm.join(names, "term", "left_anti").join(vocab.drop(weight).join(names, "term", "left_anti"), "term")
    return often.unionByName(seldom)


def _keep_terms(dfm: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``dfm`` whose term is in ``kept`` (term, docfreq)."""
    return join_terms(dfm, kept.select("term", "docfreq")).select(*dfm.columns)


def trim_termfreq(dfm: DataFrame, min_termfreq: float) -> DataFrame:
    """``dfm_trim(min_termfreq=t)``: terms with total count >= t (row 90a)."""
    return _keep_terms(dfm, term_stats(dfm).where(F.col("total") >= F.lit(min_termfreq)))


def trim_docfreq(dfm: DataFrame, min_docfreq: float) -> DataFrame:
    """``dfm_trim(min_docfreq=t)``: terms in >= t documents (row 90b)."""
    return _keep_terms(dfm, term_stats(dfm).where(F.col("docfreq") >= F.lit(min_docfreq)))


def trim_sparsity(dfm: DataFrame, sparsity: float, n_docs: DataFrame) -> DataFrame:
    """``dfm_trim(sparsity=s)``: docfreq >= (1 - s) x documents (row 90c). ``n_docs`` is a one-row ``(_n)``."""
    kept = term_stats(dfm).crossJoin(F.broadcast(n_docs)).where(F.col("docfreq") >= F.lit(1.0 - sparsity) * F.col("_n"))
    return _keep_terms(dfm, kept)


def top_terms(dfm: DataFrame, k: int = 10) -> DataFrame:
    """``topfeatures(dfm, k)``: total count desc, term asc (rows 55, 86). A distributed top-k."""
    return dfm.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc("term")).limit(k)


def top_terms_list(dfm: DataFrame, k: int = 100) -> DataFrame:
    """One string: the ``k`` top feature names, quoted and comma-joined (row 45)."""
    top = top_terms(dfm, k)
    s = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("term").alias("t"))))
    return top.agg(F.concat(F.lit("'"), F.array_join(F.transform(s, lambda x: x["t"]), "','"), F.lit("'")).alias("terms"))


def tfidf_top(dfm: DataFrame, n_docs: DataFrame, k: int = 10) -> DataFrame:
    """``topfeatures(dfm_tfidf(dfm), k)``: count x log10(N / docfreq), summed per term (row 93)."""
    st = term_stats(dfm).crossJoin(F.broadcast(n_docs))
    w = st.select("term", (F.col("total") * F.log10(F.col("_n") / F.col("docfreq"))).alias("weight"))
    return w.orderBy(F.desc("weight"), F.asc("term")).limit(k)


def stopword_table(spark) -> DataFrame:
    """Union of the packaged and the hand-picked stop words, distinct (row 61)."""
    words = sorted(set(SNOWBALL_ENGLISH) | set(CUSTOM_STOPWORDS))
    return spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("term"))  # no Python worker is started for it


def remove_stopwords(dfm: DataFrame) -> DataFrame:
    """Broadcast anti join with the fixed stop-word list (row 95)."""
    return dfm.join(F.broadcast(stopword_table(dfm.sparkSession)), "term", "left_anti")


def dictionary_map(dfm: DataFrame, dictionary: DataFrame, id_col: str = "my_id") -> DataFrame:
    """Replace each feature by its dictionary value (first value by name when a key has several), re-aggregate (row 94).

    The counts are written in blocks (:func:`corpuslab.operators.words.term_blocks`), of which only the distinct terms meet the entries that change a term: these
    are broadcast up to ``BROADCAST_TERMS``, else joined by a shuffle. Rows of an id that lie together are added inside their block; only ids that
    occur in several places are shuffled.
    """
    d = dictionary.where("word is not null").groupBy(F.col("word").alias("_term")).agg(F.min("lemma").alias("_to")).where("_to is not null and _to <> _term")
    d = stage_roundtrip(d, "dictionary-values")
    d = F.broadcast(d) if d.count() <= BROADCAST_TERMS else d
    ids = dfm.schema[id_col].dataType.simpleString()
    rows = dfm.where("term is not null").select(id_col, F.col("term").cast("string").alias("term"), F.col("n").cast("long").alias("n"))
    blocks = stage_roundtrip(rows.mapInArrow(wd.term_blocks(), f"block long, ids array<{ids}>, sizes array<int>, codes array<int>, ns array<long>, vocab array<string>"), "term-blocks")
    met = blocks.select("block", F.posexplode("vocab").alias("code", "_word")).join(d, F.col("_word") == F.col("_term"))
    met = met.groupBy("block").agg(F.collect_list(F.struct("code", F.col("_to").alias("lemma"))).alias("lemmas"))
    mapped = blocks.join(met, "block", "left").mapInArrow(wd.mapped_counts(id_col), f"`{id_col}` {ids}, term string, n long")
    again = blocks.select(F.explode("ids").alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    if again.isEmpty():
        return mapped
    again = stage_roundtrip(again, "ids-of-several-runs")
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    several = mapped.join(again, same, "left_semi").groupBy(id_col, "term").agg(F.sum("n").alias("n"))
    return mapped.join(again, same, "left_anti").unionByName(several)


# ---------------------------------------------------------------------------
# Boolean topic flags from the label DFM (rows 27, 91)
# ---------------------------------------------------------------------------
def flag_features(trimmed: DataFrame, id_col: str = "my_id", keep: int = 9, prefix_len: int = 3) -> DataFrame:
    """The first ``keep`` features in order of first appearance (document order, then position),
    with their column names ``topic_`` + 3-character prefix left-padded with ``_`` (suffix on collision)."""
    # ids are padded but never cut, so (length, id) is their numeric order
    first = trimmed.groupBy("term").agg(F.min(F.struct(F.length(id_col).alias("_width"), F.col(id_col), F.col("pos"))).alias("_first"))
    chosen = first.orderBy("_first").limit(keep)
    w = Window.orderBy("_first")  # at most `keep` rows
    chosen = chosen.withColumn("position", F.row_number().over(w))
    pre = F.substring("term", 1, prefix_len)
    chosen = chosen.withColumn("_base", F.concat(F.lit("topic_"), F.lpad(pre, prefix_len, "_")))
    dup = F.row_number().over(Window.partitionBy("_base").orderBy("position"))
    chosen = chosen.withColumn("_k", dup)
    name = F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("_"), F.col("_k").cast("string")))
    return chosen.select(F.col("position").cast("long").alias("position"), "term", name.alias("flag"))


def topic_flags_by_position(docs: DataFrame, trimmed: DataFrame, id_col: str = "my_id", keep: int = 9, feats: DataFrame | None = None) -> DataFrame:
    """``flag_1 .. flag_<keep>``, one row per document of ``docs``: whether it has the feature of that position."""
    feats = flag_features(trimmed, id_col, keep) if feats is None else feats
    hits = trimmed.join(F.broadcast(feats), "term")  # at most `keep` rows
    wide = hits.groupBy(id_col).agg(*[F.max(F.col("position") == i).alias(f"flag_{i}") for i in range(1, keep + 1)])
    out = docs.select(id_col).join(wide, id_col, "left")
    return out.select(id_col, *[F.coalesce(f"flag_{i}", F.lit(False)).alias(f"flag_{i}") for i in range(1, keep + 1)])


def topic_flags_long(docs: DataFrame, trimmed: DataFrame, id_col: str = "my_id", keep: int = 9) -> DataFrame:
    """``(id, position, flag, present)`` for every document and kept feature."""
    feats = flag_features(trimmed, id_col, keep)
    wide = topic_flags_by_position(docs, trimmed, id_col, keep, feats)
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.col(f"flag_{i}").alias("present")) for i in range(1, keep + 1)])
    cells = wide.select(id_col, F.inline(cells))
    return cells.join(F.broadcast(feats.select("position", "flag")), "position").select(id_col, "position", "flag", "present")


def topic_flags_wide(docs: DataFrame, trimmed: DataFrame, id_col: str = "my_id", keep: int = 9) -> DataFrame:
    """One boolean column per kept feature, one row per document of ``docs`` (rows 27, 91).

    The ``keep`` column names are data: they are read back to the driver (``keep`` short strings).
    """
    feats = flag_features(trimmed, id_col, keep)
    names = {r["position"]: r["flag"] for r in feats.collect()}
    wide = topic_flags_by_position(docs, trimmed, id_col, keep, feats)
    return wide.select(id_col, *[F.col(f"flag_{i}").alias(names[i]) for i in sorted(names)])


# ---------------------------------------------------------------------------
# Corpus processing for the topic model (rows 96-99)
# ---------------------------------------------------------------------------
def process_corpus(corpus: DataFrame, sparselevel: float = 0.9975, id_col: str = "my_id", text_col: str = "lemma_text",
                   min_word_length: int = 3) -> DataFrame:
    """``textProcessor``: custom stop words removed, then only terms in **more than**
    ``N * (1 - sparselevel)`` documents kept; empty documents drop out (row 96).

    ``N`` counts every document handed in, including those without any term.
    """
    n_docs = corpus.agg(F.count(F.lit(1)).alias("_n"))
    d = remove_stopwords(text_dfm(corpus, id_col, text_col)).where(F.length("term") >= min_word_length)
    kept = term_stats(d).crossJoin(F.broadcast(n_docs)).where(F.col("docfreq") > F.lit(1.0 - sparselevel) * F.col("_n"))
    return _keep_terms(d, kept)


def prep_documents(processed: DataFrame, upper_share: float | None = None, upper_thresh: float | None = None,
                   lower_thresh: float = 1, id_col: str = "my_id") -> DataFrame:
    """``prepDocuments``: keep terms with ``lower < docfreq < upper`` and re-index them (row 97).

    ``upper`` is absolute (``upper_thresh``) or a share of the documents. Adds
    ``term_id`` (1-based, alphabetical, as the vocabulary is sorted); emptied
    documents disappear because they have no rows left.
    """
    stats = term_stats(processed, id_col)
    if upper_share is not None:
        n_docs = processed.select(id_col).distinct().agg(F.count(F.lit(1)).alias("_n"))
        stats = stats.crossJoin(F.broadcast(n_docs)).withColumn("_up", F.lit(upper_share) * F.col("_n"))
    else:
        stats = stats.withColumn("_up", F.lit(float("inf") if upper_thresh is None else upper_thresh))
    kept = stage_roundtrip(stats.where((F.col("docfreq") > F.lit(lower_thresh)) & (F.col("docfreq") < F.col("_up"))).select("term", "docfreq"), "kept-terms")
    return join_terms(processed, vocabulary_index(kept).join(kept, "term"))


def vocabulary_index(terms: DataFrame) -> DataFrame:
    """``(term, term_id)`` with 1-based ids in term order, without a single-partition window."""
    from corpuslab.operators.ranking import add_row_number

    return add_row_number(terms.select("term").distinct(), "term", "term_id")


def corpus_documents(prepped: DataFrame, id_col: str = "my_id") -> DataFrame:
    """Per document the ``term_id:n`` pairs in term-id order, as one string (row 98)."""
    pairs = F.array_sort(F.collect_list(F.struct("term_id", "n")))
    return prepped.groupBy(id_col).agg(
        F.array_join(F.transform(pairs, lambda p: F.concat(p["term_id"].cast("string"), F.lit(":"), p["n"].cast("string"))), " ").alias("doc_terms"),
        F.sum("n").alias("n_tokens"),
    )


def corpus_totals(stages: dict[str, DataFrame], id_col: str = "my_id") -> DataFrame:
    """Tokens, terms and documents after each stage (row 99)."""
    out = None
    for name, d in stages.items():
        row = d.agg(
            F.lit(name).alias("stage"),
            F.sum("n").cast("long").alias("n_tokens"),
            F.countDistinct("term").alias("n_terms"),
            F.countDistinct(id_col).alias("n_docs"),
        )
        out = row if out is None else out.unionByName(row)
    return out

