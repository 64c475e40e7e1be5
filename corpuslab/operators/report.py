"""Reports on a topic model: theta ``(doc, topic, p)`` and beta ``(topic, term, p)`` (rows 11, 28, 39, 46-48, 56, 107-113).

Both are long DataFrames. Per-topic rankings use a salted two-stage top-k,
so a topic that holds most documents or terms never lands in one task;
correlations are one aggregate pass over the wide theta (no pair rows);
coherence codes each document's set of top words as a bit mask, so the
co-document counts come from a histogram of masks instead of word pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.explore import five_number_summary
from corpuslab.operators.ranking import cumulative_counts


def topic_name(k: int, width: int = 2, prefix: str = "tm_") -> str:
    return f"{prefix}{k:0{width}d}"


# ---------------------------------------------------------------------------
# Fixed model stand-ins (FIXTURES.md section 4)
# ---------------------------------------------------------------------------
def fixture_theta(embeddings: DataFrame, k: int = 10, scale: float = 4.0, packed: bool = False) -> DataFrame:
    """Softmax of ``k`` sums over the whole embedding (positions modulo ``k``), per row: array functions, no shuffle.

    ``(doc_id, topic, p)``, or with ``packed`` one row a document, ``(doc_id, theta)``.
    """
    def total(t):
        own = F.filter("embedding", lambda x, i: (i % k) == t)
        return F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    w = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: F.exp(F.lit(scale) * total(t)))
    e = embeddings.select(F.col("vec_id").alias("doc_id"), w.alias("_w"))
    e = e.withColumn("_s", F.aggregate("_w", F.lit(0.0), lambda acc, x: acc + x))
    if packed:
        return e.select("doc_id", F.transform("_w", lambda x: x / F.col("_s")).alias("theta"))
    return e.select("doc_id", F.posexplode("_w").alias("_t", "_x"), "_s").select(
        "doc_id", (F.col("_t") + 1).cast("int").alias("topic"), (F.col("_x") / F.col("_s")).alias("p"))


def doc_word_counts(words: DataFrame) -> DataFrame:
    """``(doc_id, word, n)``: partial-aggregated word counts per document."""
    return words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def fixture_beta(doc_words: DataFrame, k: int = 10, min_docs: int = 20, smooth: float = 0.5) -> DataFrame:
    """Smoothed term share by ``doc_id % k + 1`` over terms found in at least ``min_docs`` documents.

    ``doc_words`` is ``(doc_id, word, n)``. One aggregate per word gives its
    document frequency and its count in each of the ``k`` topics; one global
    aggregate gives the topic totals (a ``k``-value row, broadcast); ``stack``
    turns each word row into its ``k`` topic rows.
    """
    topic = ((F.col("doc_id") % k) + 1).cast("int")
    per_term = doc_words.groupBy(F.col("word").alias("term")).agg(
        F.count(F.lit(1)).alias("_df"),
        *[F.sum(F.when(topic == t, F.col("n")).otherwise(0)).cast("double").alias(f"_n{t}") for t in range(1, k + 1)])
    per_term = per_term.where(F.col("_df") >= min_docs)
    tot = per_term.agg(*[F.sum(F.col(f"_n{t}") + smooth).alias(f"_t{t}") for t in range(1, k + 1)],
                       *[F.sum(f"_n{t}").alias(f"_c{t}") for t in range(1, k + 1)])
    items = ", ".join(f"cast({t} as int), (_n{t} + {smooth!r}) / _t{t}, _c{t}" for t in range(1, k + 1))
    long = per_term.crossJoin(F.broadcast(tot)).selectExpr("term", f"stack({k}, {items}) as (topic, p, _c)")
    return long.where(F.col("_c") > 0).select("topic", "term", "p")


# ---------------------------------------------------------------------------
# Ranking helper
# ---------------------------------------------------------------------------
def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, salt_col: str | None = None, salts: int = 64,
                    rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per group by ``order_cols`` (which must make the order total).

    Stage 1 ranks inside (group, salt) buckets and keeps ``k`` per bucket;
    stage 2 ranks the at most ``k x salts`` survivors per group.
    """
    g = list(group_cols)
    salt = F.abs(F.xxhash64(F.col(salt_col))) % salts if salt_col else F.abs(F.xxhash64(*[F.col(c) for c in df.columns])) % salts
    s = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*g, "_salt").orderBy(*order_cols)
    s = s.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*g).orderBy(*order_cols)
    return s.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


# ---------------------------------------------------------------------------
# Theta reports
# ---------------------------------------------------------------------------
def theta_wide(theta: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """``tm_01 .. tm_k`` columns, one row per document (rows 11, 106).

    From packed shares ``(id, theta)`` in the row, without a shuffle; long shares ``(id, topic, p)`` are pivoted.
    """
    if "theta" in theta.columns:
        return theta.select(id_col, *[F.get("theta", F.lit(t - 1)).alias(topic_name(t)) for t in range(1, k + 1)])
    return theta.groupBy(id_col).agg(
        *[F.max(F.when(F.col("topic") == t, F.col("p"))).alias(topic_name(t)) for t in range(1, k + 1)])


def bind_theta(meta: DataFrame, theta: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Metadata joined with the wide theta on the document id, never by position (row 28)."""
    return meta.join(theta_wide(theta, k, id_col), id_col, "inner")


def theta_row_sums(theta: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per-document sum of theta (must be 1) (row 46); of packed shares in the row."""
    if "theta" in theta.columns:
        return theta.select(id_col, F.aggregate("theta", F.lit(0.0), lambda a, x: a + x).alias("row_sum"))
    return theta.groupBy(id_col).agg(F.sum("p").alias("row_sum"))


def topic_prevalence(theta: DataFrame) -> DataFrame:
    """Per-topic mean of theta and its 2-digit rounding, as the script prints it (rows 46, 107)."""
    return theta.groupBy("topic").agg(F.avg("p").alias("prevalence")).withColumn("prevalence_2", F.round("prevalence", 2))


def theta_summary(theta: DataFrame) -> DataFrame:
    """``summary(theta)`` per topic: min, quartiles, mean, max (row 39)."""
    return five_number_summary(theta, "p", ["topic"])


def topic_correlation(theta: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Pearson correlation of the topic columns across documents; diagonal (and any value 1) set to 0 (row 47).

    One aggregate over the wide theta computes every pair; ``stack`` turns the row into ``(topic_a, topic_b, r)``.
    """
    wide = theta_wide(theta, k, id_col)
    pairs = [(a, b) for a in range(1, k + 1) for b in range(a + 1, k + 1)]
    row = wide.agg(*[F.corr(topic_name(a), topic_name(b)).alias(f"c_{a}_{b}") for a, b in pairs])
    items = []
    for a in range(1, k + 1):
        for b in range(1, k + 1):
            if a == b:
                items.append(f"{a}, {b}, cast(0.0 as double)")
            else:
                lo, hi = min(a, b), max(a, b)
                items.append(f"{a}, {b}, c_{lo}_{hi}")
    long = row.selectExpr(f"stack({len(items)}, {', '.join(items)}) as (topic_a, topic_b, r)")
    return long.withColumn("r", F.when(F.col("r") == 1.0, F.lit(0.0)).otherwise(F.col("r")))


def topic_graph(corr: DataFrame, cutoff: float = 0.01) -> DataFrame:
    """Edges between topics whose correlation is above ``cutoff`` (row 113)."""
    return corr.where((F.col("topic_a") < F.col("topic_b")) & (F.col("r") > cutoff))


def theta_histogram(theta: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of theta values per topic in ``bins`` equal-width bins on [0, 1] (row 48)."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return theta.groupBy("topic", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def topic_exemplars(theta: DataFrame, meta: DataFrame, n: int = 3, max_chars: int = 500, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``findThoughts``: the ``n`` documents with the highest share of each topic among those
    shorter than ``max_chars`` characters, with their text (row 56)."""
    short = meta.where(F.length(text_col) < max_chars).select(id_col, text_col)
    cand = theta.join(short.select(id_col), id_col, "left_semi")
    top = top_k_per_group(cand, ["topic"], [F.desc("p"), F.asc(id_col)], n, salt_col=id_col)
    return top.join(short, id_col).select("topic", "rank", id_col, "p", text_col)


# ---------------------------------------------------------------------------
# Beta reports
# ---------------------------------------------------------------------------
def topic_labels(beta: DataFrame, n: int = 7) -> DataFrame:
    """Highest-probability words per topic (row 108)."""
    return top_k_per_group(beta, ["topic"], [F.desc("p"), F.asc("term")], n, salt_col="term").select("topic", "rank", "term", "p")


def topic_lift(beta: DataFrame, doc_words: DataFrame, n: int = 7) -> DataFrame:
    """Label variant: words with the highest lift ``beta_kv / (share of v among all tokens)`` (row 108)."""
    freq = doc_words.groupBy(F.col("word").alias("term")).agg(F.sum("n").alias("_c"))
    total = freq.agg(F.sum("_c").alias("_tot"))
    lift = beta.join(freq, "term").crossJoin(F.broadcast(total)).withColumn("lift", F.col("p") / (F.col("_c") / F.col("_tot")))
    return top_k_per_group(lift, ["topic"], [F.desc("lift"), F.asc("term")], n, salt_col="term").select("topic", "rank", "term", "lift")


def topic_cloud(beta: DataFrame, topic: int, n: int = 100) -> DataFrame:
    """Word-cloud weights: the ``n`` most probable words of one topic (row 110)."""
    return beta.where(F.col("topic") == topic).orderBy(F.desc("p"), F.asc("term")).limit(n).select("term", "p")


def topic_contrast(beta: DataFrame, a: int, b: int, n: int = 10) -> DataFrame:
    """Two-topic perspective: per word ``(p_a - p_b) / (p_a + p_b)``, the ``n`` words leaning most to each side (row 109)."""
    two = beta.where(F.col("topic").isin(a, b)).groupBy("term").agg(
        F.max(F.when(F.col("topic") == a, F.col("p"))).alias("p_a"), F.max(F.when(F.col("topic") == b, F.col("p"))).alias("p_b"))
    two = two.withColumn("contrast", (F.col("p_a") - F.col("p_b")) / (F.col("p_a") + F.col("p_b")))
    side_a = two.orderBy(F.desc("contrast"), F.asc("term")).limit(n).withColumn("side", F.lit(a))
    side_b = two.orderBy(F.asc("contrast"), F.asc("term")).limit(n).withColumn("side", F.lit(b))
    return side_a.unionByName(side_b).select("side", "term", "p_a", "p_b", "contrast")


def _average_rank(df: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """R ``rank`` (ties averaged) of ``value_col`` within each topic, via distributed running counts."""
    hist = df.groupBy("topic", F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cum = cumulative_counts(hist, "_v", "_c", ["topic"])
    r = cum.select("topic", "_v", (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out_col), "_total")
    return df.join(r, (df["topic"] == r["topic"]) & (df[value_col] == r["_v"])).drop(r["topic"]).drop("_v")


def frex_scores(beta: DataFrame, w: float = 0.7, digits: int = 12) -> DataFrame:
    """FREX per (topic, term): weighted harmonic mean of the within-topic rank shares of
    exclusivity ``p / sum_topics p`` and of frequency ``p`` (row 112).

    Both are rounded to ``digits`` before ranking so that ties do not depend on summation order.
    """
    tot = beta.groupBy("term").agg(F.sum("p").alias("_sp"))
    b = beta.join(tot, "term").select("topic", "term", "p",
                                      F.round(F.col("p") / F.col("_sp"), digits).alias("_ex"), F.round("p", digits).alias("_fr"))
    b = _average_rank(b, "_ex", "_rex").drop("_total")
    b = _average_rank(b, "_fr", "_rfr")
    ex, fr = F.col("_rex") / F.col("_total"), F.col("_rfr") / F.col("_total")
    return b.select("topic", "term", "p", (1.0 / (F.lit(w) / ex + F.lit(1 - w) / fr)).alias("frex"))


def topic_exclusivity(beta: DataFrame, m: int = 10, w: float = 0.7) -> DataFrame:
    """Per topic: sum of FREX over its ``m`` most probable words (row 112)."""
    scores = frex_scores(beta, w)
    top = top_k_per_group(scores, ["topic"], [F.desc("p"), F.asc("term")], m, salt_col="term")
    return top.groupBy("topic").agg(F.sum("frex").alias("exclusivity"))


def topic_coherence(beta: DataFrame, doc_terms: DataFrame, m: int = 10, id_col: str = "doc_id", term_col: str = "term") -> DataFrame:
    """Semantic coherence (Mimno et al. 2011) of each topic's ``m`` most probable words (row 111):
    ``sum_{i>j} log((D(w_i, w_j) + 1) / D(w_j))`` with ``D`` counting documents.

    Each document's set of a topic's top words is coded as an ``m``-bit mask;
    ``D`` for a word or a pair is a sum over the (at most ``2^m``) mask counts.
    """
    top = top_k_per_group(beta, ["topic"], [F.desc("p"), F.asc("term")], m, salt_col="term").select(
        "topic", F.col("term").alias(term_col), "rank")
    hits = doc_terms.select(id_col, term_col).join(F.broadcast(top), term_col)  # top: topics x m rows
    # a bitwise or takes a repeated term once, so the terms need no distinct before the join
    masks = hits.groupBy(id_col, "topic").agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(rank - 1 as int))")).alias("mask"))
    hist = masks.groupBy("topic", "mask").agg(F.count(F.lit(1)).alias("c"))
    pairs = [(i, j) for i in range(2, m + 1) for j in range(1, i)]
    bit = lambda r: (F.shiftright(F.col("mask"), r - 1) % 2) == 1
    aggs = []
    for i, j in pairs:
        aggs.append(F.sum(F.when(bit(i) & bit(j), F.col("c")).otherwise(0)).alias(f"d{i}_{j}"))
    for j in range(1, m):
        aggs.append(F.sum(F.when(bit(j), F.col("c")).otherwise(0)).alias(f"d{j}"))
    d = hist.groupBy("topic").agg(*aggs)
    terms = [F.log(F.try_divide(F.col(f"d{i}_{j}") + 1.0, F.col(f"d{j}"))) for i, j in pairs]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return d.select("topic", total.alias("coherence"))


def topic_summary(theta: DataFrame, beta: DataFrame, n_words: int = 3) -> DataFrame:
    """Topic prevalence with its top words, most prevalent first (row 107)."""
    words = topic_labels(beta, n_words)
    joined = words.groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ", ").alias("top_words"))
    return topic_prevalence(theta).join(joined, "topic").select("topic", "prevalence", "top_words")
