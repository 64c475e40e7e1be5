"""Registered queries: one Spark DataFrame builder and (where SQL can say it) one DuckDB oracle per key.

Every builder takes ``(spark, sf_dir)``, reads the driver's tables, and returns
a lazy DataFrame whose column names and types match the oracle's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.plans import sql as S
from corpuslab.plans import stages as st
from corpuslab.session import stage_dir

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# Flagship: the whole cleansing chain (row 87)
# ---------------------------------------------------------------------------
@register("clean_corpus", S.with_base("select my_id, clean_word_text, lemma_text from texts"))
def q_clean_corpus(spark, sf):
    return st.texts_df(spark, sf)


from corpuslab.functions import text as tx  # noqa: E402
from corpuslab.functions.lists import EXCLUDED_LEAD_TYPES, ENTITY_EXCLUSIONS, sql_list  # noqa: E402
from corpuslab.operators import cleanse, explore, features  # noqa: E402
from corpuslab.sources import tables  # noqa: E402

W = S.with_base
ARTICLE_COLS = tables.ARTICLE_COLUMNS + ["doc_id"]
FEATURE_COLS = ARTICLE_COLS + ["top_OK", "my_id", "top_partner", "date_min", "nb_days", "nb_char_text",
                               "nb_topics", "first_author", "post_lead_type2", "top_series"]


def _feat(spark, sf, text=False):
    return st.features_df(spark, sf, text)


# ---------------------------------------------------------------------------
# 2.1 Sources, sinks, catalog (rows 1-6)
# ---------------------------------------------------------------------------
def _written(df, name):
    """Path of a table written for the loaders."""
    path = stage_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


@register("load_articles", W(f"select {', '.join(tables.ARTICLE_COLUMNS)} from articles"))
def q_load_articles(spark, sf):
    return tables.load_articles(spark, _written(st.articles_df(spark, sf).drop("doc_id"), "article-file"))


@register("load_lexicon", W("select word, lemma from lexicon"))
def q_load_lexicon(spark, sf):
    return tables.load_lexicon(spark, _written(cleanse.fixture_lexicon(tables.article_texts(spark, sf)), "lexicon-file"))


@register("stage_roundtrip", W(f"select {', '.join(FEATURE_COLS)} from features"))
def q_stage_roundtrip(spark, sf):
    return tables.stage_roundtrip(_feat(spark, sf, text=True).select(*FEATURE_COLS), "feature_table")


@register("feature_table", W(f"select {', '.join(FEATURE_COLS)} from features"))
def q_feature_table(spark, sf):
    return _feat(spark, sf, text=True).select(*FEATURE_COLS)


@register("list_columns", W(" union all ".join(
    f"select cast({i + 1} as bigint) as position, '{c}' as column_name, count({c}) as n_non_null from articles"
    for i, c in enumerate(ARTICLE_COLS))))
def q_list_columns(spark, sf):
    return tables.list_columns(st.articles_df(spark, sf).select(*ARTICLE_COLS))


@register("preview_truncated", W(
    "select " + ", ".join(f"substring(cast({c} as varchar), 1, 200) as {c}" for c in ARTICLE_COLS)
    + " from articles order by url limit 10"))
def q_preview(spark, sf):
    return tables.preview_truncated(st.articles_df(spark, sf).select(*ARTICLE_COLS), 10, 200, "url")


CARD_SQL = """
select 'articles' as stage, count(*) as n_rows, count(distinct url) + max(case when url is null then 1 else 0 end) as n_unique from articles
union all select 'authors', count(*), count(distinct author) + max(case when author is null then 1 else 0 end) from articles
union all select 'tokens', count(*), count(distinct word) from tokwords
union all select 'words', count(*), count(distinct word) from words
union all select 'lemmatised', count(*), count(distinct word) from joined1 where length(lemma) > 3
union all select 'lemmatised_grown', count(*), count(distinct word) from joined2 where length(lemma) > 3
"""


@register("cardinality_audit", W(CARD_SQL))
def q_cardinality(spark, sf):
    def card(df, stage, col):
        return df.agg(
            F.lit(stage).alias("stage"),
            F.count(F.lit(1)).alias("n_rows"),
            (F.countDistinct(col) + F.max(F.col(col).isNull().cast("long"))).cast("long").alias("n_unique"),
        )

    c = st.run(spark, sf)
    toks = cleanse.add_words(cleanse.tokenise(c.scoped))
    counts = st.stage(toks.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    parts = [card(c.articles, "articles", "url"), card(c.articles, "authors", "author"),
             cleanse.token_audit(counts, c.lex, S.TOP_GROWTH)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# 2.2 Projection, column update, filter, predicates (rows 7-19)
# ---------------------------------------------------------------------------
@register("project_text", W("select my_id, text from scoped"))
def q_project_text(spark, sf):
    return cleanse.project_text(st.scoped_df(spark, sf))


@register("add_column", W("select my_id, author, top_partner, nb_char_text, nb_topics from features"))
def q_add_column(spark, sf):
    return _feat(spark, sf).select("my_id", "author", "top_partner", "nb_char_text", "nb_topics")


@register("conditional_update", W("select my_id, top_OK, date_min, nb_days from feat2"))
def q_conditional_update(spark, sf):
    return st.features_first_scope_df(spark, sf).select("my_id", "top_OK", "date_min", "nb_days")


@register("drop_columns", W('select my_id, "order", token, word from joined1'))
def q_drop_columns(spark, sf):
    return st.joined1_df(spark, sf, tokens=True).drop("lemma").select("my_id", "order", "token", "word")


@register("scope_filter", W("select my_id, url from features where top_OK"))
def q_scope_filter(spark, sf):
    return _feat(spark, sf).where(F.col("top_OK")).select("my_id", "url")


@register("filter_complement", W(
    "select f.my_id from feat3 f left join len_pr p on f.my_id = p.my_id "
    "where not coalesce(length(f.text) > 200 and p.pr < 0.95, false)"))
def q_filter_complement(spark, sf):
    t = features.add_length_percent_rank(st.features_first_scope_df(spark, sf), "_pr")
    rule = tx.null_false((F.col("nb_char_text") > 200) & (F.col("_pr") < 0.95))
    return t.where(~rule).select("my_id")


@register("filter_null_lemma", W('select my_id, "order", word from joined1 where lemma is null'))
def q_filter_null_lemma(spark, sf):
    return cleanse.oov_words(st.joined1_df(spark, sf)).select("my_id", "order", "word")


@register("in_list", W(
    "select a.url, a.channel, c.n is not null as channel_ok from articles a "
    "left join chan_freq c on a.channel is not distinct from c.channel"))
def q_in_list(spark, sf):
    a = st.articles_df(spark, sf)
    chans = features.frequent_values(a, "channel", None, S.CHANNEL_SHARE)
    # at most 1 / share channels can hold that share of the rows
    return features.in_list(a, "channel", chans, "channel", "channel_ok", bounded=True).select("url", "channel", "channel_ok")


@register("not_in_list", W(
    f"select url, post_lead_type from articles where post_lead_type is not null "
    f"and post_lead_type not in ({sql_list(EXCLUDED_LEAD_TYPES)})"))
def q_not_in_list(spark, sf):
    a = st.articles_df(spark, sf)
    excluded = spark.createDataFrame([(v,) for v in (*EXCLUDED_LEAD_TYPES, None)], "v string")
    return features.not_in_list(a, "post_lead_type", excluded, "v").select("url", "post_lead_type")


@register("scope_flag", W("select url, top_OK from scoped0"))
def q_scope_flag(spark, sf):
    return features.add_scope_flag(st.articles_df(spark, sf), st.SCOPE).select("url", "top_OK")


@register("scope_flag_tight", W("select my_id, top_OK from features"))
def q_scope_flag_tight(spark, sf):
    return _feat(spark, sf).select("my_id", "top_OK")


@register("lead_type_class", W("select url, post_lead_type, post_lead_type2 from feat2"))
def q_lead_type_class(spark, sf):
    return features.add_lead_type_class(st.articles_df(spark, sf)).select("url", "post_lead_type", "post_lead_type2")


# ---------------------------------------------------------------------------
# 2.3 Joins (rows 20-29)
# ---------------------------------------------------------------------------
@register("lemma_left_join", W('select my_id, "order", word, lemma from joined1'))
def q_lemma_left_join(spark, sf):
    return st.joined1_df(spark, sf).select("my_id", "order", "word", "lemma")


@register("lemma_rejoin", W('select my_id, "order", word, lemma from joined2'))
def q_lemma_rejoin(spark, sf):
    return st.joined2_df(spark, sf).select("my_id", "order", "word", "lemma")


@register("join_doc_texts", W("select my_id, clean_word_text, lemma_text from texts"))
def q_join_doc_texts(spark, sf):
    return cleanse.collapse_texts(st.joined2_df(spark, sf))  # both texts from one aggregate: the chain runs once, nothing is joined


@register("attach_doc_texts", W(
    "select s.my_id, s.url, s.top_city, t.clean_word_text, t.lemma_text from scoped s left join texts t on s.my_id = t.my_id"))
def q_attach_doc_texts(spark, sf):
    return st.run(spark, sf).attached().select("my_id", "url", "top_city", "clean_word_text", "lemma_text")


@register("top_series", W("select my_id, title, top_series from features"))
def q_top_series(spark, sf):
    return _feat(spark, sf).select("my_id", "title", "top_series")


@register("semi_by_id", W(
    "select f.my_id from feat3 f where f.my_id in (select p.my_id from len_pr p join feat3 g on p.my_id = g.my_id "
    "where length(g.text) > 200 and p.pr < 0.95)"))
def q_semi_by_id(spark, sf):
    t = st.features_first_scope_df(spark, sf)
    kept = features.add_length_percent_rank(t, "_pr").where((F.col("nb_char_text") > 200) & (F.col("_pr") < 0.95))
    return t.join(kept.select("my_id"), "my_id", "left_semi").select("my_id")


@register("oov_tokens", W('select w.my_id, w."order", w.word from words w anti join lexicon x on w.word = x.word'))
def q_oov_tokens(spark, sf):
    c = st.run(spark, sf)
    return c.words.join(c.lex, "word", "left_anti").select("my_id", "order", "word")


@register("days_since_first", W("select my_id, date, date_min, nb_days from feat2"))
def q_days_since_first(spark, sf):
    return st.features_first_scope_df(spark, sf).select("my_id", "date", "date_min", "nb_days")


# ---------------------------------------------------------------------------
# 2.4 Aggregations (rows 30-42)
# ---------------------------------------------------------------------------
def _count_query(name: str, source: str, keys: tuple[str, ...], builder):
    cols = ", ".join(keys)
    register(name, W(f"select {cols}, count(*) as n from {source} group by {cols}"))(
        lambda spark, sf: explore.group_count(builder(spark, sf), *keys)
    )


for _k in ("channel", "author", "post_lead_type", "geo", "sourced_from", "content_type", "shares", "date",
           "topics", "title"):
    _count_query(f"count_by_{_k}" if _k != "post_lead_type" else "count_by_lead_type", "articles", (_k,),
                 lambda spark, sf: st.articles_df(spark, sf))
_count_query("count_by_top_ok", "features", ("top_OK",), _feat)
_count_query("count_by_top_series", "features", ("top_series",), _feat)
_count_query("count_by_top_city", "scoped", ("top_city",), lambda spark, sf: st.scoped_df(spark, sf))
_count_query("count_by_two_keys", "articles", ("topics", "author"), lambda spark, sf: st.articles_df(spark, sf))
_count_query("count_by_title_author", "articles", ("title", "author"), lambda spark, sf: st.articles_df(spark, sf))
_count_query("count_by_class_channel", "features", ("post_lead_type2", "channel"), _feat)


@register("count_by_month", W(
    "select concat(substring(date, 7, 5), substring(date, 1, 2)) as month, count(*) as n from articles group by 1"))
def q_count_by_month(spark, sf):
    return explore.count_by_month(st.articles_df(spark, sf))


@register("series_groups", W(
    "select title, author, count(*) as n from articles group by title, author having count(*) > 2"))
def q_series_groups(spark, sf):
    return features.series_groups(st.articles_df(spark, sf), 2)


@register("frequent_channels", W("select channel, n from chan_freq"))
def q_frequent_channels(spark, sf):
    return features.frequent_values(st.articles_df(spark, sf), "channel", None, S.CHANNEL_SHARE)


@register("distinct_lead_types", W("select distinct post_lead_type from articles"))
def q_distinct_lead_types(spark, sf):
    return st.articles_df(spark, sf).select("post_lead_type").distinct()


DUPS = "dups AS (select * from articles union all select * from articles where doc_id % 50 = 0)"


@register("dedupe_by_url", W(
    f"select {', '.join(ARTICLE_COLS)} from dups qualify row_number() over (partition by url order by doc_id) = 1", DUPS))
def q_dedupe_by_url(spark, sf):
    return features.dedupe_by_key(tables.articles_with_duplicates(spark, sf), "url").select(*ARTICLE_COLS)


@register("min_date", W("select date_min_lexicographic, date_min_chronological from dmin"))
def q_min_date(spark, sf):
    t = st.features_first_scope_df(spark, sf)  # de-duplicated without its texts
    return features.min_date(t).select("date_min_lexicographic", "date_min_chronological")


def _summary_sql(src: str, col: str) -> str:
    return (f"select min({col})::double as min, quantile_cont({col}, 0.25)::double as q1, "
            f"quantile_cont({col}, 0.5)::double as median, avg({col})::double as mean, "
            f"quantile_cont({col}, 0.75)::double as q3, max({col})::double as max, count({col}) as n from {src}")


@register("shares_summary", W(_summary_sql("articles", "shares")))
def q_shares_summary(spark, sf):
    return explore.five_number_summary(st.articles_df(spark, sf), "shares").select(
        "min", "q1", "median", "mean", "q3", "max", "n")


@register("length_mean_median", W(
    "select avg(nb_char_text)::double as mean, quantile_cont(nb_char_text, 0.5)::double as median from feat2 where top_OK"))
def q_length_mean_median(spark, sf):
    t = st.features_first_scope_df(spark, sf).where(F.col("top_OK"))
    return explore.mean_median(t, "nb_char_text")


def _fivenum_sql(src: str, col: str, label: str) -> str:
    return f"""(with x as (select cast({col} as double) as v from {src} where {col} is not null),
  o as (select v, row_number() over (order by v) as r, count(*) over () as n from x),
  d as (select n, floor((n + 3) / 2) / 2 as n4 from o limit 1),
  pos as (select 0 as i, 1.0 as p from d union all select 1, n4 from d union all select 2, (n + 1) / 2 from d
          union all select 3, n + 1 - n4 from d union all select 4, n from d),
  f as (select pos.i, 0.5 * (a.v + b.v) as fv from pos join o a on a.r = floor(pos.p) join o b on b.r = ceil(pos.p)),
  h as (select max(case when i = 1 then fv end) as lower_hinge, max(case when i = 2 then fv end) as median,
        max(case when i = 3 then fv end) as upper_hinge from f)
  select '{label}' as variable,
    min(case when v >= lower_hinge - 1.5 * (upper_hinge - lower_hinge) and v <= upper_hinge + 1.5 * (upper_hinge - lower_hinge) then v end) as ymin,
    lower_hinge, median, upper_hinge,
    max(case when v >= lower_hinge - 1.5 * (upper_hinge - lower_hinge) and v <= upper_hinge + 1.5 * (upper_hinge - lower_hinge) then v end) as ymax,
    count(*) as n,
    sum(case when v >= lower_hinge - 1.5 * (upper_hinge - lower_hinge) and v <= upper_hinge + 1.5 * (upper_hinge - lower_hinge) then 0 else 1 end)::bigint as n_out
  from x cross join h group by lower_hinge, median, upper_hinge)"""


@register("boxplot_stats", W(
    "select * from " + _fivenum_sql("articles", "shares", "shares") + " union all select * from "
    + _fivenum_sql("features", "nb_char_text", "nb_char_text")))
def q_boxplot_stats(spark, sf):
    a = explore.boxplot_stats(st.articles_df(spark, sf), "shares").select(F.lit("shares").alias("variable"), "*")
    b = explore.boxplot_stats(_feat(spark, sf), "nb_char_text").select(F.lit("nb_char_text").alias("variable"), "*")
    return a.unionByName(b)


def _kde_sql(src: str, col: str) -> str:
    return f"""with x as (select cast({col} as double) as v from {src} where {col} is not null),
  s as (select count(*) as n, stddev_samp(v) as sd, min(v) as mn, max(v) as mx,
        quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from x),
  b as (select n, 0.9 * (case when least(sd, (q3 - q1) / 1.34) > 0 then least(sd, (q3 - q1) / 1.34)
          when sd > 0 then sd else 1.0 end) * pow(cast(n as double), -0.2) as bw, mn, mx from s),
  g as (select n, bw, mn - 3 * bw as lo, (mx + 3 * bw - (mn - 3 * bw)) / 511 as step, mn - 7 * bw as low, (mx + 7 * bw - (mn - 7 * bw)) / 511 as delta from b),
  near as (select floor((v - low) / delta)::bigint as j, (v - low) / delta - floor((v - low) / delta) as f from x cross join g),
  mass as (select j, sum(m) as m from (select j, 1 - f as m from near union all select j + 1, f from near) group by j),
  rough as (select i as k, sum(m * exp(-0.5 * pow((i - j) * delta / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) as y
        from range(512) t(i) cross join g cross join mass group by i),
  points as (select i, lo + i * step as px, (lo + i * step - low) / delta as p from range(512) t(i) cross join g)
select cast(i as bigint) as i, round(px, 4) as x, round(r.y * (1 - (p - floor(p))) + q.y * (p - floor(p)), 12) as density
from points join rough r on r.k = floor(p) join rough q on q.k = floor(p) + 1"""


def _exact_kde_sql(src: str, col: str) -> str:
    """The same density as the sum of every value's kernel, without bins."""
    return f"""with x as (select cast({col} as double) as v from {src} where {col} is not null),
  s as (select count(*) as n, stddev_samp(v) as sd, min(v) as mn, max(v) as mx,
        quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from x),
  b as (select n, 0.9 * (case when least(sd, (q3 - q1) / 1.34) > 0 then least(sd, (q3 - q1) / 1.34)
          when sd > 0 then sd else 1.0 end) * pow(cast(n as double), -0.2) as bw, mn, mx from s),
  g as (select n, bw, mn - 3 * bw as lo, (mx + 3 * bw - (mn - 3 * bw)) / 511 as step from b),
  h as (select v, count(*) as c from x group by v),
  grid as (select cast(i as bigint) as i, lo + i * step as gx, n, bw from g cross join range(512) t(i))
select grid.i, round(grid.gx, 4) as x,
  round(sum(h.c * exp(-0.5 * ((grid.gx - h.v) / grid.bw) * ((grid.gx - h.v) / grid.bw)))
        / (grid.n * grid.bw * sqrt(2 * pi())), 12) as density
from grid cross join h group by grid.i, grid.gx, grid.n, grid.bw"""


def _kde_spark(df, col, density=explore.kernel_density):
    k = density(df, col)
    return k.select("i", F.round("x", 4).alias("x"), F.round("density", 12).alias("density"))


register("density_shares", _kde_sql("(select * from articles)", "shares").replace("with x as", "with " + S.ARTICLES + ", x as", 1))(
    lambda spark, sf: _kde_spark(st.articles_df(spark, sf), "shares"))


@register("shares_digits", W("select url, length(cast(shares as varchar)) as shares_digits from articles"))
def q_shares_digits(spark, sf):
    return st.articles_df(spark, sf).select("url", tx.digit_count("shares").alias("shares_digits"))


# ---------------------------------------------------------------------------
# 2.5 Window functions (rows 49-51)
# ---------------------------------------------------------------------------
@register("row_ids", W("select url, my_id from feat1"))
def q_row_ids(spark, sf):
    a = features.dedupe_by_key(st.articles_df(spark, sf), "url")
    return features.add_row_ids(a, "url", "my_id", 5).select("url", "my_id")


@register("token_order", W('select my_id, "order", token from tokens'))
def q_token_order(spark, sf):
    return cleanse.tokenise(st.scoped_df(spark, sf))


@register("length_percent_rank", W(
    "select f.my_id, round(p.pr, 6) as length_pr from feat3 f left join len_pr p on f.my_id = p.my_id"))
def q_length_percent_rank(spark, sf):
    t = features.add_length_percent_rank(st.features_first_scope_df(spark, sf), "length_pr")
    return t.select("my_id", F.round("length_pr", 6).alias("length_pr"))


# ---------------------------------------------------------------------------
# 2.7 Set operations (rows 58-61)
# ---------------------------------------------------------------------------
@register("extend_lexicon", W("select word, lemma from lexicon2"))
def q_extend_lexicon(spark, sf):
    return st.grown_lexicon_df(spark, sf)


@register("kept_lead_types", W(
    f"select distinct post_lead_type from articles where post_lead_type is not null "
    f"and post_lead_type not in ({sql_list(EXCLUDED_LEAD_TYPES)})"))
def q_kept_lead_types(spark, sf):
    return features.kept_lead_types(st.articles_df(spark, sf))


@register("lexicon_exclusions", W(f"select word, n from growth where word not in ({sql_list(ENTITY_EXCLUSIONS)})"))
def q_lexicon_exclusions(spark, sf):
    return cleanse.lexicon_exclusions(st.growth_df(spark, sf))


# ---------------------------------------------------------------------------
# 2.8 Scalar functions (rows 62-76)
# ---------------------------------------------------------------------------
@register("author_lower", W("select url, author from feat1"))
def q_author_lower(spark, sf):
    return st.articles_df(spark, sf).select("url", F.lower("author").alias("author"))


@register("text_length", W("select my_id, nb_char_text from features"))
def q_text_length(spark, sf):
    return _feat(spark, sf).select("my_id", "nb_char_text")


@register("has_coauthor", W("select my_id, author, top_partner from features"))
def q_has_coauthor(spark, sf):
    return _feat(spark, sf).select("my_id", "author", "top_partner")


@register("first_author", W("select my_id, author, first_author from features"))
def q_first_author(spark, sf):
    return _feat(spark, sf).select("my_id", "author", "first_author")


@register("topic_count", W("select url, nb_topics from feat2"))
def q_topic_count(spark, sf):
    return st.articles_df(spark, sf).select("url", tx.topic_count("topics").alias("nb_topics"))


@register("parse_date", W("select url, date, cast(try_strptime(date, '%m/%d/%Y') as date) as day from articles"))
def q_parse_date(spark, sf):
    return st.articles_df(spark, sf).select("url", "date", tx.parse_date("date").alias("day"))


@register("dateline_flag", W("select my_id, top_city from scoped"))
def q_dateline_flag(spark, sf):
    return st.scoped_df(spark, sf).select("my_id", "top_city")


@register("dateline_strip", W("select my_id, text from scoped"))
def q_dateline_strip(spark, sf):
    return st.scoped_df(spark, sf).select("my_id", "text")


# ---------------------------------------------------------------------------
# 2.9 Text cleansing (rows 77-86)
# ---------------------------------------------------------------------------
@register("normalise_ws", W("select my_id, translate(text, chr(10) || chr(9) || chr(13), '   ') as text from scoped"))
def q_normalise_ws(spark, sf):
    return st.scoped_df(spark, sf).select("my_id", tx.normalise_ws("text").alias("text"))


@register("tokenise", W('select my_id, "order", token from tokens'))
def q_tokenise(spark, sf):
    return cleanse.tokenise(st.scoped_df(spark, sf))


def _token_step(name: str, sql_expr: str, col_fn):
    register(name, W(f'select my_id, "order", {sql_expr} as x from tokens'))(
        lambda spark, sf: cleanse.tokenise(st.scoped_df(spark, sf)).select("my_id", "order", col_fn("token").alias("x"))
    )


_token_step("strip_urls", f"regexp_replace(token, {S.URL}, ' ', 'g')", tx.strip_urls)
_token_step("strip_emails", f"regexp_replace(token, {S.EMAIL}, ' ', 'g')", tx.strip_emails)
_token_step("strip_punct", r"regexp_replace(token, '[!-/:-@\[-`{-~]', ' ', 'g')", tx.strip_punct)
_token_step("strip_codepoints", r"regexp_replace(token, '^(.*?)<U\+\w+>', '\1 ')", tx.strip_codepoints)
_token_step("letters_only", "lower(regexp_replace(token, '[^a-zA-Z]', '', 'g'))", tx.letters_only)


@register("drop_short_words", W('select my_id, "order", word from words'))
def q_drop_short_words(spark, sf):
    return st.words_df(spark, sf).select("my_id", "order", "word")


@register("drop_short_lemmas", W('select my_id, "order", word, lemma from joined2 where length(lemma) > 3'))
def q_drop_short_lemmas(spark, sf):
    return cleanse.drop_short(st.joined2_df(spark, sf), "lemma").select("my_id", "order", "word", "lemma")


@register("augment_lexicon", W("select word, n from growth"))
def q_augment_lexicon(spark, sf):
    return st.growth_df(spark, sf)


@register("clean_word_text", W("select my_id, clean_word_text from texts"))
def q_clean_word_text(spark, sf):
    return cleanse.ordered_text(st.joined2_df(spark, sf), "my_id", "order", "word", "clean_word_text")


@register("lemma_text", W("select my_id, lemma_text from texts where lemma_text is not null"))
def q_lemma_text(spark, sf):
    return cleanse.ordered_text(cleanse.drop_short(st.joined2_df(spark, sf), "lemma"), "my_id", "order", "lemma", "lemma_text")


# ---------------------------------------------------------------------------
# 2.10 Document-feature matrices (rows 45, 55, 61, 88-99)
# ---------------------------------------------------------------------------
from corpuslab.operators import dfm  # noqa: E402


def _dbl(x: float) -> str:
    """A Python double as a DuckDB double literal (same rounding as the Spark side)."""
    return f"cast('{x!r}' as double)"


LABEL_N = "(select count(*) from features)"
DFM_CTES = rf"""
label_toks AS (
  select my_id, unnest(l) as term, generate_subscripts(l, 1) - 1 as pos
  from (select my_id, regexp_split_to_array(lower(topics), '[,\s]+') as l from features)
),
label_dfm AS (
  select my_id, term, count(*) as n, min(pos) as pos from label_toks
  where term <> '' and term not in ('uncategorized', ',') group by my_id, term
),
label_stats AS (select term, cast(sum(n) as bigint) as total, count(*) as docfreq from label_dfm group by term),
label_sparse AS (
  select d.* from label_dfm d join label_stats s on d.term = s.term
  where s.docfreq >= {_dbl(1 - S.LABEL_SPARSITY)} * {LABEL_N}
),
first_seen AS (
  select term, my_id, pos from (select term, my_id, pos, row_number() over (partition by term order by cast(my_id as bigint), pos) as r
  from label_sparse) where r = 1
),
flag_feats0 AS (
  select term, row_number() over (order by cast(my_id as bigint), pos) as position
  from (select * from first_seen order by cast(my_id as bigint), pos limit 9)
),
flag_feats AS (
  select cast(position as bigint) as position, term,
    case when k = 1 then base else base || '_' || cast(k as varchar) end as flag
  from (select *, row_number() over (partition by base order by position) as k
        from (select *, 'topic_' || lpad(substring(term, 1, 3), 3, '_') as base from flag_feats0))
),
flag_grid AS (
  select f.my_id, ff.position, ff.flag, exists (select 1 from label_sparse s where s.my_id = f.my_id and s.term = ff.term) as present
  from features f cross join flag_feats ff
),
lemma_dfm AS (
  select my_id, term, count(*) as n from (
    select my_id, unnest(list_filter(string_split(lemma_text, ' '), lambda x: x <> '')) as term from texts
    where lemma_text is not null) group by my_id, term
),
processed AS (
  select d.* from lemma_dfm d where d.term not in (select term from stopwords) and length(d.term) >= 3
    and d.term in (select term from lemma_dfm where term not in (select term from stopwords) group by term
                   having count(*) > {_dbl(1 - S.CORPUS_SPARSITY)} * (select count(*) from scoped))
),
prep_vocab AS (
  select term, cast(row_number() over (order by term) as bigint) as term_id from (
    select term from processed group by term
    having count(*) > 1 and count(*) < {_dbl(S.CORPUS_UPPER_SHARE)} * (select count(distinct my_id) from processed))
),
prepped AS (select p.*, v.term_id from processed p join prep_vocab v on p.term = v.term)"""


def WD(body: str, *extra: str) -> str:
    return S.with_base(body, DFM_CTES, *extra)


def _labels(spark, sf):
    """The label column of the feature table, written once: the label queries read it several times."""
    return st.stage(_feat(spark, sf).select("my_id", "topics"), "labels")


def _n(df):
    return df.agg(F.count(F.lit(1)).alias("_n"))


def _label_dfm(spark, sf, labels=None):
    return dfm.label_dfm(_feat(spark, sf) if labels is None else labels)


def _label_sparse(spark, sf, labels=None):
    labels = _labels(spark, sf) if labels is None else labels
    return dfm.trim_sparsity(dfm.label_dfm(labels), S.LABEL_SPARSITY, _n(labels))


@register("label_dfm", WD("select my_id, term, n from label_dfm"))
def q_label_dfm(spark, sf):
    return _label_dfm(spark, sf).select("my_id", "term", "n")


@register("top_terms", WD("select term, cast(sum(n) as bigint) as n from label_dfm group by term order by n desc, term limit 10"))
def q_top_terms(spark, sf):
    return dfm.top_terms(_label_dfm(spark, sf), 10)


@register("trim_termfreq", WD(
    f"select d.my_id, d.term, d.n from label_dfm d join label_stats s on d.term = s.term "
    f"where s.total >= {_dbl(S.LABEL_MIN_TERMFREQ_SHARE)} * {LABEL_N}"))
def q_trim_termfreq(spark, sf):
    labels = _labels(spark, sf)
    n = labels.count()  # scalar threshold from the row count
    return dfm.trim_termfreq(_label_dfm(spark, sf, labels), S.LABEL_MIN_TERMFREQ_SHARE * n).select("my_id", "term", "n")


@register("trim_docfreq", WD(
    f"select d.my_id, d.term, d.n from label_dfm d join label_stats s on d.term = s.term "
    f"where s.docfreq >= {_dbl(S.LABEL_MIN_DOCFREQ_SHARE)} * {LABEL_N}"))
def q_trim_docfreq(spark, sf):
    labels = _labels(spark, sf)
    n = labels.count()
    return dfm.trim_docfreq(_label_dfm(spark, sf, labels), S.LABEL_MIN_DOCFREQ_SHARE * n).select("my_id", "term", "n")


@register("trim_sparsity", WD("select my_id, term, n from label_sparse"))
def q_trim_sparsity(spark, sf):
    return _label_sparse(spark, sf).select("my_id", "term", "n")


@register("topic_flag_features", WD("select position, term, flag from flag_feats"))
def q_topic_flag_features(spark, sf):
    return dfm.flag_features(_label_sparse(spark, sf))


FLAGS_SQL = ", ".join(f"coalesce(bool_or(g.present and g.position = {i}), false) as flag_{i}" for i in range(1, 10))


@register("topic_flag_grid", WD("select my_id, position, flag, present from flag_grid"))
def q_topic_flag_grid(spark, sf):
    labels = _labels(spark, sf)
    return dfm.topic_flags_long(labels, _label_sparse(spark, sf, labels))


@register("topic_flags", WD(f"select f.my_id, {FLAGS_SQL} from features f left join flag_grid g on f.my_id = g.my_id group by f.my_id"))
def q_topic_flags(spark, sf):
    labels = _labels(spark, sf)
    return dfm.topic_flags_by_position(labels, _label_sparse(spark, sf, labels))


@register("bind_topic_flags", WD(
    f"select f.my_id, f.url, f.top_OK, {FLAGS_SQL} from features f left join flag_grid g on f.my_id = g.my_id group by f.my_id, f.url, f.top_OK"))
def q_bind_topic_flags(spark, sf):
    feats = st.stage(_feat(spark, sf).select("my_id", "url", "top_OK", "topics"), "label-features")
    flags = dfm.topic_flags_by_position(feats, _label_sparse(spark, sf, feats))
    return feats.select("my_id", "url", "top_OK").join(flags, "my_id")


FLAG_COLS = [f"flag_{i}" for i in range(1, 10)]
ARTICLE_TABLE_COLS = FEATURE_COLS + FLAG_COLS + ["top_city", "clean_word_text", "lemma_text"]


def _article_table(c: st.Corpus, corpus=None):
    """The finished table of a run: scoped articles with all derived columns, the topic flags and both texts."""
    labels = c.features.select("my_id", "topics")
    flags = dfm.topic_flags_by_position(labels, _label_sparse(c.spark, c.sf_dir, labels))
    return (c.attached() if corpus is None else corpus).join(flags, "my_id").select(*ARTICLE_TABLE_COLS)


@register("article_table", WD(
    f"select {', '.join('s.' + x for x in FEATURE_COLS)}, {', '.join('coalesce(f.' + x + ', false) as ' + x for x in FLAG_COLS)}, "
    f"s.top_city, t.clean_word_text, t.lemma_text from scoped s left join texts t on s.my_id = t.my_id "
    f"left join (select g.my_id, {FLAGS_SQL} from flag_grid g group by g.my_id) f on s.my_id = f.my_id"))
def q_article_table(spark, sf):
    """The table that ends the flow: 12 metadata, 11 derived, 9 flag columns, dateline flag, both texts (and doc_id)."""
    return _article_table(st.run(spark, sf))


@register("tfidf_top", WD(
    f"select term, round(weight, 4) as weight from (select term, total * log10(cast({LABEL_N} as double) / docfreq) as weight "
    f"from label_stats order by weight desc, term limit 10)"))
def q_tfidf_top(spark, sf):
    labels = _labels(spark, sf)
    return dfm.tfidf_top(_label_dfm(spark, sf, labels), _n(labels), 10).select("term", F.round("weight", 4).alias("weight"))


def _lemma_dfm(spark, sf):
    return dfm.text_dfm(st.texts_df(spark, sf), "my_id", "lemma_text")


@register("text_dfm", WD("select my_id, term, n from lemma_dfm"))
def q_text_dfm(spark, sf):
    return _lemma_dfm(spark, sf)


@register("top_terms_list", WD(
    "select '''' || string_agg(term, ''',''' order by n desc, term) || '''' as terms from "
    "(select term, sum(n) as n from lemma_dfm group by term order by n desc, term limit 100)"))
def q_top_terms_list(spark, sf):
    return dfm.top_terms_list(_lemma_dfm(spark, sf), 100)


NGRAM_CTE = """
ng_lists AS (select my_id, list_filter(string_split(lemma_text, ' '), lambda x: x <> '') as l from texts where lemma_text is not null),
ng_all AS (
  select my_id, unnest(l) as term from ng_lists
  union all select my_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || '_' || l[i + 1])) from ng_lists where len(l) >= 2
  union all select my_id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || '_' || l[i + 1] || '_' || l[i + 2])) from ng_lists where len(l) >= 3
)"""


@register("ngrams", WD("select my_id, term, count(*) as n from ng_all group by my_id, term", NGRAM_CTE))
def q_ngrams(spark, sf):
    return dfm.text_dfm(st.texts_df(spark, sf), "my_id", "lemma_text", ngrams=(1, 2, 3))


@register("remove_stopwords", WD("select my_id, term, n from lemma_dfm where term not in (select term from stopwords)"))
def q_remove_stopwords(spark, sf):
    return dfm.remove_stopwords(_lemma_dfm(spark, sf)).select("my_id", "term", "n")


@register("stopword_union", WD(
    "select s.term, cast(coalesce(sum(d.n), 0) as bigint) as n from stopwords s left join lemma_dfm d on s.term = d.term group by s.term"))
def q_stopword_union(spark, sf):
    stop = dfm.stopword_table(spark)
    counts = _lemma_dfm(spark, sf).groupBy("term").agg(F.sum("n").alias("n"))
    return stop.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("dictionary_map", WD(
    "select my_id, coalesce(x.lemma, d.term) as term, cast(sum(d.n) as bigint) as n from "
    "(select my_id, term, count(*) as n from (select my_id, unnest(string_split(clean_word_text, ' ')) as term from texts) group by 1, 2) d "
    "left join (select word, min(lemma) as lemma from lexicon2 group by word) x on d.term = x.word group by 1, 2"))
def q_dictionary_map(spark, sf):
    c = st.run(spark, sf)
    c.chain.write_growth()  # for the texts and for the map
    words = dfm.text_dfm(c.chain.texts().select("my_id", "clean_word_text"), "my_id", "clean_word_text")
    return dfm.dictionary_map(words, c.grown_lexicon()).select("my_id", "term", F.col("n").cast("long").alias("n"))


def _processed(spark, sf):
    return st.processed_df(spark, sf)


def _prepped(spark, sf):
    return st.prepped_df(spark, sf)


@register("process_corpus", WD("select my_id, term, n from processed"))
def q_process_corpus(spark, sf):
    return _processed(spark, sf).select("my_id", "term", "n")


@register("prep_documents", WD("select my_id, term, term_id, n from prepped"))
def q_prep_documents(spark, sf):
    return _prepped(spark, sf).select("my_id", "term", F.col("term_id").cast("long").alias("term_id"), "n")


@register("corpus_triple", WD(
    "select my_id, string_agg(cast(term_id as varchar) || ':' || cast(n as varchar), ' ' order by term_id) as doc_terms, "
    "cast(sum(n) as bigint) as n_tokens from prepped group by my_id"))
def q_corpus_triple(spark, sf):
    return dfm.corpus_documents(_prepped(spark, sf)).select("my_id", "doc_terms", F.col("n_tokens").cast("long").alias("n_tokens"))


@register("corpus_vocab", WD("select term_id, term from prep_vocab"))
def q_corpus_vocab(spark, sf):
    return _prepped(spark, sf).select(F.col("term_id").cast("long").alias("term_id"), "term").distinct()


@register("corpus_totals", WD(
    "select 'lemma_dfm' as stage, cast(sum(n) as bigint) as n_tokens, count(distinct term) as n_terms, count(distinct my_id) as n_docs from lemma_dfm "
    "union all select 'processed', cast(sum(n) as bigint), count(distinct term), count(distinct my_id) from processed "
    "union all select 'prepped', cast(sum(n) as bigint), count(distinct term), count(distinct my_id) from prepped"))
def q_corpus_totals(spark, sf):
    corpus = st.corpus_df(spark, sf)
    processed = st.processed_df(spark, sf, corpus)
    return dfm.corpus_totals({"lemma_dfm": dfm.text_dfm(st.texts_df(spark, sf, corpus), "my_id", "lemma_text"),
                              "processed": processed, "prepped": st.prepped_df(spark, sf, processed)})


# ---------------------------------------------------------------------------
# 2.11 Reports on the fixed theta / beta stand-ins (rows 11, 28, 39, 46-48, 56, 107-113)
# ---------------------------------------------------------------------------
from corpuslab.operators import report  # noqa: E402

K = 10
CONTRAST = (2, 8)
FREX_W = 0.7
MODEL_CTES = f"""
theta AS (
  select vec_id as doc_id, cast(topic as integer) as topic, w / sum(w) over (partition by vec_id) as p from (
    select vec_id, topic, exp(4 * cast(x as double)) as w from (
      select vec_id, sum(cast(x as double)) as x, (pos - 1) % {K} + 1 as topic from (
        select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by all))
),
beta_k AS (select word as term from fx_words group by word having count(distinct doc_id) >= 20),
beta_g AS (
  select cast(doc_id % {K} + 1 as integer) as topic, word as term, count(*) as n from fx_words
  where word in (select term from beta_k) group by 1, 2
),
beta_f AS (select tt.topic, k.term from beta_k k cross join (select distinct topic from beta_g) tt),
beta AS (
  select f.topic, f.term, (coalesce(n, 0) + cast(0.5 as double))
    / sum(coalesce(n, 0) + cast(0.5 as double)) over (partition by f.topic) as p
  from beta_f f left join beta_g g on f.topic = g.topic and f.term = g.term
),
theta_wide AS (
  select doc_id, {', '.join(f"max(case when topic = {t} then p end) as {report.topic_name(t)}" for t in range(1, K + 1))}
  from theta group by doc_id
),
corr_long AS (
  select a.topic as topic_a, b.topic as topic_b,
    case when a.topic = b.topic then 0.0 when corr(a.p, b.p) = 1 then 0.0 else corr(a.p, b.p) end as r
  from theta a join theta b on a.doc_id = b.doc_id group by 1, 2
),
beta_top AS (
  select topic, term, p, row_number() over (partition by topic order by p desc, term) as rk from beta
)"""


def WM(body: str, *extra: str) -> str:
    return S.with_base(body, MODEL_CTES, *extra)


def _theta(spark, sf, packed=False):
    return report.fixture_theta(tables.read_table(spark, sf, "embeddings"), K, packed=packed)


def _fx_words(spark, sf, arts=None):
    return cleanse.fixture_words(tables.article_texts(spark, sf) if arts is None else arts)


def _fx_doc_words(spark, sf):
    """Fixture ``(doc_id, word, n)`` table, materialised: beta and the coherence presence both read it."""
    return st.stage(report.doc_word_counts(_fx_words(spark, sf)), "fx_doc_words")


def _beta(spark, sf, doc_words=None):
    """Fixture beta, materialised like a fitted model (several reports read it more than once)."""
    dw = _fx_doc_words(spark, sf) if doc_words is None else doc_words
    return st.stage(report.fixture_beta(dw, K), "fx_beta")


def _r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


TM = [report.topic_name(t) for t in range(1, K + 1)]


@register("rename_topics", WM(f"select doc_id, {', '.join(f'round({c}, 6) as {c}' for c in TM)} from theta_wide"))
def q_rename_topics(spark, sf):
    return _r6(report.theta_wide(_theta(spark, sf, packed=True), K), *TM)


@register("bind_theta", WM(
    f"select a.doc_id, a.url, a.title, {', '.join(f'round(w.{c}, 6) as {c}' for c in TM)} "
    f"from articles a join theta_wide w on a.doc_id = w.doc_id"))
def q_bind_theta(spark, sf):
    meta = st.articles_df(spark, sf).select("doc_id", "url", "title")
    return _r6(report.bind_theta(meta, _theta(spark, sf, packed=True), K), *TM)


@register("theta_summary", WM(
    "select topic, round(min(p), 6) as min, round(quantile_cont(p, 0.25), 6) as q1, round(quantile_cont(p, 0.5), 6) as median, "
    "round(avg(p), 6) as mean, round(quantile_cont(p, 0.75), 6) as q3, round(max(p), 6) as max, count(*) as n from theta group by topic"))
def q_theta_summary(spark, sf):
    return _r6(report.theta_summary(_theta(spark, sf)), "min", "q1", "median", "mean", "q3", "max").select(
        "topic", "min", "q1", "median", "mean", "q3", "max", "n")


@register("theta_row_sums", WM("select doc_id, round(sum(p), 6) as row_sum from theta group by doc_id"))
def q_theta_row_sums(spark, sf):
    return _r6(report.theta_row_sums(_theta(spark, sf, packed=True)), "row_sum")


@register("topic_prevalence", WM(
    "select topic, round(avg(p), 6) as prevalence, round(avg(p), 2) as prevalence_2 from theta group by topic"))
def q_topic_prevalence(spark, sf):
    return _r6(report.topic_prevalence(_theta(spark, sf)), "prevalence")


@register("topic_correlation", WM("select topic_a, topic_b, round(r, 6) as r from corr_long"))
def q_topic_correlation(spark, sf):
    return _r6(report.topic_correlation(_theta(spark, sf, packed=True), K), "r")


@register("topic_graph", WM("select topic_a, topic_b, round(r, 6) as r from corr_long where topic_a < topic_b and r > -0.1"))
def q_topic_graph(spark, sf):
    # the stand-in's shares sum to one and have no positive correlations; the cut lets its strongest pairs through
    return _r6(report.topic_graph(report.topic_correlation(_theta(spark, sf, packed=True), K), -0.1), "r")


@register("theta_histogram", WM(
    "select topic, cast(least(floor(p * 20), 19) as bigint) as bin, count(*) as n from theta group by 1, 2"))
def q_theta_histogram(spark, sf):
    return report.theta_histogram(_theta(spark, sf), 20)


@register("topic_exemplars", WM(
    "select topic, rank, doc_id, round(p, 6) as p, text from (select t.topic, t.doc_id, t.p, a.text, "
    "row_number() over (partition by t.topic order by t.p desc, t.doc_id) as rank "
    "from theta t join articles a on t.doc_id = a.doc_id where length(a.text) < 500) where rank <= 3"))
def q_topic_exemplars(spark, sf):
    out = report.topic_exemplars(_theta(spark, sf), st.articles_df(spark, sf), 3, 500)
    return _r6(out.withColumn("rank", F.col("rank").cast("long")), "p")


@register("topic_labels", WM("select topic, rk as rank, term, round(p, 6) as p from beta_top where rk <= 7"))
def q_topic_labels(spark, sf):
    return _r6(report.topic_labels(_beta(spark, sf), 7).withColumn("rank", F.col("rank").cast("long")), "p")


@register("topic_cloud", WM(f"select term, round(p, 6) as p from beta where topic = {CONTRAST[0]} order by p desc, term limit 100"))
def q_topic_cloud(spark, sf):
    return _r6(report.topic_cloud(_beta(spark, sf), CONTRAST[0], 100), "p")


_A, _B = CONTRAST


@register("topic_contrast", WM(
    f"select side, term, round(p_a, 6) as p_a, round(p_b, 6) as p_b, round(contrast, 6) as contrast from ("
    f"select * from (select {_A} as side, * from c order by contrast desc, term limit 10) "
    f"union all select * from (select {_B} as side, * from c order by contrast asc, term limit 10))",
    f"""two AS (select term, max(case when topic = {_A} then p end) as p_a, max(case when topic = {_B} then p end) as p_b
      from beta where topic in ({_A}, {_B}) group by term),
    c AS (select *, (p_a - p_b) / (p_a + p_b) as contrast from two)"""))
def q_topic_contrast(spark, sf):
    return _r6(report.topic_contrast(_beta(spark, sf), _A, _B, 10), "p_a", "p_b", "contrast")


COHERENCE_CTES = """
pres AS (select distinct doc_id, word as term from fx_words),
ctop AS (select topic, term, rk from beta_top where rk <= 10),
cpairs AS (select a.topic, a.rk as i, b.rk as j, a.term as ti, b.term as tj from ctop a join ctop b on a.topic = b.topic and a.rk > b.rk),
dterm AS (select t.topic, t.rk, count(*) as d from ctop t join pres p on t.term = p.term group by 1, 2),
dpair AS (select c.topic, c.i, c.j, count(*) as d from cpairs c join pres pa on pa.term = c.ti
          join pres pb on pb.term = c.tj and pb.doc_id = pa.doc_id group by 1, 2, 3)"""


@register("topic_coherence", WM(
    "select c.topic, round(sum(ln((coalesce(dp.d, 0) + 1.0) / dj.d)), 6) as coherence from cpairs c "
    "left join dpair dp on dp.topic = c.topic and dp.i = c.i and dp.j = c.j "
    "join dterm dj on dj.topic = c.topic and dj.rk = c.j group by c.topic", COHERENCE_CTES))
def q_topic_coherence(spark, sf):
    dw = _fx_doc_words(spark, sf)
    return _r6(report.topic_coherence(_beta(spark, sf, dw), dw.select("doc_id", F.col("word").alias("term")), 10), "coherence")


FREX_CTES = f"""
fx AS (select b.topic, b.term, b.p, round(b.p / s.sp, 12) as ex, round(b.p, 12) as fr
       from beta b join (select term, sum(p) as sp from beta group by term) s on b.term = s.term),
fxr AS (select *, rank() over (partition by topic order by ex) + (count(*) over (partition by topic, ex) - 1) / 2.0 as rex,
               rank() over (partition by topic order by fr) + (count(*) over (partition by topic, fr) - 1) / 2.0 as rfr,
               count(*) over (partition by topic) as tot from fx),
frex AS (select topic, term, p, 1.0 / ({FREX_W!r} / (rex / tot) + {1 - FREX_W!r} / (rfr / tot)) as frex from fxr)"""


@register("topic_exclusivity", WM(
    "select topic, round(sum(frex), 6) as exclusivity from (select *, row_number() over (partition by topic order by p desc, term) as rk "
    "from frex) where rk <= 10 group by topic", FREX_CTES))
def q_topic_exclusivity(spark, sf):
    return _r6(report.topic_exclusivity(_beta(spark, sf), 10, FREX_W), "exclusivity")


@register("topic_frex_labels", WM(
    "select topic, rank, term, round(frex, 6) as frex from (select *, row_number() over (partition by topic order by frex desc, term) as rank "
    "from frex) where rank <= 7", FREX_CTES))
def q_topic_frex_labels(spark, sf):
    scores = report.frex_scores(_beta(spark, sf), FREX_W)
    top = report.top_k_per_group(scores, ["topic"], [F.desc("frex"), F.asc("term")], 7, salt_col="term")
    return _r6(top.select("topic", F.col("rank").cast("long").alias("rank"), "term", "frex"), "frex")


@register("topic_summary", WM(
    "select p.topic, round(p.prevalence, 6) as prevalence, w.top_words from "
    "(select topic, avg(p) as prevalence from theta group by topic) p join "
    "(select topic, string_agg(term, ', ' order by rk) as top_words from beta_top where rk <= 3 group by topic) w on p.topic = w.topic"))
def q_topic_summary(spark, sf):
    return _r6(report.topic_summary(_theta(spark, sf), _beta(spark, sf), 3), "prevalence")


# ---------------------------------------------------------------------------
# 2.11 Topic models (rows 100-106, 114)
# ---------------------------------------------------------------------------
from corpuslab.models import design as mdesign  # noqa: E402
from corpuslab.models import spectral, topics  # noqa: E402
from corpuslab.models.docs import doc_arrays, vocab_size  # noqa: E402

CTM_ITER = 50
STM_ITER = 25
SEARCH_KS = (10, 15, 20)


@register("cooccurrence", WD(
    "select a.term_id as term_a, b.term_id as term_b, round(sum((a.n * b.n - case when a.term_id = b.term_id then a.n else 0 end) "
    "/ (dn.nd * (dn.nd - 1.0))), 12) as q from prepped a join prepped b on a.my_id = b.my_id "
    "join (select my_id, sum(n) as nd from prepped group by my_id having sum(n) >= 2) dn on dn.my_id = a.my_id "
    "group by 1, 2 having sum((a.n * b.n - case when a.term_id = b.term_id then a.n else 0 end) / (dn.nd * (dn.nd - 1.0))) <> 0"))
def q_cooccurrence(spark, sf):
    prepped = st.prepped_df(spark, sf)
    q = spectral.mirrored(spectral.cooccurrence(doc_arrays(prepped), vocab_size(prepped)))
    return q.select("term_a", "term_b", F.round("q", 12).alias("q"))


@register("prevalence_design", WD(
    "select w.*, case when a.r > 0 then (case when n.na <= n.nl then 10 else 9 + n.nl end) + a.r end::int as author_column, "
    "case when l.r > 0 then (case when n.na <= n.nl then 9 + n.na else 10 end) + l.r end::int as lead_column "
    "from (select my_id, " + ", ".join(f"round(max(case when i = {j + 1} then v end), 6) as s{j}" for j in range(1, 11)) + " from b3 group by my_id) w "
    "join rk a on a.my_id = w.my_id and a.f = 0 join rk l on l.my_id = w.my_id and l.f = 1 cross join nlev n",
    "kn AS (select min(nb_days)::double as lo, max(nb_days)::double as hi, "
    + ", ".join(f"quantile_cont(nb_days, {i / 8!r})::double as k{i}" for i in range(1, 8))
    + " from features where top_OK), " + S.SPLINE_BASIS + """,
    rk AS (select my_id, 0 as f, dense_rank() over (order by coalesce(first_author, 'NA')) - 1 as r from features where top_OK
           union all select my_id, 1, dense_rank() over (order by coalesce(post_lead_type2, 'NA')) - 1 from features where top_OK),
    nlev AS (select max(case when f = 0 then r + 1 end) as na, max(case when f = 1 then r + 1 end) as nl from rk)"""))
def q_prevalence_design(spark, sf):
    """The sparse design unpacked: the spline's columns, and the column number of each document's author and lead type."""
    meta = _feat(spark, sf).where(F.col("top_OK")).select("my_id", "first_author", "post_lead_type2", "nb_days")
    design = mdesign.sparse_design(meta, ("first_author", "post_lead_type2"), "nb_days")
    span = {r["factor"]: (r["a"], r["b"]) for r in design.levels.groupBy("factor").agg(F.min("col").alias("a"), F.max("col").alias("b")).collect()}
    entry = F.map_from_arrays("xi", "xv")
    spline = [F.round(F.coalesce(F.try_element_at(entry, F.lit(i)), F.lit(0.0)), 6).alias(f"s{i}") for i in range(1, 11)]

    def column(f):  # null where the level is the factor's first
        lo, hi = span[f]
        return F.get(F.filter("xi", lambda x: x.between(lo, hi)), F.lit(0)) if lo is not None else F.lit(None).cast("int")

    return design.rows(meta).select("my_id", *spline, column(0).alias("author_column"), column(1).alias("lead_column"))


@register("spectral_init")
def q_spectral_init(spark, sf):
    """Anchor word of each topic and its share of the topic (rows-only)."""
    prepped = st.prepped_df(spark, sf)
    docs, v = topics.model_docs(prepped)
    start = spectral.spectral_start(docs, v, K)
    anchors = spark.createDataFrame([(t + 1, int(a) + 1) for t, a in enumerate(start.anchors)], "topic int, term_id long")
    vocab = prepped.select(F.col("term_id").cast("long").alias("term_id"), "term").distinct()
    found = start.frame().join(F.broadcast(anchors), ["topic", "term_id"]).join(vocab, "term_id")
    return found.withColumn("unfinished_words", F.lit(start.unfinished))


@register("fit_ctm")
def q_fit_ctm(spark, sf):
    """Document-topic shares of the correlated topic model, K = 10, spectral start (rows-only)."""
    return topics.fit_ctm(st.prepped_df(spark, sf), K, CTM_ITER).theta()


def _stm_inputs(spark, sf):
    """The prepared document-term table and the covariates, from one run of the chain."""
    c = st.run(spark, sf)
    prepped = st.prepped_df(spark, sf, st.processed_df(spark, sf, c.lemma_texts()))
    return prepped, c.features.where(F.col("top_OK")).select("my_id", "first_author", "nb_days", "post_lead_type2", "channel")


@register("fit_stm")
def q_fit_stm(spark, sf):
    """Structural topic model with prevalence ~ first_author + s(nb_days) + post_lead_type2 (rows-only)."""
    prepped, meta = _stm_inputs(spark, sf)
    m = topics.fit_stm(prepped, meta, K, STM_ITER, content_col=None)
    return m.theta()


@register("fit_stm_content")
def q_fit_stm_content(spark, sf):
    """STM with prevalence covariates and content ~ channel: top words of each (channel, topic) (rows-only)."""
    prepped, meta = _stm_inputs(spark, sf)
    m = topics.fit_stm(prepped, meta, K, STM_ITER, content_col="channel")
    levels = topics.content_levels(meta.join(prepped.select("my_id"), "my_id", "left_semi"), "channel")
    vocab = prepped.select(F.col("term_id").cast("long").alias("term_id"), "term").distinct()
    b = m.beta_frame(spark, vocab)
    lv = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "level int, channel string")
    top = report.top_k_per_group(b, ["level", "topic"], [F.desc("p"), F.asc("term")], 7, salt_col="term")
    return top.join(F.broadcast(lv), "level").select("channel", "topic", "rank", "term", "p")


@register("search_k")
def q_search_k(spark, sf):
    """Held-out likelihood, bound, exclusivity and coherence for K in (10, 15, 20), both covariates given (rows-only)."""
    prepped, meta = _stm_inputs(spark, sf)
    return topics.search_k(prepped, SEARCH_KS, STM_ITER, meta=meta, content_col="channel")


# ---------------------------------------------------------------------------
# Remaining variants: densities of row 42, lift labels (row 108), fitted data (row 106)
# ---------------------------------------------------------------------------
def _kde_register(name: str, src_sql: str, col_sql: str, builder, stated=_kde_sql):
    sql = stated(f"({src_sql})", col_sql).replace("with x as", "with " + S.ARTICLES + ", " + S.FEATURES[1:] + ", x as", 1)
    register(name, sql)(builder)


_kde_register("density_share_digits", "select length(cast(shares as varchar)) as d from articles", "d",
              lambda spark, sf: _kde_spark(st.articles_df(spark, sf).select(tx.digit_count("shares").alias("d")), "d", explore.exact_kernel_density), _exact_kde_sql)
_kde_register("density_text_length", "select nb_char_text from feat2 where top_OK", "nb_char_text",
              lambda spark, sf: _kde_spark(st.features_first_scope_df(spark, sf).where(F.col("top_OK")), "nb_char_text"))


@register("topic_labels_lift", WM(
    "select topic, rank, term, round(lift, 6) as lift from (select b.topic, b.term, b.p / (f.c / t.tot) as lift, "
    "row_number() over (partition by b.topic order by b.p / (f.c / t.tot) desc, b.term) as rank "
    "from beta b join (select word as term, count(*) as c from fx_words group by word) f on b.term = f.term "
    "cross join (select count(*) as tot from fx_words where word in (select term from beta_k)) t) where rank <= 7"))
def q_topic_labels_lift(spark, sf):
    dw = _fx_doc_words(spark, sf)
    beta = _beta(spark, sf, dw)
    kept = dw.join(beta.select(F.col("term").alias("word")).distinct(), "word", "left_semi")
    out = report.topic_lift(beta, kept, 7)
    return _r6(out.withColumn("rank", F.col("rank").cast("long")), "lift")


def _fitted_inputs(spark, sf):
    c = st.run(spark, sf)
    corpus = c.corpus()
    return _article_table(c, corpus), st.prepped_df(spark, sf, st.processed_df(spark, sf, corpus))


def _fitted(spark, sf, ctm_iter, stm_iter):
    meta, prepped = _fitted_inputs(spark, sf)
    meta = st.stage(meta, "article-table")
    covariates = meta.select("my_id", "first_author", "nb_days", "post_lead_type2", "channel")
    fits = {"ctm": topics.fit_ctm(prepped, K, ctm_iter), "stm": topics.fit_stm(prepped, covariates, K, stm_iter, content_col=None)}
    ctm, stm = (report.bind_theta(meta, m.theta(packed=True), K, "my_id").withColumn("model", F.lit(name)) for name, m in fits.items())
    return ctm.unionByName(stm)


@register("fitted_data")
def q_fitted_data(spark, sf):
    """The finished article table of the modelled documents with the tm_01..tm_10 columns of both models (``model``: ctm, and stm
    with prevalence covariates), joined on my_id (rows-only)."""
    return _fitted(spark, sf, CTM_ITER, STM_ITER)


@register("fitted_columns", WD(
    f"select m.model, {', '.join('s.' + x for x in FEATURE_COLS)}, {', '.join('coalesce(f.' + x + ', false) as ' + x for x in FLAG_COLS)}, "
    f"s.top_city, t.clean_word_text, t.lemma_text, 1.0::double as theta_sum from scoped s left join texts t on s.my_id = t.my_id "
    f"left join (select g.my_id, {FLAGS_SQL} from flag_grid g group by g.my_id) f on s.my_id = f.my_id "
    "cross join (values ('ctm'), ('stm')) m(model) where s.my_id in (select my_id from prepped)"))
def q_fitted_columns(spark, sf):
    """``fitted_data`` after one EM iteration of each model: everything in it that does not depend on the fit, and the sum of each row's topic shares."""
    both = _fitted(spark, sf, 1, 1)
    names = [report.topic_name(t) for t in range(1, K + 1)]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return both.withColumn("theta_sum", F.round(total, 9)).drop(*names)
