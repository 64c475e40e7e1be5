"""Feature engineering and scoping on the article table (rows 9-19, 24-25, 29, 34-37, 49, 51, 62-72).

Each function is ``DataFrame -> DataFrame``. Lists that the script keeps as R
vectors (frequent channels, kept lead types, series titles, the global minimum
date) stay DataFrames and are joined back, never collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.lists import EXCLUDED_LEAD_TYPES
from corpuslab.operators.ranking import add_row_number, cumulative_counts, percent_rank_by_histogram, value_histogram
from corpuslab.sources.tables import stage_roundtrip, text_digest


@dataclass(frozen=True)
class ScopeParams:
    """Thresholds of the scoping rules. ``*_share`` values are fractions of the row count."""

    min_channel_rows: float | None = 300  # reference value
    min_channel_share: float | None = None  # fixture: 0.12
    min_text_length: int = 200
    max_length_percent_rank: float = 0.95
    series_min_rows: int = 2
    id_width: int = 5
    chronological_min_date: bool = True


SERIES_BROADCAST = 100_000  # titles (and authors) of some hundred bytes: tens of MB

FIXTURE_SCOPE = ScopeParams(min_channel_rows=None, min_channel_share=0.12)


def _row_count(df: DataFrame) -> DataFrame:
    """One-row DataFrame ``(_n)``: joined by broadcast where a threshold depends on the row count."""
    return df.agg(F.count(F.lit(1)).alias("_n"))


def threshold_filter(counts: DataFrame, n_col: str, total: DataFrame, absolute: float | None, share: float | None) -> DataFrame:
    """Keep rows whose count is above an absolute value, or above ``share`` x total rows."""
    if share is not None:
        return counts.crossJoin(F.broadcast(total)).where(F.col(n_col) > F.lit(share) * F.col("_n")).drop("_n")
    return counts.where(F.col(n_col) > F.lit(absolute))


def frequent_values(df: DataFrame, col: str, min_rows: float | None = 300, min_share: float | None = None) -> DataFrame:
    """``table[,.N,col][order(-N)][N > t]``: values with more than ``t`` rows, null group included (rows 33, 34, 52)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    kept = threshold_filter(counts, "n", _row_count(df), min_rows, min_share)
    return kept.orderBy(F.desc("n"), F.asc_nulls_first(col))


def kept_lead_types(df: DataFrame, col: str = "post_lead_type", excluded=EXCLUDED_LEAD_TYPES) -> DataFrame:
    """Distinct lead types minus the excluded ones and null (row 59)."""
    return df.select(col).where(F.col(col).isNotNull() & ~F.col(col).isin(*excluded)).distinct()


def in_list(df: DataFrame, col: str, values: DataFrame, value_col: str, out_col: str, bounded: bool = False) -> DataFrame:
    """R ``%in%`` as a null-safe flag: TRUE/FALSE, never null; a null value matches a null list entry (row 15).

    ``bounded`` says that the list is short by construction; it is then broadcast.
    """
    vals = values.select(F.col(value_col).alias("_val")).distinct().withColumn("_hit", F.lit(True))
    vals = F.broadcast(vals) if bounded else vals
    j = df.join(vals, df[col].eqNullSafe(vals["_val"]), "left")
    return j.withColumn(out_col, F.coalesce(F.col("_hit"), F.lit(False))).drop("_val", "_hit")


def not_in_list(df: DataFrame, col: str, values: DataFrame, value_col: str) -> DataFrame:
    """R ``x[x %!in% values]``: null-safe anti join (row 16)."""
    vals = values.select(F.col(value_col).alias("_val")).distinct()
    return df.join(vals, df[col].eqNullSafe(vals["_val"]), "left_anti")


def add_scope_flag(df: DataFrame, p: ScopeParams = ScopeParams()) -> DataFrame:
    """``top_OK``: frequent channel AND kept lead type AND text not null and not empty (row 17).

    "lead type in (distinct lead types minus excluded and null)" is the same as
    "lead type not null and not excluded", so that half needs no join.
    """
    chans = frequent_values(df, "channel", p.min_channel_rows, p.min_channel_share)
    # at most 1 / share values can each hold that share of the rows
    flagged = in_list(df, "channel", chans, "channel", "_chan_ok", bounded=p.min_channel_share is not None)
    lead_ok = F.col("post_lead_type").isNotNull() & ~F.col("post_lead_type").isin(*EXCLUDED_LEAD_TYPES)
    length = F.length("text") if "text" in df.columns else F.col("nb_char_text")
    text_ok = length.isNotNull() & (length > 0)
    return flagged.withColumn("top_OK", F.col("_chan_ok") & lead_ok & text_ok).drop("_chan_ok")


def key_counts(hashed: DataFrame, key: str) -> DataFrame:
    """``(_key, _best, _n)``: rows of each key and the least hash among them; numbers only, so a hash aggregate combines them on the map side."""
    return hashed.groupBy(F.col(key).alias("_key")).agg(F.min("_h").alias("_best"), F.count(F.lit(1)).alias("_n"))


def dedupe_by_key(df: DataFrame, key: str = "url", order_cols: list[str] | None = None, wide=("text",),
                  id_col: str | None = None, width: int = 5, copies_col: str | None = None) -> DataFrame:
    """Keep one row per key: the one that is first by ``order_cols`` (default: all other columns but the ``wide`` ones),
    then by the hash of the whole row (row 36). With ``id_col`` the kept rows get their id of :func:`add_row_ids`.

    Keys are counted first (:func:`key_counts`); only rows of keys that occur several times are ordered, as narrow rows (key, order columns, hash). The whole
    rows then meet the written choice in one join on key and hash, so copies of a hot key that lose are spread over the
    tasks. Exact copies of a winner are combined on the map side. A null key is a key like others.
    ``copies_col`` names a column for the number of rows that the key had.
    """
    order = order_cols or [c for c in df.columns if c != key and c not in wide]
    hashed = df.withColumn("_h", F.xxhash64(*[F.col(c) for c in df.columns]))
    won = stage_roundtrip(key_counts(hashed, key), "dedupe-keys")
    several = won.where("_n > 1")
    if not several.isEmpty():  # only these rows need the order columns, whose strings no hash aggregate can hold
        again = F.col(key).eqNullSafe(F.col("_key"))
        rows = hashed.join(several.select("_key"), again, "left_semi").select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in order], F.col("_h")).alias("_o"))
        best = rows.groupBy("_key").agg(F.min("_o").getField("_h").alias("_best"), F.count(F.lit(1)).alias("_n"))
        won = stage_roundtrip(won.where("_n = 1").unionByName(best), "dedupe-winners")
    if id_col is not None:
        won = add_row_ids(won, "_key", id_col, width)
    out = df.columns + ([] if id_col is None else [id_col]) + ([] if copies_col is None else [F.col("_n").alias(copies_col)])
    kept = hashed.join(won, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_best")))
    once = kept.where("_n = 1").select(*out)
    if several.isEmpty():
        return once
    return once.unionByName(kept.where("_n > 1").select(*out).dropDuplicates([key]))


def add_row_ids(df: DataFrame, order_col: str = "url", out_col: str = "my_id", width: int = 5) -> DataFrame:
    """``str_pad(1:.N, width, pad='0')`` in key order; pads but never truncates (row 49)."""
    numbered = add_row_number(df, order_col, "_rn")
    return numbered.withColumn(out_col, tx.pad_id(F.col("_rn"), width)).drop("_rn")


def add_author_features(df: DataFrame) -> DataFrame:
    """Lower-case author, co-author flag, first author (rows 62, 68, 69)."""
    return (
        df.withColumn("author", F.lower("author"))
        .withColumn("top_partner", tx.has_coauthor("author"))
        .withColumn("first_author", tx.first_author("author"))
    )


def min_date(df: DataFrame, scope_col: str = "top_OK") -> DataFrame:
    """Minimum date over in-scope rows, both ways (row 37).

    ``date_min_lexicographic`` is what ``min`` on ``MM/dd/yyyy`` strings gives;
    ``date_min_chronological`` is the earliest parsed day, formatted back.
    """
    scoped = df.where(tx.null_false(F.col(scope_col))) if scope_col else df
    return scoped.agg(
        F.min("date").alias("date_min_lexicographic"),
        F.date_format(F.min(tx.parse_date("date")), tx.DATE_FORMAT_OUT).alias("date_min_chronological"),
    )


def add_days_since_first(df: DataFrame, chronological: bool = True, scope_col: str = "top_OK", dates: DataFrame | None = None) -> DataFrame:
    """``date_min`` and ``nb_days`` on in-scope rows, null elsewhere (rows 9, 29, 71, 72).

    The global minimum is a one-row aggregate joined by broadcast. ``dates`` holds the
    same rows' dates and scope where a cheaper table than ``df`` has them.
    """
    m = min_date(df if dates is None else dates, scope_col).select(
        F.col("date_min_chronological" if chronological else "date_min_lexicographic").alias("_dmin")
    )
    in_scope = tx.null_false(F.col(scope_col))
    j = df.crossJoin(F.broadcast(m))
    return (
        j.withColumn("date_min", F.when(in_scope, F.col("_dmin")))
        .withColumn(
            "nb_days",
            F.when(in_scope, F.datediff(tx.parse_date("date"), tx.parse_date("_dmin")).cast("double")),
        )
        .drop("_dmin")
    )


def add_text_stats(df: DataFrame) -> DataFrame:
    """``nb_char_text`` and ``nb_topics`` (rows 64, 70)."""
    return df.withColumn("nb_char_text", tx.text_length("text")).withColumn("nb_topics", tx.topic_count("topics"))


def add_lead_type_class(df: DataFrame) -> DataFrame:
    """``post_lead_type2``: Video / Article / Gallery (row 19)."""
    return df.withColumn("post_lead_type2", tx.lead_type_class("post_lead_type"))


def series_groups(df: DataFrame, min_rows: int = 2, keys=("title", "author")) -> DataFrame:
    """(title, author) groups with more than ``min_rows`` rows (rows 24, 33)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_rows)


def add_series_flag(df: DataFrame, min_rows: int = 2, by_author: bool = False, id_col: str | None = None) -> DataFrame:
    """``top_series``: the row's title is the title of a large (title, author) group (row 24).

    As in the script, only the title is matched unless ``by_author``. The groups are written and
    counted: up to ``SERIES_BROADCAST`` of them are broadcast. Beyond, with ``id_col`` (a unique key), only
    (id, keys) meet them and the flag comes back by the id, so a hot title never moves whole rows.
    """
    keys = ["title", "author"] if by_author else ["title"]
    groups = series_groups(df, min_rows).select(*[F.col(k).alias("_" + k) for k in keys]).distinct()
    groups = stage_roundtrip(groups, "series-groups").withColumn("_hit", F.lit(True))
    few = groups.count() <= SERIES_BROADCAST
    left = df if few or id_col is None else df.select(id_col, *keys)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys])
    flagged = left.join(F.broadcast(groups) if few else groups, same, "left")
    flagged = flagged.withColumn("top_series", F.coalesce("_hit", F.lit(False))).drop("_hit", *["_" + k for k in keys])
    return flagged if left is df else df.join(flagged.select(id_col, "top_series"), id_col)


def add_length_percent_rank(df: DataFrame, out_col: str = "length_pr") -> DataFrame:
    """``percent_rank(nchar(text))`` over the whole table, nulls ignored (row 51); a table without its texts has their lengths."""
    with_len = df.withColumn("_len", F.length("text") if "text" in df.columns else F.col("nb_char_text").cast("int"))
    return percent_rank_by_histogram(with_len, "_len", out_col).drop("_len")


def length_ceiling(df: DataFrame, p: ScopeParams, col: str = "nb_char_text") -> DataFrame:
    """One row: the greatest length whose percent rank is below the ceiling, null if none is.

    The percent rank grows with the length, so the rank rule is a comparison with this value.
    """
    cum = cumulative_counts(value_histogram(df, col), "_v", "_c")
    below = (F.col("_total") > 1) & (F.col("_before") / (F.col("_total") - F.lit(1)) < F.lit(p.max_length_percent_rank))
    return cum.where(below).agg(F.max("_v").alias("_ceiling"))


def tighten_scope(df: DataFrame, p: ScopeParams = ScopeParams(), lengths: DataFrame | None = None) -> DataFrame:
    """``top_OK`` stays TRUE only if length > floor and length percent-rank < ceiling (row 18).

    ``lengths`` holds ``nb_char_text`` of the same rows where a cheaper table than ``df`` has it.
    """
    t = df.crossJoin(F.broadcast(length_ceiling(df if lengths is None else lengths, p)))
    ok = tx.null_false((F.col("nb_char_text") > p.min_text_length) & (F.col("nb_char_text") <= F.col("_ceiling")))
    return t.withColumn("top_OK", F.col("top_OK") & ok).drop("_ceiling")


def without_text(articles: DataFrame) -> DataFrame:
    """The articles with length and hash (``nb_char_text``, ``_text``) in place of the text."""
    return articles.withColumns(text_digest()).drop("text")


def attach_text(rows: DataFrame, articles: DataFrame, key: str = "url") -> DataFrame:
    """``rows`` of :func:`without_text` with their texts again, by key and hash of the text, in one join.

    Texts of keys that occurred several times (``_copies``) are first made unique; the others need no step of their own.
    ``articles`` may be any table that has every key with its text.
    """
    texts = articles.select(F.col(key).alias("_key"), F.xxhash64("text").alias("_hash"), "text")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text") == F.col("_hash"))
    out = [*[c for c in rows.columns if c not in ("_text", "_copies")], "text"]
    once = rows.where("_copies = 1").join(texts, same).select(*out)
    several = rows.where("_copies > 1")
    if several.isEmpty():
        return once
    again = several.join(texts, same).dropDuplicates([key])  # one row a key is left of them
    return once.unionByName(again.select(*out))


def narrow_features(narrow: DataFrame, p: ScopeParams = ScopeParams(), topic_flags: DataFrame | None = None, tighten: bool = True, stage=None) -> DataFrame:
    """All derived columns of the exploration / feature stage, for articles :func:`without_text`.

    Row-level columns are computed in one pass into a base table (scope flag,
    de-duplication, ids, author, lengths, label count, lead-type class). Every
    global aggregate the script uses (minimum date, series titles, length
    ranks) is computed from that base and joined back, so no branch re-derives
    another. The rows hold no text, only its length and hash (``_text``), for :func:`attach_text`. ``stage(df, name)`` may
    materialise them, as they are read several times, and the base (e.g. :func:`corpuslab.sources.tables.stage_roundtrip`); by default both stay lazy.
    ``topic_flags`` (wide, keyed by ``my_id``) is joined on the id, never bound by position.
    """
    order = [c for c in narrow.columns if c not in ("url", "nb_char_text", "_text")] + ["top_OK"]
    if stage is not None:
        narrow = stage(narrow, "articles-without-text")
    base = add_scope_flag(narrow, p)  # channel counts come from the input table, as in the script
    base = dedupe_by_key(base, "url", order_cols=order, id_col="my_id", width=p.id_width, copies_col="_copies")
    base = add_lead_type_class(add_author_features(base).withColumn("nb_topics", tx.topic_count("topics")))
    if stage is not None:
        base = stage(base, "feature_base")
    t = add_series_flag(base, p.series_min_rows, id_col="my_id")
    t = add_days_since_first(t, p.chronological_min_date, dates=base)
    if topic_flags is not None:
        t = t.join(topic_flags, "my_id", "left")
    return tighten_scope(t, p, base) if tighten else t


def feature_table(articles: DataFrame, p: ScopeParams = ScopeParams(), topic_flags: DataFrame | None = None, tighten: bool = True, stage=None,
                  text: bool = True, narrow: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """:func:`narrow_features` of the articles; with ``text`` the texts join once, at the end.

    ``narrow`` holds the articles :func:`without_text` and ``texts`` their urls and texts where cheaper tables than ``articles`` have them.
    """
    t = narrow_features(without_text(articles) if narrow is None else narrow, p, topic_flags, tighten, stage)
    return attach_text(t, articles if texts is None else texts) if text else t.drop("_text", "_copies")


def scoped_articles(features: DataFrame) -> DataFrame:
    """``table[top_OK==TRUE]`` plus the dateline flag and the dateline strip (rows 12, 75, 76)."""
    return (
        features.where(F.col("top_OK"))
        .withColumn("top_city", tx.dateline_flag("text"))
        .withColumn("text", tx.dateline_strip("text"))
    )
