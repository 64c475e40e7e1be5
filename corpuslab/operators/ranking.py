"""Order-dependent operators that must not collapse to one task.

``row_number().over(Window.orderBy(..))``, ``percent_rank()`` and exact
quantiles over an unpartitioned window move every row into a single partition.
The forms here keep the work distributed: values are first counted per distinct
value (a partial aggregate, so hot values cost nothing extra), the key range is
cut into ranges whose numbers are written with the rows (so the range of a key
never depends on how a branch of the plan happens to be partitioned), each range
computes its local running count, and only one row per (group, range) goes
through the small offset window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.sources.tables import stage_roundtrip

_UNB = Window.unboundedPreceding


#: Rows of one bucket: at least ``SMALL_BUCKET`` (below that a further task costs more than it saves), at most about ``BUCKET_ROWS``.
SMALL_BUCKET = 1_000
BUCKET_ROWS = 1_000_000


def bucketed(df: DataFrame, col: str, num_partitions: int | None = None) -> DataFrame:
    """``df`` cut into ranges of ``col``, the number of the range in ``_b``, written once.

    The ranges are those of ``repartitionByRange``; as the table is written with
    its ``_b``, every branch of a later plan reads the same numbers, however it is
    partitioned. Equal keys share a range, nulls lie in the first. The number of
    ranges grows with the rows, so a range stays small at any size. Pass narrow rows: they are shuffled once.
    """
    n = num_partitions
    if n is None:
        df = stage_roundtrip(df, "rank-keys")
        rows = df.count()
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = max(rows // BUCKET_ROWS + 1, min(parts, rows // SMALL_BUCKET + 1))
    return stage_roundtrip(df.repartitionByRange(n, col).withColumn("_b", F.spark_partition_id()), "rank-buckets")


def add_row_number(df: DataFrame, order_col: str, out_col: str = "row_no", num_partitions: int | None = None) -> DataFrame:
    """1-based row number in ``order_col`` order, nulls first; the key should be unique (rows of one key share a number).

    Only the keys are numbered: cut into ranges, numbered inside their range by a window partitioned by
    range, plus the count of the ranges before (one row per range goes through that small window and is
    broadcast). Other columns are attached by one join on the key.
    """
    b = bucketed(df.select(order_col).distinct(), order_col, num_partitions)
    local = b.withColumn("_local", F.row_number().over(Window.partitionBy("_b").orderBy(order_col)))
    offsets = (
        b.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(_UNB, -1)), F.lit(0)))
        .select("_b", "_off")
    )
    numbered = local.join(F.broadcast(offsets), "_b").select(order_col, (F.col("_off") + F.col("_local")).alias(out_col))
    if df.columns == [order_col]:
        return numbered
    # a null key matches nothing in the join; it sorts first, so its number is 1
    return df.join(numbered, order_col, "left").withColumn(out_col, F.coalesce(out_col, F.lit(1).cast("long")))


def cumulative_counts(hist: DataFrame, value_col: str, count_col: str, group_cols=(), num_partitions: int | None = None) -> DataFrame:
    """Add ``_before`` (rows of the group with a smaller value) and ``_total`` (rows of the group)
    to a ``(groups..., value, count)`` histogram, without any single-partition window.

    Values are cut into ranges (:func:`bucketed`); each (group, range)
    runs its own running sum, and one row per (group, range) goes through
    the window that adds the counts of earlier ranges.
    """
    g = list(group_cols)
    b = bucketed(hist, value_col, num_partitions)
    w_local = Window.partitionBy(*g, "_b").orderBy(value_col).rowsBetween(_UNB, -1)
    local = b.withColumn("_loc", F.coalesce(F.sum(count_col).over(w_local), F.lit(0)))
    per = b.groupBy(*g, "_b").agg(F.sum(count_col).alias("_pc"))
    w_grp = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    per = per.withColumn("_off", F.coalesce(F.sum("_pc").over(w_grp.orderBy("_b").rowsBetween(_UNB, -1)), F.lit(0)))
    per = per.withColumn("_total", F.sum("_pc").over(w_grp)).drop("_pc")
    out = local.join(per, g + ["_b"])
    return out.withColumn("_before", F.col("_loc") + F.col("_off")).drop("_loc", "_off", "_b")


def value_histogram(df: DataFrame, value_col: str, group_cols=()) -> DataFrame:
    v = F.col(value_col)
    return df.where(v.isNotNull()).groupBy(*group_cols, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def values_at_ranks(cum: DataFrame, targets: DataFrame, group_cols=()) -> DataFrame:
    """For each target row ``(groups..., _k)`` (0-based rank), the value holding that rank.

    ``targets`` is small (groups x requested ranks); it is joined on the group
    keys with a range condition on the running counts.
    """
    g = list(group_cols)
    t = targets.alias("t")
    c = cum.select(*g, "_v", "_c", "_before").alias("c")
    cond = [F.col("c._before") <= F.col("t._k"), F.col("t._k") < F.col("c._before") + F.col("c._c")]
    cond += [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in g]
    # targets: groups x requested ranks, bounded by the caller
    joined = F.broadcast(t).join(c, cond)
    return joined.select(*[F.col(f"t.{k}").alias(k) for k in g], "t._k", F.col("c._v").alias("_at"))


def exact_quantiles(df: DataFrame, value_col: str, probs: dict[str, float], group_cols=()) -> DataFrame:
    """Exact quantiles by linear interpolation (R type 7, Spark ``percentile``, DuckDB ``quantile_cont``).

    Returns one row per group with one column per name in ``probs``.
    """
    g = list(group_cols)
    spark = df.sparkSession
    cum = cumulative_counts(value_histogram(df, value_col, g), "_v", "_c", g)
    totals = cum.select(*g, "_total").distinct()
    p = spark.createDataFrame([(k, float(v)) for k, v in probs.items()], "_name string, _p double")
    t = totals.crossJoin(F.broadcast(p)).withColumn("_h", (F.col("_total") - 1) * F.col("_p"))
    t = t.withColumn("_lo", F.floor("_h")).withColumn("_hi", F.ceil("_h"))
    ks = t.select(*g, F.col("_lo").alias("_k")).unionByName(t.select(*g, F.col("_hi").alias("_k"))).distinct()
    at = values_at_ranks(cum, ks, g)
    lo = at.select(*g, F.col("_k").alias("_lo"), F.col("_at").alias("_vlo"))
    hi = at.select(*g, F.col("_k").alias("_hi"), F.col("_at").alias("_vhi"))
    r = t.join(lo, g + ["_lo"]).join(hi, g + ["_hi"])
    r = r.withColumn("_q", F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo")))
    aggs = [F.max(F.when(F.col("_name") == k, F.col("_q"))).cast("double").alias(k) for k in probs]
    return r.groupBy(*g).agg(*aggs) if g else r.agg(*aggs)


def percent_rank_by_histogram(df: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """dplyr ``percent_rank``: (rows with a smaller value) / (non-null rows - 1); null stays null."""
    cum = cumulative_counts(value_histogram(df, value_col), "_v", "_c")
    ranks = cum.select(
        "_v",
        F.when(F.col("_total") > 1, F.col("_before") / (F.col("_total") - F.lit(1)))
        .otherwise(F.lit(float("nan")))
        .alias(out_col),
    )
    return df.join(ranks, F.col(value_col) == F.col("_v"), "left").drop("_v")


def percent_rank_by_window(df: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """Textbook form of :func:`percent_rank_by_histogram` (one-partition window; small inputs and tests only)."""
    v = F.col(value_col)
    ranked = df.where(v.isNotNull()).withColumn(out_col, F.percent_rank().over(Window.orderBy(v)))
    return ranked.unionByName(df.where(v.isNull()).withColumn(out_col, F.lit(None).cast("double")))
