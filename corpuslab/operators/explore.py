"""Exploration: group counts, summaries, box-plot statistics, kernel densities (rows 30-42, 52-53, 65).

Summaries that need order statistics use the exact, distributed rank lookup of
:mod:`corpuslab.operators.ranking` (histogram + range-partitioned running
counts), never a single-partition sort.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators.ranking import cumulative_counts, exact_quantiles, value_histogram, values_at_ranks
from corpuslab.sources.tables import stage_roundtrip


def group_count(df: DataFrame, *keys) -> DataFrame:
    """``table[, .N, by=keys]``: one row per key combination, null groups kept (rows 30, 31)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_by_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Group count on the ``yyyyMM`` key cut out of an ``MM/dd/yyyy`` string (row 32)."""
    return df.groupBy(tx.month_key(date_col).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def five_number_summary(df: DataFrame, col: str, group_cols=()) -> DataFrame:
    """R ``summary``: min, first quartile, median, mean, third quartile, max (rows 38, 39)."""
    g = list(group_cols)
    v = F.col(col).cast("double")
    base = df.where(v.isNotNull())
    simple = base.groupBy(*g).agg(
        F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.count(F.lit(1)).alias("n")
    )
    q = exact_quantiles(base.select(*g, v.alias("_x")), "_x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, g)
    return simple.join(q, g, "inner") if g else simple.crossJoin(q)


def mean_median(df: DataFrame, col: str) -> DataFrame:
    """Mean and median of a column (row 40)."""
    v = F.col(col).cast("double")
    base = df.where(v.isNotNull()).select(v.alias("_x"))
    return base.agg(F.avg("_x").alias("mean")).crossJoin(exact_quantiles(base, "_x", {"median": 0.5}))


def boxplot_stats(df: DataFrame, col: str, coef: float = 1.5) -> DataFrame:
    """``boxplot.stats``: Tukey hinges (``fivenum``), whiskers at ``coef`` x hinge spread, outliers (row 41).

    Output: ``ymin, lower_hinge, median, upper_hinge, ymax, n, n_out``.
    """
    spark = df.sparkSession
    v = F.col(col).cast("double")
    base = df.where(v.isNotNull()).select(v.alias("_x"))
    cum = cumulative_counts(value_histogram(base, "_x"), "_v", "_c")
    n = cum.select("_total").distinct()
    # fivenum positions (1-based, may be x.5): 1, n4, (n+1)/2, n+1-n4, n with n4 = floor((n+3)/2)/2
    names = spark.createDataFrame([(i,) for i in range(5)], "_i int")
    n4 = F.floor((F.col("_total") + 3) / 2) / 2
    d = (
        F.when(F.col("_i") == 0, F.lit(1.0))
        .when(F.col("_i") == 1, n4)
        .when(F.col("_i") == 2, (F.col("_total") + 1) / 2)
        .when(F.col("_i") == 3, F.col("_total") + 1 - n4)
        .otherwise(F.col("_total").cast("double"))
    )
    pos = n.crossJoin(F.broadcast(names)).withColumn("_d", d)
    pos = pos.withColumn("_lo", F.floor("_d") - 1).withColumn("_hi", F.ceil("_d") - 1)
    ks = pos.select(F.col("_lo").alias("_k")).unionByName(pos.select(F.col("_hi").alias("_k"))).distinct()
    at = values_at_ranks(cum, ks)
    lo = at.select(F.col("_k").alias("_lo"), F.col("_at").alias("_vlo"))
    hi = at.select(F.col("_k").alias("_hi"), F.col("_at").alias("_vhi"))
    fv = pos.join(lo, "_lo").join(hi, "_hi").withColumn("_f", 0.5 * (F.col("_vlo") + F.col("_vhi")))
    hinges = fv.agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_f"))).alias(nm) for i, nm in enumerate(["_min", "lower_hinge", "median", "upper_hinge", "_max"])],
        F.max("_total").alias("n"),
    )
    spread = F.col("upper_hinge") - F.col("lower_hinge")
    lo_f, hi_f = F.col("lower_hinge") - coef * spread, F.col("upper_hinge") + coef * spread
    out = cum.crossJoin(F.broadcast(hinges))
    inside = (F.col("_v") >= lo_f) & (F.col("_v") <= hi_f)
    return out.groupBy("lower_hinge", "median", "upper_hinge", "n").agg(
        F.min(F.when(inside, F.col("_v"))).alias("ymin"),
        F.max(F.when(inside, F.col("_v"))).alias("ymax"),
        F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).cast("long").alias("n_out"),
    ).select("ymin", "lower_hinge", "median", "upper_hinge", "ymax", F.col("n").cast("long").alias("n"), "n_out")


def _density_range(df: DataFrame, col: str, cut: float) -> tuple[DataFrame, DataFrame]:
    """The values ``_x`` that are not null, and one row with their number, bandwidth and the ends of the output points; no row without any value."""
    v = F.col(col).cast("double")
    base = df.where(v.isNotNull()).select(v.alias("_x"))
    stats = base.agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_min"), F.max("_x").alias("_max")
    ).where("_n > 0").crossJoin(exact_quantiles(base, "_x", {"_q1": 0.25, "_q3": 0.75}))
    lo = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
    lo = F.when(lo > 0, lo).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    stats = stats.withColumn("_bw", 0.9 * lo * F.pow(F.col("_n").cast("double"), -0.2))
    stats = stats.withColumn("_from", F.col("_min") - cut * F.col("_bw")).withColumn("_to", F.col("_max") + cut * F.col("_bw"))
    return base, stats


def kernel_density(df: DataFrame, col: str, n_points: int = 512, cut: float = 3.0, n_bins: int = 512) -> DataFrame:
    """Gaussian kernel density at ``n_points`` from ``min - cut*bw`` to ``max + cut*bw`` (row 42), as R's ``density`` computes it.

    Bandwidth is R's default rule ``0.9 * min(sd, IQR/1.34) * n^-0.2`` (sd when the IQR is 0, then 1). Values are binned linearly: each
    gives its two neighbours on a grid of ``n_bins`` points, four bandwidths wider at both ends, shares by its nearness. The bins' masses
    are convolved with the kernel, and the grid is interpolated linearly at the output points. A value adds to one row of a
    partial aggregate with at most ``n_bins`` groups, whatever the data; all later tables have a fixed size. Output: ``i`` (0-based), ``x``, ``density``;
    nulls are left out, without any value the result is empty.
    """
    spark = df.sparkSession
    base, stats = _density_range(df, col, cut)
    stats = stats.withColumn("_low", F.col("_from") - 4 * F.col("_bw")).withColumn("_delta", (F.col("_to") + 4 * F.col("_bw") - F.col("_low")) / (n_bins - 1))
    stats = stats.withColumn("_step", (F.col("_to") - F.col("_from")) / (n_points - 1)).select("_n", "_bw", "_from", "_step", "_low", "_delta")
    stats = stage_roundtrip(stats, "density-grid")  # one row, read by three branches
    place = (F.col("_x") - F.col("_low")) / F.col("_delta")
    near = base.crossJoin(F.broadcast(stats)).select(F.floor(place).alias("j"), (place - F.floor(place)).alias("_f"))
    binned = near.groupBy("j").agg(F.sum(1 - F.col("_f")).alias("_here"), F.sum("_f").alias("_next"))
    mass = binned.select("j", F.col("_here").alias("m")).unionByName(binned.select((F.col("j") + 1).alias("j"), F.col("_next").alias("m")))
    mass = mass.groupBy("j").agg(F.sum("m").alias("m"))  # at most n_bins rows
    grid = spark.range(n_bins).select(F.col("id").alias("g")).crossJoin(F.broadcast(stats))
    z = (F.col("g") - F.col("j")) * F.col("_delta") / F.col("_bw")
    rough = grid.crossJoin(F.broadcast(mass)).groupBy("g").agg((F.sum(F.col("m") * F.exp(-0.5 * z * z)) / F.first(F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))).alias("y"))
    at = spark.range(n_points).select(F.col("id").alias("i")).crossJoin(F.broadcast(stats)).withColumn("x", F.col("_from") + F.col("i") * F.col("_step"))
    at = at.withColumn("_p", (F.col("x") - F.col("_low")) / F.col("_delta")).withColumn("g", F.floor("_p"))
    rough = rough.withColumn("_y2", F.lead("y").over(Window.orderBy("g")))  # n_bins rows
    both = at.join(F.broadcast(rough), "g")
    f = F.col("_p") - F.col("g")
    return both.select(F.col("i").cast("long").alias("i"), "x", (F.col("y") * (1 - f) + F.col("_y2") * f).alias("density"))


def exact_kernel_density(df: DataFrame, col: str, n_points: int = 512, cut: float = 3.0) -> DataFrame:
    """:func:`kernel_density` without bins: the sum of every value's kernel at every output point.

    Values are counted first, so the work is ``n_points`` for each distinct value; the output points are broadcast, and what is shuffled
    is a partial sum for each point and task.
    """
    base, stats = _density_range(df, col, cut)
    stats = stats.withColumn("_step", (F.col("_to") - F.col("_from")) / (n_points - 1)).select("_n", "_bw", "_from", "_step")
    stats = stage_roundtrip(stats, "density-grid")  # one row
    points = df.sparkSession.range(n_points).select(F.col("id").cast("long").alias("i")).crossJoin(F.broadcast(stats))
    points = points.withColumn("x", F.col("_from") + F.col("i") * F.col("_step"))
    z = (F.col("x") - F.col("_v")) / F.col("_bw")
    spread = value_histogram(base, "_x").crossJoin(F.broadcast(points))
    sums = spread.groupBy("i", "x", "_n", "_bw").agg(F.sum(F.col("_c") * F.exp(-0.5 * z * z)).alias("_s"))
    return sums.select("i", "x", (F.col("_s") / (F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
