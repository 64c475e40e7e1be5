"""Binned kernel density against the rule written out in numpy and against the exact sum of kernels."""

import numpy as np
from pyspark.sql import functions as F

from corpuslab.operators import explore


def _density(x, n=512):
    sd, (q1, q3) = x.std(ddof=1), np.quantile(x, [0.25, 0.75])
    bw = 0.9 * (min(sd, (q3 - q1) / 1.34) or sd or 1.0) * len(x) ** -0.2
    a, b = x.min() - 3 * bw, x.max() + 3 * bw
    g = np.linspace(a - 4 * bw, b + 4 * bw, n)
    d = g[1] - g[0]
    p = (x - g[0]) / d
    j = np.floor(p).astype(int)
    mass = np.bincount(j, 1 - (p - j), n) + np.bincount(j + 1, p - j, n)
    y = np.exp(-0.5 * ((g[:, None] - g[None, :]) / bw) ** 2) @ mass / (len(x) * bw * np.sqrt(2 * np.pi))
    out = np.linspace(a, b, n)
    exact = np.exp(-0.5 * ((out[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    return out, np.interp(out, g, y), exact


def test_binned_density(spark):
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=700), np.concatenate([rng.exponential(900.0, 300), [1e4] * 300]), np.array([5.0, 5.0, 5.0]), np.repeat([1.0, 2.0], 40)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        rows = explore.kernel_density(df, "v").orderBy("i").collect()
        at, want, exact = _density(x)
        assert [r.i for r in rows] == list(range(512))
        assert np.allclose([r.x for r in rows], at) and np.allclose([r.density for r in rows], want, atol=1e-9 * want.max())
        assert np.abs(want - exact).max() < 0.01 * exact.max()


def test_density_of_nothing_and_its_plan(spark):
    assert explore.kernel_density(spark.createDataFrame([(None,)], "v double"), "v").count() == 0
    df = spark.range(50_000).select((F.rand(1) * 1000).alias("v"))
    plan = explore.kernel_density(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no fan-out of values
    area = explore.kernel_density(df, "v").agg(F.sum("density") * (F.max("x") - F.min("x")) / 511).first()[0]
    assert abs(area - 1) < 0.01


def test_exact_density_sums_every_kernel(spark):
    x = np.repeat([3.0, 4.0, 5.0, 6.0], [2, 5, 90, 9])  # few distinct values, as digit counts are
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    rows = explore.exact_kernel_density(df, "v").orderBy("i").collect()
    at, binned, exact = _density(x)
    assert [r.i for r in rows] == list(range(512)) and np.allclose([r.x for r in rows], at)
    assert np.allclose([r.density for r in rows], exact, atol=1e-12 * exact.max())
    assert np.abs(binned - exact).max() > 1e-6 * exact.max()
    assert explore.exact_kernel_density(df.where("v is null"), "v").count() == 0


def test_density_of_digits_is_exact(spark):
    from corpuslab.plans import queries

    assert "mass" not in queries.ORACLES["density_share_digits"] and "cross join h" in queries.ORACLES["density_share_digits"]
