"""Residual dispersion against a direct computation, and the number of planted topics."""

import numpy as np

from corpuslab.models import residuals, topics
from corpuslab.models.docs import doc_arrays


def _corpus(spark, k=4, v=24, d=160, seed=9):
    rng = np.random.default_rng(seed)
    true = np.full((k, v), 0.01)
    for t in range(k):
        true[t, t * (v // k):(t + 1) * (v // k)] = 1.0
    true /= true.sum(axis=1, keepdims=True)
    rows = []
    for i in range(d):
        c = rng.multinomial(150, rng.dirichlet(np.full(k, 0.25)) @ true)
        rows += [(f"{i:05d}", f"w{j:03d}", int(j) + 1, int(c[j])) for j in np.flatnonzero(c)]
    return spark.createDataFrame(rows, "my_id string, term string, term_id long, n long")


def test_dispersion_equals_direct_computation_and_finds_the_topics(spark):
    prepped = _corpus(spark)
    docs = doc_arrays(prepped)
    found = {}
    for k in (2, 4):
        model = topics.fit_ctm(prepped, k=k, max_iter=15)
        got = residuals.residual_dispersion(model, docs)
        theta = {}
        for r in model.theta().collect():
            theta.setdefault(r.my_id, {})[r.topic] = r.p
        squares = cells = 0.0
        for r in docs.collect():
            x = np.zeros(24)
            x[np.array(r.ids)] = r.cts
            q = np.array([theta[r.my_id][t + 1] for t in range(k)]) @ model.beta[0]
            use = q * x.sum() > residuals.LEAST
            squares += ((x - q * x.sum()) ** 2 / (x.sum() * q * (1 - q)))[use].sum()
            cells += use.sum()
        assert got["cells"] == cells and abs(got["squares"] - squares) < 1e-6 * squares
        assert got["parameters"] == 160 * (k - 1) + k * 23 and got["documents"] == 160
        found[k] = got["dispersion"]
    assert found[2] > 3 and 0.7 < found[4] < 1.3


def test_blocks_and_documents_without_terms(spark):
    rng = np.random.default_rng(0)
    theta, beta = rng.dirichlet(np.ones(3), 20), rng.dirichlet(np.ones(10), 3)
    ids = [np.arange(10) for _ in range(20)]
    cts = [rng.poisson(3.0, 10).astype(float) for _ in range(20)]
    assert np.allclose(residuals.document_sums(theta, beta, ids, cts, cells=35), residuals.document_sums(theta, beta, ids, cts))
    assert residuals.document_sums(theta[:1], beta, [np.array([], int)], [np.array([])]) == (0.0, 0.0)
