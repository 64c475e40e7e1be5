"""Saved models, scoring of new documents, the state of EM, and every report on a fitted model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.models import blocks, em, store, topics
from corpuslab.operators import report
from tests.test_models import _planted


@pytest.fixture(scope="module")
def fitted(spark):
    prepped, _ = _planted(spark, d=90)
    ids = sorted(r.my_id for r in prepped.select("my_id").distinct().collect())
    meta = spark.createDataFrame([(i, "ab"[n % 2], float(n), "Video" if n % 3 else "Article", "en" if n % 4 else "fr") for n, i in enumerate(ids)],
                                 "my_id string, first_author string, nb_days double, post_lead_type2 string, channel string")
    model = topics.fit_stm(prepped, meta, k=3, max_iter=4, content_col="channel")
    vocabulary = prepped.groupBy("term_id", "term").agg(F.countDistinct("my_id").alias("docfreq"))
    return prepped, meta, model, vocabulary


def _theta(df):
    return {(r.my_id, r.topic): r.p for r in df.collect()}


def test_saved_model_scores_as_the_fitted_one_in_another_session(spark, fitted, tmp_path):
    prepped, meta, model, vocabulary = fitted
    path = f"file://{tmp_path}/model"
    assert store.versions(spark, path) == [] and store.save(model, path, vocabulary, {"content_col": "channel"}) == 1
    assert store.save(model, path, vocabulary, {"content_col": "channel"}) == 2
    other = spark.newSession()
    loaded = store.load(other, path)
    assert loaded.version == 2 and store.versions(spark, path) == [1, 2] and loaded.model.levels == ["en", "fr"]
    for a, b in ((model.beta, loaded.model.beta), (model.gamma, loaded.model.gamma), (model.sigma, loaded.model.sigma), (model.kappa.interaction, loaded.model.kappa.interaction)):
        assert np.array_equal(a, b)
    here = store.Stored(model, vocabulary.withColumn("docfreq", F.col("docfreq").cast("long")), {"covariates": {"content_col": "channel"}}, 0)
    terms = prepped.select("my_id", "term", "n")
    want, got = _theta(store.score(here, terms, meta)), _theta(store.score(loaded, terms, meta))
    assert want.keys() == got.keys() and max(abs(want[k] - got[k]) for k in want) < 1e-9
    assert _theta(loaded.model.theta()) == _theta(model.theta())
    with pytest.raises(FileNotFoundError):
        store.load(spark, path, 7)
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"file://{tmp_path}/nothing")


def test_new_documents(spark, fitted, tmp_path):
    prepped, meta, model, vocabulary = fitted
    path = f"file://{tmp_path}/model"
    store.save(model, path, vocabulary, {"content_col": "channel"})
    loaded = store.load(spark, path)
    one = prepped.where("my_id = '00003'").select("my_id", "term", "n")
    more = one.withColumn("my_id", F.lit("with unseen terms")).unionByName(spark.createDataFrame([("with unseen terms", "zzz", 9), ("only unseen terms", "zzz", 4)], "my_id string, term string, n long"))
    covariates = meta.where("my_id = '00003'").drop("my_id")
    ids = spark.createDataFrame([("00003",), ("with unseen terms",), ("only unseen terms",)], "my_id string")
    got = _theta(store.score(loaded, one.unionByName(more), ids.crossJoin(covariates)))
    for t in (1, 2, 3):
        assert abs(got["00003", t] - got["with unseen terms", t]) < 1e-12
    x = model.design.rows(meta.where("my_id = '00003'")).first()
    prior = np.append(sum(v * model.gamma[i] for i, v in zip(x.xi, x.xv)), 0.0)
    want = np.exp(prior) / np.exp(prior).sum()
    assert np.allclose([got["only unseen terms", t] for t in (1, 2, 3)], want, atol=1e-7)
    strange = spark.createDataFrame([("00003", "nobody", None, "Radio", "xx")], meta.schema)
    assert abs(sum(_theta(store.score(loaded, one, strange)).values()) - 1) < 1e-12
    assert store.score(loaded, one.limit(0), meta).count() == 0


def test_state_is_narrow_and_meets_documents_without_a_shuffle(spark, fitted, monkeypatch):
    prepped, _, _, _ = fitted
    docs, v = topics.model_docs(prepped)
    plans, sizes = [], []
    write = blocks.Buckets.write

    def spy(self, df, name, dealt=False):
        if dealt:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(self, df, name, dealt)
        sizes.append((name, out.columns))
        return out

    monkeypatch.setattr(blocks.Buckets, "write", spy)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = em.fit(docs, 3, v, topics.initial_beta(docs, v, 3), max_iter=3, tol=0.0, name="narrow")
    assert len(plans) == 3 and all("Exchange" not in p for p in plans) and all("ShuffledHashJoin" in p for p in plans[1:])
    assert all("ids" not in cols for name, cols in sizes if name.endswith("state"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held  # executors keep nothing
    assert model.docs.count() == 90 and not [t for t in spark.catalog.listTables() if t.name.startswith("corpuslab_narrow")]


def test_documents_apart_give_the_same_model(spark, fitted, monkeypatch):
    """Same result whatever the buckets, and with documents that have no terms."""
    prepped, _, _, _ = fitted
    docs, v = topics.model_docs(prepped)
    beta0 = topics.initial_beta(docs, v, 3)
    extra = docs.limit(1).select(F.lit("empty").alias("my_id"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<double>").alias("cts"))
    a = em.fit(docs, 3, v, beta0, max_iter=4, tol=0.0)
    monkeypatch.setattr(em, "LARGE_BUCKET", 4)
    b = em.fit(docs, 3, v, beta0, max_iter=4, tol=0.0)
    assert np.allclose(a.beta, b.beta, atol=1e-10) and _theta(a.theta()).keys() == _theta(b.theta()).keys()
    c = em.fit(docs.unionByName(extra), 3, v, beta0, max_iter=2, tol=0.0)
    shares = [p for (i, _), p in _theta(c.theta()).items() if i == "empty"]
    assert len(shares) == 3 and abs(sum(shares) - 1) < 1e-12


def test_every_report_on_a_fitted_model(spark, fitted):
    prepped, meta, model, vocabulary = fitted
    theta = model.theta().select(F.col("my_id").alias("doc_id"), "topic", "p").cache()
    beta = model.beta_frame(spark, vocabulary.select("term_id", "term")).groupBy("topic", "term").agg(F.avg("p").alias("p")).cache()
    presence = prepped.select(F.col("my_id").alias("doc_id"), "term")
    dense = np.zeros((90, 3))
    ids = sorted(r.doc_id for r in theta.select("doc_id").distinct().collect())
    for r in theta.collect():
        dense[ids.index(r.doc_id), r.topic - 1] = r.p
    mean = model.beta.mean(axis=0)
    prevalence = {r.topic: r.prevalence for r in report.topic_prevalence(theta).collect()}
    assert np.allclose([prevalence[t] for t in (1, 2, 3)], dense.mean(axis=0))
    sums = [r.row_sum for r in report.theta_row_sums(theta).collect()]
    assert np.allclose(sums, 1) and len(sums) == 90
    corr = {(r.topic_a, r.topic_b): r.r for r in report.topic_correlation(theta, 3).collect()}
    assert np.allclose([corr[a, b] for a in (1, 2, 3) for b in (1, 2, 3) if a != b], [np.corrcoef(dense.T)[a - 1, b - 1] for a in (1, 2, 3) for b in (1, 2, 3) if a != b])
    labels = {(r.topic, r["rank"]): r.term for r in report.topic_labels(beta, 5).collect()}
    for t in range(3):
        top = sorted(range(30), key=lambda j: (-mean[t, j], f"w{j:03d}"))[:5]
        assert [labels[t + 1, i + 1] for i in range(5)] == [f"w{j:03d}" for j in top]
    contrast = {(r.side, r.term): r.contrast for r in report.topic_contrast(beta, 1, 2, 4).collect()}
    share = (mean[0] - mean[1]) / (mean[0] + mean[1])
    assert len(contrast) == 8 and all(abs(c - share[int(term[1:])]) < 1e-9 for (_, term), c in contrast.items())
    docs = meta.select(F.col("my_id").alias("doc_id"), F.concat(F.lit("text of "), "my_id").alias("text"))
    exemplars = report.topic_exemplars(theta, docs, 3, 500).collect()
    for t in (1, 2, 3):
        best = sorted(range(90), key=lambda i: (-dense[i, t - 1], ids[i]))[:3]
        assert [r.doc_id for r in sorted((r for r in exemplars if r.topic == t), key=lambda r: r["rank"])] == [ids[i] for i in best]
    assert report.topic_coherence(beta, presence, 5).count() == 3 and report.topic_exclusivity(beta, 5).count() == 3
    assert report.topic_summary(theta, beta, 3).count() == 3 and report.topic_cloud(beta, 1, 7).count() == 7
    assert report.theta_histogram(theta, 20).agg(F.sum("n")).first()[0] == 270 and report.theta_summary(theta).count() == 3
    assert report.topic_graph(report.topic_correlation(theta, 3), -1.0).count() == 3
    packed = model.theta("doc_id", packed=True)  # the same from one row a document, without a shuffle
    assert "Exchange" not in report.theta_row_sums(packed)._jdf.queryExecution().executedPlan().toString()
    assert np.allclose([r.row_sum for r in report.theta_row_sums(packed).collect()], 1)
    again = {(r.topic_a, r.topic_b): r.r for r in report.topic_correlation(packed, 3).collect()}
    assert again.keys() == corr.keys() and all(abs(again[x] - corr[x]) < 1e-9 for x in corr)
    wide = report.bind_theta(meta, model.theta(), 3, "my_id")
    assert wide.count() == 90 and {"tm_01", "tm_02", "tm_03", "channel"} <= set(wide.columns)
