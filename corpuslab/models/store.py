"""Saved topic models (rows 3, 106): a versioned folder, loaded in any session, and scoring of new documents.

``save`` writes one version below a folder on any file system Spark writes to:

    v=1/arrays      beta, prior mean, covariance, coefficients and content deviations, one row per matrix row
    v=1/vocabulary  term_id, term, docfreq
    v=1/levels      the prevalence factors' levels with their design columns (as the design has them)
    v=1/theta       my_id, lev, eta of the fitted documents
    v=1/manifest    one JSON text: shapes, covariates, knots, content levels, bounds; written last, so a version without it does not count

Versions are never overwritten. Doubles go through Parquet unchanged, so a loaded model scores exactly as the saved one.

Scoring (:func:`score`) drops terms the vocabulary lacks; a document none of whose terms are known, and one without terms, gets the shares of its prior
mean; an unknown factor level adds nothing to that mean, a number beyond the knots counts as the nearest knot, and an
unknown content level takes the mean of the levels' words.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.models import content, em
from corpuslab.models.design import Design, design_spec, saved_design
from corpuslab.models.topics import level_code
from corpuslab.operators.dfm import join_terms

FORMAT = 1
_MATRIX_SCHEMA = "name string, row long, values array<double>"


@dataclass
class Stored:
    """A loaded model with what it takes to read new documents."""

    model: em.TopicModel
    vocabulary: DataFrame  # term_id, term, docfreq
    manifest: dict
    version: int


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below ``path``, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [v for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/v={v}/manifest/_SUCCESS"))]


def _matrices(model: em.TopicModel) -> dict[str, np.ndarray]:
    levels, k, v = model.beta.shape
    out = {"beta": model.beta.reshape(levels * k, v), "mu": model.mu[None], "sigma": model.sigma}
    if model.gamma is not None:
        out["gamma"] = model.gamma
    if model.pooled is not None:
        out |= {"alpha": model.pooled.alpha, "tau": model.pooled.tau[None]}
    if model.kappa is not None:
        f = model.kappa
        out |= {"topic": f.topic.T, "level": f.level.T, "interaction": f.interaction.reshape(len(f.topic), -1).T}
    return out


def save(model: em.TopicModel, path: str, vocabulary: DataFrame, covariates: dict | None = None) -> int:
    """Write a new version of ``model`` below ``path``; its number. ``vocabulary`` has ``term_id, term`` and maybe ``docfreq``;
    ``covariates`` may name the ``content_col`` that :func:`score` shall read."""
    spark = vocabulary.sparkSession
    taken = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = taken.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(taken)] if fs.exists(taken) else []
    version = 1 + max((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()), default=0)
    root = f"{path.rstrip('/')}/v={version}"
    arrays = _matrices(model)
    rows = pd.DataFrame([(name, i, row) for name, m in arrays.items() for i, row in enumerate(np.atleast_2d(m))], columns=["name", "row", "values"])
    spark.createDataFrame(rows, _MATRIX_SCHEMA).write.parquet(f"{root}/arrays")
    docfreq = F.col("docfreq").cast("long") if "docfreq" in vocabulary.columns else F.lit(0).cast("long")
    vocabulary.select(F.col("term_id").cast("long").alias("term_id"), "term", docfreq.alias("docfreq")).write.parquet(f"{root}/vocabulary")
    design: Design | None = model.design
    if design is not None:
        design.levels.write.parquet(f"{root}/levels")
    if model.docs is not None:
        model.docs.select("my_id", "lev", "eta").write.parquet(f"{root}/theta")
    manifest = {
        "format": FORMAT, "k": model.k, "shape": list(model.beta.shape), "levels": model.levels, "iterations": model.iterations, "bounds": model.bounds,
        "unconverged": model.unconverged, "design": design_spec(design) if design is not None else None, "content": model.kappa is not None, "theta": model.docs is not None, "covariates": covariates or {},
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{root}/manifest")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Stored:
    """The given version, or the newest complete one."""
    have = versions(spark, path)
    if not have or (version is not None and version not in have):
        raise FileNotFoundError(f"no saved model {'' if version is None else f'version {version} '}below {path}")
    version = have[-1] if version is None else version
    root = f"{path.rstrip('/')}/v={version}"
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/manifest").collect()))
    if manifest["format"] != FORMAT:
        raise ValueError(f"saved in format {manifest['format']}, this library reads format {FORMAT}")
    parts: dict[str, dict[int, list]] = {}
    for r in spark.read.schema(_MATRIX_SCHEMA).parquet(f"{root}/arrays").collect():
        parts.setdefault(r["name"], {})[r["row"]] = r["values"]
    m = {name: np.array([rows[i] for i in range(len(rows))]) for name, rows in parts.items()}
    levels, k, v = manifest["shape"]
    kappa = None
    if manifest["content"]:
        kappa = content.Fit(m["topic"].T, m["level"].T, m["interaction"].T.reshape(v, levels, k), np.zeros(v), np.zeros(v), np.zeros(v))
    spec = manifest["design"]
    design = saved_design(spark, spec, spark.read.parquet(f"{root}/levels")) if spec else None
    docs = spark.read.schema("my_id string, lev int, eta array<double>").parquet(f"{root}/theta") if manifest["theta"] else None
    model = em.TopicModel(
        k=k, beta=m["beta"].reshape(levels, k, v), mu=m["mu"][0], gamma=m.get("gamma"), sigma=m["sigma"], bounds=manifest["bounds"], docs=docs,
        iterations=manifest["iterations"], unconverged=manifest["unconverged"], kappa=kappa, levels=manifest["levels"], design=design,
    )
    return Stored(model, spark.read.parquet(f"{root}/vocabulary"), manifest, version)


def term_arrays(terms: DataFrame, vocabulary: DataFrame, id_col: str = "my_id") -> DataFrame:
    """``(my_id, ids, cts)`` of ``terms`` (my_id, term, n) under a vocabulary; documents without a known term keep empty arrays."""
    known = join_terms(terms.select(id_col, "term", "n"), vocabulary.select("term", "term_id", "docfreq"))
    counted = known.select(id_col, F.struct((F.col("term_id") - 1).cast("int").alias("i"), F.col("n").cast("double").alias("c")).alias("p"))
    every = counted.unionByName(terms.select(id_col, F.lit(None).cast(counted.schema["p"].dataType).alias("p")).distinct())
    pairs = every.groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("_p"))  # nulls are not collected
    return pairs.select(id_col, F.transform("_p", lambda s: s["i"]).alias("ids"), F.transform("_p", lambda s: s["c"]).alias("cts"))


def score(stored: Stored, terms: DataFrame, meta: DataFrame | None = None, id_col: str = "my_id") -> DataFrame:
    """``(my_id, topic, p)`` of the documents of ``terms`` (my_id, term, n), with the covariates of ``meta`` if the model has any."""
    model = stored.model
    docs = term_arrays(terms, stored.vocabulary, id_col)
    if meta is not None and model.design is not None:
        docs = docs.join(model.design.rows(meta, id_col), id_col, "left")
    content_col = stored.manifest["covariates"].get("content_col")
    if meta is not None and content_col and model.levels:
        docs = docs.join(meta.select(id_col, level_code(content_col, model.levels).alias("lev")), id_col, "left")
    return em.theta_of(em.fold_in(model, docs.withColumnRenamed(id_col, "my_id")), id_col)
