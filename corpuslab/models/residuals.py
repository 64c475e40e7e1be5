"""Residual dispersion of a fitted topic model, to judge the number of topics (row 114; Taddy 2012).

Under the right model a count ``x`` of a document with ``m`` tokens has mean ``m q`` and variance ``m q (1 - q)`` with ``q = theta' beta``, so the
squared standardised residuals sum to about their degrees of freedom: the cells with an expected count above ``LEAST``, less the
model's parameters. Too few topics leave the ratio above 1.

One aggregate: a task takes its documents' shares and counts, forms ``q`` for a block of documents and terms at a time, and sends two numbers a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.models.estep import padded

LEAST = 0.01
CELLS = 1 << 21  # documents x terms held at once: 16 MB an array


def _shares(eta: np.ndarray) -> np.ndarray:
    e = np.concatenate([eta, np.zeros((len(eta), 1))], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_sums(theta: np.ndarray, beta: np.ndarray, ids: list, cts: list, least: float = LEAST, cells: int = CELLS) -> tuple[float, float]:
    """Squared residuals and cells of documents of one level (``beta`` is K x V)."""
    squares = used = 0.0
    step = max(1, cells // beta.shape[1])
    for a in range(0, len(theta), step):
        part = slice(a, a + step)
        m = np.array([float(np.sum(c)) for c in cts[part]])
        q = theta[part] @ beta
        mean = q * m[:, None]
        open_ = mean > least
        free = 1.0 / np.where(open_, mean * (1 - q), np.inf)
        squares += float((mean**2 * free).sum())  # as if every count were zero
        used += float(open_.sum())
        at = padded(ids[part], -1, np.int64)
        x = padded(cts[part], 0.0, float)
        rows = np.arange(len(at))[:, None]
        mu = np.where(at >= 0, mean[rows, at], 0.0)
        squares += float((((x - mu) ** 2 - mu**2) * np.where(at >= 0, free[rows, at], 0.0)).sum())  # corrected where they are not
    return squares, used


def residual_dispersion(model, docs: DataFrame, least: float = LEAST) -> dict:
    """``{"dispersion", "squares", "cells", "parameters", "documents"}`` of a model on the documents (my_id, ids, cts) it was fitted on.

    The dispersion is NaN where there are no more cells than parameters.
    """
    levels, k, v = model.beta.shape
    bc = docs.sparkSession.sparkContext.broadcast(model.beta)
    table = docs.select("my_id", "ids", "cts").join(model.docs.select("my_id", F.coalesce("lev", F.lit(0)).alias("lev"), "eta"), "my_id").where(F.size("ids") > 0)

    def run(batches):
        beta = bc.value
        for pdf in batches:
            theta, lev = _shares(np.stack(pdf["eta"].to_list())), pdf["lev"].to_numpy(np.int64)
            for c in np.unique(lev):
                own = np.flatnonzero(lev == c)
                s, n = document_sums(theta[own], beta[c], [pdf["ids"].iloc[i] for i in own], [pdf["cts"].iloc[i] for i in own], least)
                yield pd.DataFrame({"squares": [s], "cells": [n], "documents": [len(own)]})

    got = table.drop("my_id").mapInPandas(run, "squares double, cells double, documents long").agg(*[F.sum(c).alias(c) for c in ("squares", "cells", "documents")]).first()
    n, squares, cells = int(got["documents"] or 0), float(got["squares"] or 0.0), float(got["cells"] or 0.0)
    parameters = n * (k - 1) + levels * k * (v - 1)
    free = cells - parameters
    return {"dispersion": squares / free if free > 0 else float("nan"), "squares": squares, "cells": cells, "parameters": parameters, "documents": n}
