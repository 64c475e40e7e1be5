"""Operator 9: exact embedding near-duplicates by a metric range join.

Vectors of one label link when their cosine is at least ``threshold``; on unit vectors that
is a Euclidean distance of at most eps = sqrt(2 - 2 threshold), a metric. Steps:

1. Equal vectors of a label form a class (a partial aggregate on a 128-bit hash); its smallest id stands for it.
2. A label with more than ``CELL`` classes draws pivots by a hash of the id, at most ``MAX_PIVOTS``
   in all labels, so they can be broadcast. A vector's home is its nearest pivot's cell.
3. The triangle inequality says which other cells may hold a partner: x is also sent to cell j
   if d(x, p_j) <= d(x, p_home) + 2 eps and d(x, p_j) <= radius_j + eps, and,
   as the space is Euclidean, its distance to the plane between the two pivots is at most eps.
   Only cells before the home cell in order are visited, so a pair meets in exactly one cell.
4. Cells join independently; a cell over ``BLOCK`` vectors is cut into blocks and each pair of blocks is a task. A task
   compares with one matrix product in double precision, and returns link counts and a spanning forest, not pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or whose
label is null, has no links and its own id as component; vectors of different
lengths do not link; repeated rows and equal vectors link with each other; a row
with a null id takes part in its class but names no component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import graph, stage
from corpuslab.llm.shared import share

CELL = 2_000
MAX_PIVOTS = 4_096
BLOCK = 2_000
_SLACK = 1e-9


def unit_rows(col) -> np.ndarray:
    """A list column of equal lengths as a matrix of unit rows in double precision."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    x = np.asarray(col.flatten(), dtype=np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _assign(pivots_of, eps: float, radius_of=None):
    """Home cells, or with radii every cell a vector is sent to."""

    def run(batches):
        pivots = pivots_of()
        radius = radius_of() if radius_of else None
        for batch in batches:
            keys = np.array([f"{a}:{b}" for a, b in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())], dtype=object)
            rows, cells, dist, guest = [], [], [], []
            for key in sorted(set(keys.tolist())):
                own = np.flatnonzero(keys == key)
                p = pivots.get(key)
                if p is None:
                    rows.append(own)
                    cells.append(np.zeros(len(own), np.int64))
                    dist.append(np.zeros(len(own)))
                    guest.append(np.zeros(len(own), bool))
                    continue
                between = _distances(p, p)
                for a in range(0, len(own), 2048):
                    part = own[a : a + 2048]
                    d = _distances(unit_rows(batch.column("embedding").take(pa.array(part))), p)
                    home = d.argmin(1)
                    low = d[np.arange(len(part)), home]
                    rows.append(part)
                    cells.append(home)
                    dist.append(low)
                    guest.append(np.zeros(len(part), bool))
                    if radius is not None:
                        gap = (d * d - (low * low)[:, None]) / (2 * np.maximum(between[home], 1e-12))
                        go = (d <= low[:, None] + 2 * eps + _SLACK) & (d <= radius[key] + eps + _SLACK) & (gap <= eps + _SLACK)
                        go &= np.arange(len(p)) < home[:, None]
                        i, j = np.nonzero(go)
                        rows.append(part[i])
                        cells.append(j)
                        dist.append(d[i, j])
                        guest.append(np.ones(len(i), bool))
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            out = batch.take(pa.array(at))
            extra = [pa.array(np.concatenate(x) if x else [], t) for x, t in ((cells, pa.int64()), (dist, pa.float64()), (guest, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*out.columns, *extra], [*out.schema.names, "cell", "distance", "guest"])

    return run


def _join_cell(table: pa.Table, threshold: float) -> pa.Table:
    ids = table.column("rep").to_numpy()
    copies = table.column("copies").to_numpy()
    guest = table.column("guest").to_numpy()
    block = table.column("block").to_numpy()
    paired = bool(table.column("paired")[0].as_py())
    order = np.lexsort((ids, guest))
    ids, copies, guest, block = ids[order], copies[order], guest[order], block[order]
    x = unit_rows(table.column("embedding").combine_chunks().take(pa.array(order)))
    n = len(ids)
    links, root, edges = np.zeros(n, np.int64), np.arange(n), []
    for a in range(0, n, 512):
        b = min(n, a + 512)
        near = x[a:b] @ x[: b].T >= threshold
        near &= np.arange(b) < np.arange(a, b)[:, None]  # each pair once: the earlier row is the column
        near &= ~(guest[a:b, None] & guest[None, :b])  # two guests meet in another cell
        if paired:
            near &= block[a:b, None] != block[None, :b]
        links[a:b] += near @ copies[:b]
        links[:b] += near.T @ copies[a:b]
        for i in np.flatnonzero(near.any(1)).tolist():
            partner = np.flatnonzero(near[i])
            r, first = np.unique(root[partner], return_index=True)
            other = r != root[a + i]
            if other.any():
                edges += [(a + i, int(partner[k])) for k in first[other]]
                merged = np.append(r, root[a + i])
                root[np.isin(root, merged)] = merged.min()
    some = np.flatnonzero(links)
    a = [int(ids[i]) for i, _ in edges] + ids[some].tolist()
    b = [int(ids[j]) for _, j in edges] + [None] * len(some)
    k = [None] * len(edges) + links[some].tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], names=["a", "b", "links"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    eps = math.sqrt(2.0 - 2.0 * threshold)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("dim", F.size("embedding"))
    v = v.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding", "label"))
    narrow = stage.written(v.select("vec_id", "sound", "h1", "h2"), "vector-keys")
    key = ["h1", "h2"]
    classes = stage.written(narrow.where("sound").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    reps = (
        v.where("sound")
        .join(classes.where("rep is not null").withColumnsRenamed({"h1": "g1", "h2": "g2"}), F.expr("vec_id = rep and h1 = g1 and h2 = g2"))
        .select("rep", "copies", "label", "dim", "embedding", "h1", "h2")
        .dropDuplicates(key)
        .drop(*key)
    )
    reps = stage.written(reps, "vector-reps")
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where(F.col("n") > CELL)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share_of = min(1.0 / CELL, MAX_PIVOTS / 2 / total) if total else 0.0
    drawn = F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(1 << 30)) < int(share_of * (1 << 30))
    # a large label has more than CELL vectors, so there are at most total / CELL of them
    chosen = reps.join(sizes, ["label", "dim"]).where(drawn | (F.col("rep") == F.col("low"))).select("label", "dim", "rep", "embedding").collect()
    grouped: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["label"], r["dim"], r["rep"])):
        grouped.setdefault(f"{r['label']}:{r['dim']}", []).append(np.array(r["embedding"], float))
    pivots = {}
    for k, rows in grouped.items():
        x = np.array(rows)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        pivots[k] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    held = share(spark, pivots)
    schema = "rep long, copies long, label string, dim int, embedding array<double>, cell long, distance double, guest boolean"
    homes = reps.mapInArrow(_assign(held, eps), schema)
    far = homes.groupBy("label", "dim", "cell").agg(F.max("distance").alias("r")).where("r > 0").collect() if pivots else []
    radius = {k: np.zeros(len(p)) for k, p in pivots.items()}
    for r in far:
        if (k := f"{r['label']}:{r['dim']}") in radius:
            radius[k][r["cell"]] = r["r"]
    sent = reps.mapInArrow(_assign(held, eps, share(spark, radius)), schema).drop("distance")
    sent = stage.written(sent, "vector-cells")
    cells = sent.groupBy("label", "dim", "cell").agg(F.count("*").alias("members")).where("members > 1")
    tasks = (
        sent.join(cells, ["label", "dim", "cell"])
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .withColumn("paired", F.col("i") != F.col("j"))
        .select("label", "dim", "cell", "i", "j", "rep", "copies", "guest", "block", "paired", "embedding")
    )
    found = tasks.groupBy("label", "dim", "cell", "i", "j").applyInArrow(lambda t: _join_cell(t, threshold), "a long, b long, links long")
    found = stage.written(found, "vector-links")
    linked = graph.components(found.where("b is not null").select("a", "b"))
    degree = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    classes = (
        classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree.withColumnRenamed("a", "rep"), "rep", "left")
        .select(*key, F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    out = narrow.join(classes.withColumn("sound", F.lit(True)), [*key, "sound"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
