"""Operator 11: exact ranked lexical search over geometrically blocked posting lists.

One pass over the documents keeps, of each, its number of terms and the frequencies of the terms that any item
asks for (the forward table, written once, with the collection's counts taken from it). The index is dealt by documents: every
task cuts its forward rows into chunks of bounded size and, for a chunk, inverts them into posting lists. A posting list is
clustered by document similarity into blocks (leaders drawn from the list; each document joins the leader whose random
projection of the weighted impacts points most nearly its way), and each block stores the coordinatewise
maximum of its documents' impacts as its summary, over the terms that occur in an item together with the list's term: no other coordinate is ever asked for.

An item walks its lists from the one that can add most to the one that can add least. A block is skipped if the product of the item's weights with its
summary, an upper bound of every score in it, is below the item's tenth best score so far; the walk ends when
all remaining lists together cannot reach that score. Bounds are exact integers and equal bounds are not skipped, so nothing is approximate: the
clustering only decides how much is skipped. A task carries its best ten of each item from chunk to chunk
and emits those; the tasks' lists are merged by a salted top-k.

The items are the query set, taken in passes of at most about ``PASS_TERMS`` (item, term) pairs (one pass for usual benchmarks); what is
broadcast, and the document frequencies that the driver sees, are bounded by that.
Terms are compared by 64-bit hashes.

Defined results: null texts and texts without a term are not counted and never found; rows of one ``item_id`` (null included)
are one item with all their terms; repeated document rows are documents of their own; a document without an id ranks
behind equal scores; a very long text is held whole by its task; items without a hit have no rows; empty tables give no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textops as tx
from corpuslab.llm.shared import share
from corpuslab.llm.stage import written
from corpuslab.operators.report import top_k_per_group

PASS_TERMS = 1_000_000  # (item, term) pairs searched in one pass over the documents: 16 MB broadcast
GROUP_TERMS = 1 << 14  # terms of the items that share one matrix of impacts
CELLS = 1 << 24  # documents x terms of that matrix: 64 MB a task
BLOCK_DOCS = 32  # documents of a block on average
SIGNATURE = 16  # dimensions of the random projection
NO_ID = np.iinfo(np.int64).max  # stands for a null id inside tasks


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each distinct term hash of each item once."""

    def run(batches):
        for batch in batches:
            for a, b in tx.slices(batch.column(1)):
                w, off = tx.words(batch.column(1).slice(a, b - a), clean=True)
                rows = np.repeat(np.arange(b - a), np.diff(off))
                ids = batch.column(0).slice(a, b - a).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(w.view(np.int64))], ["item_id", "term"])

    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "item_id long, term long").distinct()


def forward(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document with a term: its number of terms, and the frequencies of those in the sorted ``vocabulary``."""
    shared = share(docs.sparkSession, vocabulary)

    def run(batches):
        vocabulary = shared()
        v = len(vocabulary)
        for batch in batches:
            for a, b in tx.slices(batch.column(1)):
                w, off = tx.words(batch.column(1).slice(a, b - a), clean=True)
                n = np.diff(off)
                at = np.searchsorted(vocabulary, w)
                at[at == v] = 0
                hit = vocabulary[at] == w
                key, tf = np.unique(np.repeat(np.arange(b - a), n)[hit] * v + at[hit], return_counts=True)
                some = np.flatnonzero(n)
                offsets = np.append(np.searchsorted(key // v, some), len(key)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(some)),
                        pa.array(n[some]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array((key % v).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int32))),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Items:
    """The items of one pass: term numbers and weights, in groups that share a matrix of impacts."""

    def __init__(self, terms: dict, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        self.ids, self.groups = [], []  # a group: its terms, their weights, and per item (number, columns)
        own, union = [], set()

        def close():
            if own:
                cols = np.array(sorted(union), dtype=np.int64)
                self.groups.append((cols, weights[cols], [(i, np.searchsorted(cols, t)) for i, t in own]))
                own.clear()
                union.clear()

        for item, t in terms.items():
            t = np.array(sorted(x for x in t if weights[x] > 0), dtype=np.int64)
            if own and len(union | set(t.tolist())) > GROUP_TERMS:
                close()
            own.append((len(self.ids), t))
            union.update(t.tolist())
            self.ids.append(item)
        close()
        self.chunk_docs = max(64, CELLS // max([len(c) for c, _, _ in self.groups], default=1))


class Chunk:
    """Posting lists, blocks and summaries of some documents for one group of items."""

    def __init__(self, impacts: np.ndarray, weights: np.ndarray, partners: list, block_docs: int = BLOCK_DOCS):
        self.impacts, self.weights, self.partners, self.block_docs = impacts, weights, partners, block_docs
        self.upper = impacts.max(axis=0).astype(np.int64) * weights if len(impacts) else np.zeros(len(weights), np.int64)
        self._signatures = None
        self._blocks: dict[int, tuple] = {}
        self.looked_up = self.skipped = self.scored = 0

    def signatures(self) -> np.ndarray:
        if self._signatures is None:
            plane = np.random.default_rng(17).standard_normal((len(self.weights), SIGNATURE)).astype(np.float32)
            plane *= self.weights[:, None].astype(np.float32) / 1e6
            flat = np.concatenate([self.impacts[a : a + 1024].astype(np.float32) @ plane for a in range(0, len(self.impacts), 1024)])
            self._signatures = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)
        return self._signatures

    def blocks(self, t: int) -> tuple:
        """The list of term ``t`` as (documents block by block, where blocks begin, summaries over ``partners[t]``)."""
        if t not in self._blocks:
            docs = np.flatnonzero(self.impacts[:, t])
            parts = -(-len(docs) // self.block_docs)
            starts = np.zeros(1, np.int64)
            if parts > 1:
                s = self.signatures()
                leaders = docs[np.random.default_rng(t).choice(len(docs), parts, replace=False)]
                near = (s[docs] @ s[leaders].T).argmax(axis=1)
                order = np.argsort(near, kind="stable")
                docs, near = docs[order], near[order]
                starts = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
            summary = np.maximum.reduceat(self.impacts[np.ix_(docs, self.partners[t])], starts, axis=0)
            self._blocks[t] = docs, starts, np.append(starts[1:], len(docs)), summary
        return self._blocks[t]

    def search(self, q: np.ndarray, best: tuple, ids: np.ndarray, k: int) -> tuple:
        """The best ``k`` (scores, ids) of ``best`` and of this chunk for an item with the columns ``q``."""
        score, found = best
        upper = self.upper[q]
        order = np.argsort(-upper, kind="stable")
        rest = np.cumsum(upper[order][::-1])[::-1]
        w = self.weights[q]
        seen = np.zeros(len(ids), bool)
        for at, reach in zip(order.tolist(), rest.tolist()):
            least = int(score[-1]) if len(score) == k else 1
            if reach < max(least, 1) or upper[at] == 0:
                break
            t = int(q[at])
            docs, starts, ends, summary = self.blocks(t)
            bound = summary[:, np.searchsorted(self.partners[t], q)].astype(np.int64) @ w
            by = np.argsort(-bound, kind="stable")
            self.looked_up += len(by)
            a, step = 0, 1
            while a < len(by):
                least = int(score[-1]) if len(score) == k else 1
                take = by[a : a + step]
                take = take[bound[take] >= least]
                if not len(take):
                    self.skipped += len(by) - a
                    break
                self.skipped += min(step, len(by) - a) - len(take)
                a, step = a + step, step * 2
                some = np.concatenate([docs[starts[i] : ends[i]] for i in take.tolist()])
                some = some[~seen[some]]
                seen[some] = True
                self.scored += len(some)
                got = self.impacts[np.ix_(some, q)].astype(np.int64) @ w
                good = got >= least
                if good.any():
                    score, found = np.concatenate([score, got[good]]), np.concatenate([found, ids[some[good]]])
                    top = np.lexsort((found, -score))[:k]
                    score, found = score[top], found[top]
        return score, found


def impact_matrix(items: Items, cols: np.ndarray, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """Documents by terms of a group: what a term adds to a document's score for each unit of its weight, at most 10**6."""
    m = 10 + (90 * n * items.n_docs) // items.n_terms
    rows = np.repeat(np.arange(len(n)), counts)
    at = np.searchsorted(cols, terms)
    at[at == len(cols)] = 0
    own = cols[at] == terms
    out = np.zeros((len(n), len(cols)), dtype=np.int32)
    tf = tfs[own].astype(np.int64)
    out[rows[own], at[own]] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows[own]])
    return out


def _partners(cols: np.ndarray, own: list) -> list:
    """For each column of a group the columns that occur in an item together with it, itself included."""
    with_: list[list] = [[] for _ in cols]
    for _, q in own:
        for t in q.tolist():
            with_[t].append(q)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in with_]


def _search_task(batches, items: Items):
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.ids]
    partners = [_partners(cols, own) for cols, _, own in items.groups]
    for batch in batches:
        for a in range(0, batch.num_rows, items.chunk_docs):
            part = batch.slice(a, items.chunk_docs)
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = part.column("n").to_numpy(zero_copy_only=False)
            counts = part.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            terms = part.column("terms").flatten().to_numpy(zero_copy_only=False)
            tfs = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
            for (cols, weights, own), with_ in zip(items.groups, partners):
                if not len(cols):
                    continue
                chunk = Chunk(impact_matrix(items, cols, n, counts, terms, tfs), weights, with_)
                for i, q in own:
                    if len(q):
                        best[i] = chunk.search(q, best[i], ids, items.k)
    rows = [(i, int(d), int(s)) for i, (score, found) in enumerate(best) for s, d in zip(score.tolist(), found.tolist())]
    for a in range(0, len(rows), 10_000):
        part = rows[a : a + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([items.ids[i] for i, _, _ in part], pa.int64()), pa.array([None if d == NO_ID else d for _, d, _ in part], pa.int64()), pa.array([s for _, _, s in part], pa.int64())],
            ["item_id", "doc_id", "score"],
        )


def _pass(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` documents of the items of one pass."""
    spark = docs.sparkSession
    given = pairs.toArrow()
    hashes = given["term"].to_numpy().view(np.uint64)
    vocabulary = np.unique(hashes)
    table = written(forward(docs, vocabulary), "forward")
    total = table.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(len(vocabulary), np.int64)
    held = table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toPandas()
    df[held["t"].to_numpy(int)] = held["n"].to_numpy(np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    terms: dict = {}
    for item, at in zip(given["item_id"].to_pylist(), np.searchsorted(vocabulary, hashes).tolist()):
        terms.setdefault(item, []).append(at)
    shared = share(spark, Items(terms, weights, total["n"], total["l"] or 1, k))
    return table.mapInArrow(lambda batches: _search_task(batches, shared()), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of the highest score above 0 of every item, equal scores by ascending id."""
    pairs = written(item_terms(items), "item-terms")
    passes = -(-pairs.count() // pass_terms)
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for p in range(passes):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        if passes == 1 or not own.isEmpty():
            out = out.unionByName(_pass(docs, own, k))
    top = top_k_per_group(out, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, salt_col="doc_id", salts=16)
    return top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
