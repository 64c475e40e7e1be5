"""Operator 2: n-gram Jaccard self join by T-occurrence search (DivideSkip).

Two documents link when the Jaccard similarity of their sets of word shingles
is at least ``percent`` / 100. The join is exact and runs in these steps:

1. *Classes.* Every document becomes (set size, 128-bit digest of its set);
   equal sets form a class, which the smallest ``doc_id`` represents. This is
   a partial aggregate, so a huge group of copies is small before the shuffle.
2. *Inverted lists.* Each task turns its documents into chunks of about a million shingle
   hashes (copies inside a chunk once) and deals them to hash-range buckets.
   A bucket finds the lists with at least two entries and sends each chunk its
   shared shingles with the list lengths. Shingles of one document alone never link.
3. *Prefixes.* With shingles ordered by list length, a linked pair must share
   one among the first ``n - ceil(percent n / 100) + 1`` of each set. Documents
   whose prefix holds unshared shingles only are done; the others link to the
   smallest document of each prefix list (a star, not pairs), and the
   components of these stars are the candidate groups.
4. *T-occurrence search.* A task gets a block of a group (or two blocks: a
   group over ``BLOCK`` documents is cut into blocks and every pair of blocks is
   one task) and searches, for every document, those that occur on at least
   T = ceil(percent n / 100) of its inverted lists. DivideSkip: the L longest
   lists are set apart, the short ones are merged, and candidates with at
   least T - L occurrences are probed in the long lists (binary search; a
   list dense enough is kept as a bitmap). The exact overlap decides.
5. Tasks return a spanning forest of their links and the number of links of
   each document, never the pairs; components of the forests are the result.

Merging sorted runs is done with numpy's sort of the concatenated runs, which
returns what a heap would, without a Python step per posting.

Defined results: a null or empty text, or one without words, has ``n_shingles``
0, no links, and its own id as component; texts under ``n`` words have one
shingle; repeated rows and equal texts are copies in one class; different texts under one id are one node of the links; rows with a
null ``doc_id`` are members of their class but name no component (a class of
such rows alone has a null component); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import graph, stage
from corpuslab.llm import textops as tx
from corpuslab.llm.graph import Union

CHUNK_SHINGLES = 1 << 20
CHUNK_ROWS = 30_000  # with the rows of one more slice still a 16-bit number
BUCKET_SHINGLES = 1_500_000
BLOCK = 2_000
_MU = 0.0085  # DivideSkip's weight of a probe against a merge step


def _packed(h: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte plane by byte plane: the high planes are zeros, which a shuffle's compression removes."""
    return np.diff(h, prepend=tx.U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(tx.U64).ravel(), dtype=tx.U64)


def _set_rows(batches, n: int):
    """(doc_id, n_shingles, d1, d2) of every row."""
    for batch in batches:
        for a, b in tx.slices(batch.column(1)):
            h, off = tx.shingles(batch.column(1).slice(a, b - a), n)
            d1, d2 = tx.digests(h, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(off), pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))],
                ["doc_id", "n_shingles", "d1", "d2"],
            )


def _chunk_rows(batches, n: int, bits: int):
    """Deals the sets of a chunk of documents to 2**bits buckets of hash ranges.

    A row: (bucket, chunk, index of the document in the chunk, hash); one more row for each chunk carries its ids and set sizes.
    """
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId() << 32, 0
    held: list[tuple] = []
    total = 0

    def chunk():
        ids = np.concatenate([x[0] for x in held])
        size = np.concatenate([x[1] for x in held])
        h = np.concatenate([x[2] for x in held])
        key = np.concatenate([x[3] for x in held])
        # equal sets of the chunk once, under their smallest id
        order = np.lexsort((ids, key[:, 1], key[:, 0], size))
        same = np.zeros(len(order), bool)
        same[1:] = (size[order][1:] == size[order][:-1]) & (key[order][1:] == key[order][:-1]).all(1)
        keep = np.zeros(len(order), bool)
        keep[order[~same]] = True
        keep &= size > 0
        index = np.full(len(order), -1, np.int64)
        index[keep] = np.arange(int(keep.sum()))
        doc = np.repeat(index, size)
        h, doc = h[doc >= 0], doc[doc >= 0].astype(np.uint16)
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        bucket = (h >> tx.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        found, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(h))
        me = task + number
        rows = [(int(k), me, doc[a:b].tobytes(), _packed(h[a:b]), None) for k, a, b in zip(found, first, ends)]
        home = int(tx.mix(np.array([me], dtype=tx.U64))[0]) % (1 << bits)
        rows.append((home, me, ids[keep].astype(np.int64).tobytes(), None, np.stack([size[keep].astype(np.int64), key[keep, 0].view(np.int64)]).tobytes()))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])],
            ["bucket", "chunk", "doc", "hash", "size"],
        )

    for batch in batches:
        for a, b in tx.slices(batch.column(1)):
            h, off = tx.shingles(batch.column(1).slice(a, b - a), n)
            d = np.stack(tx.digests(h, off), axis=1)
            held.append((batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(off), h, d))
            total += len(h)
            if total >= CHUNK_SHINGLES or sum(len(x[0]) for x in held) >= CHUNK_ROWS:
                yield chunk()
                held, total, number = [], 0, number + 1
    if held:
        yield chunk()


def _bucket_lists(table: pa.Table) -> pa.Table:
    """The lists of a bucket with two entries or more, sent back to the chunks: (chunk, doc, hash, df)."""
    chunk, doc, hsh, size = (table.column(k).to_pylist() for k in ("chunk", "doc", "hash", "size"))
    out = [(c, d, None, None, s) for c, d, h, s in zip(chunk, doc, hsh, size) if h is None]
    own = [(c, d, h) for c, d, h in zip(chunk, doc, hsh) if h is not None]
    if own:
        h = np.concatenate([_unpacked(x[2]) for x in own])
        d = np.concatenate([np.frombuffer(x[1], np.uint16) for x in own])
        src = np.repeat(np.arange(len(own), dtype=np.int32), [len(x[2]) // 8 for x in own])
        order = np.argsort(h)
        s = h[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        df = np.diff(np.append(first, len(s)))
        df = np.repeat(df, df)
        order, df = order[df > 1], np.minimum(df[df > 1], 0xFFFF).astype(np.uint16)  # only an order of the shingles
        by = np.argsort(src[order], kind="stable")
        order, df = order[by], df[by]
        bound = np.searchsorted(src[order], np.arange(len(own) + 1))
        for k, (c, _, _) in enumerate(own):
            a, b = bound[k], bound[k + 1]
            if b > a:
                out.append((c, d[order[a:b]].tobytes(), _packed(h[order[a:b]]), df[a:b].tobytes(), None))
    cols = list(zip(*out)) or [()] * 5
    return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["chunk", "doc", "hash", "df", "size"])


def _prefix_rows(table: pa.Table, percent: int) -> pa.Table:
    """Documents of a chunk whose prefix holds a shared shingle: id, set size, all shared shingles, the prefix."""
    rows = list(zip(*(table.column(k).to_pylist() for k in ("doc", "hash", "df", "size"))))
    head = next(r for r in rows if r[3] is not None)
    ids = np.frombuffer(head[0], np.int64)
    size, d1 = np.frombuffer(head[3], np.int64).reshape(2, -1)
    rows = [r for r in rows if r[3] is None]
    out = [[], [], [], [], []]
    if rows:
        doc = np.concatenate([np.frombuffer(r[0], np.uint16) for r in rows])
        h = np.concatenate([_unpacked(r[1]) for r in rows])
        df = np.concatenate([np.frombuffer(r[2], np.uint16) for r in rows])
        order = np.lexsort((h, df, doc))
        doc, h = doc[order], h[order]
        bound = np.searchsorted(doc, np.arange(len(ids) + 1))
        shared = np.diff(bound)
        prefix = size - (percent * size + 99) // 100 + 1
        prefix = np.minimum(shared, prefix - (size - shared))
        for i in np.flatnonzero(prefix > 0):
            own = h[bound[i] : bound[i + 1]]
            out[0].append(int(ids[i]))
            out[1].append(int(size[i]))
            out[2].append(np.sort(own).tobytes())
            out[3].append(own[: prefix[i]].view(np.int64))
            out[4].append(int(d1[i]))
    return pa.table(
        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.int64())],
        names=["doc_id", "n_shingles", "shared", "prefix", "d1"],
    )


def t_occurrence(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, percent: int):
    """All (query, partner, overlap) with partner before query, by DivideSkip over the sets' inverted lists.

    ``sizes`` ascend and may count elements that no other set holds. With ``side``, only pairs of unequal sides.
    Yields (query, partners, overlaps).
    """
    d = len(sets)
    counts = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets) if d else np.zeros(0, tx.U64)
    distinct, token = np.unique(token, return_inverse=True)
    doc = np.repeat(np.arange(d), counts)
    order = np.argsort(token, kind="stable")  # runs of one list, each in ascending order of documents
    post = doc[order].astype(np.int32)
    length = np.bincount(token, minlength=len(distinct))
    begin = np.concatenate([[0], np.cumsum(length)])
    dense = np.flatnonzero(length * 32 >= d)
    row = np.full(len(distinct), -1, np.int64)
    row[dense] = np.arange(len(dense))
    bits = np.zeros((len(dense), d), bool)
    for k, t in enumerate(dense):
        bits[k, post[begin[t] : begin[t + 1]]] = True
    off = np.concatenate([[0], np.cumsum(counts)])
    for q in range(d):
        own = token[off[q] : off[q + 1]]
        own = own[length[own] > 1]
        need = -(-percent * int(sizes[q]) // 100)
        if len(own) < need:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        longest = int(length[own[-1]])
        apart = min(need - 1, int(need / (_MU * math.log2(max(2, longest)) + 1)))
        short, long_ = own[: len(own) - apart], own[len(own) - apart :]
        merged = np.sort(np.concatenate([post[begin[t] : begin[t + 1]] for t in short.tolist()]))
        merged = merged[: np.searchsorted(merged, q)]  # partners come before the query
        if not len(merged):
            continue
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        cand, seen = merged[first], np.diff(np.append(first, len(merged)))
        ok = (seen >= need - apart) & (100 * sizes[cand] >= percent * sizes[q])
        if side is not None:
            ok &= side[cand] != side[q]
        cand, seen = cand[ok], seen[ok]
        if not len(cand):
            continue
        known = long_[row[long_] >= 0]
        if len(known):
            seen = seen + (bits[row[known]].sum(0)[cand] if 4 * len(cand) > d else bits[row[known][:, None], cand[None, :]].sum(0))
        for t in long_[row[long_] < 0].tolist():
            run = post[begin[t] : begin[t + 1]]
            at = np.searchsorted(run, cand)
            seen = seen + ((at < len(run)) & (run[np.minimum(at, len(run) - 1)] == cand))
        ok = 100 * seen >= percent * (sizes[q] + sizes[cand] - seen)
        if ok.any():
            yield q, cand[ok], seen[ok]


def _search_rows(table: pa.Table, percent: int) -> pa.Table:
    """Spanning links (a, b) of a task's documents, and (a, links) sums over linked copies."""
    ids = table.column("doc_id").to_numpy()
    size, copies, block = (table.column(k).to_numpy() for k in ("n_shingles", "copies", "block"))
    order = np.lexsort((ids, size))
    shared = table.column("shared").to_pylist()
    sets = [np.frombuffer(shared[i], tx.U64) for i in order]
    ids, size, copies, block = ids[order], size[order], copies[order], block[order]
    paired = bool(table.column("paired")[0].as_py())
    joined, links, edges = Union(len(ids)), np.zeros(len(ids), np.int64), []
    for q, partners, _ in t_occurrence(sets, size, block if paired else None, percent):
        links[q] += copies[partners].sum()
        links[partners] += copies[q]
        edges += [(q, p) for p in partners.tolist() if joined.join(q, p)]
    some = np.flatnonzero(links)
    a = [int(ids[q]) for q, _ in edges] + ids[some].tolist()
    b = [int(ids[p]) for _, p in edges] + [None] * len(some)
    n = [None] * len(edges) + links[some].tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])


def with_sets(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (doc_id, text, row) as (doc_id, n_shingles, d1, d2, row): the key of each row's own set."""
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = list(_set_rows([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"])], n))
            done = 0
            for s in sets:
                yield pa.RecordBatch.from_arrays([*s.columns, batch.column("row").slice(done, s.num_rows)], [*s.schema.names, "row"])
                done += s.num_rows

    return docs.mapInArrow(run, f"doc_id long, n_shingles long, d1 long, d2 long, row {kind}")


def _own_nodes(classes: DataFrame) -> DataFrame:
    """``classes`` with ``node``: their smallest id, or an unused number where a class of another set has that id already."""
    key = F.struct("n_shingles", "d1", "d2")
    first = classes.where("class_id is not null").groupBy("class_id").agg(F.min(key).alias("first"), F.count("*").alias("sets")).where("sets > 1")
    first = stage.written(first.select("class_id", "first"), "shared-ids")
    if first.isEmpty():
        return classes.withColumn("node", F.col("class_id"))
    again = classes.join(first, "class_id").where(key != F.col("first")).select("class_id", "n_shingles", "d1", "d2")
    salt = 0
    while True:
        named = again.withColumn("node", F.xxhash64(F.lit(salt), "class_id", "n_shingles", "d1", "d2"))
        nodes = classes.where("class_id is not null").select(F.col("class_id").alias("node")).distinct().unionByName(named.select("node"))
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            return classes.join(named, ["class_id", "n_shingles", "d1", "d2"], "left").withColumn("node", F.coalesce("node", "class_id"))
        salt += 1


def _winners(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, first) of all linked classes; ``first`` is the group's class of the smallest id, of several sets the smallest."""
    member = linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct())
    member = member.join(classes, "node").select("node", "component", F.struct("class_id", "n_shingles", "d1", "d2").alias("key"))
    return member.join(member.groupBy("component").agg(F.min("key").alias("first")), "component").select("node", "first")


def kept_sets(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, its set's n_shingles, d1, d2, and whether a row of this id and set stays of its linked group.

    Unlike :func:`jaccard_classes`, different sets under one id are nodes of their own.
    """
    sizes, classes, linked, _ = _linked(docs, n, percent, apart=True)
    key = F.struct("class_id", "n_shingles", "d1", "d2")
    classes = classes.join(_winners(classes, linked), "node", "left").select("n_shingles", "d1", "d2", "class_id", F.coalesce(F.col("first") == key, F.lit(True)).alias("wins"))
    keeps = (F.col("n_shingles") == 0) | F.col("doc_id").isNull() | (F.col("wins") & (F.col("doc_id") == F.col("class_id")))
    return sizes.join(classes, ["n_shingles", "d1", "d2"], "left").select("doc_id", "n_shingles", "d1", "d2", keeps.alias("keeps"))


def _linked(docs: DataFrame, n: int, percent: int, apart: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sets of all rows, their classes with a node each, the components of the nodes, and (node, links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = stage.written(docs.mapInArrow(lambda b: _set_rows(b, n), "doc_id long, n_shingles long, d1 long, d2 long"), "sets")
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    classes = (
        sizes.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    )
    classes = stage.written(classes, "classes")
    classes = stage.written(_own_nodes(classes), "nodes") if apart else classes.withColumn("node", F.col("class_id"))

    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET_SHINGLES))))
    dealt = docs.where("doc_id is not null").mapInArrow(lambda b: _chunk_rows(b, n, bits), "bucket int, chunk long, doc binary, hash binary, size binary")
    lists = dealt.groupBy("bucket").applyInArrow(_bucket_lists, "chunk long, doc binary, hash binary, df binary, size binary")
    active = lists.groupBy("chunk").applyInArrow(
        lambda t: _prefix_rows(t, percent), "doc_id long, n_shingles long, shared binary, prefix array<long>, d1 long"
    )
    reps = classes.where("class_id is not null").select(F.col("class_id").alias("doc_id"), "n_shingles", "d1", "copies", "node")
    # a repeated row comes from several chunks
    active = stage.written(active.join(reps, ["doc_id", "n_shingles", "d1"]).dropDuplicates(["doc_id", "n_shingles", "d1"]).drop("d1", "doc_id").withColumnRenamed("node", "doc_id"), "active")

    postings = active.select("doc_id", F.explode("prefix").alias("token"))
    heads = postings.groupBy("token").agg(F.min("doc_id").alias("head"), F.count("*").alias("df")).where("df > 1")
    stars = postings.join(heads, "token").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    member = graph.components(stars)
    member = member.unionByName(member.select(F.col("component").alias("node"), "component").distinct())
    group = member.groupBy("component").agg(F.count("*").alias("g"))
    bins = max(1, -(-(group.agg(F.sum("g")).first()[0] or 0) // BLOCK))

    held = (
        active.drop("prefix")
        .join(member.withColumnRenamed("node", "doc_id").join(group, "component"), "doc_id")  # narrow rows first
        .withColumn("blocks", F.ceil(F.col("g") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    small = F.col("blocks") == 1  # whole small groups share a task
    held = held.select(
        F.when(small, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("key"),
        F.when(small, F.lit(-1)).otherwise(F.least("block", "other")).alias("i"),
        F.when(small, F.lit(-1)).otherwise(F.greatest("block", "other")).alias("j"),
        "doc_id", "n_shingles", "shared", "copies", "block",
        (F.col("block") != F.col("other")).alias("differs"),
    ).withColumn("paired", F.col("i") != F.col("j")).drop("differs")
    found = stage.written(
        held.groupBy("key", "i", "j").applyInArrow(lambda t: _search_rows(t, percent), "a long, b long, links long"), "links"
    )
    linked = graph.components(found.where("b is not null").select("a", "b"))
    degree = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    return sizes, classes, linked, degree


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links, class_id (smallest id with an equal set)."""
    sizes, classes, linked, degree = _linked(docs, n, percent, apart=False)
    classes = (
        classes.join(linked, "node", "left")
        .join(degree, "node", "left")
        .select(
            "n_shingles", "d1", "d2", "class_id",
            F.coalesce("component", "class_id").alias("component_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    empty = F.col("n_shingles") == 0
    return sizes.join(classes, ["n_shingles", "d1", "d2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
    )
