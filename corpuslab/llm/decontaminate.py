"""Operator 5: benchmark decontamination with spaced seeds.

A spaced seed looks at the tokens of a window through a fixed mask: positions
under ``0`` are ignored, so a substituted token there does not break the
seed. Seeds of all benchmark positions under every mask form a sorted table
of hashes; the seeds of all document windows are joined to it (a bitmap turns
most windows away first). A hit names a diagonal (document position less item position), on which
the two token sequences are compared as a whole: an overlap is the longest
stretch with at least ``percent`` % equal tokens. It counts if ``min_tokens`` of its tokens,
or ``percent`` % of the item's tokens, are equal. So an overlap may
hold substitutions around and inside its hits.

A token is a run of letters and digits (ASCII case folded; other ASCII characters separate).
The benchmark is the query set: it is taken in blocks of at most about
``BLOCK_TOKENS`` tokens (one block for usual benchmarks), each broadcast and
searched in one pass over all documents; nothing of the documents is shuffled.
A long document only holds its words' hashes in memory.

Defined results: null or empty documents and items never overlap; an item shorter
than a mask is one seed of all its tokens; repeated document rows each give their
rows; repeated items each count; ties between overlaps of one document and item go
to the one with more equal tokens, then the earliest; items with a null id are
searched like others; an empty table gives no rows and removes nothing; other columns are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textops as tx
from corpuslab.llm.shared import share

MASKS = ("11111111", "110110110101", "11101001011", "1011001110101")
MIN_TOKENS = 13
PERCENT = 80
BLOCK_TOKENS = 500_000

OVERLAP_SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, tokens long, equal_tokens long"


def seeds(w: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The seed of every window of ``w`` under a mask; windows at row ends run over and must be dropped by the caller."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, tx.U64)
    c = tx.constants(len(mask), 1000 + salt)
    out = np.full(n, c[0] ^ tx.U64(salt), dtype=tx.U64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += w[k : k + n] * c[k]
    return out


class SeedTable:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple], masks: tuple[str, ...], min_tokens: int, percent: int):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.min_tokens, self.percent = min_tokens, percent
        longest = max(map(len, masks))
        short = sorted({len(w) for w in self.words if 0 < len(w) < longest})
        self.masks = [(m, k) for k, m in enumerate(masks)] + [("1" * n, 100 + n) for n in short]
        h, item, at, mask = [], [], [], []
        for number, w in enumerate(self.words):
            for j, (m, salt) in enumerate(self.masks):
                if salt >= 100 and len(w) != len(m):
                    continue
                s = seeds(w, m, salt)
                h.append(s)
                item.append(np.full(len(s), number))
                at.append(np.arange(len(s)))
                mask.append(np.full(len(s), j))
        h = np.concatenate(h) if h else np.zeros(0, tx.U64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.item, self.at, self.mask = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (item, at, mask))
        self.bits = max(12, int(np.ceil(np.log2(max(1, len(h)) * 64))))
        self.near = np.zeros(1 << self.bits, bool)
        self.near[(self.h >> tx.U64(64 - self.bits)).astype(np.int64)] = True

    def overlaps(self, col) -> list[tuple]:
        """(row, item number, document start, item start, tokens, equal tokens) of a column's rows."""
        w, off = tx.words(col, clean=True)
        found = set()
        for j, (m, salt) in enumerate(self.masks):
            for a in range(0, len(w), tx.SEGMENT):
                s = seeds(w[a : a + tx.SEGMENT + len(m) - 1], m, salt)
                hit = np.flatnonzero(self.near[(s >> tx.U64(64 - self.bits)).astype(np.int64)])
                if not len(hit):
                    continue
                lo, hi = np.searchsorted(self.h, s[hit], "left"), np.searchsorted(self.h, s[hit], "right")
                real = hi > lo
                for p, x, y in zip((hit[real] + a).tolist(), lo[real].tolist(), hi[real].tolist()):
                    row = int(np.searchsorted(off, p, "right")) - 1
                    if p + len(m) <= off[row + 1]:
                        found.update((row, int(self.item[e]), p - int(off[row]) - int(self.at[e])) for e in range(x, y) if self.mask[e] == j)
        best: dict[tuple, tuple] = {}
        for row, item, diagonal in sorted(found):
            o = self._stretch(w[off[row] : off[row + 1]], self.words[item], diagonal)
            if o and ((row, item) not in best or o[3] > best[row, item][3]):
                best[row, item] = o
        return [(*k, *v) for k, v in sorted(best.items())]

    def _stretch(self, doc: np.ndarray, item: np.ndarray, diagonal: int):
        """The longest stretch of the diagonal with enough equal tokens: (document start, item start, tokens, equal)."""
        a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        same = doc[a + diagonal : b + diagonal] == item[a:b]
        total = np.concatenate([[0], np.cumsum(np.where(same, 100 - self.percent, -self.percent))])
        low = np.minimum.accumulate(total)
        opened = np.flatnonzero(np.concatenate([[True], total[1:] < low[:-1]]))  # starts worth trying: new minima
        last = np.maximum.accumulate(total[::-1])[::-1]  # the best total at or after each end
        best = (0, 0)
        for i in opened.tolist():
            # the farthest end whose total is not below the start's; ``last`` never rises
            j = int(np.searchsorted(-last, -total[i], "right")) - 1
            if j - i > best[1] - best[0]:
                best = (i, j)
        i, j = best
        while i < j and not same[i]:
            i += 1
        while j > i and not same[j - 1]:
            j -= 1
        equal = int(same[i:j].sum())
        if equal < self.min_tokens and 100 * equal < self.percent * len(item):
            return None
        return a + i + diagonal, a + i, j - i, equal


def _blocks(benchmark: DataFrame, masks, min_tokens: int, percent: int):
    """Seed tables of the benchmark, a bounded block of items at a time."""

    def hashed(batches):
        for batch in batches:
            w, off = tx.words(batch.column(1), clean=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary()), pa.array(np.diff(off), pa.int64())], ["item_id", "words", "n"]
            )

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(hashed, "item_id long, words binary, n long").where("n > 0")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TOKENS))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).collect()
        rows = sorted(((r["item_id"], np.frombuffer(r["words"], tx.U64)) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1].tobytes()))
        yield SeedTable(rows, masks, min_tokens, percent)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, min_tokens: int = MIN_TOKENS, percent: int = PERCENT) -> DataFrame:
    """One row for every document row and benchmark item that overlap, with the overlap's place."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for table in _blocks(benchmark, tuple(masks), min_tokens, percent):
        part = docs.mapInArrow(_overlap_rows(share(docs.sparkSession, table)), OVERLAP_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _overlap_rows(table_of):
    def run(batches):
        table = table_of()
        types = [pa.int64()] * 6
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b in tx.slices(batch.column(1)):
                rows = [(ids[a + r], table.ids[i], *rest) for r, i, *rest in table.overlaps(batch.column(1).slice(a, b - a))]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "doc_start", "item_start", "tokens", "equal_tokens"])

    return run


def remove(docs: DataFrame, benchmark: DataFrame, masks=MASKS, min_tokens: int = MIN_TOKENS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that overlap an item; all columns stay as they are."""

    def keep(table_of):
        def run(batches):
            table = table_of()
            for batch in batches:
                text = batch.column("text")
                for a, b in tx.slices(text):
                    kept = np.ones(b - a, bool)
                    kept[[r for r, *_ in table.overlaps(text.slice(a, b - a))]] = False
                    yield batch.slice(a, b - a).filter(pa.array(kept))

        return run

    for table in _blocks(benchmark, tuple(masks), min_tokens, percent):
        docs = docs.mapInArrow(keep(share(docs.sparkSession, table)), docs.schema)
    return docs
