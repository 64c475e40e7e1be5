"""Operator 1: hierarchical multi-length packing.

A document is its byte-BPE ids followed by one end id. Documents are cut into
whole windows of the longest tier plus a rest; the rest is *routed* to the
shortest tier (256, 512, 1024 or 2048 tokens) that holds it. In each block of
documents the tiers are *packed* from the longest to the shortest: a window
starts with one rest of its own tier, its gap is *filled* by the largest whole
rests of shorter tiers that fit, and what no whole rest fits is closed by
cutting the shortest rest left. All windows of every tier are thus full, so a
sequence is exactly 256, 512, 1024 or 2048 tokens and carries no padding; rests
without a partner are carried to the task's next block, and at the task's end
they are joined into longest-tier windows, of which only the last is padded.

Sequences of one tier are dealt to *step groups* of equal token counts; inside
a block the deal goes back and forth over the sequences sorted by attention
cost (sum of squared piece lengths), so that step groups cost about the same.

Every task packs the documents it reads and nothing is shuffled: the plan is
one scan and one Arrow map, a task holds one block of ids (``BLOCK_TOKENS``),
and a lost task is recomputed from its own split. ``sequence_id`` and
``step_group`` carry the task's number in their upper bits. The padding is at
most one partial window per task.

Defined results: a null or empty text is a document of the end id alone; a null
id is a row like any other (its pieces carry a null id); repeated rows are
packed once each; ties between equal rests keep reading order; an empty table
gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textops as tx
from corpuslab.llm.bpe import Encoder
from corpuslab.llm.shared import released

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 65_536
BLOCK_TOKENS = 1 << 20
_TASK_BITS = 33

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, sequence_tokens long, step_group long"
)


class BlockPacker:
    """Packs one task's documents block by block. ``rows`` of a sequence: (document number, start, length)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers))
        self.carried: list[tuple[int, int, int]] = []

    def block(self, docs: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Sequences (tier, pieces) that are full; rests that stay alone are carried on."""
        longest = self.tiers[-1]
        out, rests = [], {t: [] for t in self.tiers}
        pool = self.carried
        self.carried = []
        for doc, n in docs:
            whole = n // longest * longest
            out += [(longest, [(doc, s, longest)]) for s in range(0, whole, longest)]
            if n > whole:
                pool.append((doc, whole, n - whole))
        for piece in pool:
            rests[next(t for t in self.tiers if piece[2] <= t)].append(piece)
        # rests of the shorter tiers, by length; each list of one length is used from its end
        shorter: dict[int, list] = {}
        for t in self.tiers[:-1]:
            for piece in reversed(rests[t]):
                shorter.setdefault(piece[2], []).append(piece)
        lengths = sorted(shorter)

        def take(n: int):
            piece = shorter[n].pop()
            if not shorter[n]:
                del shorter[n]
                lengths.remove(n)
            return piece

        def give(piece) -> None:
            if piece[2] not in shorter:
                shorter[piece[2]] = []
                lengths.insert(bisect_right(lengths, piece[2]), piece[2])
            shorter[piece[2]].append(piece)

        def close(tier: int, pieces: list) -> None:
            gap = tier - sum(p[2] for p in pieces)
            while gap and lengths:
                k = bisect_right(lengths, gap)
                if k:  # the largest whole rest that fits
                    pieces.append(take(lengths[k - 1]))
                    gap -= pieces[-1][2]
                else:  # cut the shortest rest that is left
                    doc, s, n = take(lengths[0])
                    pieces.append((doc, s, gap))
                    give((doc, s + gap, n - gap))
                    gap = 0
            if gap:
                self.carried += pieces
            else:
                out.append((tier, pieces))

        for piece in sorted(rests[self.tiers[-1]], key=lambda p: -p[2]):
            close(longest, [piece])
        for tier in reversed(self.tiers[:-1]):
            while lengths and lengths[-1] > tier // 2 or lengths and tier == self.tiers[0]:
                if lengths[-1] > tier:  # cannot be: longer rests opened windows of their own tier before
                    raise AssertionError("a rest is longer than its tier")
                close(tier, [take(lengths[-1])])
        return out

    def last(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """The carried rests in windows of the longest tier, cut at their ends; the last may be partial."""
        longest, out, room = self.tiers[-1], [], 0
        for doc, s, n in self.carried:
            while n:
                if not room:
                    out.append((longest, []))
                    room = longest
                k = min(room, n)
                out[-1][1].append((doc, s, k))
                s, n, room = s + k, n - k, room - k
        self.carried = []
        return out


def deal_steps(sequences: list, step_tokens: int, first: dict[int, int]) -> list[tuple[int, int]]:
    """(tier number, step number) of each sequence; ``first`` counts the steps each tier has used."""
    out = [(0, 0)] * len(sequences)
    tiers = sorted({t for t, _ in sequences})
    for t in tiers:
        own = [i for i, (tier, _) in enumerate(sequences) if tier == t]
        cost = {i: sum(n * n for _, _, n in sequences[i][1]) for i in own}
        own.sort(key=lambda i: (-cost[i], i))
        groups = -(-len(own) // max(1, step_tokens // t))
        for rank, i in enumerate(own):
            turn, k = divmod(rank, groups)
            out[i] = (t, first.get(t, 0) + (k if turn % 2 == 0 else groups - 1 - k))
        first[t] = first.get(t, 0) + groups
    return out


def _pack_task(batches, vocabulary: str, tiers, end_id: int, step_tokens: int, block_tokens: int, with_ids: bool):
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() << _TASK_BITS
    encoder, packer = Encoder(vocabulary), BlockPacker(tiers)
    docs: dict[int, tuple] = {}  # number: (id, ids); those of this block and carried ones
    pending: list[tuple[int, int]] = []
    state = {"seq": 0, "held": 0, "next": 0}
    steps: dict[int, int] = {}

    def rows(sequences):
        cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "sequence_tokens", "step_group", "ids")}
        for (tier, pieces), (_, step) in zip(sequences, deal_steps(sequences, step_tokens, steps)):
            offset, total = 0, sum(n for _, _, n in pieces)
            for doc, s, n in pieces:
                key, ids = docs[doc]
                part = ids[s : s + n].tobytes()
                for k, v in (("doc_id", key), ("start", s), ("length", n), ("ids_crc32", zlib.crc32(part)), ("doc_tokens", len(ids)), ("sequence_id", task + state["seq"]), ("offset", offset), ("tier", tier), ("sequence_tokens", total), ("step_group", task + step * len(tiers) + tiers.index(tier))):
                    cols[k].append(v)
                if with_ids:
                    cols["ids"].append(part)
                offset += n
            state["seq"] += 1
        types = {k: pa.int64() for k in cols} | {"tier": pa.int32(), "ids": pa.binary()}
        names = [k for k in cols if k != "ids" or with_ids]
        return pa.RecordBatch.from_arrays([pa.array(cols[k], types[k]) for k in names], names)

    def flush(end: bool):
        sequences = packer.block(pending)
        if end:
            sequences += packer.last()
        pending.clear()
        batch = rows(sequences)
        alive = {d for d, _, _ in packer.carried}
        for d in [d for d in docs if d not in alive]:
            del docs[d]
        state["held"] = 0
        return batch

    for batch in batches:
        keys, text = batch.column(0), batch.column(1)
        for a, b in tx.slices(text, 1 << 20):
            ids, off = encoder.column(text.slice(a, b - a))
            for i, key in enumerate(keys.slice(a, b - a).to_pylist()):
                own = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)).astype("<u4")
                docs[state["next"]] = (key, own)
                pending.append((state["next"], len(own)))
                state["next"] += 1
                state["held"] += len(own)
            if state["held"] >= block_tokens:
                yield flush(False)
    if pending or packer.carried:
        yield flush(True)


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    ``vocabulary_path`` names a tokenizer JSON that the driver reads (a few MB) and ships to the tasks.
    ``with_ids`` adds the piece's ids as little-endian 32-bit integers.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        released(lambda batches: _pack_task(batches, vocabulary.value, tiers, end_id, step_tokens, block_tokens, with_ids)), schema
    )
