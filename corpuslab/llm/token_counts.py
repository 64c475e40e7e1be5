"""Operator 12: token counts of byte-level BPE vocabularies, without making the tokens.

A byte-level BPE cuts a text into pieces and merges adjacent symbols inside each piece only, from its
single bytes upwards, always the pair of the lowest rank (of equal ones the leftmost). Every merge turns two symbols into one, so a
piece counts its bytes minus its merges. :func:`merges` finds that number with a heap of the mergeable adjacent
pairs over a doubly linked list of symbols: the lowest rank is popped, stale entries (a symbol already merged away or
changed) are dropped, and the at most two new neighbours are pushed, so a piece of ``n`` bytes takes ``O(n log n)``
whatever it looks like. Token ids are never built or emitted.

Pieces are found with numpy over a whole column slice; each distinct piece is merged once and its count kept in a cache of
at most ``CACHE_PIECES`` entries. Texts with characters whose class the table of :mod:`corpuslab.llm.bpe` does not
state are cut by the library's own pre-tokenizer. Strings of added special tokens inside a text count
one token each and part the text around them, as the library does by default.

Everything is map-only: nothing is shuffled, collected or broadcast but the vocabulary (a few MB), and a lost task is
simply run again.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row; a null id stays
null; very long texts are counted whole (their task holds the text and about 40 bytes a character); an empty table gives
an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textops as tx
from corpuslab.llm.bpe import _TABLE, Encoder

CACHE_PIECES = 1 << 19  # distinct pieces whose counts a worker keeps, about 60 MB; then the cache starts anew
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters for
    themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class MergeTable:
    """The merge ranks of a tokenizer JSON: ``pairs[a << 32 | b]`` is the rank of a pair of symbols, ``made[rank]`` the symbol it becomes.
    Symbols 0 to 255 are the bytes."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only plain byte-level BPE vocabularies can be counted")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their surroundings cannot be counted")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=lambda s: (-len(s), s))
        number = {c: b for b, c in enumerate(byte_alphabet())}
        missing = [c for c in number if c not in model["vocab"]]
        if missing:
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.made.append(number.setdefault(a + b, len(number)))
            self.pairs[number[a] << 32 | number[b]] = rank


def merges(piece: bytes, pairs: dict[int, int], made: list[int]) -> int:
    """How many merges a piece undergoes.

    ``rank[i]`` is the rank of the pair that begins at symbol ``i`` now, or -1; a popped entry of another rank is stale.
    """
    symbol = list(piece)
    n = len(symbol)
    get = pairs.get
    rank = [get(a << 32 | b, -1) for a, b in zip(symbol, symbol[1:])]
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return 0
    rank.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    done = 0
    while heap:
        entry = pop(heap)
        r, i = entry >> 32, entry & 0xFFFFFFFF
        if rank[i] != r:
            continue
        done += 1
        j = after[i]
        merged = symbol[i] = made[r]
        rank[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = rank[i] = get(merged << 32 | symbol[k], -1)
            if r >= 0:
                push(heap, r << 32 | i)
        else:
            rank[i] = -1
        h = before[i]
        if h >= 0:
            r = rank[h] = get(symbol[h] << 32 | merged, -1)
            if r >= 0:
                push(heap, r << 32 | h)
    return done


class Counter:
    """Counts tokens of columns of texts; built in a task from the vocabulary's JSON."""

    def __init__(self, vocabulary: str, cache_pieces: int = CACHE_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cut = Tokenizer.from_str(vocabulary).pre_tokenizer
        self.table = MergeTable(vocabulary)
        self.special = re.compile("|".join(map(re.escape, self.table.special))) if self.table.special else None
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.limit = cache_pieces
        self.cache: dict[int, int] = {}  # by the hash of a piece's characters
        self.slow: dict[str, int] = {}  # by a piece as the library writes it

    def column(self, col) -> np.ndarray:
        """Token counts of all rows; null counts 0."""
        data, offsets = tx.column_bytes(col)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        text = data.tobytes().decode("utf-8")
        head = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=head[1:])
        chars = head[offsets]
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        cls = _TABLE[np.minimum(cp, len(_TABLE) - 1)]
        starts = Encoder._piece_starts(cp, cls, chars)
        count = self._pieces(cp, starts, text)
        total = np.concatenate([[0], np.cumsum(count)])
        out = np.diff(total[np.searchsorted(starts, chars)])
        apart = np.zeros(n, bool)
        odd = np.flatnonzero(cls == 4)
        apart[np.searchsorted(chars, odd, "right") - 1] = True
        if self.special is not None and self.special.search(text):
            for s in self.table.special:
                apart |= np.asarray(pc.fill_null(pc.match_substring(col.cast(pa.large_string()), s), False), dtype=bool)
        for i in np.flatnonzero(apart).tolist():
            out[i] = self.one(text[chars[i] : chars[i + 1]])
        return out

    def _pieces(self, cp: np.ndarray, starts: np.ndarray, text: str) -> np.ndarray:
        """Counts of the pieces that begin at ``starts``; each distinct one is merged once."""
        index = np.arange(len(cp), dtype=np.int64)
        first = np.zeros(len(cp), np.int64)
        first[starts] = starts
        index -= np.maximum.accumulate(first)
        power = np.ones(int(index.max()) + 1, dtype=tx.U64)
        power[1:] = tx.U64(0x9E3779B97F4A7C15)
        np.multiply.accumulate(power, out=power)
        keys = tx.mix(np.add.reduceat(tx.mix(cp.astype(tx.U64) + tx.U64(0x5851F42D4C957F2D)) * power[index], starts))
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.cache) + len(distinct) > self.limit:
            self.cache.clear()
        ends = np.append(starts[1:], len(cp))
        known, cache, table = distinct.tolist(), self.cache, self.table
        counts = np.empty(len(known), np.int64)
        for i, key in enumerate(known):
            count = cache.get(key)
            if count is None:
                piece = text[starts[where[i]] : ends[where[i]]].encode("utf-8")
                count = cache[key] = len(piece) - merges(piece, table.pairs, table.made)
            counts[i] = count
        return counts[inverse]

    def one(self, text: str) -> int:
        """The count of one text whose pieces the library finds; special strings count one each."""
        total, at = 0, 0
        for found in self.special.finditer(text) if self.special is not None else ():
            total += 1 + self._segment(text[at : found.start()])
            at = found.end()
        return total + self._segment(text[at:])

    def _segment(self, text: str) -> int:
        total = 0
        for piece, _ in self.cut.pre_tokenize_str(text) if text else ():
            count = self.slow.get(piece)
            if count is None:
                if len(self.slow) >= self.limit:
                    self.slow.clear()
                raw = bytes(self.byte[c] for c in piece)
                count = self.slow[piece] = len(raw) - merges(raw, self.table.pairs, self.table.made)
            total += count
        return total


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``: UTF-8 bytes, tokens, and whether they exceed ``limit``.

    ``vocabulary_path`` names a tokenizer JSON that the driver reads (a few MB) and ships to the tasks.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    MergeTable(text)  # fail here, not in a task
    vocabulary = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches):
        counter = Counter(vocabulary.value, cache_pieces)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in tx.slices(texts):
                col = texts.slice(a, b - a)
                size = pc.fill_null(pc.binary_length(col.cast(pa.large_string())), 0).cast(pa.int64())
                tokens = counter.column(col)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), size, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
