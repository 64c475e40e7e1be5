"""Operator 6: Brown class-based bigram language model.

P(w | w') = P(c(w) | c(w')) P(w | c(w)): every training word has one of ``CLASSES`` classes.

* The seed, the ``FREQUENT`` most frequent training words, is clustered on the driver by exchange: each word in turn moves to
  the class that raises the likelihood of the class bigrams most, until a sweep moves nothing.
* Spark then sums the neighbour symbols of every other training word, and each word goes to the class of the
  largest exchange gain against the broadcast class matrix. The words of a sweep move at once, the matrix follows, and sweeps go on until
  at most ``FEW`` of the words move (at most ``PLACE_SWEEPS`` of them in the last round, ``FIRST_SWEEPS`` before; ``moved`` and ``placed`` of the model say how it ended). In the first
  round a neighbour below the seed stands for its shape (last byte and whether it holds non-ASCII letters); in each further one (``ROUNDS`` in all) for its class.
* Unseen words only belong to the shapes; the end of text is a class of its own.
* Class transitions are interpolated with the class frequencies (``PRIOR`` pseudo counts).
* Emissions are relative frequencies. A training word seen once counts in its class with 1 - d and as an unseen word of its shape with d
  (the discount from the counts of counts), so the model has one unknown word for each shape.

All counts are taken over all training texts: tasks turn texts into chunks of about two million word codes, written once.
The driver holds the model only: seed bigrams, class matrices, ``KNOWN`` word counts and classes. The other words of a chunk are looked up in the full table of
words: the chunk's distinct words are dealt to hash ranges, met there by that range of the table, and counts and classes
go back to the chunk, which stays out of the lookup. A frequent word costs one entry per chunk.

Defined results: a null or empty text is the end token alone; a null id has
the remainder of the empty text; repeated rows are counted each and get equal scores; with no training
row N = V = 0, every token is unknown, the base is 0 a token, and the score uses uniform classes; an empty table gives no rows; ties in frequency go to the smaller hash; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import stage
from corpuslab.llm import textops as tx
from corpuslab.llm.shared import share

FREQUENT = 2_000
CLASSES = 48
KNOWN = 1 << 16
PRIOR = 20.0
SWEEPS = 20
CHUNK_WORDS = 2_000_000
RANGE_WORDS = 300_000
ASKED_WORDS = 2_000_000  # words that one lookup task is asked for
ENTRIES = 4_000_000  # neighbour counts of one hash range, before they are summed
ROUNDS = 2
FIRST_SWEEPS = 2  # of the rounds before the last
PLACE_SWEEPS = 5
FEW = 0.01  # of the words below the seed; sweeps end when no more move

_GROUPS = 24  # groups of last bytes
OPEN = 2 * _GROUPS
END = tx.U64(0x0E0D0E0D0E0D0E0D)

_LAST = np.zeros(256, np.int64)
_LAST[97:123] = np.arange(26) % (_GROUPS - 3)
_LAST[65:91] = _LAST[97:123]
_LAST[48:58] = _GROUPS - 3
_LAST[128:] = _GROUPS - 2
_LAST[[c for c in range(128) if not chr(c).isalnum()]] = _GROUPS - 1


def sequence(col):
    """Word hashes of all rows, each row closed by END; their open classes (-1 for END); row offsets."""
    h, data, starts, ends, off = tx.hashed_spans(col)
    n = len(off) - 1
    size = np.diff(off)
    total = np.concatenate([[0], np.cumsum(size + 1)])
    seq = np.full(int(total[-1]), END, dtype=tx.U64)
    shape = np.full(len(seq), -1, np.int8)
    if len(h):
        at = np.arange(len(h)) + np.repeat(np.arange(n), size)
        high = np.concatenate([[0], np.cumsum(data >= 128)])
        seq[at] = h
        shape[at] = _LAST[data[ends - 1]] + _GROUPS * (high[ends] > high[starts])
    return seq, shape, total


def _word_counts(batches):
    """(word, shape, n) of chunks: words are counted before they leave the task."""
    held, total = [], 0

    def chunk():
        seq = np.concatenate([s for s, _ in held])
        shape = np.concatenate([s for _, s in held])
        words, first, n = np.unique(seq, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(shape[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "shape", "n"])

    for batch in batches:
        for a, b in tx.slices(batch.column(0)):
            seq, shape, _ = sequence(batch.column(0).slice(a, b - a))
            held.append((seq, shape))
            total += len(seq)
            if total >= CHUNK_WORDS:
                yield chunk()
                held, total = [], 0
    if held:
        yield chunk()


def _pack(x: np.ndarray) -> bytes:
    """An array as compressed byte planes; small numbers leave the high planes empty."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpack(b: bytes, kind) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Units:
    """The frequent words every task knows: hashes, counts and shapes in order of falling counts, without END.

    A token's code is 0 for END, 1 + rank for a known word, and from 1 + the number of known words on for the other words of a chunk.
    """

    def __init__(self, known: np.ndarray, counts: np.ndarray, shapes: np.ndarray, frequent: int):
        self.frequent = min(frequent, len(known))
        order = np.argsort(known)
        self.sorted, self.rank, self.count = known[order], order, counts[order]
        self.words, self.counts, self.shapes = known, counts, shapes
        self.size = self.frequent + OPEN + 1

    def find(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into the sorted known words and whether the word is there."""
        if not len(self.sorted):
            return np.zeros(len(seq), np.int64), np.zeros(len(seq), bool)
        at = np.minimum(np.searchsorted(self.sorted, seq), len(self.sorted) - 1)
        return at, self.sorted[at] == seq

    def shape_of(self, other: np.ndarray) -> np.ndarray:
        """The shape of every code but END's."""
        return np.concatenate([self.shapes, other]).astype(np.int64)


def _chunks(units_of):
    """Documents in chunks of ``CHUNK_WORDS``: ids, tokens per document, codes, and the chunk's other words in ascending order with their shapes."""

    def run(batches):
        from pyspark import TaskContext

        units = units_of()
        task, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        total = 0

        def chunk():
            seq, shape = (np.concatenate([h[i] for h in held]) for i in (2, 3))
            at, there = units.find(seq)
            there &= shape >= 0
            other = np.flatnonzero(~there & (shape >= 0))
            words, first, place = np.unique(seq[other], return_index=True, return_inverse=True)
            code = np.zeros(len(seq), np.int32)
            if len(units.sorted):
                code[there] = units.rank[at[there]] + 1
            code[other] = place + 1 + len(units.sorted)
            ids = pa.concat_arrays([h[0] for h in held])
            size = np.concatenate([h[1] for h in held]).astype(np.int32)
            blobs = [_pack(size), _pack(code), _pack(np.diff(words, prepend=tx.U64(0))), _pack(shape[other][first])]
            return pa.RecordBatch.from_arrays(
                [pa.array([task + number]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([len(words)]), *(pa.array([x], pa.binary()) for x in blobs)],
                ["chunk", "ids", "asked", "sizes", "codes", "words", "shapes"],
            )

        for batch in batches:
            for a, b in tx.slices(batch.column(1)):
                seq, shape, off = sequence(batch.column(1).slice(a, b - a))
                held.append((batch.column(0).slice(a, b - a), np.diff(off), seq, shape))
                total += len(seq)
                if total >= CHUNK_WORDS:
                    yield chunk()
                    held, total, number = [], 0, number + 1
        if held:
            yield chunk()

    return run


_CHUNK = "chunk long, ids array<long>, asked long, sizes binary, codes binary, words binary, shapes binary"


def _words(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, tx.U64), dtype=tx.U64)


def _bigram_counts(units_of):
    """Counts of unit bigrams; units are the clustered words, the shapes of all others, and END."""

    def run(batches):
        units = units_of()
        for batch in batches:
            for codes, shapes in zip(*(batch.column(k).to_pylist() for k in ("codes", "shapes"))):
                unit = np.concatenate([[units.size - 1], units.frequent + units.shape_of(_unpack(shapes, np.int8))])
                unit[1 : 1 + units.frequent] = np.arange(units.frequent)
                u = unit[_unpack(codes, np.int32)]
                pair, n = np.unique(np.concatenate([[units.size - 1], u[:-1]]) * units.size + u, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    return run


def _packed(batches):
    """Summed pairs as one row of two arrays per batch, so the driver takes them a partition at a time."""
    for batch in batches:
        rows = [[batch.column(k).to_numpy().astype(np.int64).tobytes()] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in rows], ["pair", "n"])


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, movable: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of every unit: ``movable`` units share ``classes`` classes, each other unit is a class of its own.

    Starts with units dealt by rank and moves one unit at a time to the class with the largest class-bigram likelihood.
    """
    units = len(bigrams)
    classes = max(1, min(classes, movable)) if movable else 0
    k = classes + units - movable
    cls = np.concatenate([np.arange(movable) % max(1, classes), classes + np.arange(units - movable)]).astype(np.int64)
    one = np.zeros((units, k))
    one[np.arange(units), cls] = 1
    right, left = bigrams @ one, bigrams.T @ one  # counts of each unit with the classes after and before it
    g = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            a, r, l, own = cls[w], right[w].copy(), left[w].copy(), bigrams[w, w]
            r[a] -= own
            l[a] -= own  # without the unit itself
            h = g.copy()
            h[a] -= r
            h[:, a] -= l
            h[a, a] -= own
            rows, cols = h.sum(1), h.sum(0)
            row_gain = _xlogx(h[:classes] + r) - _xlogx(h[:classes])
            col_gain = _xlogx(h[:, :classes].T + l) - _xlogx(h[:, :classes].T)
            d = np.arange(classes)
            diagonal = _xlogx(h[d, d] + r[d] + l[d] + own) - _xlogx(h[d, d])
            gain = row_gain.sum(1) + col_gain.sum(1) - row_gain[d, d] - col_gain[d, d] + diagonal
            gain -= _xlogx(rows[:classes] + r.sum() + own) - _xlogx(rows[:classes])
            gain -= _xlogx(cols[:classes] + l.sum() + own) - _xlogx(cols[:classes])
            # the unit's own bigrams with classes whose margins it does not change cancel between targets
            b = int(gain.argmax())
            if b != a and gain[b] > gain[a] + 1e-9:
                cls[w] = b
                moved += 1
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
                g = h
                g[b] += r
                g[:, b] += l
                g[b, b] += own
        if not moved:
            break
    return cls


class Model:
    """Classes, transitions and emissions; all logarithms are to base 10.

    Symbols: ``k`` classes, ``OPEN`` shapes of unseen words, END. ``moved`` and ``placed`` count the words that
    the last sweep over the words below the seed moved, and those it went over.
    """

    def __init__(self, units: Units, k: int, tokens: int, distinct: int, ends: int, n1: int, n2: int):
        self.units, self.k, self.tokens, self.distinct, self.ends = units, k, tokens, distinct, ends
        self.symbols = k + OPEN + 1
        self.discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
        self.cls = k + units.shapes.astype(np.int64)  # of the known words; those not placed yet stand for their shape
        self.moved = self.placed = 0
        self.sweeps: list[tuple] = []
        self.log_base_total = math.log10(tokens + distinct + 1)
        self.mass = np.zeros(OPEN)  # training words in the shapes: none
        self.finish(np.zeros((2, self.symbols, self.symbols)))

    def finish(self, g: np.ndarray) -> None:
        """Transitions from the class bigrams of the training texts, once with words seen once in their classes, once in their shapes."""
        g = (1 - self.discount) * g[0] + self.discount * g[1]
        share_of = (g.sum(0) + 1) / (g.sum() + self.symbols)
        self.log_next = np.log10((g + PRIOR * share_of) / (g.sum(1, keepdims=True) + PRIOR))
        self.class_mass = g.sum(0)

    def log_emission(self, count: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of a word with a training count in its class; the unseen word of a shape has all of it, and so has END."""
        own = np.where(count == 1, 1 - self.discount, np.maximum(count, 1))
        return np.where((count > 0) & (symbol < self.k), np.log10(own / np.maximum(self.class_mass[symbol], 1e-9)), 0.0)

    def log_base(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + 1.0) - self.log_base_total

    def tables(self, shapes: np.ndarray, count: np.ndarray | None, cls: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Count and symbol of every code of a chunk; without counts its other words stand for their shapes."""
        none = np.zeros(len(shapes), np.int64)
        count = none if count is None else count
        own = self.k + shapes.astype(np.int64) if cls is None else np.where(cls >= 0, cls, self.k + shapes.astype(np.int64))
        return np.concatenate([[self.ends], self.units.counts, count]), np.concatenate([[self.symbols - 1], self.cls, own])


def _split(total: int, most: int) -> int:
    """Bits of a hash that cut ``total`` entries into parts of about ``most``."""
    return max(0, math.ceil(math.log2(max(1, total / most))))


def _asks(bits: int, parts: int):
    """The other words of each chunk, dealt to hash ranges; a range is split further by the chunk."""

    def run(batches):
        for batch in batches:
            for me, blob in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist()):
                words = _words(blob)
                if not len(words):
                    continue
                part = int(tx.mix(np.array([me], dtype=tx.U64))[0]) % parts
                bucket = (words >> tx.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
                found, at = np.unique(bucket, return_index=True)
                ends = np.append(at[1:], len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found * parts + part, pa.int32()), pa.array([me] * len(found), pa.int64()), pa.array([words[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())],
                    ["bucket", "chunk", "words"],
                )

    return run


def _look_up(key, asked: pa.Table, table: pa.Table) -> pa.Table:
    """Counts and classes of the asked words of one hash range, sent back to their chunks."""
    word = table.column("word").to_numpy().view(tx.U64)
    order = np.argsort(word)
    word, n, cls = word[order], table.column("n").to_numpy()[order], table.column("cls").to_numpy()[order]
    out: list[list] = [[], []]
    for blob in asked.column("words"):
        w = np.frombuffer(blob.as_buffer(), tx.U64)
        at = np.minimum(np.searchsorted(word, w), max(0, len(word) - 1))
        hit = word[at] == w if len(word) else np.zeros(len(w), bool)
        for o, values, none, kind in ((out[0], n, 0, np.int64), (out[1], cls, -1, np.int16)):
            o.append(_pack(np.where(hit, values[at], none).astype(kind) if len(word) else np.full(len(w), none, kind)))
    return pa.table([asked.column("bucket"), asked.column("chunk"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["bucket", "chunk", "counts", "cls"])


def _answered(chunks: DataFrame, table: DataFrame, distinct: int, apply, schema: str) -> DataFrame:
    """``apply`` on every chunk with the counts and classes of its other words.

    Only chunk numbers and words meet the table (word, n, cls): ranges are bounded by its words, and each
    range's parts, which repeat its counts, by the words that chunks ask for.
    """
    bits = _split(distinct, RANGE_WORDS)
    asked = chunks.agg(F.sum("asked")).first()[0] or 0
    parts = 1 << _split(asked, ASKED_WORDS << bits)
    low = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)
    table = table.select("word", "n", "cls", F.explode(F.sequence(low * parts, low * parts + (parts - 1))).alias("bucket"))
    asks = chunks.select("chunk", "words").mapInArrow(_asks(bits, parts), "bucket int, chunk long, words binary")
    answers = asks.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_look_up, "bucket int, chunk long, counts binary, cls binary")

    def one(key, home: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("bucket").to_numpy())
        count, cls = (np.concatenate([np.zeros(0, kind), *(_unpack(x, kind) for x in found.column(k).take(order).to_pylist())]) for k, kind in (("counts", np.int64), ("cls", np.int16)))
        return pa.Table.from_batches([apply(home.to_pylist()[0], count, cls)])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(one, schema)


_CONTEXTS = "bucket int, words binary, cls binary, sizes binary, slots binary, n binary"


def _matrices(model: Model, code: np.ndarray, count: np.ndarray, symbol: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Symbol bigrams of a chunk: words seen once in their classes, and in their shapes."""
    once = np.where((count == 1) & (symbol < model.k), model.k + np.concatenate([[0], model.units.shape_of(shapes)]), symbol)
    once[0] = symbol[0]
    out = []
    for s in (symbol, once):
        c = s[code]
        out.append(np.bincount(np.concatenate([[s[0]], c[:-1]]) * model.symbols + c, minlength=model.symbols**2))
    return np.stack(out)


def _contexts(model_of, bits: int | None):
    """A chunk's neighbour symbols of every word below the seed, dealt to hash ranges, and its symbol bigrams as range -1."""

    def apply(home: dict, count=None, cls=None) -> pa.RecordBatch:
        model = model_of()
        units, code, shapes = model.units, _unpack(home["codes"], np.int32), _unpack(home["shapes"], np.int8)
        count, symbol = model.tables(shapes, count, cls)
        rows = [(-1, b"", b"", b"", b"", _pack(_matrices(model, code, count, symbol, shapes).astype(np.int64).ravel()))]
        at = np.flatnonzero(code > units.frequent)
        if bits is not None and len(at):
            c = symbol[code]
            wide = 2 * model.symbols
            own = code[at].astype(np.int64) * wide
            key, n = np.unique(np.concatenate([own + c[at + 1], own + model.symbols + np.append(c[-1:], c)[at]]), return_counts=True)
            who, first, size = np.unique(key // wide, return_index=True, return_counts=True)
            words = np.concatenate([[END], units.words, _words(home["words"])])[who]
            start = np.where(symbol[who] < model.k, symbol[who], -1).astype(np.int16)
            bucket = (words >> tx.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
            order = np.lexsort((words, bucket))
            ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
            for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
                o = order[a:b]
                e = np.repeat(first[o] - np.concatenate([[0], np.cumsum(size[o])[:-1]]), size[o]) + np.arange(size[o].sum())
                rows.append((int(bucket[o[0]]), _pack(np.diff(words[o], prepend=tx.U64(0))), _pack(start[o]), _pack(size[o].astype(np.int32)), _pack((key[e] % wide).astype(np.int16)), _pack(n[e].astype(np.int32))))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["bucket", "words", "cls", "sizes", "slots", "n"])

    return apply


def _over_chunks(apply):
    def run(batches):
        for batch in batches:
            for home in batch.to_pylist():
                yield apply(home)

    return run


def _summed(wide: int):
    """One row for each hash range: its words, each with its summed neighbour symbols."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = np.concatenate([_words(r["words"]) for r in rows])
        size = np.concatenate([_unpack(r["sizes"], np.int32) for r in rows])
        word, first, place = np.unique(words, return_index=True, return_inverse=True)
        start = np.concatenate([_unpack(r["cls"], np.int16) for r in rows])[first]
        key = np.repeat(place, size) * wide + np.concatenate([_unpack(r["slots"], np.int16) for r in rows])
        key, where = np.unique(key, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([_unpack(r["n"], np.int32) for r in rows])).astype(np.int64)
        size = np.bincount(key // wide, minlength=len(word)).astype(np.int32)
        cols = [_pack(np.diff(word, prepend=tx.U64(0))), _pack(start), _pack(size), _pack((key % wide).astype(np.int16)), _pack(n)]
        return pa.table([table.column("bucket").slice(0, 1), *(pa.array([x], pa.binary()) for x in cols)], names=["bucket", "words", "cls", "sizes", "slots", "n"])

    return run


def best_class(matrix: np.ndarray, entry: np.ndarray, slot: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The class of the largest exchange gain of every word, whose entries (word, slot, n) are its neighbours.

    ``matrix`` (classes x slots) counts the classes' neighbours, first those after, then those before; words leave their class ``cls`` first (-1: none).
    """
    k, half = len(matrix), matrix.shape[1] // 2
    gain = np.zeros((len(cls), k))
    few = np.minimum(n, 33)
    step = np.zeros((33, matrix.shape[1], k))
    for i in range(1, 33):
        step[i] = (_xlogx(matrix + i) - _xlogx(matrix)).T
    at = np.flatnonzero(np.diff(entry, prepend=-1))
    a = 0
    while a < len(at):  # entries at a time, to bound the memory
        b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 16))))
        x, y = at[a], at[b] if b < len(at) else len(entry)
        s, m = slot[x:y], n[x:y]
        add = step[few[x:y] % 33, s]
        big = np.flatnonzero(m > 32)
        add[big] = _xlogx(matrix[:, s[big]].T + m[big, None]) - _xlogx(matrix[:, s[big]].T)
        gain[entry[at[a:b]]] = np.add.reduceat(add, at[a:b] - x, axis=0)
        a = b
    sums = np.stack([matrix[:, :half].sum(1), matrix[:, half:].sum(1)])
    own = np.stack([np.bincount(entry, weights=n * side, minlength=len(cls)) for side in (slot < half, slot >= half)])
    for m, o in zip(sums, own):
        gain -= _xlogx(m[None, :] + o[:, None]) - _xlogx(m)[None, :]
    inside = np.flatnonzero(cls >= 0)
    if len(inside):  # without the word itself
        c = cls[entry]
        e = np.flatnonzero(c >= 0)
        g = matrix[c[e], slot[e]]
        without = np.bincount(entry[e], weights=_xlogx(g) - _xlogx(np.maximum(g - n[e], 0)), minlength=len(cls))[inside]
        for m, o in zip(sums, own):
            m = m[cls[inside]]
            without -= _xlogx(m) - _xlogx(np.maximum(m - o[inside], 0))
        gain[inside, cls[inside]] = without + 1e-9
    return gain.argmax(1)


def placed(matrix: np.ndarray, size: np.ndarray, slot: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """:func:`best_class` of words with ``size`` ascending slots each; words seen once with equal neighbours and class are judged once."""
    k, wide = matrix.shape
    begin = np.cumsum(size) - size
    last = begin + size - 1
    once = (size == 2) & (n[begin] == 1) & (n[last] == 1) & (slot[begin] < wide // 2) & (slot[last] >= wide // 2)
    out = np.empty(len(size), np.int64)
    key, place = np.unique((slot[begin[once]] * wide + slot[last[once]]) * (k + 1) + cls[once] + 1, return_inverse=True)
    pair = key // (k + 1)
    out[once] = best_class(matrix, np.repeat(np.arange(len(key)), 2), np.column_stack([pair // wide, pair % wide]).ravel(), np.ones(2 * len(key), np.int64), key % (k + 1) - 1)[place]
    rest = np.repeat(~once, size)
    out[~once] = best_class(matrix, np.repeat(np.arange(int((~once).sum())), size[~once]), slot[rest], n[rest], cls[~once])
    return out


def _placed(model_of, last: bool):
    """Every word goes through the sweeps' matrices. The sums by which it changes them and the number of moved words, or at the ``last`` the classes."""

    def run(batches):
        model = model_of()
        wide = 2 * model.symbols
        change, moved, total = np.zeros((model.k, wide)), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                size, slot, n = _unpack(row["sizes"], np.int32), _unpack(row["slots"], np.int16).astype(np.int64), _unpack(row["n"], np.int64)
                start = _unpack(row["cls"], np.int16).astype(np.int64)
                entry, cls = np.repeat(np.arange(len(size)), size), start
                for matrix in model.sweeps:
                    before, cls = cls, placed(matrix, size, slot, n, cls)
                if last:
                    right = np.bincount(entry, weights=n * (slot < model.symbols), minlength=len(size)).astype(np.int64)  # one for each token
                    yield pa.RecordBatch.from_arrays([pa.array(_words(row["words"]).view(np.int64)), pa.array(right), pa.array(cls.astype(np.int16))], ["word", "n", "cls"])
                    continue
                moved, total = moved + int((before != cls).sum()), total + len(cls)
                for c, sign in ((cls, 1), (start, -1)):
                    e = np.flatnonzero(c[entry] >= 0)
                    change += sign * np.bincount(c[entry[e]] * wide + slot[e], weights=n[e], minlength=change.size).reshape(change.shape)
        if not last and total:
            yield pa.RecordBatch.from_arrays([pa.array([moved]), pa.array([total]), pa.array([change.tobytes()], pa.binary())], ["moved", "total", "change"])

    return run


def _sum_of_matrices(rows: DataFrame, model: Model) -> np.ndarray:
    def run(batches):
        total = np.zeros(2 * model_symbols**2, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                total += _unpack(b, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    model_symbols = model.symbols
    out = np.zeros(2 * model_symbols**2, np.int64)
    for r in rows.where("bucket = -1").select("n").mapInArrow(run, "n binary").toLocalIterator():
        out += np.frombuffer(r["n"], np.int64)
    return out.reshape(2, model_symbols, model_symbols).astype(float)


def _place(rows: DataFrame, model: Model, matrix: np.ndarray, sweeps: int) -> DataFrame:
    """(word, n, cls) of all words below the seed: sweeps over their summed neighbours until at most ``FEW`` of them move."""
    spark = rows.sparkSession
    summed = stage.written(rows.where("bucket >= 0").groupBy("bucket").applyInArrow(_summed(2 * model.symbols), _CONTEXTS), "contexts")
    model.sweeps = [matrix]
    for _ in range(sweeps):
        model.moved = model.placed = 0
        change = np.zeros(matrix.shape)
        for r in summed.mapInArrow(_placed(share(spark, model), False), "moved long, total long, change binary").collect():
            model.moved, model.placed = model.moved + r["moved"], model.placed + r["total"]
            change += np.frombuffer(r["change"]).reshape(matrix.shape)
        if model.moved <= FEW * model.placed:
            break
        if len(model.sweeps) < sweeps:
            model.sweeps.append(np.maximum(matrix + change, 0))
    found = stage.written(summed.mapInArrow(_placed(share(spark, model), True), "word long, n long, cls short"), "classes-of-words")
    model.sweeps = []
    return found


def fit(texts: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES, known: int = KNOWN, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the full table of words without END (word, a hash, n, cls) of the training ``texts`` (text)."""
    spark = texts.sparkSession
    texts = texts.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.select("text").mapInArrow(_word_counts, "word long, shape int, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    counts = stage.written(counts, "word-counts")
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("shape") < 0, F.col("n"))), *(F.count_if((F.col("shape") >= 0) & (F.col("n") == i)) for i in (1, 2))).first()
    top = counts.where("shape >= 0").orderBy(F.desc("n"), "word").limit(known).select("word", "n", "shape").toPandas()
    units = Units(top["word"].to_numpy(np.int64).view(tx.U64), top["n"].to_numpy(np.int64), top["shape"].to_numpy(np.int64), frequent)
    held = share(spark, units)
    chunks = stage.written(texts.mapInArrow(_chunks(held), _CHUNK), "train-chunks")
    pairs = chunks.select("codes", "shapes").mapInArrow(_bigram_counts(held), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    bigrams = np.zeros((units.size, units.size))
    for r in pairs.mapInArrow(_packed, "pair binary, n binary").toLocalIterator():
        bigrams.flat[np.frombuffer(r["pair"], np.int64)] = np.frombuffer(r["n"], np.int64)
    cls = exchange(bigrams, units.frequent, classes)
    k = int(cls.max()) - OPEN
    model = Model(units, k, int(total[0] or 0), int(total[1]), int(total[2] or 0), int(total[3]), int(total[4]))
    model.cls[: units.frequent] = cls[: units.frequent]
    one = np.zeros((units.size, model.symbols))
    one[np.arange(units.size), cls] = 1
    g = one.T @ bigrams @ one
    seed = top[["word", "n"]].iloc[: units.frequent].astype("int64").assign(cls=cls[: units.frequent].astype("int16"))
    table = seed = spark.createDataFrame(seed if len(seed) else [], "word long, n long, cls short")
    rest = model.tokens - model.ends - int(units.counts[: units.frequent].sum())
    bits = _split(2 * rest, ENTRIES)
    for i in range(rounds if rest else 0):
        apply = _contexts(share(spark, model), bits)
        if i == 0:
            rows = chunks.mapInArrow(_over_chunks(apply), _CONTEXTS)
        else:
            rows = stage.written(_answered(chunks, table, model.distinct, apply, _CONTEXTS), "neighbours")
            g = _sum_of_matrices(rows, model)[0]
        found = _place(rows, model, np.hstack([g[:k], g[:, :k].T]), PLACE_SWEEPS if i == rounds - 1 else FIRST_SWEEPS)
        table = found.unionByName(seed)
        mine = spark.createDataFrame(top[["word"]].iloc[units.frequent :].astype("int64"), "word long") if len(top) > units.frequent else None
        if mine is not None:
            now = found.join(F.broadcast(mine), "word").toPandas().set_index("word")["cls"]
            model.cls[units.frequent :] = now.loc[top["word"].iloc[units.frequent :]].to_numpy(np.int64)
    model.finish(_sum_of_matrices(_answered(chunks, table, model.distinct, _contexts(share(spark, model), None), _CONTEXTS), model))
    return model, table


def _scores(model_of):
    def apply(home: dict, count: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        model = model_of()
        code, size = _unpack(home["codes"], np.int32), _unpack(home["sizes"], np.int32).astype(np.int64)
        count, symbol = model.tables(_unpack(home["shapes"], np.int8), count, cls)
        c, off = symbol[code], np.concatenate([[0], np.cumsum(size)])
        score = model.log_next[np.concatenate([[model.symbols - 1], c[:-1]]), c] + model.log_emission(count, symbol)[code]
        cols = [tx.segment_sums(x[code], off) for x in ((count > 0).astype(np.int64), model.log_base(count))]
        return pa.RecordBatch.from_arrays(
            [pa.array(home["ids"], pa.int64()), pa.array(size), *map(pa.array, cols), pa.array(tx.segment_sums(score, off))], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        )

    return apply


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = stage.written(docs.mapInArrow(_chunks(share(spark, model.units)), _CHUNK), "chunks")
    return _answered(chunks, counts, model.distinct, _scores(share(spark, model)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
