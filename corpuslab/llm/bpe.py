"""Byte-level BPE ids of whole texts, computed per distinct piece.

A byte-level BPE first cuts a text into pieces (contractions, letter runs,
digit runs, other runs, white space) and merges inside each piece only, so the
ids of a text are the ids of its pieces in order. :class:`Encoder` finds the
pieces of a whole column with numpy, looks each *distinct* piece up in a cache
of bounded size, hands only unseen pieces to the ``tokenizers`` library, and
gathers the ids. Texts with characters outside the table below (so that two
libraries' Unicode versions could disagree about a character's class) are
encoded by the library as a whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from corpuslab.llm import textops as tx

CACHE_PIECES = 1 << 20  # distinct pieces kept by a worker; then the cache starts anew

# character classes: 0 other, 1 letter, 2 number, 3 white space, 4 let the library decide
_TABLE = np.full(0x2070, 4, dtype=np.uint8)
_TABLE[0x20:0x7F] = 0
_TABLE[0xA1:0xC0] = 0
for _a, _b in ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0x24F)):
    _TABLE[_a : _b + 1] = 1
for _c in (0xD7, 0xF7):
    _TABLE[_c] = 0
for _a, _b in ((0x30, 0x39), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE)):
    _TABLE[_a : _b + 1] = 2
for _a, _b in ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0)):
    _TABLE[_a : _b + 1] = 3
_TABLE[0x2010:0x2028] = 0
_TABLE[0x2030:0x205F] = 0


class Encoder:
    """Encodes columns of texts; built in a task from the vocabulary's JSON."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cache: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.cache.clear()
        self.pieces, self.used = 0, 0
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        return array if need <= len(array) else np.concatenate([array, np.zeros(max(len(array), need - len(array)), array.dtype)])

    def _add(self, keys: list[int], texts: list[str]) -> None:
        """Encode unseen pieces and append their ids to the flat table."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))
        p, q, u, v = self.pieces, self.pieces + len(ids), self.used, self.used + len(flat)
        self.ids, self.at, self.length = self._room(self.ids, v), self._room(self.at, q), self._room(self.length, q)
        self.ids[u:v] = flat
        self.length[p:q] = length
        self.at[p:q] = u + np.cumsum(length) - length
        self.cache.update(zip(keys, range(p, q)))
        self.pieces, self.used = q, v

    def column(self, col) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (uint32, in order) and the row offsets into them; null is empty."""
        data, offsets = tx.column_bytes(col)
        n = len(offsets) - 1
        text = data.tobytes().decode("utf-8")
        head = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=head[1:])
        chars = head[offsets]
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        cls = _TABLE[np.minimum(cp, len(_TABLE) - 1)]
        odd = cls == 4
        rows_odd = np.zeros(n, bool)
        if odd.any():
            rows_odd[np.searchsorted(chars, np.flatnonzero(odd), "right") - 1] = True
        starts = self._piece_starts(cp, cls, chars)
        index = np.arange(len(cp), dtype=np.int64)
        first = np.zeros(len(cp), np.int64)
        first[starts] = starts
        index -= np.maximum.accumulate(first) if len(cp) else first
        power = np.ones(int(index.max()) + 1 if len(cp) else 1, dtype=tx.U64)
        power[1:] = tx.U64(0x9E3779B97F4A7C15)
        np.multiply.accumulate(power, out=power)
        keys = tx.mix(np.add.reduceat((cp.astype(tx.U64) + tx.U64(0x9E3779B97F4A7C55)) * power[index], starts)) if len(starts) else np.zeros(0, tx.U64)
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.pieces + len(distinct) > CACHE_PIECES:
            self._reset()
        ends = np.append(starts[1:], len(cp))
        known = distinct.tolist()
        new = [i for i, k in enumerate(known) if k not in self.cache]
        if new:
            w = where[new]
            self._add([known[i] for i in new], [text[a:b] for a, b in zip(starts[w].tolist(), ends[w].tolist())])
        slot = np.array([self.cache[k] for k in known], dtype=np.int64)[inverse] if known else np.zeros(0, np.int64)
        size = self.length[slot] if len(slot) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.repeat(self.at[slot] - total[:-1], size) + np.arange(total[-1])] if len(slot) else np.zeros(0, np.uint32)
        row_off = total[np.searchsorted(starts, chars)]
        if rows_odd.any():
            return self._splice(out, row_off, rows_odd, text, chars)
        return out, row_off

    def _splice(self, out, row_off, rows_odd, text, chars):
        parts = []
        for i in range(len(rows_odd)):
            if rows_odd[i]:
                e = self.library.encode(text[chars[i] : chars[i + 1]], add_special_tokens=False)
                parts.append(np.array(e.ids, dtype=np.uint32))
            else:
                parts.append(out[row_off[i] : row_off[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    @staticmethod
    def _piece_starts(cp: np.ndarray, cls: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Where pieces begin. A run of one class is a piece; a single blank before a run belongs to
        it; white space before a run keeps its last character apart; 's 't 'm 'd 're 've 'll after a run are pieces."""
        n = len(cp)
        if n == 0:
            return np.zeros(0, np.int64)
        row = np.zeros(n + 1, bool)
        row[chars] = True  # a row's first character, and the end
        space = cls == 3
        start = row[:n].copy()
        start[1:] |= cls[1:] != cls[:-1]
        # the last white-space character of a run that something follows in its row
        last = space.copy()
        last[:-1] &= ~space[1:] & ~row[1:n]
        last[-1] = False
        start |= last
        blank = np.flatnonzero(last & (cp == 0x20))
        start[blank + 1] = False  # the blank begins the following piece
        quote = np.flatnonzero((cp == 0x27) & start)
        for q in quote.tolist():  # few: contractions only where an apostrophe begins a piece
            e = q
            pair = cp[q + 1 : q + 3].tolist()
            stop = n if q + 1 >= n else q + 1 + int(np.argmax(row[q + 1 : q + 4])) if row[q + 1 : q + 4].any() else q + 4
            if pair[:1] and q + 1 < stop and pair[0] in (0x73, 0x74, 0x6D, 0x64):
                e = q + 2
            elif len(pair) == 2 and q + 2 < stop and tuple(pair) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
                e = q + 3
            if e > q:
                start[q + 1 : e] = False
                if e < n:
                    if not (space[e] or start[e]):
                        start[e] = True
        return np.flatnonzero(start)
