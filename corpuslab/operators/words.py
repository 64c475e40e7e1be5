"""Words of whole text columns, found by numpy over the Arrow buffers inside Spark tasks (rows 50, 77-87, 89, 92).

Texts are taken in slices of bounded size (or one longer text). A token is a run of bytes other than blank, newline, tab and carriage
return; its word is what :func:`corpuslab.functions.text.clean_word` gives: ASCII letters in lower case, the few tokens with
``://`` or ``@`` first pass the same patterns as there.
"""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # text of a slice or block
PIECE_BYTES = 1 << 20  # text whose tokens are found at once; temporaries are some ten times as much
PIECE_TOKENS = 1 << 17  # tokens of a block that become rows at once
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEPT = np.where(_BLANK, np.uint8(0x20), _LETTER)  # letters in lower case, one sign for all blanks, 0 for the rest
_ANY = r"[^\n\r\x85\u2028\u2029]*"  # what ".*" is in Spark's patterns
_URL = re.compile(rf" ?(f|ht)(tp)(s?)(://)({_ANY})[.|/]({_ANY})")
_EMAIL = re.compile("[^ \t\n\x0b\f\r]*@[^ \t\n\x0b\f\r]*")
_NON_LETTER = re.compile("[^a-zA-Z]")


def free_memory() -> None:
    """Gives back to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """``run`` over a task's batches; at its end the worker, which may wait for long beside a busy JVM, keeps no freed memory."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            free_memory()

    return task


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty rows."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(col, limit: int = SLICE_BYTES):
    """``(first row, rows, bytes, offsets)`` of pieces of a column, each of at most ``limit`` bytes or one row."""
    yield from pieces(*column_bytes(col), limit)


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int):
    """:func:`slices` of a column's bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b - a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def token_ranges(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK):
    """``(starts, ends, first)``: the tokens' byte ranges, and the number of each row's first token (one more at the end)."""
    inside = ~blank[data]
    begins, lasts = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    lasts[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    at, to = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[at], lasts[to] = inside[at], inside[to]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(lasts) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A string column from its bytes and its values' sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _marks(data: np.ndarray) -> np.ndarray:
    """Places of ``@`` and ``://``."""
    marks = np.flatnonzero(data == 0x40)
    if len(data) > 2:
        marks = np.concatenate([marks, np.flatnonzero((data[:-2] == 0x3A) & (data[1:-1] == 0x2F) & (data[2:] == 0x2F))])
    return marks


def _clean_marked(data: np.ndarray, clean: np.ndarray, ranges) -> None:
    """Puts the words of the tokens at ``ranges``, which hold marks, into ``clean``."""
    for a, b in ranges:
        x = data[a:b].tobytes().decode("utf-8", "replace")
        x = _URL.sub(" ", x) if "://" in x else x
        x = _EMAIL.sub(" ", x) if "@" in x else x
        w = _NON_LETTER.sub("", x).lower().encode()
        clean[a:b] = 0
        clean[a : a + len(w)] = np.frombuffer(w, np.uint8)  # never longer than the token


def bare_words(col, min_len: int) -> pa.Array:
    """The words of :func:`words` of a column without their places: blanks and letters alone are kept of the bytes, so a word's size is the distance of two blanks."""
    ended = pc.binary_join_element_wise(pc.fill_null(col.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, _ = column_bytes(ended)
    clean = _KEPT[data]
    marks = _marks(data)
    if len(marks):
        blanks = np.flatnonzero(clean == 0x20)  # the last byte is one
        k = np.unique(np.searchsorted(blanks, marks))
        _clean_marked(data, clean, zip((np.concatenate([[-1], blanks])[k] + 1).tolist(), blanks[k].tolist()))
    clean = clean[clean > 0]
    blank = clean == 0x20
    size = np.diff(np.flatnonzero(blank), prepend=-1) - 1
    keep = size > min_len
    return strings(clean[np.repeat(keep, size + 1) & ~blank], size[keep])


def words(data: np.ndarray, offsets: np.ndarray, min_len: int):
    """``(word, row, order, starts, ends)`` of the tokens whose word has more than ``min_len`` letters; ``order`` counts all tokens of the row from 1."""
    starts, ends, first = token_ranges(data, offsets)
    clean = _LETTER[data]
    marked = np.unique(np.searchsorted(starts, _marks(data), "right") - 1)
    _clean_marked(data, clean, zip(starts[marked].tolist(), ends[marked].tolist()))
    letters = clean[clean > 0]
    place = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(clean > 0, out=place[1:])
    size = place[ends] - place[starts]
    keep = size > min_len
    word = strings(letters[np.repeat(keep, size)], size[keep])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.arange(1, len(starts) + 1) - first[row]
    return word, row[keep], order[keep], starts[keep], ends[keep]


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as a string column."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return strings(data[np.cumsum(edge[:-1], dtype=np.int8) > 0], ends - starts)


def _text(values) -> pa.Array:
    return values.cast(pa.string())


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def word_rows(min_len: int, tokens: bool, id_col: str):
    """``(id, text)`` -> ``(id, order[, token], word)``."""

    def run(batches):
        for batch in batches:
            for a, n, data, offsets in slices(batch.column(1), PIECE_BYTES):
                word, row, order, starts, ends = words(data, offsets, min_len)
                cols = {id_col: batch.column(0).slice(a, n).take(pa.array(row)), "order": pa.array(order, pa.int32())}
                if tokens:
                    cols["token"] = _text(cut(data, starts, ends))
                cols["word"] = _text(word)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return lean(run)


def word_counts(min_len: int):
    """``(text)`` -> ``(word, n)``, counted in each slice: a word has at most one row a slice."""

    def run(batches):
        for batch in batches:
            for a, n, _, _ in slices(batch.column(0)):
                got = pc.value_counts(bare_words(batch.column(0).slice(a, n), min_len))
                yield pa.RecordBatch.from_arrays([_text(got.field("values")), got.field("counts").cast(pa.int64())], ["word", "n"])

    return lean(run)


def _cell(values) -> pa.Array:
    """One list that holds all ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


BLOCK_FIELDS = "sizes array<int>, orders array<int>, codes array<int>, vocab array<string>, counts array<long>, tokens array<string>"


def word_blocks(min_len: int, tokens: bool):
    """``(id, text)`` -> one row for each slice of the table: the ids and sizes of its documents with words, the words' places and codes, the
    distinct words with their counts, and the tokens if asked for."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, n, data, offsets in slices(batch.column(1)):
                found = []
                for i, _, piece, at in pieces(data, offsets, PIECE_BYTES):
                    word, row, order, starts, ends = words(piece, at, min_len)
                    token = _text(cut(piece, starts, ends)) if tokens else pa.array([], pa.string())
                    found.append((word, (row + i).astype(np.int32), order.astype(np.int32), token))
                row, order = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                if not len(row):
                    continue
                word, token = (pa.concat_arrays([f[j] for f in found]) for j in (0, 3))
                coded = word.dictionary_encode()
                codes = np.asarray(coded.indices)
                sizes = np.bincount(row, minlength=n)
                own = np.flatnonzero(sizes)
                cells = [batch.column(0).slice(a, n).take(pa.array(own)), pa.array(sizes[own], pa.int32()), pa.array(order, pa.int32()), pa.array(codes, pa.int32()),
                         _text(coded.dictionary), pa.array(np.bincount(codes, minlength=len(coded.dictionary)), pa.int64()), token]
                names = ["block", "ids", "sizes", "orders", "codes", "vocab", "counts", "tokens"]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *map(_cell, cells)], names)
                block += 1

    return lean(run)


def _opened(batch):
    """Of each block: its columns' lists as flat columns, by name; ``lemmas`` may be null."""
    for i in range(batch.num_rows):
        yield {f.name: batch.column(k).slice(i, 1).flatten() for k, f in enumerate(batch.schema) if pa.types.is_list(f.type) or pa.types.is_large_list(f.type)}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + sizes[i] - 1`` for every ``i``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _lists(values, sizes: np.ndarray, docs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """``values``, of which ``sizes[i]`` belong to the i-th token, joined by blanks for each document (``docs``: its tokens); and how many each has."""
    at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(docs)])]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values.cast(pa.large_string())), pa.scalar(" ", pa.large_string())), np.diff(at)


def _lemmas(b: dict) -> tuple[np.ndarray, pa.Array]:
    """Codes and lemmas of a block, ordered by both."""
    return np.asarray(b["lemmas"].field("code"), dtype=np.int64), b["lemmas"].field("lemma")


def block_texts(min_lemma_len: int, id_col: str):
    """Blocks with ``lemmas`` -> ``(id, clean_word_text, lemma_text)`` as :func:`corpuslab.operators.cleanse.collapse_texts` makes them."""

    def run(batches):
        for batch in batches:
            for b in _opened(batch):
                codes, docs = np.asarray(b["codes"], dtype=np.int64), np.asarray(b["sizes"], dtype=np.int64)
                code, lemma = _lemmas(b)
                fan = np.maximum(np.bincount(code, minlength=len(b["vocab"])), 1)[codes]  # a word with several lemmas fans out
                text, _ = _lists(b["vocab"].take(pa.array(np.repeat(codes, fan))), fan, docs)
                good = np.asarray(pc.fill_null(pc.greater(pc.utf8_length(lemma), min_lemma_len), False), dtype=bool)
                code, lemma = code[good], lemma.filter(pa.array(good))
                own = np.bincount(code, minlength=len(b["vocab"]))
                begin = np.cumsum(own) - own
                joined, n = _lists(lemma.take(pa.array(_spread(begin[codes], own[codes]))), own[codes], docs)
                joined = pc.if_else(pa.array(n > 0), joined, pa.scalar(None, joined.type))
                yield pa.RecordBatch.from_arrays([b["ids"], _text(text), _text(joined)], [id_col, "clean_word_text", "lemma_text"])

    return lean(run)


def block_rows(tokens: bool, id_col: str):
    """Blocks with ``lemmas`` -> ``(word, id, order[, token], lemma)``, one row for each token and lemma, a null lemma where there is none."""

    def run(batches):
        for batch in batches:
            for b in _opened(batch):
                every, docs = np.asarray(b["codes"]), np.asarray(b["sizes"], dtype=np.int64)
                code, lemma = _lemmas(b)
                own = np.bincount(code, minlength=len(b["vocab"]))
                begin, every_doc = np.cumsum(own) - own, np.repeat(np.arange(len(docs), dtype=np.int32), docs)
                for a in range(0, len(every), PIECE_TOKENS):
                    codes, doc = every[a : a + PIECE_TOKENS], every_doc[a : a + PIECE_TOKENS]
                    fan = np.maximum(own[codes], 1)
                    token = np.repeat(np.arange(len(codes)), fan)
                    at = _spread(begin[codes], fan)
                    cols = {"word": b["vocab"].take(pa.array(codes[token])), id_col: b["ids"].take(pa.array(doc[token])), "order": b["orders"].take(pa.array(a + token))}
                    if tokens:
                        cols["token"] = b["tokens"].take(pa.array(a + token))
                    cols["lemma"] = lemma.take(pa.array(at, mask=own[codes[token]] == 0)) if len(lemma) else pa.nulls(len(token), pa.string())
                    yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return lean(run)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``keys``, which are sorted in place, and how often each occurs."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def _packed_grams(sizes: tuple[int, ...], row: np.ndarray, codes: np.ndarray, bits: int):
    """``(rows, codes of the places, counts)`` of the n-grams of each size: a row's number and its codes are one integer, ``bits`` bits a code."""
    for size in range(1, max(sizes) + 1):
        at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if size > 1 else np.arange(len(row))
        if size not in sizes or not len(at):
            continue
        keys = row[at]
        for j in range(size):
            keys = (keys << bits) | codes[at + j]
        keys, count = _runs(keys)
        yield keys >> (bits * size), [(keys >> (bits * (size - 1 - j))) & ((1 << bits) - 1) for j in range(size)], count


def _ranked_grams(sizes: tuple[int, ...], row: np.ndarray, codes: np.ndarray, vocab: int):
    """:func:`_packed_grams` where these integers would be too long: the n-grams of each size are numbered from those of the size before."""
    gram, at = codes, np.arange(len(codes))  # at: the grams' first tokens
    for size in range(1, max(sizes) + 1):
        if size > 1:
            on = at + size - 1 < len(row)
            on[on] &= row[at[on] + size - 1] == row[at[on]]
            at = at[on]
            if not len(at):
                break
            _, gram = np.unique(gram[on] * vocab + codes[at + size - 1], return_inverse=True)
        if size not in sizes:
            continue
        _, where, count = np.unique(row[at] * (int(gram.max()) + 1) + gram, return_index=True, return_counts=True)
        yield row[at[where]], [codes[at[where] + j] for j in range(size)], count


PACKED_BITS = 63
COUNTED_BYTES = 64 << 20  # of a block of counts at most, but for one batch
GRAM_BYTES = 1 << 20  # nothing is counted across documents: short slices have short codes and stay in the cache


def term_counts(sizes: tuple[int, ...], id_col: str):
    """``(id, text)`` -> ``(id, term, n)``: the ``_``-joined n-grams of a text's blank-separated words, counted in the row."""

    def run(batches):
        for batch in batches:
            for a, n, data, offsets in slices(batch.column(1), GRAM_BYTES):
                starts, ends, first = token_ranges(data, offsets, _SPACE)
                if not len(starts):
                    continue
                row = np.repeat(np.arange(n), np.diff(first))
                raw = strings(data[~_SPACE[data]], ends - starts)
                coded = raw.dictionary_encode()
                vocab, codes = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
                bits = max(1, (len(vocab) - 1).bit_length())
                packed = (n - 1).bit_length() + bits * max(sizes) <= PACKED_BITS
                found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
                for at, own, count in _packed_grams(sizes, row, codes, bits) if packed else _ranked_grams(sizes, row, codes, len(vocab)):
                    parts = [vocab.take(pa.array(x)) for x in own]
                    found.append((at, parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar("_", pa.large_string())), count))
                if not found:
                    continue
                table = pa.table({"row": np.concatenate([f[0] for f in found]), "term": pa.chunked_array([f[1] for f in found]), "n": np.concatenate([f[2] for f in found])})
                if max(sizes) > 1 and pc.any(pc.match_substring(vocab, "_")).as_py():  # different grams may then read alike
                    table = table.group_by(["row", "term"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
                ids = batch.column(0).slice(a, n).take(pa.array(table["row"].to_numpy()))
                yield pa.RecordBatch.from_arrays([ids, _text(_one(table["term"])), pa.array(table["n"].to_numpy(), pa.int64())], [id_col, "term", "n"])

    return lean(run)


BLOCK_ROWS = 1 << 18  # counts of a block of a document-term table, some tens of MB


def _coded(column) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values of a column, a null being a value."""
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def term_blocks():
    """``(id, term, n)`` -> one row for each block of rows: the ids and sizes of the runs of rows with one id, the rows' codes and counts, the distinct
    terms. A run is cut only where it alone fills a block."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33

        def made(table):
            nonlocal block
            keys, _ = _coded(table.column(0))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            codes, vocab = _coded(table.column(1))
            cells = [table.column(0).take(pa.array(first)).combine_chunks(), pa.array(np.diff(first, append=len(keys)), pa.int32()), pa.array(codes, pa.int32()),
                     table.column(2).combine_chunks(), vocab]
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([block - 1], pa.int64()), *map(_cell, cells)], ["block", "ids", "sizes", "codes", "ns", "vocab"])

        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows < BLOCK_ROWS and size < COUNTED_BYTES:
                continue
            table = pa.concat_tables(held)
            keys, _ = _coded(table.column(0))
            ends = np.flatnonzero(keys[1:] != keys[:-1])
            cut_at = int(ends[-1]) + 1 if len(ends) else rows  # the last run may go on
            yield made(table.slice(0, cut_at))
            held, rows = ([table.slice(cut_at)], rows - cut_at) if cut_at < rows else ([], 0)
            size = sum(t.nbytes for t in held)
        if rows:
            yield made(pa.concat_tables(held))

    return lean(run)


def mapped_counts(id_col: str):
    """Blocks of :func:`term_blocks` with ``lemmas`` (a code and its value) -> ``(id, term, n)``, added for each run and value."""

    def run(batches):
        for batch in batches:
            for b in _opened(batch):
                vocab, codes = b["vocab"], np.asarray(b["codes"], dtype=np.int64)
                code, lemma = _lemmas(b)
                value = np.arange(len(vocab))
                value[code] = len(vocab) + np.arange(len(code))
                own, names = _coded(pa.chunked_array([pa.concat_arrays([vocab, lemma.cast(vocab.type)]).take(pa.array(value))]))
                docs = np.repeat(np.arange(len(b["ids"])), np.asarray(b["sizes"], dtype=np.int64))
                table = pa.table({"key": docs * len(names) + own[codes], "n": b["ns"]}).group_by("key", use_threads=False).aggregate([("n", "sum")])
                key, n = np.asarray(table["key"]), table["n_sum"].combine_chunks()
                yield pa.RecordBatch.from_arrays([b["ids"].take(pa.array(key // len(names))), _text(names.take(pa.array(key % len(names)))), n], [id_col, "term", "n"])

    return lean(run)
