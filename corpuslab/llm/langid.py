"""Operator 10: language ID with language-bitmask n-gram filters.

One Bloom filter per language over byte 4-grams, stored bit-sliced: slot ``s``
holds a bitmask whose bit ``l`` is slot ``s`` of language ``l``'s filter. The
``AND`` of an n-gram's slots is the set of all languages that may contain it,
found with one probe however many languages there are. A document counts,
per language, the n-grams whose set holds the language (a popcount over its
positions), takes off the share expected from false positives (the filter's
fill to the power of the number of hashes), and the largest corrected share decides.
The score is the logistic function of the corrected lead over the second language, in n-grams.

Learning takes a bounded sample of labelled rows: at most about
``sample_per_lang`` documents of each language, picked by a hash of the id,
whose n-grams Spark counts; a language's filter holds its ``grams_per_lang``
most frequent n-grams that occur at least twice. The filters are bounded by
these parameters. Prediction is one scan with no shuffle over whole texts.

Text is reduced to letters: ``A-Z`` in lower case, other ASCII characters as a
blank, and a blank before and after the text; 4-grams that hold two inner blanks are skipped.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a text none of whose n-grams is known is the language with the most training
rows with score 0; ties go to the language with more training rows, then the first by name; repeated rows get equal results; without
any training row every text is ``und``; a null id is a row like any other; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textops as tx
from corpuslab.llm.logistic import sigmoid
from corpuslab.llm.shared import share

SAMPLE_PER_LANG = 2_000
GRAMS_PER_LANG = 40_000
HASHES = 2
SLOTS_PER_GRAM = 16
UNKNOWN = "und"

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[65:91] += 32
_BLANK[[c for c in range(128) if not (65 <= c < 91 or 97 <= c < 123)]] = 0x20


def grams(col):
    """Per window of the column: 4-gram codes (uint32) and the row of each, over whole texts."""
    data, offsets = tx.column_bytes(col)
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.full(len(data) + 3 * n, 0x20, np.uint8)
    begin = offsets[:-1] + 3 * np.arange(n)  # a blank before, two after
    row = np.repeat(np.arange(n), size)
    out[np.arange(len(data)) + 3 * row + 1] = _BLANK[data]
    del row
    edges = np.append(begin, len(out))
    for a in range(0, max(0, len(out) - 3), tx.SEGMENT):
        b = min(len(out) - 3, a + tx.SEGMENT)
        w = out[a : b + 3].astype(np.uint32)
        code = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
        rows = np.searchsorted(edges, np.arange(a, b), "right") - 1
        ok = (np.arange(a, b) + 4 <= edges[rows + 1]) & ((code & 0x00FFFF00) != 0x00202000)
        yield code[ok], rows[ok]


def slots(code: np.ndarray, k: int, total: int):
    """The ``k`` slots of each n-gram among ``total`` (a power of two)."""
    h = tx.mix(code.astype(tx.U64) + tx.U64(0x51ED270B))
    return [((h >> tx.U64(32 * j)) & tx.U64(total - 1)).astype(np.int64) for j in range(k)]


def has_letter(data: np.ndarray, offsets: np.ndarray, texts) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    hit = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    found = hit[offsets[1:]] > hit[offsets[:-1]]
    for i in np.flatnonzero(~found).tolist():
        t = texts[i].as_py()
        found[i] = t is not None and any(c.isalpha() for c in t)
    return found


class LanguageFilters:
    """Bit-sliced filters of all languages; ``grams_of`` maps a language to its n-gram codes."""

    def __init__(self, grams_of: dict[str, np.ndarray], rows_of: dict[str, int], hashes: int = HASHES, slots_per_gram: int = SLOTS_PER_GRAM):
        self.langs = sorted(grams_of)
        self.hashes = hashes
        most = max([len(g) for g in grams_of.values()] + [1])
        self.total = 1 << max(6, int(np.ceil(np.log2(most * slots_per_gram))))
        words = -(-len(self.langs) // 64)
        kind = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(self.langs) <= bits or bits == 64)
        self.table = np.zeros((max(1, words), self.total), kind)
        for i, lang in enumerate(self.langs):
            for s in slots(grams_of[lang], hashes, self.total):
                self.table[i // 64][s] |= kind(1 << (i % 64))
        self.false = np.array([(((self.table[i // 64] >> self.table.dtype.type(i % 64)) & 1).mean()) ** hashes for i in range(len(self.langs))])
        rows = np.array([rows_of[x] for x in self.langs], float)
        self.prior = rows / max(1.0, rows.sum())

    def predict(self, col) -> tuple[list[str], np.ndarray]:
        n = len(col)
        hits = np.zeros((len(self.langs), n))
        total = np.zeros(n)
        for code, rows in grams(col):
            if not len(code):
                continue
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            which = rows[first]
            total[which] += np.diff(np.append(first, len(rows)))
            at = slots(code, self.hashes, self.total)
            for word in range(self.table.shape[0]):
                mask = self.table[word][at[0]]
                for s in at[1:]:
                    mask &= self.table[word][s]
                for i in range(word * 64, min(len(self.langs), word * 64 + 64)):
                    bit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                    hits[i, which] += np.add.reduceat(bit, first, dtype=np.int64)
        data, offsets = tx.column_bytes(col)
        letters = has_letter(data, offsets, col)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        false = self.false[:, None]
        share = np.maximum(0, (hits - total * false) / ((1 - false) * np.maximum(1, total)))
        best = (share + 1e-9 * self.prior[:, None]).argmax(0)
        top = share.max(0)
        second = np.sort(share, axis=0)[-2] if len(self.langs) > 1 else np.zeros(n)
        score = np.where(top > 0, sigmoid(total * (top - second)), 0.0)
        lang = np.array(self.langs, dtype=object)[best]
        return np.where(letters, lang, UNKNOWN).tolist(), np.where(letters, score, 0.0)


def _gram_counts(batches):
    """(lang, gram, n) per slice of the sample: n-grams are counted before they leave the task."""
    for batch in batches:
        for a, b in tx.slices(batch.column(1)):
            langs = np.array(batch.column(0).slice(a, b - a).to_pylist(), dtype=object)
            parts: dict[str, list] = {}
            for code, rows in grams(batch.column(1).slice(a, b - a)):
                for lang in set(langs[np.unique(rows)].tolist()):
                    parts.setdefault(lang, []).append(code[langs[rows] == lang])
            for lang, codes in parts.items():
                g, c = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])


def fit(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, grams_per_lang: int = GRAMS_PER_LANG) -> LanguageFilters:
    """Filters from (doc_id, text, lang); only rows with a text and a language count."""
    from pyspark.sql import Window

    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not count:
        return LanguageFilters({}, {})
    per_million = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1_000_000, -(-1_000_000 * sample_per_lang // n)))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < per_million[F.col("lang")])
    counted = picked.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("r", F.row_number().over(by)).where(F.col("r") <= grams_per_lang).select("lang", "gram").toPandas()
    grams_of = {k: top.gram[top.lang == k].to_numpy(np.int64).astype(np.uint32) for k in count}
    return LanguageFilters(grams_of, count)


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` instead of columns of those names; only (text) is read for them."""
    shared = share(docs.sparkSession, model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*[F.col(f"`{c}`") for c in rest]).dtypes) + ", lang_pred string, score double"

    def run(batches):
        model = shared()
        for batch in batches:
            text = batch.column("text")
            for a, b in tx.slices(text):
                lang, score = model.predict(text.slice(a, b - a))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
