"""Operator 3: convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its
leading 4 to 8 bytes, so inflected forms share a part. Filters of several widths run over the
word sequence, each filter's maximum over the whole text is a feature, and a
linear layer gives the logit. The first embedding dimension starts at the shrunk log
odds of its hash bucket, learned on one third of the sample; the network is trained (Adam) on the second
third; the last third calibrates: one slope, and a threshold for each language, shrunk
to the common one. A text's language comes from its own letters (:func:`language_hint`), never from a
column. The score is the logistic function of slope * (logit - threshold), so 0.5 is the language's threshold.

Learning takes at most ``SAMPLE_PER_CLASS`` labelled documents of each class and
``TRAIN_WORDS`` evenly spread words of each. Scoring is one scan of whole texts without a shuffle; a
long text goes through the filters in pieces that overlap by the filter width, and the maxima are merged.

Defined results: a null or empty text, or one without words, has no features and scores as the
linear layer's bias says; a document labelled twice is toxic if any label says so; rows with a null label or id
teach nothing; with one class only the score is 1 or 0 for that class, with none 0; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textops as tx
from corpuslab.llm.logistic import fit_logistic, sigmoid
from corpuslab.llm.quality import labelled_sample
from corpuslab.llm.shared import share

SAMPLE_PER_CLASS = 3_000
TRAIN_WORDS = 4_096
BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (4, 5, 6, 7, 8)
EPOCHS = 6
SEED = 5

# Letters (second byte of their UTF-8 form after 0xC3) that mark a language in a text.
MARKS = {"de": "äöüß", "es": "áíñóú", "fr": "àçèéêëîôœùû"}


def language_hint(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row 0 for no marks, else 1 + the index of the language in ``MARKS`` with the most marks."""
    code = np.zeros(256, np.int64)
    for i, letters in enumerate(MARKS.values()):
        for c in letters:
            b = c.encode("utf-8")
            if b[0] == 0xC3:
                code[b[1]] = i + 1
    counts = np.zeros((len(MARKS) + 1, len(offsets) - 1), np.int64)
    if len(data) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3)
        kind = code[data[at + 1]]
        row = np.searchsorted(offsets, at, "right") - 1
        for i in range(1, len(MARKS) + 1):
            counts[i] = np.bincount(row[kind == i], minlength=counts.shape[1])
    return np.where(counts.max(0) > 0, counts.argmax(0), 0)


def features(col) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of every word and its prefixes (words x features) and the row offsets into the words."""
    data, starts, ends, off = tx.spans(col)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), off
    size = ends - starts
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    index = np.arange(len(data)) - np.maximum.accumulate(first)
    value = tx._BYTE_LOWER[data]
    power = np.ones(max(1, int(size.max())), dtype=tx.U64)
    power[1:] = tx._POWER
    np.multiply.accumulate(power, out=power)
    value *= power[np.minimum(index, len(power) - 1)]  # blanks have value 0
    total = np.concatenate([np.zeros(1, tx.U64), np.cumsum(value, dtype=tx.U64)])
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    salt = tx.constants(1 + len(PREFIXES), 31)
    for k, n in enumerate((None, *PREFIXES)):
        stop = ends if n is None else np.minimum(ends, starts + n)
        h = tx.mix((total[stop] - total[starts]) + salt[k])
        out[:, k] = (h & tx.U64(BUCKETS - 1)).astype(np.int32)
    return out, off


def _blocks_of_rows(col):
    """The column in row ranges, and long rows in pieces of words with an overlap: (row numbers, features, offsets)."""
    lap = max(WIDTHS) - 1
    limit = 1 << 17
    for a, b in tx.slices(col, 1 << 20):
        f, off = features(col.slice(a, b - a))
        rows, parts = [], []
        for i in range(b - a):
            x, y = int(off[i]), int(off[i + 1])
            for s in range(x, max(y, x + 1), limit):
                rows.append(a + i)
                parts.append((s, min(y, s + limit + lap)))
        k = 0
        while k < len(rows):
            j, words = k, 0
            while j < len(rows) and (j == k or words + parts[j][1] - parts[j][0] <= limit + lap):
                words += parts[j][1] - parts[j][0]
                j += 1
            yield np.array(rows[k:j]), np.concatenate([f[x:y] for x, y in parts[k:j]]), np.concatenate([[0], np.cumsum([y - x for x, y in parts[k:j]])])
            k = j


class Cnn:
    def __init__(self, rng: np.random.Generator | None = None):
        self.constant: float | None = None
        rng = rng or np.random.default_rng(SEED)
        self.emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # every width starts with filters that pass the log odds
            f[:, 0, : FILTERS // 2] = 1.0 / len(f)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.bias = np.float32(0)
        self.slope, self.threshold = 1.0, np.zeros(len(MARKS) + 1)

    def pooled(self, f: np.ndarray, off: np.ndarray, where: bool = False):
        """Maxima of every filter over each row (rows x filters); with ``where`` also their positions. Rows without words give -inf, positions -1."""
        n = len(off) - 1
        out = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        at = np.full(out.shape, -1, np.int64)
        if not len(f):
            return (out, at) if where else out
        e = self.emb[f[:, 0]]
        for k in range(1, f.shape[1]):
            e += self.emb[f[:, k]]
        size = np.diff(off)
        for i, (w, bank) in enumerate(zip(WIDTHS, self.filters)):
            pad = np.vstack([e, np.zeros((w - 1, DIM), np.float32)])
            conv = pad[: len(e)] @ bank[0]
            for k in range(1, w):
                step = pad[k : k + len(e)] @ bank[k]
                inside = np.repeat(off[1:], size) - np.arange(len(e)) > k  # a window does not run into the next row
                conv += step * inside[:, None]
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            full = np.flatnonzero(size)
            out[full, cols] = np.maximum.reduceat(conv, off[:-1][full], axis=0)
            if where:
                for r in full.tolist():
                    at[r, cols] = off[r] + conv[off[r] : off[r + 1]].argmax(0)
        return (out, at) if where else out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(pooled), np.maximum(pooled, 0), 0) @ self.out + self.bias

    def start_odds(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        counts = np.zeros((2, BUCKETS))
        for f, label in zip(docs, y):
            counts[int(label), np.unique(f)] += 1
        n = np.maximum(1, np.bincount(y.astype(int), minlength=2))
        odds = np.log((counts[1] + 2) / (n[1] + 4)) - np.log((counts[0] + 2) / (n[0] + 4))
        odds -= np.log((n[0] + 4) / (n[1] + 4))  # an unseen bucket is neutral
        self.emb[:, 0] = odds / (1 + len(PREFIXES))

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        """Adam on the filters and the linear layer; embeddings move where a maximum was taken."""
        if not docs:
            return
        params = [*self.filters, self.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        bias_m, bias_v, t = 0.0, 0.0, 0
        weight = np.where(y == 1, 0.5 / max(1e-9, (y == 1).mean()), 0.5 / max(1e-9, (y == 0).mean()))
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), 32):
                part = order[s : s + 32]
                f = np.concatenate([docs[i] for i in part])
                off = np.concatenate([[0], np.cumsum([len(docs[i]) for i in part])])
                pooled, at = self.pooled(f, off, where=True)
                g = ((sigmoid(self.logits(pooled)) - y[part]) * weight[part] / len(part)).astype(np.float32)
                act = np.where(np.isfinite(pooled), np.maximum(pooled, 0), 0)
                grads = [np.zeros_like(p) for p in params]
                grads[-1] = g @ act + 1e-4 * self.out
                back = g[:, None] * self.out[None, :] * (pooled > 0) * np.isfinite(pooled)
                for i, (w, bank) in enumerate(zip(WIDTHS, self.filters)):
                    for c in range(FILTERS):
                        col = i * FILTERS + c
                        rows = np.flatnonzero(back[:, col])
                        for k in range(w):
                            p = at[rows, col] + k
                            inside = p < off[rows + 1]
                            p, r = p[inside], rows[inside]
                            grads[i][k, :, c] += (back[r, col][:, None] * self.emb[f[p]].sum(1)).sum(0)
                            step = 0.05 * back[r, col][:, None, None] * bank[k, :, c][None, None, :]
                            np.subtract.at(self.emb, f[p], np.broadcast_to(step, (len(p), f.shape[1], DIM)))
                    grads[i] += 1e-4 * bank
                t += 1
                for p, gr, a, b in zip(params, grads, m, v):
                    a[...] = 0.9 * a + 0.1 * gr
                    b[...] = 0.999 * b + 0.001 * gr * gr
                    p -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
                bias_m, bias_v = 0.9 * bias_m + 0.1 * float(g.sum()), 0.999 * bias_v + 0.001 * float(g.sum()) ** 2
                self.bias -= np.float32(0.01 * (bias_m / (1 - 0.9**t)) / (np.sqrt(bias_v / (1 - 0.999**t)) + 1e-8))

    def calibrate(self, logit: np.ndarray, hint: np.ndarray, y: np.ndarray) -> None:
        """Slope and common threshold by a logistic fit; a language's threshold is the one with the fewest errors
        on its texts, shrunk to the common one by how few positives there are."""
        w, b = fit_logistic(logit[:, None], y)
        self.slope = max(1e-3, float(w[0]))
        common = self._best(logit, y, -float(b) / self.slope)
        for k in range(len(self.threshold)):
            own = hint == k
            n = int(y[own].sum())
            self.threshold[k] = common if not n else common + (self._best(logit[own], y[own], common) - common) * n / (n + 20)

    @staticmethod
    def _best(x: np.ndarray, y: np.ndarray, start: float) -> float:
        """The cut with the fewest errors; in a gap between classes the middle of the gap, among ties the nearest to ``start``."""
        order = np.argsort(x)
        x, y = x[order], y[order]
        wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
        cuts = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]]) if len(x) else np.array([start])
        best = np.flatnonzero(wrong == wrong.min()) if len(x) else np.array([0])
        return float(cuts[best[np.argmin(np.abs(cuts[best] - start))]])

    def score(self, logit: np.ndarray, hint: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        return sigmoid(self.slope * (logit - self.threshold[hint]))


def _column_scores(model: Cnn, col) -> np.ndarray:
    best = np.full((len(col), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    for rows, f, off in _blocks_of_rows(col):
        np.maximum.at(best, rows, model.pooled(f, off))
    return model.score(model.logits(best), language_hint(*tx.column_bytes(col)))


def fit(docs: DataFrame, labels: DataFrame, learn, sample_per_class: int = SAMPLE_PER_CLASS, train_words: int = TRAIN_WORDS, epochs: int = EPOCHS) -> Cnn:
    def sampled(batches):
        for batch in batches:
            hint = language_hint(*tx.column_bytes(batch.column("text")))
            for i, (d, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist())):
                f, _ = features(batch.column("text").slice(i, 1))
                if len(f) > train_words:
                    f = f[np.arange(train_words) * len(f) // train_words]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([y], pa.int32()), pa.array([int(hint[i])], pa.int32()), pa.array([f.astype(np.uint16).tobytes()], pa.binary())], ["doc_id", "y", "hint", "words"])

    sample = labelled_sample(docs, labels, "toxic", learn, sample_per_class).select("doc_id", "text", "y")
    rows = sample.mapInArrow(sampled, "doc_id long, y int, hint int, words binary").orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").collect()
    model = Cnn()
    classes = {r["y"] for r in rows}
    if len(classes) < 2:
        model.constant = float(next(iter(classes))) if classes else 0.0
        return model
    y = np.array([r["y"] for r in rows], float)
    hint = np.array([r["hint"] for r in rows])
    words = [np.frombuffer(r["words"], np.uint16).reshape(-1, 1 + len(PREFIXES)).astype(np.int32) for r in rows]
    third = np.zeros(len(rows), int)
    for k in (0, 1):  # thirds of each class
        own = np.flatnonzero(y == k)
        third[own] = np.arange(len(own)) % 3
    pick = lambda k: ([words[i] for i in np.flatnonzero(third == k)], y[third == k])
    model.start_odds(*pick(0))
    model.train(*pick(1), epochs, np.random.default_rng(SEED))
    last = np.flatnonzero(third == 2) if (third == 2).any() else np.arange(len(rows))
    logit = np.concatenate([model.logits(model.pooled(words[i], np.array([0, len(words[i])]))) for i in last])
    model.calibrate(logit, hint[last], y[last])
    return model


def predict(docs: DataFrame, model: Cnn) -> DataFrame:
    """``docs`` with ``score`` instead of a column of that name."""
    shared = share(docs.sparkSession, model)
    rest = [c for c in docs.columns if c != "score"]
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", score double"

    def run(batches):
        own = shared()
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                score = _column_scores(own, part.column("text")).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])

    return kept.mapInArrow(run, schema)
