"""Operator 8: compression classifier for text quality.

Two zstandard dictionaries are built, one from blocks of good and one from
blocks of bad labelled texts. A text is cut into blocks of ``BLOCK_BYTES``, each
block is compressed with either dictionary, and the difference of the two
compressed sizes over the text's bytes is the raw measure: bad text
compresses better with the dictionary of bad text. Blocks keep the dictionaries relevant over
the whole of a long text. A logistic fit on labelled texts that the
dictionaries have not seen turns the measure into a score in 0..1.

Learning takes at most ``sample_per_class`` labelled documents of each class
and ``blocks_per_doc`` evenly spread blocks of each. Scoring is one scan of whole texts, no shuffle.

Defined results: a null or empty text has measure 0 (the dictionaries tell
nothing) and its calibrated score; a document labelled twice counts as good
if any label says so; rows with a null label or id teach nothing; with one class only, the
score is 1 or 0 for that class, with none 0.5; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.logistic import fit_logistic, sigmoid
from corpuslab.llm.shared import share

BLOCK_BYTES = 512
DICT_BYTES = 112_640
LEVEL = 3
SAMPLE_PER_CLASS = 3_000
BLOCKS_PER_DOC = 16


def cut(text: str | None, size: int) -> list[bytes]:
    data = (text or "").encode("utf-8")
    return [data[i : i + size] for i in range(0, len(data), size)]


def spread(blocks: list, most: int) -> list:
    """At most ``most`` blocks, evenly spread over the whole text."""
    if len(blocks) <= most:
        return blocks
    return [blocks[i * len(blocks) // most] for i in range(most)]


class Compressors:
    """The two dictionaries and the calibration; compressors are made on first use in a process."""

    def __init__(self, good: bytes, bad: bytes, weight: float = 1.0, bias: float = 0.0, constant: float | None = None):
        self.good, self.bad, self.weight, self.bias, self.constant = good, bad, weight, bias, constant
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def measure(self, blocks: list[bytes]) -> float:
        """(size with the bad dictionary - size with the good one) / bytes."""
        if not blocks or self.constant is not None:
            return 0.0
        if self.made is None:
            import zstandard as zstd

            self.made = []
            for data in (self.good, self.bad):
                d = zstd.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                self.made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        good, bad = self.made
        return sum(len(bad(b)) - len(good(b)) for b in blocks) / sum(map(len, blocks))

    def score(self, measure: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(measure), self.constant)
        return sigmoid(self.weight * np.asarray(measure) + self.bias)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the raw samples where there are too few to train one."""
    import zstandard as zstd

    total = sum(map(len, samples))
    try:
        return zstd.train_dictionary(min(size, max(256, total // 4)), samples, k=200, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:] or b"\x00" * 8


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled documents of each class, in an order by a hash of the id.

    ``learn`` is a condition on ``doc_id``. The picked ids are bounded, so they are broadcast and the texts are scanned once.
    """
    y = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(learn)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    picked = None
    for k in (0, 1):
        own = y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, learn, sample_per_class: int = SAMPLE_PER_CLASS, blocks_per_doc: int = BLOCKS_PER_DOC) -> Compressors:
    """Dictionaries from one half of the sample, calibration from the other."""

    def blocks(batches):
        for batch in batches:
            cols = batch.to_pydict()
            out = [spread(cut(t, BLOCK_BYTES), blocks_per_doc) for t in cols["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(cols["y"], pa.int32()), pa.array(out, pa.list_(pa.binary()))], ["doc_id", "y", "blocks"])

    sample = labelled_sample(docs, labels, "quality", learn, sample_per_class)
    rows = sorted((r["doc_id"], r["y"], r["blocks"]) for r in sample.mapInArrow(blocks, "doc_id long, y int, blocks array<binary>").collect())
    classes = {y for _, y, _ in rows}
    if len(classes) < 2:
        return Compressors(b"", b"", constant=float(next(iter(classes))) if classes else 0.5)
    parts: dict[tuple, list] = {}
    for y in (0, 1):
        for i, (_, _, b) in enumerate(r for r in rows if r[1] == y):
            parts.setdefault((y, i % 2), []).append([bytes(x) for x in b])
    model = Compressors(*(_dictionary([b for doc in parts[y, 0] for b in doc if len(b) >= 8], DICT_BYTES) for y in (1, 0)))
    rest = [(y, doc) for y in (0, 1) for doc in parts.get((y, 1), parts[y, 0])]
    x = np.array([model.measure(doc) for _, doc in rest])
    y = np.array([y for y, _ in rest], float)
    share = np.bincount(y.astype(int), minlength=2) / len(y)
    weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0])
    w, b = fit_logistic(x[:, None] / (x.std() or 1.0), y, weight)
    model.weight, model.bias = float(w[0] / (x.std() or 1.0)), float(b)
    return model


def predict(docs: DataFrame, model: Compressors) -> DataFrame:
    """``docs`` with ``score`` instead of a column of that name."""
    shared = share(docs.sparkSession, model)
    rest = [c for c in docs.columns if c != "score"]
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", score double"

    def run(batches):
        m = shared()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                x = np.array([m.measure(cut(t.as_py(), BLOCK_BYTES)) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.score(x), pa.float64())], [*part.schema.names, "score"])

    return kept.mapInArrow(run, schema)
