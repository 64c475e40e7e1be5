"""Operator 4: a reproducible shuffle into shards by a Feistel permutation.

Every row gets a global row number: its rank by a 64-bit hash of (doc_id, text
crc32, size). Ranks are row numbers inside hash ranges plus the running count of the
ranges before, so no task sees all rows, and they do not depend on the number of ranges or
partitions. A keyed Feistel network over the smallest power of four not below the row count
permutes the numbers; a result outside the count is sent through again until it
falls inside (cycle walking), which keeps it a permutation of the row numbers. Position
``p`` is shard ``p % shards``, slot ``p // shards``: shard sizes differ by at most one,
slots have no gaps, and both follow from the row number, the count and the
seed alone (:func:`place`; :func:`row_at` is the inverse).

Defined results: a null text has size 16 and the crc32 of the empty text; a null id hashes as null;
rows equal in id, text and size have neighbouring row numbers in any order, as they cannot be
told apart; fewer rows than shards leave shards empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import stage
from corpuslab.llm import textops as tx

ROUNDS = 6
SEED = 20_240_607
RANGE_ROWS = 250_000


def half_bits(rows: int) -> int:
    """Bits of either half of the permuted numbers."""
    return max(1, math.ceil(max(1, (rows - 1).bit_length()) / 2))


def _keys(seed: int) -> np.ndarray:
    return tx.constants(ROUNDS, seed)


def _network(x: np.ndarray, h: int, keys, inverse: bool) -> np.ndarray:
    mask, shift = tx.U64((1 << h) - 1), tx.U64(h)
    left, right = x >> shift, x & mask
    for k in reversed(keys) if inverse else keys:
        if inverse:
            left, right = right ^ (tx.mix(left + k) & mask), left
        else:
            left, right = right, left ^ (tx.mix(right + k) & mask)
    return (left << shift) | right


def _walk(x, rows: int, seed: int, inverse: bool) -> np.ndarray:
    x = np.asarray(x, dtype=tx.U64).copy()
    h, keys = half_bits(rows), _keys(seed)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _network(x[todo], h, keys, inverse)
        todo = todo[x[todo] >= tx.U64(rows)]
    return x.astype(np.int64)


def permute(row_number, rows: int, seed: int = SEED) -> np.ndarray:
    """Position of each row number in the shuffle of ``rows`` rows."""
    return _walk(row_number, rows, seed, False)


def unpermute(position, rows: int, seed: int = SEED) -> np.ndarray:
    return _walk(position, rows, seed, True)


def place(row_number, rows: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    p = permute(row_number, rows, seed)
    return p % shards, p // shards


def row_at(shard, slot, rows: int, shards: int, seed: int = SEED) -> np.ndarray:
    """The row number that stands in a slot of a shard."""
    return unpermute(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64), rows, seed)


def numbered(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row_number and the carried columns) and the row count."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(f"`{c}`").alias(f"carried_{c}") for c in carry],
    ).withColumn("h", F.xxhash64("doc_id", "text_crc32", "size"))
    rows = stage.written(rows, "shard-rows")
    total = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, total / RANGE_ROWS))))
    range_ = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("range", range_)
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    # one row for every RANGE_ROWS rows; the running sum over these few rows is the offset of each range
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("range", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("range").orderBy(F.expr("shiftrightunsigned(h, 32)"), F.expr("h & 4294967295L"), "doc_id", "text_crc32", "size")
    out = rows.join(before, "range").withColumn("row_number", F.row_number().over(order) - 1 + F.col("before"))
    return out.drop("range", "before", "h"), total


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's shard and slot under the ``rows`` law."""
    rows, total = numbered(docs, carry)

    def run(batches):
        for batch in batches:
            shard, slot = place(batch.column("row_number").to_numpy(), total, shards, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], [*batch.schema.names, "shard", "slot"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", shard int, slot long"
    return rows.mapInArrow(run, schema)


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = SEED) -> None:
    """The shuffled documents as one folder per shard, in slot order inside each file."""
    placed = shuffle_into_shards(docs, shards, seed, carry=("text",)).withColumnRenamed("carried_text", "text")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
