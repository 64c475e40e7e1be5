"""Written intermediate tables and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import stage_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a new folder below the shared checkpoint folder and read it back.

    The plan is cut there: whoever reads the table re-reads files if an executor is lost.
    """
    path = stage_dir(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
