"""Helpers that the corpus operators share: whole-table reads and Arrow functions over rows."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.sources.scratch import shared_dir, written

__all__ = ["DOCUMENTS", "as_text", "documents", "free_prefix", "map_arrow", "shared_dir", "without_rows", "written"]

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` whose workers find this package where driver and workers share a disk;
    elsewhere it comes with --py-files or is installed."""
    root = str(Path(__file__).resolve().parents[2])
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)

    def released(batches):
        """Workers outlive their task, so what a batch took goes back at once."""
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix`` with as many underscores before it as it takes for no column to begin with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix


#: Rows of keys up to which they are broadcast (under 100 bytes each).
BROADCAST_KEYS = 300_000


def without_rows(df: DataFrame, keys: Mapping[str, Column], lost: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``keys`` are a row of ``lost``, a written table with columns
    of the same names; null is a key like any other. Few lost rows go to where ``df`` is read;
    many meet it in a shuffle."""
    prefix = free_prefix(df, "_lost")
    gone = lost.select(*[F.col(k).alias(f"{prefix}_{k}") for k in keys])
    on = [expression.eqNullSafe(F.col(f"{prefix}_{k}")) for k, expression in keys.items()]
    few = gone.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(gone) if few else gone, on, "left_anti")


def as_text(column: str = "text"):
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
