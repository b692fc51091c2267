"""Stored pages in hash buckets, so that a join by URL reads them where they are."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BUCKETS = 64


def _name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, key: str = "url", buckets: int = BUCKETS) -> None:
    """``df`` as a new Parquet table at ``path`` in ``buckets`` by the hash of ``key``. A bucket is
    one file or more per writing task; none is sorted or gathered."""
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(_name(path))


def read_bucketed(
    spark: SparkSession, path: str, schema: T.StructType, key: str = "url", buckets: int = BUCKETS
) -> DataFrame:
    """What :func:`write_bucketed` wrote, in any session: the buckets are declared again, so that
    joins and aggregates by ``key`` need no exchange of this side."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(path)} ({fields}) USING parquet"
        f" CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_name(path))


def drop_declaration(spark: SparkSession, paths: Sequence[str]) -> None:
    """Forget the tables declared at ``paths``; their files stay."""
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
