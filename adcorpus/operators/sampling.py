"""Reproducible exemplar sampling.

Randomness is a hash of seed and row id: the same rows come out whatever the partitioning,
and also after a lost executor. Sampling per label aggregates two integers per label instead
of collecting or sorting a label's rows, so a label holding most of the table is no problem.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adcorpus.functions.chat import last_content


def sample_key(id_column: str, seed: int) -> Column:
    """60 bits of ``md5(seed:id)`` as a bigint, a fixed-width key that hash aggregates handle.

    Never null: a row without an id sorts after all others.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return F.coalesce(key, F.lit(2**63 - 1))


def record_pairs(
    records: DataFrame, keep: Sequence[str], label: str = "category", messages: str = "messages"
) -> DataFrame:
    """``keep``, ``text`` and ``label``: last user and last assistant content of each record.

    Records where either is missing or empty are dropped.
    """
    pairs = records.select(
        *keep,
        last_content(F.col(messages), "user").alias("text"),
        last_content(F.col(messages), "assistant").alias(label),
    )
    return pairs.where((F.col("text") != "") & (F.col(label) != ""))


def one_per_label(
    df: DataFrame,
    label: str,
    id_column: str,
    order: str,
    max_labels: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """One random row per label, for the first ``max_labels`` labels by first appearance.

    Adds ``first_pos``, the smallest ``order`` of the label. The first pass reads label, order
    and id only; the second fetches the winning rows by ``(label, key)``. Should two rows of a
    label share the winning key, the smaller id is taken.
    """
    usable = df.where(F.col(label).isNotNull() & (F.col(label) != ""))
    keyed = usable.withColumn("_key", sample_key(id_column, seed))
    winners = keyed.groupBy(label).agg(
        F.min("_key").alias("_key"), F.min(order).alias("first_pos")
    )
    if max_labels is not None:
        winners = winners.orderBy("first_pos", label).limit(max_labels)
    rest = [c for c in df.columns if c != label]
    return (
        keyed.join(winners, [label, "_key"])
        .groupBy(label, "first_pos")
        .agg(F.min_by(F.struct(*rest), F.col(id_column)).alias("r"))
        .select(label, "first_pos", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def sample_k(df: DataFrame, k: int, id_column: str, seed: int = 42) -> DataFrame:
    """``k`` random rows without replacement, or all rows when there are no more than ``k``.

    Planned as a per-task top-k and one merge of the survivors; nothing is shuffled.
    """
    return (
        df.withColumn("_key", sample_key(id_column, seed))
        .orderBy("_key", id_column)
        .limit(k)
        .drop("_key")
    )
