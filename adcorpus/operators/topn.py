"""The first rows of each group, by number or by weight, where one group may hold most of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adcorpus.operators.metrics import null_safe_join

BUCKET = 65_536


def take_first(
    rows: DataFrame, group: str, order: str, limit: int | DataFrame, bucket: int = BUCKET
) -> DataFrame:
    """The first rows of each ``group`` by ``order``, an integer that is unique in its group.

    ``limit`` is one number for all groups, or a frame of ``group`` and ``n_remaining``; groups
    that the frame lacks give nothing. No group is ranked in one task: ``order`` is cut into
    buckets of at most ``bucket`` rows, a running total over the bucket counts gives each bucket
    its offset, and only rows within one bucket are ranked.
    """
    bucketed = rows.withColumn("_bucket", F.col(order) - F.pmod(order, F.lit(bucket)))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    offsets = (
        bucketed.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(before) - F.col("_n"))
    )
    if isinstance(limit, int):
        offsets = offsets.withColumn("_limit", F.lit(limit))
    else:
        limits = limit.select(group, F.col("n_remaining").alias("_limit"))
        offsets = offsets.join(limits, group)
    needed = offsets.where(F.col("_before") < F.col("_limit")).drop("_n")
    rank = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(order))
    return (
        bucketed.join(needed, [group, "_bucket"])
        .withColumn("_rank", F.col("_before") + rank)
        .where(F.col("_rank") <= F.col("_limit"))
        .select(*rows.columns)
    )


def take_weight(
    rows: DataFrame, group: str, order: str, weight: str, limit: int, bucket: int = BUCKET
) -> DataFrame:
    """The first rows of each ``group`` by ``order`` until their ``weight`` adds up to ``limit``,
    with ``before``: the weight of the rows before. The last one may go beyond the limit.

    ``order`` is an integer that is unique in its group, and weights are not negative; rows without
    weight are left out. Weights are summed by bucket of ``order`` first, and only buckets that
    begin below the limit are put in order: one bucket at a time, of at most ``bucket`` rows.
    """
    bucketed = rows.where(F.col(weight) > 0).withColumn("_bucket", F.col(order) - F.pmod(order, F.lit(bucket)))
    earlier = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = bucketed.groupBy(group, "_bucket").agg(F.sum(weight).alias("_sum"))
    sums = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = W.partitionBy(group, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        null_safe_join(bucketed, sums.where(F.col("_base") < limit), [group, "_bucket"])
        .withColumn("before", F.col("_base") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .where(F.col("before") < limit)
        .select(*rows.columns, "before")
    )
