"""Dense numbers in a total order without ranking everything in one task.

Rows are dealt out by range of the order, on quantiles that Spark samples, and sorted within each
range; a row's number is its place in its range plus the sizes of the ranges before. A group that
holds most rows is cut by its own order, so no task gets more than its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adcorpus.sources.scratch import written

#: ``monotonically_increasing_id`` puts the task above the place of the row.
PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number", ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in ``order``, written to the shared folder.

    Rows that tie in ``order`` are numbered in any order, but the same one at every read. Only one
    row per range is gathered to add up the sizes. ``ranges`` defaults to the shuffle partitions.
    """
    id_name = f"_{name}_id"
    while id_name in df.columns:
        id_name = "_" + id_name
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn(id_name, F.monotonically_increasing_id()), "numbered")
    task = F.shiftright(F.col(id_name), PLACE_BITS)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # at most one row per range
    out = dealt.join(F.broadcast(starts), task == F.col("_task"))
    place = F.col(id_name).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return out.select(*df.columns, (F.col("_start") + place).alias(name))


def positions(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "pos", ranges: int | None = None
) -> DataFrame:
    """``df`` with ``name``: the place of a row within its group, from 0, in ``order``. Null is a
    value of ``group`` like any other."""
    rows = numbered(df, [*[F.col(g) for g in group], *order], "_number", ranges)
    firsts = rows.groupBy(*group).agg(F.min("_number").alias("_first"))
    firsts = firsts.select(*[F.col(g).alias(f"_group_{g}") for g in group], "_first")
    same = [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in group]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    # one row per group on that side, so adaptive execution can split a hot one
    return rows.join(firsts, on).select(*df.columns, (F.col("_number") - F.col("_first")).alias(name))
