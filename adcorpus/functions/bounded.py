"""Small values that every row needs: built once, size-checked, attached without a join.

A label vocabulary or an exemplar list that one message must hold is one value. It is computed as
a one-row frame and attached as a scalar subquery, so the big side is neither shuffled nor joined.
The caller states how many entries and bytes a message may hold. Both are counted first, by an
aggregate with map-side combine; only when they fit is the array built, else the query raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_array(
    df: DataFrame,
    value: Column,
    max_items: int,
    max_bytes: int,
    what: str,
    name: str = "items",
    bytes_of: Column | None = None,
) -> DataFrame:
    """One row holding the ascending array of ``value``.

    Raises beyond ``max_items`` entries, or when ``bytes_of`` (by default the bytes of ``value``
    as text) adds up to more than ``max_bytes``.
    """
    size = F.octet_length(value.cast("string")) if bytes_of is None else bytes_of
    sized = df.select(value.alias("v"), F.coalesce(size, F.lit(0)).alias("b"))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    fits = totals.select(
        F.when(F.col("n") > max_items, F.raise_error(F.lit(f"{what}: more than {max_items} entries")))
        .when(F.col("b") > max_bytes, F.raise_error(F.lit(f"{what}: more than {max_bytes} bytes")))
        .otherwise(F.lit(True))
        .alias("fits")
    )
    # Joined to its one row of totals rather than filtered by a subquery: the array is itself used
    # as a subquery, and the optimizer fails on some nests of those.
    checked = sized.join(F.broadcast(fits), F.col("fits"))
    return checked.agg(F.sort_array(F.collect_list("v")).alias(name))


def distinct_array(
    df: DataFrame, value: Column, max_items: int, max_bytes: int, what: str, name: str = "items"
) -> DataFrame:
    """As :func:`bounded_array`, over the distinct non-null values."""
    values = df.select(value.alias("v")).where(F.col("v").isNotNull()).distinct()
    return bounded_array(values, F.col("v"), max_items, max_bytes, what, name)


def attach(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """Add the single value of ``one_row`` to every row as a scalar subquery."""
    return df.withColumn(name, one_row.scalar())
