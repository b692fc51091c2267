"""Run grids: every model with every adapter on every test set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adcorpus.functions.bounded import distinct_array
from adcorpus.operators.metrics import null_safe_join

NO_ADAPTER = "no-adapter"
RUN_COLUMNS = ("model", "adapter", "test_tag")


def run_grid(
    models: DataFrame, adapters: DataFrame, tests: DataFrame, max_choices: int, max_bytes: int = 1 << 20
) -> DataFrame:
    """One row per combination of the three single-column configuration frames.

    A launcher's product of short lists, at most ``max_choices`` entries each; where runs are
    found in data or planned one by one, :func:`grid_of` has no limit. A blank or null adapter is
    one run, named ``no-adapter``. Adds ``run_id``, the joined names.
    """
    lists = [
        df.select(F.col(df.columns[0]).cast("string").alias(name))
        for df, name in zip((models, adapters, tests), RUN_COLUMNS)
    ]
    lists[1] = adapter_label(lists[1], RUN_COLUMNS[1])
    arrays = [
        distinct_array(df, F.col(name), max_choices, max_bytes, name)
        for df, name in zip(lists, RUN_COLUMNS)
    ]
    grid = arrays[0].select(F.explode("items").alias("model"))
    for choices, name in zip(arrays[1:], RUN_COLUMNS[1:]):
        grid = grid.withColumn("_items", choices.scalar()).select(
            *grid.columns, F.explode("_items").alias(name)
        )
    return grid.withColumn("run_id", F.concat_ws("/", *RUN_COLUMNS))


def grid_of(runs: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """The runs that occur in ``runs``, and the ``planned`` ones; no product is built."""
    found = adapter_label(runs.select(*RUN_COLUMNS), "adapter")
    if planned is not None:
        found = found.union(adapter_label(planned.select(*RUN_COLUMNS), "adapter"))
    return found.distinct().withColumn("run_id", F.concat_ws("/", *RUN_COLUMNS))


def adapter_label(df: DataFrame, column: str) -> DataFrame:
    """Blank or null adapters become ``no-adapter``."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(NO_ADAPTER))
    return df.withColumn(column, value)


def scores_on_grid(grid: DataFrame, scores: DataFrame, by: Sequence[str] = RUN_COLUMNS) -> DataFrame:
    """All runs of the grid with their scores; runs without rows keep null scores."""
    return null_safe_join(grid, scores, list(by), "left")
