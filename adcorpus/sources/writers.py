"""Writers. Hot partitions are split before a partitioned write, never funnelled to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from adcorpus.operators.grid import RUN_COLUMNS


def balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of a partition together, hot partitions split, small ones merged.

    The rebalance hint lets adaptive execution choose the number and size of output files.
    """
    return df.hint("rebalance", *columns)


def write_chat(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "error",
    rebalance: bool = False,
) -> None:
    """Chat records as JSON lines, UTF-8, null fields left out.

    By default tasks write what they formatted, without a shuffle: a few partitions per task are
    cheaper than moving every text. ``rebalance`` trades that shuffle for fewer files.
    """
    if rebalance:
        df = balanced(df, *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def write_exemplars(df: DataFrame, path: str, mode: str = "error") -> None:
    """Exemplars as CSV with a header; quotes are doubled and outer spaces are kept."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_evaluation(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per name under ``path``, partitioned by run.

    Saving a run again replaces its rows and leaves the other runs as they are.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*RUN_COLUMNS).parquet(f"{path}/{name}")


def append_results(df: DataFrame, path: str) -> None:
    """Append a batch of extraction results, partitioned by source."""
    balanced(df, "source").write.mode("append").partitionBy("source").parquet(path)
