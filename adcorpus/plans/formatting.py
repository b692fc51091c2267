"""Format every split, task and variant of a corpus in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adcorpus.functions.chat import chat_record
from adcorpus.operators.prompts import (
    category_messages,
    map_alternate_schema,
    merge_variants,
    salary_messages,
)
from adcorpus.sources.writers import write_chat

FANOUT_COLUMNS = ("task", "variant", "shots", "split")


def format_splits(
    ads: DataFrame,
    alternate: DataFrame | None,
    vocabulary: DataFrame,
    category_exemplars: DataFrame | None = None,
    salary_exemplars: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``task, variant, shots, split, messages`` (and ``keep``) for both tasks and both schemas.

    Both tables need a ``split`` column. With exemplars the records are few-shot, otherwise
    zero-shot; ``shots`` says which, so that both forms fit in one output.
    """
    kept = ["split", *keep]
    category = category_messages(ads, vocabulary, keep=kept, exemplars=category_exemplars)
    salary = {"main": salary_messages(ads, keep=kept, exemplars=salary_exemplars)}
    if alternate is not None:
        mapped = map_alternate_schema(alternate, keep=kept)
        salary["alternate"] = salary_messages(mapped, keep=kept, exemplars=salary_exemplars)
    tasks = [
        merge_variants(main=category).withColumn("task", F.lit("category")),
        merge_variants(**salary).withColumn("task", F.lit("salary")),
    ]
    few = (category_exemplars is not None, salary_exemplars is not None)
    tasks = [t.withColumn("shots", F.lit("few" if f else "zero")) for t, f in zip(tasks, few)]
    return tasks[0].unionByName(tasks[1]).select(*FANOUT_COLUMNS, *keep, "messages")


def write_splits(formatted: DataFrame, path: str, mode: str = "error") -> None:
    """Write :func:`format_splits` output as chat records partitioned by :data:`FANOUT_COLUMNS`."""
    records = formatted.select(
        *FANOUT_COLUMNS, chat_record(F.col("messages")).alias("r")
    ).select(*FANOUT_COLUMNS, "r.*")
    write_chat(records, path, partition_by=FANOUT_COLUMNS, mode=mode)
