"""Score predictions over a grid of runs and write the result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adcorpus.functions.chat import ground_truth, is_valid, prompt_messages, render
from adcorpus.functions.text import is_present, parse_integer
from adcorpus.operators.grid import RUN_COLUMNS, adapter_label, scores_on_grid
from adcorpus.operators.labels import parse_category
from adcorpus.operators.metrics import (
    class_report,
    class_scores,
    confusion_cells,
    confusion_counts,
    confusion_matrix,
    flag_correct,
    keep_parsable,
    regression_scores,
)
from adcorpus.sources.writers import write_evaluation


def scorable_prompts(
    records: DataFrame, keep: Sequence[str] = (), messages: str = "messages"
) -> DataFrame:
    """``keep``, ``prompt`` and ``ground_truth`` of the records that can be scored.

    The last message must be the assistant's; the prompt renders the others and opens a new
    assistant turn, so it is never empty. Records with an empty truth, or with a message that
    lacks a role or a content, are dropped.
    """
    msgs = F.col(messages)
    last = F.try_element_at(msgs, F.lit(-1))
    usable = records.where(
        (last["role"] == "assistant") & is_present(last["content"]) & is_valid(msgs)
    )
    prompt = render(prompt_messages(msgs), generation_prompt=True)
    return usable.select(*keep, prompt.alias("prompt"), ground_truth(msgs).alias("ground_truth"))


def _runs(generations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs without an adapter get its label, as in the grid."""
    return adapter_label(generations, "adapter") if "adapter" in by else generations


def evaluate_categories(
    generations: DataFrame,
    vocabulary: DataFrame,
    by: Sequence[str] = RUN_COLUMNS,
    grid: DataFrame | None = None,
    dense: bool = False,
) -> dict[str, DataFrame]:
    """Tables ``predictions``, ``scores``, ``report`` and ``matrix``: the cells that occur, or with
    ``dense`` a cell for every pair of a run's labels.

    ``generations`` holds the run columns, ``ground_truth`` and ``generated_text``. All score
    tables derive from one aggregate, the confusion counts.
    """
    parsed = parse_category(_runs(generations, by), "generated_text", vocabulary, name="predicted_category")
    predictions = flag_correct(parsed, "ground_truth", "predicted_category")
    counts = confusion_counts(predictions, "ground_truth", "predicted_category", by)
    return {"predictions": predictions, **_from_counts(counts, by, grid, dense)}


def _from_counts(
    counts: DataFrame, by: Sequence[str], grid: DataFrame | None, dense: bool
) -> dict[str, DataFrame]:
    scores = class_scores(counts, by)
    return {
        "scores": scores if grid is None else scores_on_grid(grid, scores, by),
        "report": class_report(counts, by),
        "matrix": confusion_matrix(counts, by) if dense else confusion_cells(counts, by),
    }


def save_categories(
    generations: DataFrame,
    vocabulary: DataFrame,
    path: str,
    grid: DataFrame | None = None,
    dense: bool = False,
) -> None:
    """Write the tables of :func:`evaluate_categories` under ``path``, partitioned by run.

    The generations are read twice, for the predictions and for the counts; the three score
    tables share the cached counts, which hold a row per run and pair of labels.
    """
    generations = _runs(generations, RUN_COLUMNS)
    parsed = parse_category(generations, "generated_text", vocabulary, name="predicted_category")
    predictions = flag_correct(parsed, "ground_truth", "predicted_category")
    counts = confusion_counts(
        predictions, "ground_truth", "predicted_category", RUN_COLUMNS
    ).persist()
    try:
        tables = _from_counts(counts, RUN_COLUMNS, grid, dense)
        write_evaluation({"predictions": predictions, **tables}, path)
    finally:
        counts.unpersist()


def save_salaries(generations: DataFrame, path: str, grid: DataFrame | None = None) -> None:
    """Write the tables of :func:`evaluate_salaries` under ``path``, partitioned by run."""
    write_evaluation(evaluate_salaries(generations, RUN_COLUMNS, grid), path)


def evaluate_salaries(
    generations: DataFrame,
    by: Sequence[str] = RUN_COLUMNS,
    grid: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables ``predictions`` (parsable rows only) and ``scores`` (with coverage)."""
    parsed = _runs(generations, by).withColumn(
        "predicted_salary", parse_integer(F.col("generated_text"))
    ).withColumn("ground_truth_salary", parse_integer(F.col("ground_truth")))
    scores = regression_scores(parsed, "ground_truth_salary", "predicted_salary", by)
    return {
        "predictions": keep_parsable(parsed, "predicted_salary"),
        "scores": scores if grid is None else scores_on_grid(grid, scores, by),
    }
