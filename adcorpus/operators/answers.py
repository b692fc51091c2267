"""Asking a model: attempts per prompt, and what they say about a URL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Answer = Callable[[list[str]], Sequence[str | None]]

ANSWERED, FAILED = "answered", "failed"
ATTEMPT = "array<struct<attempt:int,outcome:string,answer:string,error:string>>"
LEDGER = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("run", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def attempts_at(answer: Answer, prompts: list[str], max_attempts: int, batch_size: int) -> list[list[dict]]:
    """Every prompt's attempts in order. None is a failed attempt. A call that raises fails for all
    its prompts; what failed is asked again prompt by prompt, so that one prompt that breaks the
    model does not take others with it."""
    tries: list[list[dict]] = [[] for _ in prompts]
    todo = list(range(len(prompts)))
    for attempt in range(1, max_attempts + 1):
        size = batch_size if attempt == 1 else 1
        left = []
        for start in range(0, len(todo), size):
            some = todo[start : start + size]
            error = None
            try:
                answers = list(answer([prompts[i] for i in some]))
                if len(answers) != len(some):
                    raise ValueError(f"{len(answers)} answers for {len(some)} prompts")
            except Exception as problem:  # noqa: BLE001 the model is the caller's; its errors are outcomes
                answers, error = [None] * len(some), f"{type(problem).__name__}: {problem}"
            for i, text in zip(some, answers, strict=True):
                outcome = FAILED if text is None else ANSWERED
                tries[i].append({"attempt": attempt, "outcome": outcome, "answer": text, "error": error})
                if text is None:
                    left.append(i)
        todo = left
    return tries


def ask(
    df: DataFrame,
    build: Callable[[], Answer],
    prompt: str = "prompt",
    max_attempts: int = 3,
    batch_size: int = 64,
    name: str = "tries",
) -> DataFrame:
    """Add ``name``: the attempts at ``prompt``, at most ``max_attempts``, the last one answered
    unless all failed. ``build`` runs once per task that has prompts; only prompts go to Python."""

    @F.pandas_udf(ATTEMPT)
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = None
        for rows in batches:
            if len(rows) and answer is None:
                answer = build()
            yield pd.Series(attempts_at(answer, rows.tolist(), max_attempts, batch_size), dtype=object)

    return df.withColumn(name, asked.asNondeterministic()(F.col(prompt)))


def ledger_state(ledger: DataFrame, run: int) -> DataFrame:
    """``(source, url, n_failed, failed_now)``: failed attempts over all runs, and whether ``run``
    has asked in vain; one aggregate with fixed-width buffers."""
    failed = F.col("outcome") == FAILED
    return ledger.groupBy("source", "url").agg(
        F.count_if(failed).alias("n_failed"),
        F.max(failed & (F.col("run") == run)).alias("failed_now"),
    )
