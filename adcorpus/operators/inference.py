"""Batched text generation with a function the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adcorpus.sources.snapshots import Snapshots

Generate = Callable[[list[str]], Sequence[str]]
#: Texts and a budget to (head, number of tokens of the whole text) per text.
Encode = Callable[[list[str], int], Sequence[tuple[str, int]]]

ANSWERS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("prompt_sha256", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)


def batch_generate(
    df: DataFrame,
    build: Callable[[], Generate],
    prompt: str = "prompt",
    batch_size: int = 64,
    name: str = "generated_text",
) -> DataFrame:
    """Add ``name``: ``build()``'s function applied to ``prompt`` in batches of ``batch_size``.

    ``build`` runs once per task that has rows, so a model is loaded once and not per batch. The function
    must return one text per prompt. Only prompts go to Python and only texts come back, in Arrow
    batches of which a task holds one.
    """

    @F.pandas_udf("string")
    def generated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = None
        for rows in batches:
            if len(rows) and generate is None:
                generate = build()
            texts: list[str] = []
            for start in range(0, len(rows), batch_size):
                prompts = rows.iloc[start : start + batch_size].tolist()
                answers = list(generate(prompts))
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} texts for {len(prompts)} prompts")
                texts.extend(answers)
            yield pd.Series(texts, dtype=object)

    # A model need not answer twice alike, and must not be asked twice.
    return df.withColumn(name, generated.asNondeterministic()(F.col(prompt)))


def token_budget_with(
    df: DataFrame,
    build: Callable[[], Encode],
    text: str,
    max_tokens: int = 512,
) -> DataFrame:
    """Token budget with the caller's tokenizer.

    ``build()`` gives a function of texts and budget that returns ``(head, n_tokens)`` per text,
    ``n_tokens`` counting the whole text. Adds ``head``, ``n_tokens`` and ``truncated``.
    """

    @F.pandas_udf("head string, n_tokens bigint")
    def budgeted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = build()
        for rows in batches:
            pairs = list(encode(rows.tolist(), max_tokens))
            yield pd.DataFrame(pairs, columns=["head", "n_tokens"])

    return df.withColumn("_budget", budgeted.asNondeterministic()(F.col(text))).select(
        *df.columns,
        F.col("_budget.head").alias("head"),
        F.col("_budget.n_tokens").alias("n_tokens"),
        (F.col("_budget.n_tokens") > max_tokens).alias("truncated"),
    )


def cut_texts(df: DataFrame, build: Callable[[], Encode], text: str, room: str) -> DataFrame:
    """``df`` with ``text`` cut to its first ``room`` tokens, a number of its own per row."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = build()
        for texts, rooms in batches:
            yield pd.Series([encode([t], int(n))[0][0] for t, n in zip(texts, rooms, strict=True)], dtype=object)

    return df.withColumn(text, cut.asNondeterministic()(F.col(text), F.col(room)))


def generate_once(
    df: DataFrame,
    build: Callable[[], Generate],
    path: str,
    run: str,
    prompt: str = "prompt",
    batch_size: int = 64,
    name: str = "generated_text",
    commits: int = 1,
) -> DataFrame:
    """Add ``name`` to every row, asking the model once per run and distinct prompt.

    Answers are kept in the snapshot store at ``path`` by (run, digest of the prompt). What is there
    is not asked again, so a rerun continues where the last one ended, and one over the same
    prompts calls the function not at all. New prompts are asked in ``commits`` shares by digest,
    each of which stays when a later one is lost. A null prompt gets a null answer.
    """
    store = Snapshots(df.sparkSession, path)
    digest = F.sha2(F.col(prompt), 256)
    asked = df.where(F.col(prompt).isNotNull()).select(digest.alias("prompt_sha256"), F.col(prompt).alias("prompt"))

    def known() -> DataFrame:
        return store.read("answers", ANSWERS).where(F.col("run") == run).select("prompt_sha256", "answer")

    for share in range(commits):
        part = asked.where(F.pmod(F.xxhash64("prompt_sha256"), F.lit(commits)) == share)
        # keys first: prompts that have an answer do not move
        missing = part.join(known().select("prompt_sha256"), "prompt_sha256", "left_anti").dropDuplicates(["prompt_sha256"])
        version = store.next_version()
        answers = batch_generate(missing, build, "prompt", batch_size, "answer")
        folder = store.stage(answers.select(F.lit(run).alias("run"), "prompt_sha256", "answer"), "answers", version)
        if store.staged(folder, ANSWERS).limit(1).count():
            store.commit(version, {"answers": [folder]})
    answers = known().withColumnRenamed("answer", name)
    rows = df.withColumn("_digest", digest)
    some = rows.where(F.col("_digest").isNotNull()).join(answers, F.col("_digest") == F.col("prompt_sha256"))
    none = rows.where(F.col("_digest").isNull()).withColumn(name, F.lit(None).cast("string"))
    return some.select(*df.columns, name).unionByName(none.select(*df.columns, name))
