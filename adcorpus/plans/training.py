"""Chat records to the texts a fine-tuning job reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adcorpus.functions.chat import budget, is_valid, render


def training_texts(
    records: DataFrame,
    keep: Sequence[str] = (),
    max_tokens: int = 512,
    messages: str = "messages",
) -> DataFrame:
    """``keep``, ``text`` and its token budget for every well-formed record.

    Records with a message that lacks a role or a content are dropped. The budget keeps the head
    of the text; :func:`adcorpus.operators.inference.token_budget_with` does the same with a
    tokenizer of the caller's.
    """
    valid = records.where(is_valid(F.col(messages)))
    rendered = valid.select(*keep, render(F.col(messages)).alias("text"))
    return rendered.select(*keep, "text", budget(F.col("text"), max_tokens).alias("b")).select(
        *keep, "text", "b.*"
    )
