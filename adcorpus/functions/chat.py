"""Column helpers for chat records held as ``array<struct<role, content>>``.

One record is one row, so everything here is a narrow projection or filter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adcorpus.constants import CHATML_GENERATION, CHATML_MESSAGE
from adcorpus.functions.text import strip, tokens


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(*items: tuple[str, Column]) -> Column:
    return F.array(*[message(role, content) for role, content in items])


def chat_record(msgs: Column, expected: Column | None = None) -> Column:
    """``struct<messages, expected>``; a blank ``expected`` is null, which JSON writers omit."""
    value = F.lit(None).cast("string") if expected is None else F.nullif(expected, F.lit(""))
    return F.struct(msgs.alias("messages"), value.alias("expected"))


def last_content(msgs: Column, role: str) -> Column:
    """Content of the last message with this role, or null."""
    return F.try_element_at(F.filter(msgs, lambda m: m["role"] == role), F.lit(-1))["content"]


def ground_truth(msgs: Column) -> Column:
    """Stripped, lowered content of the last message when the assistant wrote it, else null."""
    last = F.try_element_at(msgs, F.lit(-1))
    return F.when(last["role"] == "assistant", F.lower(strip(last["content"])))


def prompt_messages(msgs: Column) -> Column:
    """All messages but the last, when the assistant wrote the last one, else null."""
    last = F.try_element_at(msgs, F.lit(-1))
    return F.when(
        last["role"] == "assistant", F.slice(msgs, F.lit(1), F.size(msgs) - F.lit(1))
    )


def is_valid(msgs: Column) -> Column:
    """True when ``msgs`` is a list whose items all have a role and a content."""
    complete = F.forall(
        msgs, lambda m: m["role"].isNotNull() & m["content"].isNotNull()
    )
    return F.coalesce(complete, F.lit(False))


def render_message(
    role: Column, content: Column, template: tuple[str, str, str] = CHATML_MESSAGE
) -> Column:
    before, between, after = template
    return F.concat(F.lit(before), role, F.lit(between), content, F.lit(after))


def render(
    msgs: Column,
    generation_prompt: bool = False,
    template: tuple[str, str, str] = CHATML_MESSAGE,
    generation: str = CHATML_GENERATION,
) -> Column:
    """The record as one string, optionally followed by the opening of an assistant turn."""
    parts = F.transform(msgs, lambda m: render_message(m["role"], m["content"], template))
    text = F.array_join(parts, "")
    return F.concat(text, F.lit(generation)) if generation_prompt else text


def budget(text: Column, max_tokens: int = 512) -> Column:
    """Keep the first ``max_tokens`` whitespace tokens of the whole text.

    Gives ``struct<head, n_tokens, n_kept, truncated>``; ``n_tokens`` counts the whole text.
    """
    toks = tokens(text)
    n = F.size(toks).cast("bigint")
    return F.struct(
        F.array_join(F.slice(toks, 1, max_tokens), " ").alias("head"),
        n.alias("n_tokens"),
        F.least(n, F.lit(max_tokens).cast("bigint")).alias("n_kept"),
        (n > max_tokens).alias("truncated"),
    )
