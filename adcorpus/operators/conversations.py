"""Operators over conversations in long form: one row per ``(conv, turn)``.

No operator gathers a conversation of unknown length into one task. Whole-conversation facts
are aggregates with map-side combine, rows are filtered by joining those facts back (the fact
side holds one row per conversation, so an adaptive skew join can split a hot one), and
rendering works on parts of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adcorpus.constants import CHATML_GENERATION, CHATML_MESSAGE
from adcorpus.functions.chat import render_message
from adcorpus.functions.text import strip, token_count, tokens
from adcorpus.operators.inference import Encode, cut_texts, token_budget_with
from adcorpus.operators.metrics import null_safe_join
from adcorpus.operators.topn import BUCKET, take_first, take_weight
from adcorpus.sources.scratch import written


def _is(role: str) -> Column:
    return F.col("role") == role


def last_user_assistant(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", content: str = "text"
) -> DataFrame:
    """Last user text and last assistant text per conversation, where both are non-empty."""

    # Turn numbers are found first, in fixed-width aggregates; then only the winning texts are
    # fetched, by (conversation, turn), which no long conversation makes uneven.
    ends = df.groupBy(conv).agg(
        F.max(F.when(_is("user"), F.col(turn))).alias("_user"),
        F.max(F.when(_is("assistant"), F.col(turn))).alias("_assistant"),
    )
    ends = ends.where(F.col("_user").isNotNull() & F.col("_assistant").isNotNull())

    def last(role: str) -> DataFrame:
        wanted = ends.select(conv, F.col(f"_{role}").alias(turn))
        rows = df.where(_is(role)).select(conv, turn, F.col(content).alias(f"{role}_text"))
        # The last message of a role decides even when its content is missing.
        return rows.join(wanted, [conv, turn]).where(F.col(f"{role}_text") != "").drop(turn)

    return last("user").join(last("assistant"), conv)


def prompt_truth_split(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", content: str = "text"
) -> DataFrame:
    """Conversations that end with a non-empty assistant message, split in prompt and truth.

    Long form: all prompt messages (every message but the last) with ``part='prompt'`` and one
    row with ``part='truth'`` holding the stripped, lowered last content. A conversation of one
    assistant message has an empty prompt and only gives its truth row.
    """
    df = df.where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
    ends = df.groupBy(conv).agg(F.max(turn).alias(turn))
    truths = (
        df.where(_is("assistant"))
        .join(ends, [conv, turn])
        .select(conv, turn, "role", F.lower(strip(F.col(content))).alias("content"))
        .where(F.col("content") != "")
    )
    prompts = df.join(
        truths.select(conv, F.col(turn).alias("_last")), conv
    ).where(F.col(turn) < F.col("_last"))
    return truths.select(conv, turn, F.lit("truth").alias("part"), "role", "content").unionByName(
        prompts.select(
            conv, turn, F.lit("prompt").alias("part"), "role", F.col(content).alias("content")
        )
    )


def valid_conversations(
    df: DataFrame, conv: str = "conv_id", content: str = "text"
) -> DataFrame:
    """Rows of the conversations in which every message has a role and a content.

    Only the ids of broken conversations are gathered, which are normally few.
    """
    broken = df.where(F.col("role").isNull() | F.col(content).isNull()).select(conv).distinct()
    return df.join(broken, conv, "left_anti")


def _segments(
    df: DataFrame, conv: str, turn: str, content: str, template: tuple[str, str, str]
) -> DataFrame:
    """Each message as rendered text; a missing role or content counts as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce(content, F.lit(""))
    return df.select(conv, turn, render_message(role, text, template).alias("segment"))


def render_conversations(
    df: DataFrame,
    part_turns: int,
    conv: str = "conv_id",
    turn: str = "turn",
    content: str = "text",
    generation_prompt: bool = False,
    template: tuple[str, str, str] = CHATML_MESSAGE,
    generation: str = CHATML_GENERATION,
) -> DataFrame:
    """Rendered text per conversation as ``(conv, part, text, n_parts)``.

    ``part`` is ``turn // part_turns``, which the caller chooses: a conversation of fewer turns is
    one part and has ``n_parts`` 1, a longer one comes in ``n_parts`` parts whose concatenation by
    part is the whole text. Turns are unique within a
    conversation, so no group exceeds ``part_turns`` rows (one more with ``generation_prompt``).
    The generation prompt is added as one more segment after the last turn of its conversation.
    """
    segments = _segments(df, conv, turn, content, template)
    if generation_prompt:
        endings = df.groupBy(conv).agg((F.max(turn) + 1).alias(turn))
        segments = segments.unionByName(
            endings.select(conv, turn, F.lit(generation).alias("segment"))
        )
    part = F.expr(f"`{turn}` div {part_turns}").alias("part")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("segment"))))
    texts = segments.groupBy(conv, part).agg(
        F.array_join(F.transform(ordered, lambda s: s["segment"]), "").alias("text")
    )
    parts = segments.select(conv, part).distinct().groupBy(conv).agg(F.count(F.lit(1)).alias("n_parts"))
    return null_safe_join(texts, parts, [conv])


def conversation_budget(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    content: str = "text",
    max_tokens: int = 512,
    template: tuple[str, str, str] = CHATML_MESSAGE,
) -> DataFrame:
    """First ``max_tokens`` whitespace tokens of each rendered conversation, with totals.

    The template gives every message at least one token, so the head lies within the first
    ``max_tokens`` messages, and no group exceeds that many rows. The first messages are found from
    bucket counts, so that a very long conversation is not ranked in one task.
    ``n_tokens`` is the total over the whole conversation. The
    template must end its messages with whitespace, so that no token spans two of them.
    """
    if not "".join(template).strip() or not template[2][-1:].isspace():
        raise ValueError("the template must hold some text and end a message with whitespace")
    segments = _segments(df, conv, turn, content, template)
    totals = segments.groupBy(conv).agg(
        F.sum(token_count(F.col("segment"))).alias("n_tokens")
    )
    rank = F.row_number().over(W.partitionBy(conv).orderBy(turn))
    heads = (
        take_first(segments, conv, turn, max_tokens).withColumn("rank", rank)
        .where(F.col("rank") <= max_tokens)
        .groupBy(conv)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("rank", F.slice(tokens(F.col("segment")), 1, max_tokens).alias("t"))
                )
            ).alias("s")
        )
        .select(
            conv, F.slice(F.flatten(F.transform("s", lambda s: s["t"])), 1, max_tokens).alias("t")
        )
    )
    return heads.join(totals, conv).select(
        conv,
        F.array_join("t", " ").alias("head"),
        "n_tokens",
        F.size("t").cast("bigint").alias("n_kept"),
        (F.col("n_tokens") > max_tokens).alias("truncated"),
    )


def conversation_budget_with(
    df: DataFrame,
    build: Callable[[], Encode],
    conv: str = "conv_id",
    turn: str = "turn",
    content: str = "text",
    max_tokens: int = 512,
    template: tuple[str, str, str] = CHATML_MESSAGE,
    bucket: int = BUCKET,
) -> DataFrame:
    """:func:`conversation_budget` with the caller's tokenizer: conv, head, n_tokens, n_kept,
    truncated.

    ``build()`` gives a function as for :func:`adcorpus.operators.inference.token_budget_with`.
    Messages are counted one by one, so the tokenizer must not merge across messages (templates
    see to that with tokens of their own); a message without tokens adds nothing. Every text is
    counted once; only numbers are summed, and only the messages of the head are fetched, of which
    only the one that crosses the limit is cut.
    """
    segments = _segments(df.where(F.col(turn).isNotNull()), conv, turn, content, template)
    counted = token_budget_with(segments, build, "segment", max_tokens)
    counts = written(counted.select(conv, turn, "n_tokens"), "token-counts")
    totals = counts.groupBy(conv).agg(F.sum("n_tokens").alias("_total"))
    first = take_weight(counts, conv, turn, "n_tokens", max_tokens, bucket)
    texts = null_safe_join(segments, first, [conv, turn])
    room = F.lit(max_tokens) - F.col("before")
    whole = texts.where(F.col("n_tokens") <= room).select(conv, turn, "segment")
    crossing = texts.where(F.col("n_tokens") > room).withColumn("_room", room)
    cut = cut_texts(crossing, build, "segment", "_room").select(conv, turn, "segment")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("segment").alias("s"))))
    heads = whole.unionByName(cut).groupBy(conv).agg(
        F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("head")
    )
    out = null_safe_join(totals, heads, [conv], "left")
    kept = F.least(F.col("_total"), F.lit(max_tokens)).cast("bigint")
    return out.select(
        conv,
        F.coalesce("head", F.lit("")).alias("head"),
        F.col("_total").cast("bigint").alias("n_tokens"),
        kept.alias("n_kept"),
        (F.col("_total") > max_tokens).alias("truncated"),
    )
