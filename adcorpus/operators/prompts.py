"""Tabular ads to chat messages, zero-shot and few-shot, for two tasks and two schemas.

Each formatter is scan -> project -> filter -> project: the only other work is the one-row
prefix (system message and exemplar turns), built once and attached as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adcorpus.constants import (
    ALT_COUNTRY,
    ALT_SALARY_COLUMNS,
    CATEGORY_SYSTEM_HEAD,
    CATEGORY_SYSTEM_TAIL,
    CATEGORY_USER_PREFIX,
    NEGOTIABLE_SALARY,
    SALARY_LINES,
    SALARY_SYSTEM,
)
from adcorpus.functions.bounded import bounded_array
from adcorpus.functions.chat import message, messages
from adcorpus.functions.text import (
    category_label,
    clean,
    is_not_negotiable,
    is_present,
    salary_label,
)
from adcorpus.operators.labels import quoted_labels


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")


def exemplar_turns(
    exemplars: DataFrame,
    order: str,
    text: str,
    label: str,
    max_exemplars: int,
    max_bytes: int,
) -> DataFrame:
    """One row, one column ``turns``: user and assistant messages of the exemplars, in order.

    Every record repeats these turns, so their number and size are checked.
    """
    ordered = bounded_array(
        exemplars,
        F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(label).alias("l")),
        max_exemplars,
        max_bytes,
        "exemplars",
        bytes_of=F.octet_length(text) + F.octet_length(label),
    )
    pairs = F.transform(
        "items", lambda e: messages(("user", e["t"]), ("assistant", e["l"]))
    )
    return ordered.select(F.flatten(pairs).alias("turns"))


def _prefix(system: DataFrame, exemplars: DataFrame | None) -> DataFrame:
    """One row, one column: the system message followed by the exemplar turns."""
    head = F.array(message("system", F.col("system")))
    if exemplars is None:
        return system.select(head.alias("prefix"))
    # One row each, joined rather than attached: the result is a subquery itself.
    both = system.join(F.broadcast(exemplars), F.col("turns").isNotNull())
    return both.select(F.concat(head, F.col("turns")).alias("prefix"))


def category_system(vocabulary: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit(CATEGORY_SYSTEM_HEAD), quoted_labels(F.col("labels")), F.lit(CATEGORY_SYSTEM_TAIL)
    )
    return vocabulary.select(text.alias("system"))


def category_messages(
    ads: DataFrame,
    vocabulary: DataFrame,
    text: str = "description",
    label: str = "category",
    keep: Sequence[str] = (),
    exemplars: DataFrame | None = None,
    null_policy: str = "drop",
) -> DataFrame:
    """``keep`` columns plus ``messages`` for every ad that has a text and a label.

    ``exemplars`` is the frame :func:`exemplar_turns` returns; exemplar texts carry no prefix.
    """
    require_columns(ads, [text, label, *keep])
    prefix = _prefix(category_system(vocabulary), exemplars).scalar()
    # A missing label never becomes text: such a row has no class to learn.
    complete = ads.where(is_present(F.col(text), null_policy) & is_present(F.col(label)))
    cleaned = complete.select(
        *keep,
        clean(F.col(text), null_policy).alias("_text"),
        category_label(F.col(label)).alias("_label"),
    )
    body = messages(
        ("user", F.concat(F.lit(CATEGORY_USER_PREFIX), F.col("_text"))),
        ("assistant", F.col("_label")),
    )
    return cleaned.select(*keep, F.concat(prefix, body).alias("messages"))


def salary_messages(
    ads: DataFrame,
    keep: Sequence[str] = (),
    exemplars: DataFrame | None = None,
    null_policy: str = "drop",
    sentinel: str = NEGOTIABLE_SALARY,
) -> DataFrame:
    """``keep`` columns plus ``messages`` for every ad with all details and a stated salary."""
    require_columns(ads, [*SALARY_LINES, "salary_avg", *keep])
    fields = [clean(F.col(name), null_policy).alias(f"_{name}") for name in SALARY_LINES]
    complete = [is_present(F.col(name), null_policy) for name in SALARY_LINES]
    usable = reduce(
        Column.__and__,
        complete,
        is_not_negotiable(F.col("salary_avg"), sentinel) & is_present(F.col("salary_avg")),
    )
    cleaned = ads.where(usable).select(
        *keep, *fields, salary_label(F.col("salary_avg")).alias("_salary")
    )
    user = F.concat_ws(
        "\n", *[F.concat(F.lit(head), F.col(f"_{name}")) for name, head in SALARY_LINES.items()]
    )
    body = messages(("user", user), ("assistant", F.col("_salary")))
    if exemplars is None:
        prefix: Column = F.array(message("system", F.lit(SALARY_SYSTEM)))
    else:
        system = exemplars.select(F.lit(SALARY_SYSTEM).alias("system"), "turns")
        prefix = system.select(
            F.concat(F.array(message("system", F.col("system"))), F.col("turns")).alias("prefix")
        ).scalar()
    return cleaned.select(*keep, F.concat(prefix, body).alias("messages"))


def map_alternate_schema(
    ads: DataFrame,
    keep: Sequence[str] = (),
    columns: dict[str, str] | None = None,
    country: str = ALT_COUNTRY,
) -> DataFrame:
    """Project the alternate salary table onto the column names of the main one."""
    mapping = columns or ALT_SALARY_COLUMNS
    require_columns(ads, [*mapping.values(), *keep])
    renamed = [F.col(theirs).alias(ours) for ours, theirs in mapping.items()]
    return ads.select(*keep, *renamed, F.lit(country).alias("country"))


def merge_variants(**variants: DataFrame) -> DataFrame:
    """Union of record frames with the same columns, tagged by ``variant``."""
    merged: DataFrame | None = None
    for name, df in variants.items():
        tagged = df.withColumn("variant", F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged)
    if merged is None:
        raise ValueError("merge_variants needs at least one frame")
    return merged


def explode_messages(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long form: ``keep`` columns, ``pos``, ``role``, ``content``."""
    return records.select(*keep, F.posexplode("messages").alias("pos", "m")).select(
        *keep,
        F.col("pos").cast("bigint").alias("pos"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("content"),
    )
