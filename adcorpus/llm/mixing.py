"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic); the cell weights are raked to the target
share of every source, language and topic in turn until they agree with all of them; a document
then stays with its cell's calibrated probability. Only the cell table goes through the
iterations, each of them a few aggregates and joins on it, written to the shared folder.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adcorpus.llm.common import as_text, documents, free_prefix, written

#: The default target: shares of tokens to this power, which evens them out a little.
POWER = 0.95
MAX_ROUNDS, TOLERANCE = 50, 1e-10
#: Without a budget, as much is sampled as leaves cells with this share of the tokens short of their
#: target: a cell that wants more than all of its documents gets all of them and no more.
SHORT_SHARE = 0.01
#: Cells up to which their table is broadcast to the documents.
BROADCAST_CELLS = 100_000

#: Topic by the first rule that a text meets; fixed words of notices, contacts and settings.
TOPICS = (
    ("legal", ("icense", "All rights reserved", "opyright")),
    ("contact", ("@", "+1 (")),
    ("technical", ("token", "password", "AKIA", "{", "=")),
)
OTHER = "general"


def topic_of(text: Column) -> Column:
    out = F.when(F.length(text) == 0, F.lit("empty"))
    for topic, words in TOPICS:
        for word in words:
            out = out.when(text.contains(word), F.lit(topic))
    return out.otherwise(F.lit(OTHER))


def dimensions() -> dict[str, Column]:
    """The default dimensions over ``documents``; null values are a value of their own."""
    return {
        "source": F.coalesce(F.col("source"), F.lit("")),
        "lang": F.coalesce(F.col("lang"), F.lit("")),
        "topic": topic_of(as_text()),
    }


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """(name, share): shares of tokens raised to ``power`` and brought back to 1."""
    shares = cells.groupBy(name).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))
    return shares.select(name, F.col("share") / shares.agg(F.sum("share")).scalar()).toDF(name, "share")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """``cells`` with ``weight``: the share of all tokens that a cell should have.

    A cell without tokens keeps weight 0, and a value that has no target share goes to 0. Targets
    that contradict each other given the cells there are cannot all be met; then the last
    dimension's are, and a warning says by how much a factor still moved after MAX_ROUNDS.
    """
    names = list(targets)
    total = cells.agg(F.sum("tokens")).scalar()
    now = written(cells.where("tokens > 0").withColumn("weight", F.col("tokens") / total), "raked")
    for _ in range(MAX_ROUNDS):
        step = now.withColumn("drift", F.lit(0.0))
        for name in names:
            sums = step.groupBy(name).agg(F.sum("weight").alias("_sum"))
            factor = sums.join(targets[name], name, "left").select(
                name, (F.coalesce("share", F.lit(0.0)) / F.nullif(F.col("_sum"), F.lit(0.0))).alias("_factor")
            )
            step = step.join(factor, name).withColumn("_factor", F.coalesce("_factor", F.lit(0.0)))
            step = step.withColumn("weight", F.col("weight") * F.col("_factor")).withColumn(
                "drift", F.when(F.col("weight") > 0, F.greatest("drift", F.abs(F.col("_factor") - 1))).otherwise(F.col("drift"))
            ).drop("_factor")
            # read twice by the next dimension, so an unwritten plan would double every time
            step = written(step, "raked")
        now = step.drop("drift")
        drift = step.agg(F.max("drift")).first()[0] or 0.0
        if drift < TOLERANCE:
            return now
    if drift > 0.01:
        warnings.warn(f"the targets are not met: after {MAX_ROUNDS} rounds weights still move by {drift:.1%}", stacklevel=2)
    return now


def probabilities(cells: DataFrame, targets: Mapping[str, DataFrame], budget: float | None = None) -> DataFrame:
    """(dimensions, weight, probability) per cell. Sampled tokens have the target shares but for
    cells whose probability is cut at 1; without a ``budget`` in tokens, those hold at most
    SHORT_SHARE of the tokens, so that no small cell decides how much of the others stays."""
    raked = rake(cells, targets)
    total = cells.agg(F.sum("tokens")).scalar()
    raked = written(raked.withColumn("weight", F.col("weight") * total / F.col("tokens")), "weights")
    if budget is None:
        # a table of cells: small
        scarcest = Window.orderBy(F.desc("weight")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        upto = raked.select("weight", F.sum("tokens").over(scarcest).alias("upto"))
        rate = 1 / upto.where(F.col("upto") > SHORT_SHARE * total).agg(F.max("weight")).scalar()
    else:
        rate = F.lit(float(budget)) / total
    return raked.select(
        *targets, "weight", F.least(F.lit(1.0), F.col("weight") * rate).alias("probability")
    )


def chance(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mixed(
    docs: DataFrame,
    dims: Mapping[str, Column] | None = None,
    targets: Mapping[str, DataFrame] | None = None,
    power: float = POWER,
    budget: float | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the dimensions, n_tokens, weight (target share over
    actual share of its cell), probability, kept; with ``carry`` the columns of ``docs`` of the
    rows that are kept instead.

    ``targets`` has a (name, share) table per dimension; those left out are tempered by ``power``.
    Null dimension values count as one value, null text as empty. Texts without words cost no
    tokens: where their cell has no tokens at all, weight and probability are 1. Rows that share a
    doc_id share their fate within a cell, null ids too. An empty table gives an empty result.
    """
    dims = dims or dimensions()
    names = list(dims)
    prefix = free_prefix(docs, "_mix")
    hidden = {name: f"{prefix}_dim_{name}" for name in names}
    inner_id, inner_tokens, inner_weight, inner_p = (f"{prefix}_{x}" for x in ("id", "tokens", "weight", "p"))
    marked = docs.select(
        *([docs[c] for c in docs.columns] if carry else []),
        F.col(id_col).alias(inner_id),
        *[c.alias(hidden[name]) for name, c in dims.items()],
        token_count(as_text(text_col)).alias(inner_tokens),
    )
    small = marked.select(inner_id, *hidden.values(), inner_tokens)
    if not carry:
        small = marked = written(small, "mixed")
    cells = small.groupBy(*hidden.values()).agg(F.sum(inner_tokens).alias("tokens")).toDF(*names, "tokens")
    cells = written(cells, "cells")
    goal = {n: targets[n] if targets and n in targets else tempered(cells, n, power) for n in names}
    goal = {n: written(t, "target") for n, t in goal.items()}
    fitted = written(probabilities(cells, goal, budget), "calibrated")
    table = fitted.toDF(*hidden.values(), inner_weight, inner_p)
    if fitted.count() <= BROADCAST_CELLS:
        table = F.broadcast(table)
    out = marked.join(table, list(hidden.values()), "left")
    p = F.coalesce(inner_p, F.lit(1.0))
    keep = chance(F.col(inner_id), seed) < p
    if carry:
        return out.where(keep).select(*docs.columns)
    return out.select(
        F.col(inner_id).alias("doc_id"),
        *[F.col(hidden[name]).alias(name) for name in names],
        F.col(inner_tokens).alias("n_tokens"),
        F.round(F.coalesce(inner_weight, F.lit(1.0)), 6).alias("weight"),
        F.round(p, 6).alias("probability"),
        keep.alias("kept"),
    )


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that ``mixed`` leaves out; all columns as they were, whatever their
    names. Edge cases are those of ``mixed``."""
    return mixed(docs, carry=True, **options)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def _op2_sql() -> str:
    topic = "CASE WHEN t = '' THEN 'empty'" + "".join(
        f" WHEN contains(t, '{w}') THEN '{topic}'" for topic, words in TOPICS for w in words
    )
    names = ("source", "lang", "topic")
    shares = ",\n".join(
        f"t_{n} AS (SELECT {n}, s / sum(s) OVER () AS share FROM (SELECT {n}, pow(sum(tokens), {POWER}) AS s"
        f" FROM c GROUP BY {n}))"
        for n in names
    )
    w = "FROM it JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)"
    return rf"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, source, lang, {topic} ELSE '{OTHER}' END AS topic,
        len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_tokens FROM d),
c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM b GROUP BY ALL),
{shares},
it AS (
  SELECT 0 AS k, source, lang, topic, tokens, tokens / sum(tokens) OVER () AS w FROM c WHERE tokens > 0
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, w * t / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT k, source, lang, topic, tokens, t, w * l / sum(w) OVER (PARTITION BY lang) AS w FROM (
      SELECT k, source, lang, topic, tokens, t_topic.share AS t, t_lang.share AS l,
        w * t_source.share / sum(w) OVER (PARTITION BY source) AS w {w} WHERE k < {MAX_ROUNDS}))),
f AS (SELECT source, lang, topic, tokens, w * sum(tokens) OVER () / tokens AS weight FROM it WHERE k = {MAX_ROUNDS}),
u AS (SELECT weight, sum(tokens) OVER (ORDER BY weight DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(tokens) OVER () AS total FROM f),
g AS (SELECT * EXCLUDE (tokens), least(1.0, weight / (SELECT max(weight) FROM u WHERE upto > {SHORT_SHARE} * total)) AS p FROM f)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 1.0), 6) AS weight,
  round(coalesce(p, 1.0), 6) AS probability,
  ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, 1.0) AS kept
FROM b LEFT JOIN g USING (source, lang, topic)
"""


OP2_SQL = _op2_sql()
