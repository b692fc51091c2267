"""Corpus statistics and row counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from adcorpus.functions.text import token_count


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame and an observation whose ``n_rows`` is filled when the frame is written."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("n_rows")), observation


def corpus_profile(
    df: DataFrame, text: str, location: str, category: str, period: str | None = None
) -> DataFrame:
    """Postings, words, words per posting, distinct locations and categories, and the period.

    One pass in two steps: partial sums per ``(location, category)``, which shrink each task's
    output to the pairs it saw, then the totals over those pairs.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum(token_count(F.col(text))).alias("w")]
    totals = [
        F.sum("n").alias("n_postings"),
        F.sum("w").alias("n_words"),
        F.try_divide(F.sum("w").cast("double"), F.sum("n").cast("double")).alias("avg_words"),
        F.count_distinct("loc").alias("n_locations"),
        F.count_distinct("cat").alias("n_categories"),
    ]
    if period is not None:
        sums += [F.min(period).alias("first"), F.max(period).alias("last")]
        totals += [F.min("first").alias("first_period"), F.max("last").alias("last_period")]
    pairs = df.groupBy(F.col(location).alias("loc"), F.col(category).alias("cat")).agg(*sums)
    return pairs.agg(*totals)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share of the total per label; nulls form a group of their own.

    The total is a scalar subquery over the same counts, so no window pulls all labels into
    one task.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    return counts.withColumn("share", F.col("n").cast("double") / total.scalar())


def value_range(df: DataFrame, low: str, high: str) -> DataFrame:
    """Smallest ``low``, largest ``high`` and how many rows state both."""
    stated = F.col(low).isNotNull() & F.col(high).isNotNull()
    return df.agg(
        F.min(low).alias("low"), F.max(high).alias("high"), F.count_if(stated).alias("n_stated")
    )
