"""Label vocabularies and membership in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adcorpus.constants import UNKNOWN_CATEGORY
from adcorpus.functions.bounded import distinct_array
from adcorpus.functions.text import strip


def label_vocabulary(df: DataFrame, label: str, max_labels: int, max_bytes: int) -> DataFrame:
    """One row, one column ``labels``: distinct raw labels, sorted, then lowered.

    Lowering comes last, so labels that differ only in case stay as repeated entries. Nulls are
    dropped. The distinct runs with map-side combine: only labels are shuffled, never rows. One
    message holds them all, so the caller says what fits (``max_labels``, ``max_bytes``); where
    labels only have to be looked up, :func:`parse_category` takes a label table of any size.
    """
    raw = distinct_array(df, F.col(label), max_labels, max_bytes, "label vocabulary", "labels")
    return raw.select(F.transform("labels", F.lower).alias("labels"))


def quoted_labels(labels: Column) -> Column:
    """``"a", "b"`` from an array of labels."""
    return F.array_join(
        F.transform(labels, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "
    )


def parse_category(
    df: DataFrame,
    generated: str,
    known: DataFrame,
    label: str = "label",
    name: str = "predicted",
    default: str = UNKNOWN_CATEGORY,
) -> DataFrame:
    """Exact match of the stripped, lowered text against a label table of any size, else ``default``.

    ``known`` is de-duplicated and joined without a hint: the engine broadcasts it if it turns
    out small, else shuffles. One very common answer is then split by the adaptive skew join,
    as the label side holds a single row per key.
    """
    names = known.select(F.lower(F.col(label)).alias("_known")).distinct()
    keyed = df.withColumn("_key", F.lower(strip(F.col(generated))))
    joined = keyed.join(names, F.col("_key") == F.col("_known"), "left")
    return joined.withColumn(name, F.coalesce("_known", F.lit(default))).drop("_key", "_known")
