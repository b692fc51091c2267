"""Exact duplicates by a heavy-hitter split.

A Misra-Gries sketch (``approx_top_k``: frequent items with periodic purging, one per digest
bucket and mergeable) names digests that may be frequent. Their exact counts and winners form a
table whose size is bounded by the sketch, so it is broadcast, and copies of frequent texts are
settled where they are read. All other digests go through one ordinary shuffle, in which no group
is larger than the sketch's error allows. The sketch decides only which way a digest takes, never
the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adcorpus.llm.common import as_text, documents, free_prefix, without_rows, written

BUCKETS = 32
#: Frequent digests kept and digests tracked, per bucket.
TOP, TRACKED = 64, 4096


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(as_text(text_col), 256).alias("text_sha256")
    )


def _key(column: str = "text_sha256"):
    """The leading 60 bits of a digest."""
    return F.conv(F.substring(column, 1, 15), 16, 10).cast("long")


def frequent_winners(hashed: DataFrame, least: int) -> DataFrame:
    """(text_sha256, keep_id, group_size) of digests with at least ``least`` rows that the sketch
    found: at most BUCKETS * TOP rows, counted exactly."""
    keyed = hashed.select("doc_id", "text_sha256", _key().alias("key"))
    sketch = keyed.groupBy(F.pmod("key", F.lit(BUCKETS)).alias("bucket")).agg(
        F.expr(f"approx_top_k(key, {TOP}, {TRACKED})").alias("top")
    )
    candidates = sketch.select(F.explode("top").alias("t")).select(
        F.col("t.item").alias("key"), F.col("t.count").alias("n")
    )
    candidates = written(candidates.where(F.col("n") >= least).select("key"), "frequent")
    return (
        keyed.join(F.broadcast(candidates), "key", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= least)
    )


def settled(docs: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests, winners of the frequent ones, all other digests' rows with keep_id and group_size)."""
    hashed = written(digests(docs, id_col, text_col), "digests")
    winners = written(frequent_winners(hashed, least), "winners")
    same = Window.partitionBy("text_sha256")
    rest = (
        hashed.join(F.broadcast(winners), "text_sha256", "left_anti")
        .withColumn("keep_id", F.max("doc_id").over(same))
        .withColumn("group_size", F.count("*").over(same))
    )
    return hashed, winners, rest


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 64
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The largest doc_id of equal texts stays
    (a null doc_id only when no copy has one). Rows that repeat both doc_id and text are one
    document and marked alike. Very long texts are hashed where they are read and never move. An
    empty table gives an empty result; other columns are not read.

    ``least``: rows from which a digest counts as frequent; only the plan depends on it.
    """
    hashed, winners, rest = settled(docs, id_col, text_col, least)
    heavy = hashed.join(F.broadcast(winners), "text_sha256")
    return heavy.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 64) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns as they were, whatever
    their names. Copies of frequent texts go where they are read, by the broadcast winners; of the
    others only digests are shuffled. Edge cases are those of ``exact_dedup``.
    """
    _, winners, rest = settled(docs, id_col, text_col, least)
    prefix = free_prefix(docs, "_copy")
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    heavy = winners.select(F.col("text_sha256").alias(f"{prefix}_sha"), F.col("keep_id").alias(f"{prefix}_keep"))
    # at most BUCKETS * TOP rows
    copies = (sha == F.col(f"{prefix}_sha")) & ~F.col(id_col).eqNullSafe(F.col(f"{prefix}_keep"))
    left = docs.join(F.broadcast(heavy), copies, "left_anti")
    lost = rest.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256")
    return without_rows(left, {"doc_id": F.col(id_col), "text_sha256": sha}, written(lost, "copies"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP6_SQL = """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER s AS keep_id, count(*) OVER s AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER s AS kept, text_sha256
FROM h WINDOW s AS (PARTITION BY text_sha256)
"""
