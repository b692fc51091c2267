"""SpotSigs fingerprints.

A signature is a common word with the next two content words after it: common words are spread
over prose but not over lists and menus, and a chain changes only where the text does. Which words are
common the corpus says: its most frequent short words, counted over all documents, of whatever
languages. A content word in sixteen, chosen by its check sum, starts a chain too, so that text with
few common words (tables, code, a rare language) is covered in every part. A text's fingerprint is
its sorted set of 32-bit signature hashes. Two sets are compared by their Jaccard likeness, which
their lengths bound: sets in length partitions that are not neighbours cannot reach the likeness
the partitions are made for, so they are not intersected.

Everything is column expressions; the neighbour of a document comes from a range-partitioned table
of keys, never from one sorted task.
"""

from __future__ import annotations

import math
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adcorpus.llm.common import as_text, documents, written

#: Anchors: so many of the most frequent words, of at most so many characters.
ANCHORS, ANCHOR_CHARS = 128, 6
#: One content word in so many starts a chain by itself.
SPREAD = 16
#: All but letters, digits and what is beyond ASCII, in lower-cased text.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
START = "^"


def frequent_words(docs: DataFrame, text_col: str = "text", n: int = ANCHORS) -> list[str]:
    """The ``n`` most frequent short words of all documents, ties in alphabetical order. Counts
    combine where texts are read; short words are few, and ``n`` of them come to the driver."""
    words = docs.select(F.explode(F.split(F.lower(as_text(text_col)), BREAK)).alias("w"))
    words = words.where((F.col("w") != "") & (F.length("w") <= ANCHOR_CHARS))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(n)
    return [r["w"] for r in top.select("w").collect()]


def spot_signatures(text: Column, anchors: Collection[str]) -> Column:
    """Sorted distinct signature hashes; the start of a text counts as an anchor. The last chain
    may be one word short. A text without content words has none."""
    common = sorted(anchors)
    words = F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")
    tagged = F.zip_with(
        words, F.concat(F.array(F.lit(START)), words), lambda w, before: F.struct(w.alias("w"), before.alias("b"))
    )
    content = F.filter(tagged, lambda t: t["w"].isNotNull() & ~t["w"].isin(common))

    def starts(t: Column) -> Column:
        spread = F.crc32(t["w"].cast("binary")) % SPREAD == 0
        return t["b"].isin(common) | (t["b"] == START) | spread

    chains = F.zip_with(
        content,
        F.slice(content, 2, 1_000_000_000),
        lambda t, after: F.when(starts(t), F.hash(t["b"], t["w"], F.coalesce(after["w"], F.lit("")))),
    )
    return F.array_sort(F.array_distinct(F.filter(chains, lambda h: h.isNotNull())))


def fingerprint(signatures: Column) -> Column:
    """Eight hexadecimal digits per signature."""
    digits = F.transform(signatures, lambda h: F.lpad(F.hex(h.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def length_partition(n: Column, least: float) -> Column:
    """Sets whose likeness is ``least`` or more are in the same partition or in neighbours."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / math.log(1 / least) + 1e-9)).otherwise(-1)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets, 0 to 1; 1 for two empty sets. With ``least``, pairs
    that cannot reach it are 0 by their lengths alone."""
    common = F.size(F.array_intersect(a, b))
    value = common / (F.size(a) + F.size(b) - common)
    out = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
    if least > 0:
        apart = F.abs(length_partition(F.size(a), least) - length_partition(F.size(b), least)) > 1
        out = out.when(apart | (F.least(F.size(a), F.size(b)) < least * F.greatest(F.size(a), F.size(b))), F.lit(0.0))
    return out.otherwise(value)


def successors(keys: DataFrame) -> DataFrame:
    """(key, next_key, n_chars) of distinct (doc_id, key, n_chars), ascending, the last one's next
    being the first. Neighbours are found within range partitions; only the first key of each
    partition meets those of the others."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc()]
    ranged = keys.repartitionByRange(*order).withColumn("slot", F.spark_partition_id())
    ranged = written(ranged, "ordered")
    heads = ranged.groupBy("slot").agg(F.min(F.struct("doc_id", "key")).alias("head"))
    heads = heads.select("slot", F.col("head.key").alias("head"))
    first = heads.agg(F.min_by("head", "slot")).scalar()
    after = F.lead("head").over(Window.orderBy("slot"))
    heads = heads.select("slot", F.coalesce(after, first).alias("head"))
    inside = F.lead("key").over(Window.partitionBy("slot").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(heads), "slot").select(
        "key", F.coalesce("inside", "head").alias("next_key"), "n_chars"
    )


def neighbour_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: Collection[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_signatures, next_id. ``anchors`` are the common
    words; by default those that :func:`frequent_words` finds in ``docs``.

    Null text counts as empty: no signatures. Equal texts have equal fingerprints. Null ids come
    first; rows that share a doc_id are ordered by a hash of their text, and rows equal in both
    share their successor. A single document follows itself. Texts of any length count whole. An
    empty table gives an empty result; other columns are not read.
    """
    anchors = frequent_words(docs, text_col) if anchors is None else anchors
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))
    base = rows.select(
        F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", spot_signatures(F.col("text"), anchors).alias("spots")
    )
    link = successors(rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.length("text").alias("n_chars")).distinct())
    link = written(link, "successors").select(F.col("key").alias("of"), F.col("next_key").alias("key"), "n_chars")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # the same shuffled rows serve as successors and as documents
    parts = base.join(link, "key").groupBy(F.col("of").alias("key")).agg(
        F.first(F.substring(F.col("text"), F.lit(1), half)).alias("head"), F.first("spots").alias("next_spots"),
        F.first("doc_id").alias("next_id"),
    )
    both = base.join(parts, "key")
    size = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (size - F.floor(size / 2)).cast("int")), F.col("head"))
    both = both.select("doc_id", "next_id", size.cast("bigint").alias("n_chars"), "spots", "next_spots", edited.alias("edited"))
    both = both.select(
        "doc_id", "next_id", "n_chars", "spots", "next_spots", F.sha2("edited", 256).alias("edited_sha256"),
        spot_signatures(F.col("edited"), anchors).alias("edited_spots"),
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        F.size("spots").cast("bigint").alias("n_signatures"),
        "next_id",
    )


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(documents(spark, sf_dir))
