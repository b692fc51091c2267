"""Best-fit packing of documents into sequences of fixed capacity.

Lengths are integers up to the capacity, so the whole packing is decided on the histogram of
lengths, whose size the capacity bounds, and holds for any number of documents. Pieces above a
third of the capacity fit at most twice in a sequence: they are matched greedily, the longest with
the longest that still fits, which is the least number of sequences for them. Shorter pieces then
go, longest first, into the tightest gap. The plan says which ranks of a length go to which
sequences; pieces get their rank within their length by counting in buckets, so that no length,
however common, is ranked in one task.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adcorpus.llm.common import as_text, documents, map_arrow, written

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
PIECE = "struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
SEGMENT = "length bigint, lo bigint, hi bigint, first_sequence bigint, at bigint, each bigint"


def tokenizer_path(name: str = VOCABULARY) -> str:
    """A path as it is; a bare name is one of the public tokenizers' files."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_level_encoder(name: str):
    """text -> ids of a byte-level BPE file of the tokenizers library.

    The same vocabulary and merges run in tiktoken, which gives the same ids in a third of the
    time; a text that spells an added token goes through tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {t["content"] for t in spec.get("added_tokens", ())}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(shifted)}
    ranks = {
        bytes(to_byte[c] for c in token): rank
        for token, rank in spec["model"]["vocab"].items()
        if token not in added
    }
    fast = tiktoken.Encoding(
        "byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    exact = lru_cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> np.ndarray:
        if any(token in text for token in added):
            return np.array(exact().encode(text, add_special_tokens=False).ids, dtype="<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(doc_id, pieces) per row; ids end with END_ID. Texts go to Python, ids do not come back."""
    rows = docs.select(F.col(id_col).alias("doc_id"), as_text(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(vocabulary)
        item = pa.struct(
            [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        )
        for batch in batches:
            pieces = []
            for text in batch.column(1):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4", copy=False)
                pieces.append(
                    [
                        {"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n].tobytes())}
                        for k, (s, n) in enumerate(cut(len(ids), capacity))
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pieces, type=pa.list_(item))], names=["doc_id", "pieces"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, pieces array<{PIECE}>")


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Segments (length, lo, hi, first_sequence, at, each): of the pieces of a length, rank
    lo + i goes to sequence first_sequence + i // each, at offset at + (i % each) * length.

    The number of segments depends on the capacity alone.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    segments: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, sequences)
    opened = 0

    def place(n: int, pieces: int, sequence: int, at: int, each: int = 1) -> None:
        segments.append((n, taken[n], taken[n] + pieces, sequence, at, each))
        taken[n] += pieces
        left[n] -= pieces

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m + n <= capacity and left[m] > (m == n)), 0)
            bins = left[n] if not mate else left[n] // 2 if mate == n else min(left[n], left[mate])
            place(n, bins, opened, 0)
            if mate:
                place(mate, bins, opened, n)
            gaps.setdefault(capacity - n - mate, []).append((opened, bins))
            opened += bins
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = min((r for r in gaps if r >= n), default=capacity)
            each = room // n
            if room in gaps:
                first, bins = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
            else:
                first, bins = opened, math.ceil(left[n] / each)
                opened += bins
            full = min(bins, left[n] // each)
            if full:
                place(n, full * each, first, capacity - room, each)
                gaps.setdefault(room - each * n, []).append((first, full))
            if full < bins and left[n]:
                rest = left[n]
                place(n, rest, first + full, capacity - room, rest)
                gaps.setdefault(room - rest * n, []).append((first + full, 1))
                full += 1
            if full < bins:
                gaps.setdefault(room, []).append((first + full, bins - full))
    return segments


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and has the end id alone. A longer text than a sequence is cut; its full
    pieces fill sequences of their own. Repeated rows are packed once per row. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    tokens = written(tokenized(docs, id_col, text_col, capacity, vocabulary), "tokens")
    pieces = tokens.select("doc_id", F.inline("pieces"))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = math.isqrt(sum(histogram.values())) + 1
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pieces.groupBy("length", "bucket")
        .count()
        .select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("n", F.row_number().over(within) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("n"))
    segments = spark.createDataFrame(packing_plan(histogram, capacity), SEGMENT)
    inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    i = F.col("rank") - F.col("lo")
    return ranked.join(
        F.broadcast(segments.withColumnRenamed("length", "_length")),
        (F.col("length") == F.col("_length")) & inside,
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(i / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + i % F.col("each") * F.col("length")).cast("bigint").alias("offset"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
