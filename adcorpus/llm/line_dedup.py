"""Line dedup by pairwise alignment.

Documents are found to overlap by hashes of short runs of lines: the shortest run from every line on,
and up to every line, that is long enough to be deleted. Any common block of that length, wherever it
begins and ends, is covered by such runs, so every later document is paired with the first holder of
each run it shares, and with no other; the pairs grow with the runs and not with the square of a
group. A pair is aligned by patience diff over its shared runs, and aligned blocks are deleted from
the later document; runs that the diff leaves out, as they are repeated or stand in another order,
are aligned by themselves in a second pass.

Only hashes and places of shared runs travel; the texts meet the result at the end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.llm.common import as_text, documents, map_arrow, written

#: Size of a block that is deleted: words, or where words are not set apart by blanks, so many
#: characters a word.
BLOCK_WORDS, WORD_CHARS = 10, 8
BLANK = " \t\x0b\x0c\r"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Deleted lines (4 bytes each) and changed documents up to which they are broadcast to the texts.
BROADCAST_LINES, BROADCAST_CHANGED = 4_000_000, 500_000

Block = tuple[int, int, int]


def unique_matches(a: list[int], b: list[int], lo: tuple[int, int], hi: tuple[int, int]) -> list[tuple[int, int]]:
    """Longest chain of lines that are unique on both sides, in order on both."""
    ours, theirs = Counter(a[lo[0] : hi[0]]), Counter(b[lo[1] : hi[1]])
    at = {h: i for i, h in enumerate(a[lo[0] : hi[0]], lo[0]) if ours[h] == 1 and theirs[h] == 1}
    ends: list[int] = []
    tops: list[tuple[int, int]] = []
    before: dict[tuple[int, int], tuple[int, int] | None] = {}
    for j in range(lo[1], hi[1]):
        i = at.get(b[j])
        if i is None:
            continue
        k = bisect_left(ends, i)
        before[i, j] = tops[k - 1] if k else None
        ends[k : k + 1], tops[k : k + 1] = [i], [(i, j)]
    chain = []
    pair = tops[-1] if tops else None
    while pair:
        chain.append(pair)
        pair = before[pair]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[Block]:
    """Aligned blocks (start in a, start in b, length), in order, of the patience diff."""
    matched: list[tuple[int, int]] = []
    todo = [((0, 0), (len(a), len(b)))]
    while todo:
        (i, j), (ei, ej) = todo.pop()
        while i < ei and j < ej and a[i] == b[j]:
            matched.append((i, j))
            i, j = i + 1, j + 1
        while i < ei and j < ej and a[ei - 1] == b[ej - 1]:
            ei, ej = ei - 1, ej - 1
            matched.append((ei, ej))
        if i == ei or j == ej:
            continue
        last = (i, j)
        for x, y in unique_matches(a, b, (i, j), (ei, ej)):
            matched.append((x, y))
            todo.append((last, (x, y)))
            last = (x + 1, y + 1)
        if last != (i, j):
            todo.append((last, (ei, ej)))
    blocks: list[Block] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def weight(line: str) -> int:
    """Words of a line that has one, and at least a word for every WORD_CHARS characters."""
    words = len(line.encode("utf-8", "surrogatepass").split())
    return max(words, (len(line) - sum(map(line.count, BLANK))) // WORD_CHARS)


def runs(weights: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of at least ``least`` from every line on and up to every
    line. Weights are positive, so no run has more than ``least`` lines."""
    found = []
    j, total = -1, 0
    for i, w in enumerate(weights):
        while total < least and j + 1 < len(weights):
            j += 1
            total += weights[j]
        if total < least:
            break
        found.append((i, j))
        total -= w
    i, total = 0, 0
    for j, w in enumerate(weights):
        total += w
        while total - weights[i] >= least:
            total -= weights[i]
            i += 1
        if total >= least:
            found.append((i, j))
    return sorted(set(found))


def run_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, run, at, n): the runs of every document. Lines without a word are left out,
    spaces at the ends of a line do not count, and ``at`` numbers the lines that are left."""
    rows = keyed(docs, id_col, text_col).where(F.col("doc_id").isNotNull()).select("doc_id", "key", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text in zip(*batch.columns, strict=True):
                doc_id, key = doc_id.as_py(), key.as_py()
                lines = [line for line in text.as_py().split("\n") if line.strip(BLANK)]
                ids = [xxhash.xxh3_128_digest(line.strip(" ").encode("utf-8", "surrogatepass")) for line in lines]
                for i, j in runs([weight(line) for line in lines], BLOCK_WORDS):
                    out.append((doc_id, key, xxhash.xxh3_128_digest(b"".join(ids[i : j + 1])), i, j - i + 1))
                    if len(out) == 20_000:
                        yield rows_of(out)
                        out = []
            if out:
                yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "run", "at", "n"])

    return map_arrow(rows, run, "doc_id bigint, key binary, run binary, at int, n int")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text); id and key name a document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))
    return rows.select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")


def overlaps(found: DataFrame) -> DataFrame:
    """(later, earlier, shared): pairs of documents and the runs (place in the earlier one, place
    in the later one, lines, run) that the earlier one is the first to hold."""
    doc = F.struct("doc_id", "key")
    first = found.groupBy("run").agg(
        F.min(F.struct("doc_id", "key", "at")).alias("first"), F.max("doc_id").alias("last")
    )
    first = first.where(F.col("first.doc_id") < F.col("last")).drop("last")
    shared = found.join(first, "run").where(F.col("doc_id") > F.col("first.doc_id"))
    earlier = F.struct("first.doc_id", "first.key").alias("earlier")
    place = F.struct(F.col("first.at").alias("ours"), F.col("at").alias("theirs"), "n", "run")
    return shared.select(doc.alias("later"), earlier, place.alias("place")).groupBy("later", "earlier").agg(
        F.collect_list("place").alias("shared")
    )


def aligned_lines(shared: list[tuple[int, int, int, object]]) -> set[int]:
    """The lines of the later document in aligned runs, given (ours, theirs, lines, run) of those
    it shares with the earlier one."""
    theirs = sorted({(t, n, r) for _, t, n, r in shared})
    ours = sorted({(o, n, r) for o, _, n, r in shared})
    blocks = patience([r for *_, r in ours], [r for *_, r in theirs])
    gone: set[int] = set()
    left = set(range(len(theirs)))
    for _, j, count in blocks:
        for t, n, _ in theirs[j : j + count]:
            gone.update(range(t, t + n))
        left.difference_update(range(j, j + count))
    for j in left:
        t, n, _ = theirs[j]
        gone.update(range(t, t + n))
    return gone


def deleted(pairs: DataFrame) -> DataFrame:
    """(doc_id, key, gone): the lines that a pair's later document loses."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [
                sorted(aligned_lines([(p["ours"], p["theirs"], p["n"], p["run"]) for p in shared.as_py()]))
                for shared in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "key", "gone"]
            )

    rows = pairs.select("later.doc_id", "later.key", "shared")
    return map_arrow(rows, run, "doc_id bigint, key binary, gone array<int>")


def without(text, gone):
    """(text without the lines ``gone``, removed line numbers, lines): ``gone`` numbers the lines
    that have a word, and a line without one goes with the line before it (the first of the text with
    the first that has a word). Every step is linear in the number of lines."""
    lines = F.split(text, "\n", -1)

    def cut(bound):
        n = F.size(bound["lines"])
        worded = F.filter(
            F.transform(bound["lines"], lambda line, i: F.when(line.rlike(HAS_WORD), i)), lambda i: i.isNotNull()
        )
        # where each line with a word and its followers begin, and where the last ones end
        starts = F.concat(F.array(F.lit(0)), F.slice(worded, 2, F.greatest(F.size(worded) - 1, F.lit(0))), F.array(n))

        def kept(with_starts):
            removed = F.flatten(
                F.transform(
                    bound["gone"],
                    lambda k: F.sequence(F.get(with_starts, k), F.get(with_starts, k + 1) - 1),
                )
            )
            rest = F.array_except(F.sequence(F.lit(0), n - 1), removed)
            return F.struct(
                F.array_join(F.transform(rest, lambda i: F.get(bound["lines"], i)), "\n").alias("text"),
                removed.alias("removed"),
                n.alias("n"),
            )

        return F.transform(F.array(starts), kept)[0]

    return F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), cut)[0]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, clean_text, n_lines, n_removed and removed (line
    numbers from 0, comma-joined).

    A line goes when it is part of consecutive lines, of BLOCK_WORDS words or more, that are also
    consecutive lines of a document with a smaller doc_id. Lines are equal when they are after
    trimming spaces; lines without a word do not count and go with the line before them. Where
    lines have few blanks, WORD_CHARS characters count as a word. Rows that share a doc_id are
    never held against each other, and a null doc_id has no place in the order, so its text stays.
    Null text counts as empty (one empty line). Whole texts are read, of any length; a document that
    loses all lines has an empty text. Equal rows get equal results. An empty table gives an
    empty result; other columns are not read.
    """
    found = written(run_rows(docs, id_col, text_col), "runs")
    gone = deleted(overlaps(found)).groupBy("doc_id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")
    )
    gone = written(gone, "removed")
    changed, lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    small = changed <= BROADCAST_CHANGED and lines <= BROADCAST_LINES
    texts = keyed(docs, id_col, text_col)
    out = texts.join(F.broadcast(gone) if small else gone, ["doc_id", "key"], "left")
    cleaned = F.when(F.col("gone").isNotNull(), without(F.col("text"), F.col("gone")))
    out = out.select("doc_id", "text", cleaned.alias("c"))
    return out.select(
        "doc_id",
        F.coalesce("c.text", "text").alias("clean_text"),
        F.coalesce("c.n", F.size(F.split("text", "\n", -1))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("c.removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("c.removed", lambda i: i.cast("string")), ","), F.lit("")).alias("removed"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned texts as digests."""
    out = line_dedup(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "n_lines",
        "n_removed",
        "removed",
        F.length("clean_text").cast("bigint").alias("n_chars"),
        F.sha2("clean_text", 256).alias("text_sha256"),
    )


OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
w AS (SELECT r, doc_id, i, trim(line, ' ') AS line, greatest(len(regexp_extract_all(line, '{HAS_WORD}+')),
    length(regexp_replace(line, '[ 	-]+', '', 'g')) // {WORD_CHARS}) AS wt FROM l WHERE regexp_matches(line, '{HAS_WORD}')),
g AS (SELECT r, any_value(doc_id) AS doc_id, list(line ORDER BY i) AS ls, list(wt ORDER BY i) AS ws, list(i ORDER BY i) AS ix FROM w GROUP BY r),
o AS (SELECT r, doc_id, ls, ws, k, k + o AS e FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM g), range({BLOCK_WORDS}) AS s(o)
  WHERE k + o <= len(ls)),
runs AS (SELECT r, doc_id, k, e, array_to_string(ls[k:e], chr(10)) AS run FROM o WHERE list_sum(ws[k:e]) >= {BLOCK_WORDS}
  AND (k = e OR list_sum(ws[k:e - 1]) < {BLOCK_WORDS} OR list_sum(ws[k + 1:e]) < {BLOCK_WORDS})),
f AS (SELECT run, min(doc_id) AS f FROM runs GROUP BY run),
gone AS (SELECT DISTINCT r, unnest(range(k, e + 1)) AS k FROM runs JOIN f USING (run) WHERE doc_id > f),
x AS (SELECT DISTINCT gone.r, unnest(range(CASE WHEN k = 1 THEN 0 ELSE ix[k] END, coalesce(ix[k + 1], len(d.ls)))) AS i
  FROM gone JOIN g USING (r) JOIN d USING (r)),
y AS (SELECT r, list(i ORDER BY i) AS removed FROM x GROUP BY r),
z AS (SELECT d.doc_id, len(ls) AS n_lines, coalesce(len(removed), 0) AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed,
  array_to_string(CASE WHEN removed IS NULL THEN ls ELSE [v FOR v, j IN ls IF NOT list_contains(removed, j - 1)] END, chr(10)) AS t
  FROM d LEFT JOIN y USING (r))
SELECT doc_id, n_lines, n_removed, removed, length(t) AS n_chars, sha256(t) AS text_sha256 FROM z
"""
