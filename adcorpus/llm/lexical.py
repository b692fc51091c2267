"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector over the terms that the items ask for; its score for an item is the
inner product with the item's term weights. Tasks cut their documents into small blocks, build a
ball tree over each and search it best-first for every item: a ball of centre c and radius r can
hold no score above q.c + |q| r, so a subtree whose bound is below the item's k-th best score so far
is left out. Bounds are floating point and rounded up; scores at the leaves are exact integers.
Vectors are scaled by the root of the term weights, which shrinks the balls where words are common.

A first wave searches a thousandth of the documents. Its k-th best scores are a floor for the
others, so that tasks of the second wave return few rows, however many tasks there are.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adcorpus.llm.common import as_text, documents, map_arrow, written

#: Every byte above 0x7F belongs to a code point that is part of a term.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TOP = 50
#: Bytes of item texts that are searched for at once; more items are searched in further blocks.
ITEM_BYTES = 8_000_000
#: A block of documents: rows and vector entries at most, and rows of a leaf.
BLOCK_ROWS, BLOCK_ENTRIES, LEAF_ROWS = 2048, 262_144, 64
#: One of so many documents goes in the first wave.
WAVE = 1024
#: Bytes of a text whose terms are held at once.
CHUNK = 1 << 20


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z lower-cased, some at a time."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            gap = BETWEEN.search(text, end)
            end = gap.start() if gap else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def term_vector(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of terms, columns, counts): terms of the vocabulary in a text."""
    n, counts = 0, {}
    for terms in terms_of(text):
        n += len(terms)
        for term in terms:
            column = vocabulary.get(term)
            if column is not None:
                counts[column] = counts.get(column, 0) + 1
    return n, np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, columns, counts) of documents that have a term at all."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, ns, columns, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                n, c, t = term_vector(text.as_py(), known)
                if n:
                    ids.append(doc_id.as_py())
                    ns.append(n)
                    columns.append(c)
                    counts.append(t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(ns, pa.int64()),
                    pa.array(columns, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "columns", "counts"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id bigint, n bigint, columns array<int>, counts array<bigint>")


@dataclass
class Corpus:
    """What scores depend on beside a document: its totals and the weight of every column."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def entries(self, n: int, counts: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def corpus_of(vectors: DataFrame, size: int) -> Corpus:
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(size, np.int64)
    for column, df in vectors.select(F.explode("columns").alias("c")).groupBy("c").count().collect():
        weights[column] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return Corpus(n_docs, n_terms or 0, weights)


class Block:
    """A ball tree over some sparse vectors; nodes are numbered as in a heap."""

    def __init__(self, ids: list, lengths: np.ndarray, columns: np.ndarray, entries: np.ndarray, weights: np.ndarray):
        """Vectors as rows of ``lengths`` entries each, none of them empty."""
        self.used, local = np.unique(columns, return_inverse=True)
        rows = np.repeat(np.arange(len(ids)), lengths)
        scaled = entries * np.sqrt(weights[columns])
        n = len(ids)
        self.depth = max(0, math.ceil(math.log2(max(1, n / LEAF_ROWS))))
        self.centres = np.zeros((2 ** (self.depth + 1) - 1, len(self.used)), np.float32)
        self.radii = np.zeros(len(self.centres))
        node = np.zeros(n, np.int64)
        for level in range(self.depth + 1):
            first, width = 2**level - 1, 2**level
            keys, at = np.unique(node[rows] * len(self.used) + local, return_inverse=True)
            sizes = np.bincount(node, minlength=width)
            centre = self.centres[first : first + width]
            centre.flat[keys] = np.bincount(at, scaled) / sizes[keys // len(self.used)]
            apart = self._apart(scaled, rows, at, centre.flat[keys].astype(float), node, keys // len(self.used), n, width)
            order = np.lexsort((apart, node))
            last = np.cumsum(sizes) - 1
            self.radii[first : first + width] = apart[order[last]]
            if level < self.depth:
                node = self._halves(scaled, rows, at, keys, node, order[last], sizes, n, width)
        order = np.argsort(node, kind="stable")
        place = np.argsort(order, kind="stable")
        by_row = np.argsort(place[rows], kind="stable")
        self.ids = [ids[i] for i in order]
        self.columns, self.entries = local[by_row], entries[by_row]
        self.row_starts = np.concatenate([[0], np.cumsum(lengths[order])])
        self.leaf_rows = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=2**self.depth))])

    @staticmethod
    def _dots(scaled, rows, at, values, n) -> np.ndarray:
        return np.bincount(rows, scaled * values[at], minlength=n)

    def _apart(self, scaled, rows, at, values, node, key_node, n, width) -> np.ndarray:
        """The distance of every row to a vector of its node, given by its values at the keys,
        rounded up by more than what cancels out."""
        own = np.bincount(rows, scaled**2, minlength=n)
        theirs = np.bincount(key_node, values**2, minlength=width)[node]
        square = own - 2 * self._dots(scaled, rows, at, values, n) + theirs
        return np.sqrt(np.maximum(0, square) + 1e-9 * (own + theirs))

    def _halves(self, scaled, rows, at, keys, node, far, sizes, n, width) -> np.ndarray:
        """Every node's rows in two equal parts, along the line from the row farthest from the
        centre to the row farthest from that one."""

        def pivot(chosen: np.ndarray) -> np.ndarray:
            values = np.zeros(len(keys))
            mine = np.zeros(n, bool)
            mine[chosen] = True
            inside = mine[rows]
            values[at[inside]] = scaled[inside]
            return values

        one = pivot(far)
        apart = self._apart(scaled, rows, at, one, node, keys // len(self.used), n, width)
        last = np.cumsum(sizes) - 1
        other = pivot(np.lexsort((apart, node))[last])
        along = self._dots(scaled, rows, at, other - one, n)
        order = np.lexsort((along, node))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(last + 1 - sizes, sizes)
        return 2 * node + (2 * rank >= sizes[node])

    def search(self, columns: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer ``best`` every document that may belong there. ``columns`` are global, ascending."""
        at = np.searchsorted(self.used, columns)
        here = (at < len(self.used)) & (self.used[np.minimum(at, len(self.used) - 1)] == columns)
        if not here.any():
            return
        at, weights = at[here], weights[here]
        root = np.sqrt(weights.astype(float))
        bounds = self.centres[:, at].astype(float) @ root + np.sqrt(weights.sum()) * self.radii
        bounds = bounds * (1 + 1e-5) + 1  # beyond any rounding error above
        dense = np.zeros(len(self.used), np.int64)
        dense[at] = weights
        leaves = 2**self.depth - 1
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= best.floor:
            node = heapq.heappop(queue)[1]
            if node < leaves:
                for child in (2 * node + 1, 2 * node + 2):
                    if bounds[child] >= best.floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            lo, hi = self.leaf_rows[node - leaves], self.leaf_rows[node - leaves + 1]
            starts = self.row_starts[lo : hi + 1]
            inside = slice(starts[0], starts[-1])
            scores = np.add.reduceat(dense[self.columns[inside]] * self.entries[inside], starts[:-1] - starts[0])
            for i in np.flatnonzero(scores >= max(1, best.floor)):
                best.offer(int(scores[i]), self.ids[lo + i])


class Best:
    """The k best documents of an item: high scores, then small ids, those without id last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.rows = k, floor, []

    def offer(self, score: int, doc_id: int | None) -> None:
        row = (score, doc_id is not None, -(doc_id or 0))
        if len(self.rows) < self.k:
            heapq.heappush(self.rows, row)
        elif row > self.rows[0]:
            heapq.heapreplace(self.rows, row)
        if len(self.rows) == self.k:
            self.floor = max(self.floor, self.rows[0][0])


def blocks_of(batches: Iterable[pa.RecordBatch], corpus: Corpus) -> Iterator[Block]:
    """Trees over the (doc_id, n, columns, counts) rows of a task, a bounded number at a time."""
    ids, columns, entries, size = [], [], [], 0

    def built() -> Block:
        lengths = np.array([len(c) for c in columns])
        return Block(ids, lengths, np.concatenate(columns), np.concatenate(entries), corpus.weights)

    for batch in batches:
        for doc_id, n, c, t in zip(*batch.columns, strict=True):
            c, t = (np.asarray(x.values) for x in (c, t))
            useful = corpus.weights[c] > 0
            if not useful.any():
                continue
            if ids and (len(ids) == BLOCK_ROWS or size + len(c) > BLOCK_ENTRIES):
                yield built()
                ids, columns, entries, size = [], [], [], 0
            ids.append(doc_id.as_py())
            columns.append(c[useful])
            entries.append(corpus.entries(n.as_py(), t[useful]))
            size += len(c)
    if ids:
        yield built()


def searched(vectors: DataFrame, corpus: Corpus, queries: Sequence[np.ndarray], k: int, floors: Sequence[int]) -> DataFrame:
    """(item, doc_id, score): every task's k best documents per item with a score of at least the
    item's floor."""
    shared = vectors.sparkSession.sparkContext.broadcast((corpus, list(queries), list(floors)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, queries, floors = shared.value
        best = [Best(k, floor) for floor in floors]
        for block in blocks_of(batches, corpus):
            for columns, b in zip(queries, best, strict=True):
                block.search(columns, corpus.weights[columns], b)
        for item, b in enumerate(best):
            if b.rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(b.rows), pa.int32()),
                        pa.array([-d if known else None for _, known, d in b.rows], pa.int64()),
                        pa.array([s for s, _, _ in b.rows], pa.int64()),
                    ],
                    names=["item", "doc_id", "score"],
                )

    return map_arrow(vectors.where(F.size("columns") > 0), run, "item int, doc_id bigint, score bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Per item its ``k`` best documents of score above 0: item_id, rank (from 1), doc_id, score.

    Null texts have no terms; documents without terms count nowhere, and items without terms find
    nothing. Ties go to the smaller doc_id; a null doc_id comes last among them. Every row of
    ``docs`` is a document, so repeated rows are found repeatedly and count in the statistics as
    often. Items are distinct (id, text) rows; an id with two texts is two items. Texts count
    whole, of any length. Empty tables give an empty result; other columns are not read.

    Items are taken ``item_bytes`` of text at a time, each block in a pass over ``docs``.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).alias("item_id"), as_text(item_text_col).alias("text")).distinct()
    rows = written(rows, "items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // item_bytes + 1
    kind = rows.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        block.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        vocabulary: dict[bytes, int] = {}
        queries = []
        for row in block:
            found = {t for terms in terms_of(row["text"].encode()) for t in terms}
            columns = [vocabulary.setdefault(t, len(vocabulary)) for t in sorted(found)]
            queries.append(np.array(sorted(columns), np.int32))
        if not vocabulary:
            continue
        vectors = written(postings(docs, vocabulary, id_col, text_col), "vectors")
        corpus = corpus_of(vectors, len(vocabulary))
        if not corpus.n_docs:
            continue
        first = F.pmod(F.xxhash64("doc_id", "n"), F.lit(WAVE)) == 0
        early = written(ranked(searched(vectors.where(first), corpus, queries, k, [1] * len(queries)), k), "early")
        floors = [1] * len(queries)
        for item, floor in early.where(F.col("rank") == k).select("item", "score").collect():
            floors[item] = floor
        late = searched(vectors.where(~first), corpus, queries, k, floors)
        both = ranked(early.drop("rank").union(late), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {kind}")
        out = out.union(both.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("item_id bigint, text string").parquet(f"{sf_dir}/benchmark.parquet")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), benchmark(spark, sf_dir))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY t, n_docs),
s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(terms) AS t FROM i) JOIN tf USING (t) JOIN w USING (t), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= {TOP}
"""
