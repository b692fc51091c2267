"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text gets its shingle set's size, a 128-bit identity and K minimum hashes. Texts with the
   same set are one node from here on, so copies are never paired.
2. A document is posted under (coordinate, value) for a prefix of its coordinates only: two
   signatures with at least T equal values out of K share one of any K - T + 1 coordinates chosen
   in a common order. The order puts frequent values last, so long lists are skipped by all
   documents that do not need them.
3. Lists are merged: collisions of two postings are counted over all K coordinates (one byte of
   each value travels along; a byte can only add collisions), pairs from T up are candidates, and
   a spanning forest of them is kept, not the pairs. A list of any length is dealt out in blocks.
4. Each candidate cluster is compared on full shingle sets, again in blocks, and a forest of the
   confirmed links gives the components.

T is the largest count that a pair at the limit stays under with a chance of at most ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.llm.common import as_text, documents, map_arrow, without_rows, written
from adcorpus.llm.components import components, roots

COORDINATES = 48
MISS = 1e-5
#: Lists from this length are skipped where others do; at most HOT_VALUES of them are told to the
#: tasks, which only chooses the prefixes.
HOT_LIST, HOT_VALUES = 32, 100_000
BLOCK = 256
#: Shingles of one cluster block, so that long texts make smaller blocks.
BLOCK_SHINGLES = 2_000_000
#: Nodes up to which the cluster table (16 bytes each) is broadcast to the texts.
BROADCAST_NODES = 1_000_000

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hasher(width: int) -> Callable[[str], np.ndarray]:
    """text -> sorted distinct 64-bit hashes of its shingles of ``width`` words; a shorter text is
    one shingle; without words there is none. A-Z are lower-cased; ASCII white space separates."""
    hashes = _WordHashes()
    odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) | 1) & (2**64 - 1)) for k in range(width)]

    def hashed(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        n = len(words) - width + 1
        total = h[:n] * odd[0]
        for k in range(1, width):
            total = mix(total) + h[k : k + n] * odd[k]
        return np.unique(mix(total))

    return hashed


def match_threshold(k: int, similarity: float, miss: float = MISS) -> int:
    """Largest T such that fewer than T of k coordinates agree with a chance of at most ``miss``."""
    below, t = 0.0, 0
    while True:
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(t, 1)
        t += 1


def signatures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, k: int = COORDINATES
) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, signature) per row; the signature holds k unsigned 32-bit."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = shingle_hasher(words)
        random = np.random.default_rng(20)
        salt = random.integers(0, 2**64, (k, 1), np.uint64)
        factor = random.integers(0, 2**64, (k, 1), np.uint64) | np.uint64(1)
        top, chunk = np.uint64(32), 4096
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for text in batch.column(1):
                s = hashed(text.as_py())
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64)))
                h2.append(int(mix(s ^ salt[0]).sum(dtype=np.uint64)))
                least = np.full(k, 2**32 - 1, np.uint64)
                for at in range(0, len(s), chunk):
                    values = ((s[at : at + chunk] ^ salt) * factor) >> top
                    np.minimum(least, values.min(axis=1), out=least)
                sig.append(least.astype("<u4").tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.array(sig, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "signature"],
            )

    return map_arrow(
        rows, run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, signature binary"
    )


def _matrix(column: pa.Array, k: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, k)


def _keys(column: pa.Array, k: int) -> np.ndarray:
    """(coordinate, value) as one integer, per node and coordinate."""
    return _matrix(column, k, "<u4").astype(np.int64) | (np.arange(k, dtype=np.int64) << 32)


def hot_lists(nodes: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and lengths of the long lists: at most HOT_VALUES, as every list from
    total / HOT_VALUES postings up is told and no shorter one."""
    least = max(HOT_LIST, math.ceil(nodes.count() * k / HOT_VALUES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, counts = np.unique(_keys(batch.column(0), k), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    counted = map_arrow(nodes.select("signature"), run, "key bigint, n bigint").groupBy("key")
    hot = counted.agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas().sort_values("key")
    return hot["key"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)


def postings(nodes: DataFrame, k: int, least: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, node, sketch) for the prefix coordinates of every node."""
    hot_keys, hot_counts = hot

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, keys = batch.column(0).to_numpy(), _keys(batch.column(1), k)
            length = np.zeros(keys.shape, np.int64)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                length = np.where(hot_keys[at] == keys, hot_counts[at], 0)
            prefix = np.argsort(length, axis=1, kind="stable")[:, : k - least + 1]
            row = np.repeat(np.arange(len(node)), prefix.shape[1])
            key = np.take_along_axis(keys, prefix, 1).ravel()
            sketch = _matrix(batch.column(1), k, "<u4").astype(np.uint8)
            for at in range(0, len(row), 20_000):
                cut = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[cut]),
                        pa.array(node[row[cut]]),
                        pa.array([s.tobytes() for s in sketch[row[cut]]], pa.binary()),
                    ],
                    names=["key", "node", "sketch"],
                )

    return map_arrow(nodes.select("node", "signature"), run, "key bigint, node bigint, sketch binary")


def dealt(posted: DataFrame) -> DataFrame:
    """(key, part, block, node, sketch): lists cut into blocks of about BLOCK postings, by the
    length that each has. A posting meets every block of its list, in a part for each pair of
    blocks; most lists are one block and one part."""
    long = posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    long = written(long.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "long-lists")
    few = long.count() <= BROADCAST_NODES
    rows = posted.join(F.broadcast(long) if few else long, "key", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    rows = rows.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    part = F.shiftleft(F.least("block", "other"), 32).bitwiseOR(F.greatest("block", "other"))
    return rows.select("key", part.alias("part"), "block", "node", "sketch")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of sorted rows in which no group of the first ``keys`` columns is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        changes = np.zeros(batch.num_rows, bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        if held:
            changes[0] = any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(columns))
        cuts = np.flatnonzero(changes)
        if len(cuts):
            if held or cuts[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _between(nodes: np.ndarray, known: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that turn the trees ``known`` into the trees ``root``; the known ones are left out,
    as the part that has both ends in one block reports them."""
    tops = np.flatnonzero((known == np.arange(len(known))) & (root != known))
    return nodes[root[tops]], nodes[tops]


def candidates(posted: DataFrame, k: int, least: int) -> DataFrame:
    """A spanning forest (a, b) of the pairs that collide in at least ``least`` coordinates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            key, part, block, node = (table.column(i).to_numpy() for i in range(4))
            sketch = _matrix(table.column(4), k, "u1")
            start = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
            last = np.append(np.flatnonzero(start)[1:], len(key)) - 1
            last = last[np.cumsum(start) - 1]
            across = (part >> 32) != (part & 0xFFFFFFFF)
            nodes, index = np.unique(node, return_inverse=True)
            # within blocks, of parts of one block and of parts of two; and between blocks
            one, two, both = (np.arange(len(nodes)) for _ in range(3))
            row = np.arange(len(key))
            for d in range(1, int((last - row).max()) + 1):
                row = row[row + d <= last[row]]
                known = np.where(across[row], both[index[row]] == both[index[row + d]], one[index[row]] == one[index[row + d]])
                i = row[~known | (across[row] & (block[row] == block[row + d]) & (two[index[row]] != two[index[row + d]]))]
                i = i[(sketch[i] == sketch[i + d]).sum(axis=1) >= least]
                if len(i):
                    x, y, far = index[i], index[i + d], across[i]
                    same = far & (block[i] == block[i + d])
                    one = roots(one, x[~far], y[~far])
                    two = roots(two, x[same], y[same])
                    both = roots(both, x[far], y[far])
            found = [_between(nodes, np.arange(len(nodes)), one), _between(nodes, two, both)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"]
            )

    lists = posted.repartition("key", "part").sortWithinPartitions("key", "part")
    return map_arrow(lists, run, "a bigint, b bigint")


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a group are linked: 100 * |intersection| >= percent * |union|."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = count[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((n, n), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, 4_000_000 // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        common += np.rint(m @ m.T).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    return (100 * common >= percent * union) & (union > 0)


def confirmed(members: DataFrame, words: int, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the links among (cluster, part, block, node, text) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = shingle_hasher(words)
        for table in whole_groups(batches, 2):
            cluster, part = table.column(0).to_numpy(), table.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (cluster[1:] != cluster[:-1]) | (part[1:] != part[:-1])])
            a, b = [], []
            for lo, hi in zip(starts, [*starts[1:], len(cluster)], strict=True):
                if hi - lo < 2:
                    continue
                group = table.slice(lo, hi - lo)
                block, node = group.column(2).to_numpy(), group.column(3).to_numpy()
                links = np.triu(_linked([hashed(t.as_py()) for t in group.column(4)], percent), 1)
                known = np.arange(hi - lo)
                if part[lo] >> 32 != part[lo] & 0xFFFFFFFF:
                    known = roots(known, *np.nonzero(links & (block[:, None] == block[None, :])))
                more = _between(node, known, roots(known, *np.nonzero(links)))
                a.append(more[0])
                b.append(more[1])
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
                )

    groups = members.select("cluster", "part", "block", "node", "text")
    groups = groups.repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return map_arrow(groups, run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    k: int = COORDINATES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| over distinct shingles;
    component_id is the smallest doc_id reachable and that document is kept. Without text or words
    a document is linked with nothing. A null doc_id is linked with nothing and kept, with a null
    component_id. A doc_id that repeats is settled row by row; equal rows are marked alike. Texts
    of any length count whole. An empty table gives an empty result; other columns are not read.
    """
    least = match_threshold(k, percent / 100)
    marks = written(signatures(docs, id_col, text_col, words, k), "signatures")
    usable = marks.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = written(
        usable.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("node"),
            F.min_by("signature", "doc_id").alias("signature"),
            F.first("n_shingles").alias("n"),
        ),
        "nodes",
    )
    posted = dealt(postings(nodes, k, least, hot_lists(nodes, k)))
    clusters = components(candidates(posted, k, least)).withColumnRenamed("component", "cluster")

    member = clusters.join(nodes.select("node", "n"), "node")
    sizes = member.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)
        ).alias("blocks")
    )
    member = written(member.select("node", "cluster").join(sizes, "cluster"), "clusters")
    size = member.count()
    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), as_text(text_col).alias("text"))
    rows = texts.join(F.broadcast(member) if size <= BROADCAST_NODES else member, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.shiftleft(F.least("block", "other"), 32).bitwiseOR(F.greatest("block", "other"))
    linked = components(confirmed(rows.withColumn("part", part), words, percent))

    found = nodes.select("h1", "h2", "node").join(linked, "node", "left")
    found = found.select("h1", "h2", F.coalesce("component", "node").alias("component"))
    alone = marks.withColumn("alone", (F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    component = F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("component"))
    return alone.join(found, ["h1", "h2"], "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component; rows that share a doc_id go together. All
    columns as they were, whatever their names; edge cases are those of ``near_duplicates``."""
    lost = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept") & F.col("doc_id").isNotNull())
    lost = written(lost.select("doc_id").distinct(), "near-copies")
    return without_rows(docs, {"doc_id": F.col(id_col).cast("bigint")}, lost)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
      FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3
        THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1),
        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM d),
n AS (SELECT s, min(doc_id) AS node FROM s WHERE len(s) > 0 GROUP BY s),
p AS (SELECT node, len(s) AS n, unnest(s) AS g FROM n),
e AS (SELECT a.node AS a, b.node AS b FROM p a JOIN p b ON a.g = b.g AND a.node < b.node
        AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
c AS (SELECT x, least(x, min(y)) AS c FROM r GROUP BY x)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.c, n.node, s.doc_id) AS component_id,
       s.doc_id = coalesce(c.c, n.node, s.doc_id) AS kept
FROM s LEFT JOIN n ON n.s = s.s LEFT JOIN c ON c.x = n.node
"""
