"""A trie of conversation prefixes, packed in double arrays per prefix shard.

Distinct turn sequences are sorted and cut into ranges; a range is a prefix shard, since every
prefix covers a run of the sorted sequences. A shard gives its turns dense ids, packs its trie into
BASE and CHECK arrays and walks every sequence through them to count what a node has. A node can lie
in two shards only if it is on the first or last path of one: those upper nodes are merged
globally, and their subtree sums are added up along the merged paths by pointer jumping. All other
nodes are complete where they are.

Long conversations are cut into bands of SPAN turns. A band's trie hangs from the node that its
key names, so no row, task or array holds more of a conversation than a band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adcorpus.llm.common import map_arrow, written
from adcorpus.operators.numbering import numbered

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, HEADS = 20, 4
#: Turns of a band, and turns of all sequences in a shard on average.
SPAN, SHARD_TURNS = 1024, 200_000
#: Ids of a node's ended conversations are joined up in chunks of this range of ids.
ID_RANGE = 4096
#: Merged upper nodes up to which their table is broadcast.
BROADCAST_NODES = 100_000
#: Places tried for the children of a node before they go behind all others.
TRIES = 200
NODE = (
    "shared boolean, id string, parent string, conv_id bigint, parent_conv_id bigint, depth bigint, n_convs bigint,"
    " n_children bigint, n_leaves bigint, saved bigint, words bigint, ends string"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """BASE and CHECK over dense turn ids: the child of state s by turn t is BASE[s] + t if CHECK
    there is s. States are listed in breadth-first order, the root (state 0) first."""

    def __init__(self, sequences: Sequence[Sequence[bytes]]):
        """``sequences`` are sorted and distinct."""
        self.codes: dict[bytes, int] = {}
        self.base, self.check = [0], [0]
        self.states, self.depths = [0], [0]
        self._low = 1
        todo = [(0, 0, len(sequences), 0)]
        for state, lo, hi, depth in todo:  # grows while it is read
            if lo < hi and len(sequences[lo]) == depth:
                lo += 1
            if lo == hi:
                continue
            turns, starts = [], []
            for i in range(lo, hi):
                turn = sequences[i][depth]
                if not turns or turn != turns[-1]:
                    turns.append(turn)
                    starts.append(i)
            codes = [self.codes.setdefault(t, len(self.codes) + 1) for t in turns]
            base = self._place(codes)
            self.base[state] = base
            starts.append(hi)
            for k, code in enumerate(codes):
                self.check[base + code] = state
                self.states.append(base + code)
                self.depths.append(depth + 1)
                todo.append((base + code, starts[k], starts[k + 1], depth + 1))

    def _place(self, codes: list[int]) -> int:
        """A base at which all ``codes`` are free."""
        while self._low < len(self.check) and self.check[self._low] >= 0:
            self._low += 1
        least, most = min(codes), max(codes)
        at = self._low
        for _ in range(TRIES):
            if at >= len(self.check):
                break
            if self.check[at] < 0 and all(
                at - least + c >= len(self.check) or self.check[at - least + c] < 0 for c in codes
            ):
                break
            at += 1
        else:
            at = len(self.check)
        grown = at - least + most + 1 - len(self.check)
        if grown > 0:
            self.check.extend([-1] * grown)
            self.base.extend([0] * grown)
        return at - least

    def walk(self, sequence: Sequence[bytes]) -> Iterator[int]:
        """The states of a sequence, the root first; ends early where the trie has no such path."""
        state = 0
        yield state
        for turn in sequence:
            code = self.codes.get(turn)
            if code is None:
                return
            child = self.base[state] + code
            if not 0 < child < len(self.check) or self.check[child] != state:
                return
            yield child
            state = child


def path_id(key: str, turns: Sequence[bytes]) -> str:
    return hashlib.sha256(b"".join([key.encode(), b"|", *turns])).hexdigest() if turns else key


def shard_nodes(key: str, rows: list[dict], span: int, first: bool, last: bool) -> list[tuple]:
    """The NODE rows of one trie of a shard; ``first`` and ``last``: the shard may share its
    first and last path with its neighbours."""
    sequences = [r["turns"] for r in rows]
    trie = DoubleArray(sequences)
    size = len(trie.check)
    n_convs, children, leaves = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    words, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    least = np.full(size, np.iinfo(np.int64).max)
    ends: dict[int, str] = {}
    ids: dict[int, str] = {0: key}  # of the nodes that other shards or bands may have
    band = int(key.partition(":")[0] or 0)
    for k, row in enumerate(rows):
        path = list(trie.walk(row["turns"]))
        n_convs[path] += row["n"]
        least[path] = np.minimum(least[path], row["conv_id"])
        words[path[1:]] = row["words"]
        ends[path[-1]] = row["ends"]
        if (first and k == 0) or (last and k == len(rows) - 1) or row["next_key"] is not None:
            for d in range(1, len(path)):
                ids.setdefault(path[d], path_id(key, row["turns"][:d]))
        if row["next_key"] is not None:
            ids[path[-1]] = row["next_key"]
    states, depths = trie.states, trie.depths
    parents = {s: trie.check[s] for s in states[1:]}
    for state in states[1:]:
        if state not in ids:
            children[parents[state]] += 1
    out = []
    for state, depth in zip(reversed(states), reversed(depths), strict=True):
        parent = parents.get(state)
        mine = int(words[state]) * (int(n_convs[state]) - 1)
        if state in ids:
            bare = band > 0 and state == 0  # counted where the band before ends
            up = ids[parent] if parent is not None else None
            out.append(
                (
                    True, ids[state], up, None if bare else int(least[state]), None, band * span + depth,
                    0 if bare else int(n_convs[state]), int(children[state]), int(leaves[state]), int(saved[state]),
                    int(words[state]), ends.get(state),
                )
            )
            continue
        leaves[state] += children[state] == 0
        saved[state] += mine
        leaves[parent] += leaves[state]
        saved[parent] += saved[state]
        known = parent not in ids
        out.append(
            (
                False, None, None if known else ids[parent], int(least[state]), int(least[parent]) if known else None,
                band * span + depth, int(n_convs[state]), int(children[state]), int(leaves[state]), int(saved[state]),
                int(words[state]), ends.get(state),
            )
        )
    return out


def node_rows(batches: Iterable[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """NODE rows of a shard's (key, turns, words, n, conv_id, ends, next_key) rows, sorted by key and
    turns."""
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64()}
    types = [kinds[f.split()[1]] for f in NODE.split(", ")]

    def packed(key: str, rows: list[dict], first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        nodes = shard_nodes(key, rows, span, first, last)
        for at in range(0, len(nodes), 10_000):
            columns = zip(*nodes[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    held: tuple[str, list[dict], bool] | None = None
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=lambda r: r["key"]):
        if held:
            yield from packed(*held, False)
        held = (key, list(group), held is None)
    if held:
        yield from packed(*held, True)


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, words): turns in order as digests, with the words of their texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("at"),
        F.substring(F.unhex(digest), 1, 16).alias("turn"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    order = [F.col("conv_id"), F.asc_nulls_first("at"), F.col("turn")]
    return numbered(rows, order, "number").drop("at")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn, words) of the rebuilt conversations, depths from 0, and (conv_id, len)
    of all of them, also those without turns."""
    convs = written(rows.groupBy("conv_id").agg(F.min("number").alias("start"), F.count("*").alias("n")), "convs")
    near = rows.join(convs.select("conv_id", "start"), "conv_id").where(F.col("number") < F.col("start") + HEADS)
    heads = near.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("number", "turn", "words"))).alias("head")
    )
    decimal = F.col("conv_id").cast("string")
    plan = convs.withColumn("h", F.crc32(decimal.cast("binary")) % HEADS)
    plan = plan.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "base", "left")
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.expr("array()").cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")))
    plan = plan.select(
        "conv_id", "start", "h", "head", (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")
    )
    plan = written(plan, "rebuilding")
    given = plan.select("conv_id", F.posexplode("head").alias("depth", "t")).select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "t.turn", "t.words"
    )
    own = rows.join(plan.select("conv_id", "start", "h", F.size("head").alias("k")), "conv_id")
    own = own.where(F.col("number") - F.col("start") >= F.col("h"))
    depth = F.col("number") - F.col("start") - F.col("h") + F.col("k")
    return given.union(own.select("conv_id", depth.alias("depth"), "turn", "words")), plan.select("conv_id", "len")


def banded(turns: DataFrame, lengths: DataFrame, span: int) -> DataFrame:
    """(conv_id, band, key, turns, words, sign, last, next_key): a conversation's bands. ``key``
    names all turns before the band: the band's number and sums of signs over the bands before it
    (120 bits). A conversation without turns has one empty band."""
    bands = turns.groupBy("conv_id", F.floor(F.col("depth") / span).alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "turn", "words"))).alias("row")
    )
    empty = lengths.where("len = 0").select("conv_id", F.lit(0).cast("bigint").alias("band"), F.expr("array()").cast(bands.schema["row"].dataType).alias("row"))
    bands = bands.union(empty).select(
        "conv_id",
        "band",
        F.transform("row", lambda t: t["turn"]).alias("turns"),
        F.transform("row", lambda t: t["words"]).alias("words"),
    )
    hexes = F.array_join(F.transform("turns", lambda t: F.hex(t)), "")
    bands = bands.withColumn("sign", F.sha2(F.concat_ws("|", F.col("band").cast("string"), hexes), 256))
    bands = written(bands, "bands")
    # only conversations of several bands need sums; most have one
    long = bands.join(bands.where("band = 1").select("conv_id"), "conv_id", "left_semi")
    lanes = [F.conv(F.substring("sign", at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    upto = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    sums = long.select(
        "conv_id", "band", *[F.sum(lane).over(upto).alias(f"s{k}") for k, lane in enumerate(lanes)]
    ).select("conv_id", (F.col("band") + 1).alias("band"), F.concat_ws(":", (F.col("band") + 1).cast("string"), "s0", "s1").alias("key"))
    sums = written(sums, "band-keys")
    keyed = bands.join(sums, ["conv_id", "band"], "left").withColumn("key", F.coalesce("key", F.lit("")))
    after = sums.select("conv_id", (F.col("band") - 1).alias("band"), F.col("key").alias("next_key"))
    # the key after the last band names nothing
    more = bands.select("conv_id", (F.col("band") - 1).alias("band"), F.lit(True).alias("more")).where("band >= 0")
    after = after.join(more, ["conv_id", "band"]).drop("more")
    keyed = keyed.join(after, ["conv_id", "band"], "left")
    return keyed.withColumn("last", F.col("next_key").isNull())


def sequences(bands: DataFrame) -> DataFrame:
    """One row per distinct (key, turns): n, the smallest conv_id, ends (the digest of the ids that
    end there) and next_key. Ids are joined up in chunks before they meet, so that a group of any
    size passes through its task as a few rows, in order and one at a time."""
    part = bands.withColumn("class", F.sha2(F.concat_ws("|", "key", "sign"), 256)).groupBy(
        "class", F.floor(F.col("conv_id") / ID_RANGE).alias("chunk")
    )
    part = part.agg(
        F.first("key").alias("key"),
        F.first("turns").alias("turns"),
        F.first("words").alias("words"),
        F.count("*").alias("n"),
        F.min("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.when(F.col("last"), F.col("conv_id")))).alias("ids"),
        F.max("next_key").alias("next_key"),
    )
    part = part.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    part = part.repartition("class").sortWithinPartitions("class", "chunk")
    schema = "key string, turns array<binary>, words array<int>, n bigint, conv_id bigint, ends string, next_key string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        types = [
            pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string(), pa.string(),
        ]
        rows = (row for batch in batches for row in batch.to_pylist())
        done: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for _, group in groupby(rows, key=lambda r: r["class"]):
            digest, n, least, some, following = hashlib.sha256(), 0, None, False, None
            for row in group:
                if row["ids"]:
                    digest.update(("," if some else "").encode() + row["ids"].encode())
                    some = True
                n += row["n"]
                least = row["conv_id"] if least is None else min(least, row["conv_id"])
                following = following or row["next_key"]
            done.append((row["key"], row["turns"], row["words"], n, least, digest.hexdigest(), following))
            if len(done) == 2000:
                yield flushed()
                done = []
        if done:
            yield flushed()

    return map_arrow(part, run, schema)


def merged(shared: DataFrame) -> DataFrame:
    """The nodes that shards have in common, each once, with the sums of their subtrees."""
    nodes = shared.groupBy("id").agg(
        F.max("parent").alias("parent"),
        *[F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.max("ends").alias("ends"),
    )
    nodes = written(nodes, "upper")
    below = nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("more")).where("id IS NOT NULL")
    nodes = nodes.join(below, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"))
    nodes = written(nodes.withColumn("saved", F.col("saved") + F.col("words") * (F.col("n_convs") - 1)), "upper")
    # after k rounds a node has the sums of all nodes less than 2^k below it
    sums = nodes.select("id", F.col("parent").alias("up"), "n_leaves", "saved")
    while sums.where("up IS NOT NULL").limit(1).count():
        more = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")
        )
        up = sums.select(F.col("id").alias("up"), F.col("up").alias("higher"))
        sums = sums.join(more, "id", "left").join(up, "up", "left").select(
            "id",
            F.col("higher").alias("up"),
            (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
        )
        sums = written(sums, "upper-sums")
    return nodes.drop("n_leaves", "saved", "more").join(sums.drop("up"), "id")


def conversation_trie(turns: DataFrame, span: int = SPAN, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Null roles and texts
    are empty, a null turn comes first, equal turn numbers go by a digest of role and text, and
    rows that repeat are turns that repeat. Rows without conv_id belong to no conversation; the
    remainder of a negative one is negative, as in SQL, so its block starts above it. Texts
    count whole; only their digests and word counts travel. Without conversations the result is
    empty.
    """
    rows = turn_rows(turns)
    bands = written(banded(*rebuilt(rows), span), "banded")
    found = written(sequences(bands), "sequences")
    size = found.agg(F.sum(F.size("turns"))).first()[0] or 0
    shards = size // shard_turns + 1
    dealt = found.repartitionByRange(shards, "key", "turns").sortWithinPartitions("key", "turns")
    nodes = written(map_arrow(dealt, lambda batches: node_rows(batches, span), NODE), "nodes")
    upper = written(merged(nodes.where("shared")), "upper-nodes")
    known = upper.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    if upper.count() <= BROADCAST_NODES:
        known = F.broadcast(known)
    own = nodes.where(~F.col("shared"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    inner = own.where("parent IS NULL").select(*columns)
    outer = own.where("parent IS NOT NULL").drop("parent_conv_id").join(known, "parent")
    outer = outer.withColumnRenamed("above", "parent_conv_id").select(*columns)
    top = upper.join(known, "parent", "left").withColumnRenamed("above", "parent_conv_id").select(*columns)
    return inner.union(outer).union(top).select(
        *columns[:6], F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("conv_id bigint, turn bigint, role string, text string").parquet(
        f"{sf_dir}/conversations.parquet"
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(conversations(spark, sf_dir))


OP12_SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY i) AS t
  FROM range(256) AS s(i)),
c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM c, tab),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN c AS b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].x, '[^ 	-
]+')) END AS own
  FROM m GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:a] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM (SELECT path, n_children, own, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN n AS p ON f.d > 0 AND p.path = f.path[1:f.d - 1]
"""
