"""The prefix trie against a trie of plain dictionaries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from adcorpus.llm import tries
from adcorpus.llm.tries import DoubleArray, conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, depth int, n string, number int"


def make(spark, rows):
    """Turns with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)


def brute(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = Counter(), Counter()
    for path in members:
        words = len(re.findall(tries.WORD, path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(members[path]) - 1) * words
    return Counter(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def talk(seed, n_convs, vocabulary, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randint(0, 3)) + str(rng.randint(0, vocabulary))))
    return rows


@pytest.mark.parametrize(("span", "shard_turns"), [(1024, 200_000), (1024, 20), (3, 15), (2, 1_000)])
def test_against_brute_force(spark, span, shard_turns):
    rows = talk(span, 90, 1, 9)
    got = conversation_trie(make(spark, rows), span, shard_turns)
    assert got.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 1, None, None), (0, 1, "user", "tie"), (0, 1, "user", "tie"),
        (1, 5, "user", "only\ttwo  words"), (2, 0, "user", ""), (None, 0, "user", "nobody"), (41, 0, "a", "b"),
        (45, 0, "a", "b"), (2_000_000, 0, "user", "first"), (7, 0, "user", "x " * 200_000), (-3, 0, "u", "minus"),
    ]
    rows += [(c, 0, "user", "same") for c in range(9000, 9300)]
    rows += [(c, t, "user", f"turn {t}") for c in (500, 501, 510) for t in range(23)]
    for span in (1024, 4):
        got = conversation_trie(make(spark, rows), span, 40)
        assert Counter(map(tuple, got.collect())) == brute(rows)
    assert conversation_trie(make(spark, rows).where("false")).count() == 0
    assert conversation_trie(make(spark, rows).where("conv_id IS NULL")).count() == 0


def test_a_third_of_all_turns_in_one_conversation(spark):
    rows = talk(3, 200, 2, 5)
    rows += [(20, t, "user", f"long {t % 7}") for t in range(6, 400)]
    got = conversation_trie(make(spark, rows), 16, 100)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_double_array():
    rng = random.Random(1)
    for vocabulary, n in ((2, 200), (50, 300), (100_000, 2000)):
        sequences = sorted({tuple(str(rng.randint(0, vocabulary)).encode() for _ in range(rng.randint(0, 6))) for _ in range(n)})
        trie = DoubleArray(sequences)
        prefixes = {s[:d] for s in sequences for d in range(len(s) + 1)}
        assert len(trie.states) == len(set(trie.states)) == len(prefixes)
        ends = {}
        for p in prefixes:
            path = list(trie.walk(p))
            assert len(path) == len(p) + 1
            ends[path[-1]] = p
        assert len(ends) == len(prefixes)
        for _ in range(300):
            s = tuple(str(rng.randint(0, vocabulary)).encode() for _ in range(4))
            assert len(list(trie.walk(s))) - 1 == max(d for d in range(5) if s[:d] in prefixes)
        assert len(trie.check) < 3 * len(prefixes) + 2 * len(trie.codes)
