"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from adcorpus.llm import near_dup
from adcorpus.llm.components import components, roots
from adcorpus.llm.exact_dedup import drop_copies, exact_dedup
from adcorpus.llm.near_dup import drop_near_copies, match_threshold, near_duplicates, shingle_hasher

from llm_cases import make_docs, prose


def brute_exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        group = groups[text or ""]
        keep = max((d for d in group if d is not None), default=None)
        out.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(odd_docs, odd_rows, no_docs):
    assert Counter(map(tuple, exact_dedup(odd_docs).collect())) == brute_exact(odd_rows)
    assert Counter(map(tuple, exact_dedup(odd_docs, least=2).collect())) == brute_exact(odd_rows)
    assert exact_dedup(no_docs).count() == 0
    left = drop_copies(odd_docs)
    assert left.columns == odd_docs.columns
    want = [r[0] for r in brute_exact(odd_rows).elements() if r[3]]
    assert Counter(r.doc_id for r in left.collect()) == Counter(want)


def test_exact_dedup_hot_group_takes_the_map_side_way(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    out = exact_dedup(make_docs(spark, rows))
    assert Counter(map(tuple, out.collect())) == brute_exact(rows)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def brute_near(rows, words, percent):
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))

    sets = [shingles(text) for _, text, *_ in rows]
    first = {}
    for (doc_id, *_), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            first[s] = min(first.get(s, doc_id), doc_id)
    parent = {d: d for d in first.values()}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    keys = list(first)
    for i, s in enumerate(keys):
        for t in keys[:i]:
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(first[s]), find(first[t])))
                parent[b] = a
    out = []
    for (doc_id, *_), s in zip(rows, sets, strict=True):
        c = find(first[s]) if s and doc_id is not None else doc_id
        out.append((doc_id, len(s), c, doc_id == c))
    return Counter(out)


def test_near_duplicates_edges(odd_docs, odd_rows, no_docs):
    for words, percent in ((3, 85), (5, 80)):
        got = near_duplicates(odd_docs, words=words, percent=percent)
        assert Counter(map(tuple, got.collect())) == brute_near(odd_rows, words, percent)
    assert near_duplicates(no_docs).count() == 0
    left = drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns
    want = Counter(r[0] for r in brute_near(odd_rows, 5, 80).elements() if r[3])
    assert Counter(r.doc_id for r in left.collect()) == want


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group of edited copies far over the block size, a passage in very many documents, and
    unrelated texts; small blocks and short hot lists make every path run."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "HOT_LIST", 4)
    rng = random.Random(3)
    base, passage = prose(50, 150).split(" "), prose(51, 60)
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 999)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, f"{prose(200 + i, 70)} {passage}") for i in range(60)]
    rows += [(200 + i, prose(400 + i, 50)) for i in range(60)]
    rng.shuffle(rows)
    got = near_duplicates(make_docs(spark, rows), words=3, percent=85)
    assert Counter(map(tuple, got.collect())) == brute_near(rows, 3, 85)


def test_match_threshold_and_shingles():
    assert match_threshold(48, 0.85) == 29
    assert match_threshold(48, 1.0) == 48
    hashed = shingle_hasher(3)
    assert len(hashed("")) == len(hashed(" \n")) == 0
    assert len(hashed("a b")) == 1 and len(hashed("a b c d a b c")) == 4
    assert np.array_equal(hashed("A b\tC"), hashed("a\nB c"))


def test_components_chain(spark):
    rng = random.Random(1)
    order = list(range(300))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199)] + [(order[i], order[200]) for i in range(201, 290)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    low, high = min(order[:200]), min(order[200:290])
    assert got == {n: low for n in order[:200]} | {n: high for n in order[200:290]}
    assert components(df.where(F.lit(False))).count() == 0
    assert roots(np.arange(4), np.array([2, 3]), np.array([3, 1])).tolist() == [0, 1, 1, 1]
