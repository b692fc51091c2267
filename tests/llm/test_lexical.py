"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from adcorpus.llm import lexical
from adcorpus.llm.lexical import Best, Block, lexical_search

from llm_cases import WORDS, make_docs, prose

ITEMS = "item_id bigint, text string, rank int, doc_id string, n int"


def make_items(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ITEMS)


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, items, k):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(d, t) for d, t in docs if t]
    n_docs, n_terms = len(docs), sum(sum(t.values()) for _, t in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item_id, text in set(items):
        scored = []
        for doc_id, counts in docs:
            m = 100 - 50 + (50 * sum(counts.values()) * n_docs) // n_terms
            score = 0
            for t in set(terms(text)) & counts.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, missing, doc_id) in enumerate(sorted(scored)[:k], 1):
            out[item_id, rank, None if missing else doc_id, -score] += 1
    return out


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, df.collect()))


QUERIES = [
    (1, "the river and the stone"), (2, "één çé 日本語"), (3, ""), (4, None), (5, "nowhere zzz"), (6, "ONE one changed"),
    (6, "garden"), (7, "river river"), (7, "river river"), (None, "castle orange"),
]


@pytest.mark.parametrize("item_bytes", [8_000_000, 20])
def test_against_brute_force(spark, odd_docs, odd_rows, no_docs, item_bytes):
    items = make_items(spark, QUERIES)
    assert found(lexical_search(odd_docs, items, k=3, item_bytes=item_bytes)) == brute(odd_rows, QUERIES, 3)
    assert found(lexical_search(no_docs, items)) == Counter()
    assert found(lexical_search(odd_docs, items.where("false"))) == Counter()


def test_many_blocks_waves_and_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WAVE", 7)
    rng = random.Random(5)
    rows = [(i, prose(i % 900, rng.randint(1, 60))) for i in range(3000)]
    rows += [(i, "castle orange basket") for i in range(3000, 4000)]
    queries = [(i, " ".join(rng.sample(WORDS, rng.randint(1, 5)))) for i in range(40)]
    got = lexical_search(make_docs(spark, rows), make_items(spark, queries), k=10)
    assert found(got) == brute(rows, queries, 10)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    weights = rng.integers(0, 9000, 400)
    weights[weights == 0] = 1
    lengths = rng.integers(1, 30, 1500)
    # documents of a few kinds, so that balls differ
    columns = np.concatenate([np.sort(rng.choice(40, n, replace=False)) + 40 * rng.integers(0, 10) for n in lengths])
    entries = rng.integers(1, 600_000, len(columns))
    block = Block(list(range(1500)), lengths, columns, entries, weights)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for _ in range(60):
        query = np.sort(rng.choice(400, 6, replace=False))
        dense = np.zeros(400, np.int64)
        dense[query] = weights[query]
        scores = [int((dense[columns[a:b]] * entries[a:b]).sum()) for a, b in zip(starts, starts[1:], strict=False)]
        best = Best(5, 1)
        block.search(query, weights[query], best)
        want = sorted(((s, True, -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:5]
        assert sorted(best.rows, reverse=True) == want


def test_terms_are_cut_at_gaps(monkeypatch):
    text = ("Alpha-béta gamma42, " * 50).encode()
    whole = [t for part in lexical.terms_of(text) for t in part]
    monkeypatch.setattr(lexical, "CHUNK", 7)
    assert [t for part in lexical.terms_of(text) for t in part] == whole
    assert whole[:3] == [b"alpha", "béta".encode(), b"gamma42"]
