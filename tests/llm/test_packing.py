"""Packing: a round trip to the token ids, and the number of sequences."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from adcorpus.llm.packing import byte_level_encoder, cut, pack, packing_plan

from llm_cases import prose


def laid_out(segments):
    bins, taken = {}, {}
    for n, lo, hi, first, at, each in segments:
        for i in range(hi - lo):
            bins.setdefault(first + i // each, []).append((at + i % each * n, n))
        taken.setdefault(n, []).append((lo, hi))
    return bins, taken


def test_plan_places_every_piece_once_without_gaps():
    rng = random.Random(4)
    for _ in range(150):
        cap = rng.choice([7, 12, 30, 100])
        items = [rng.randint(1, cap if rng.random() < 0.5 else max(1, cap // 4)) for _ in range(rng.randint(0, 120))]
        histogram = {n: items.count(n) for n in items}
        bins, taken = laid_out(packing_plan(histogram, cap))
        for n, count in histogram.items():
            ranges = sorted(taken[n])
            assert ranges[0][0] == 0 and ranges[-1][1] == count
            assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        for content in bins.values():
            end = 0
            for at, n in sorted(content):
                assert at == end
                end += n
            assert end <= cap
            assert sum(3 * n > cap for _, n in content) <= 2
        room = []
        for n in sorted(items, reverse=True):
            fits = [j for j, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits, key=room.__getitem__)] -= n
            else:
                room.append(cap - n)
        assert len(bins) <= len(room) + 1


def test_plan_size_depends_on_the_capacity_alone():
    small = packing_plan({n: 1000 for n in range(1, 2049)}, 2048)
    large = packing_plan({n: 1_000_000 for n in range(1, 2049)}, 2048)
    assert len(large) < 1.2 * len(small) + 100 < 20_000


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)]
    assert cut(9, 8) == [(0, 1), (1, 8)] and cut(16, 8) == [(0, 8), (8, 8)]


def test_ids_are_those_of_the_tokenizer(odd_rows):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = byte_level_encoder("byte_bpe_50k.json")
    texts = [t or "" for _, t, *_ in odd_rows] + ["<|endoftext|> a", "  x\n\n y\t1234 don't", "   ß", "a" * 5000]
    for text in texts:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(odd_docs, odd_rows, no_docs):
    encode = byte_level_encoder("byte_bpe_50k.json")
    out = [r.asDict() for r in pack(odd_docs).collect()]
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = np.append(encode(text or ""), 0).astype("<u4")
        want += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 2048))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        end = 0
        for at, n in sorted(content):
            assert at == end
            end += n
        assert end <= 2048
    assert len(bins) == -(-sum(w[3] for w in want) // 2048)
    assert pack(no_docs).count() == 0
    assert prose(1, 3) == prose(1, 3)
