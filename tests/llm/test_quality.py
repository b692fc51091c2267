"""Quality rules against a plain count and against what each rule is for."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from adcorpus.llm import quality as q

from llm_cases import make_docs, prose


def brute_base(text):
    words = re.findall(q.WORD, text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(q.WORD, x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def terms(text):
    return [t for t in re.split(q.BETWEEN, text.lower()) if t]


def classes(text):
    out = []
    for pattern in q.CLASSES:
        left = re.sub(pattern, "", text)
        out.append(len(text) - len(left))
        text = left
    return [*out, len(text)]


def jsd(counts, shares, least):
    total = sum(counts)
    if total < least:
        return None
    p = [c / total for c in counts]
    part = lambda a, b: a * math.log2(a / ((a + b) / 2)) if a else 0.0
    d = sum(part(a, b) + part(b, a) for a, b in zip(p, shares, strict=True)) / 2
    return math.sqrt(max(0.0, d - (len(shares) - 1) / (8 * math.log(2) * total)))


def brute(rows):
    by_lang = defaultdict(Counter)
    chars = defaultdict(lambda: [0] * (len(q.CLASSES) + 1))
    for _, text, lang, _ in rows:
        for key in (lang or "", q.POOLED):
            by_lang[key].update(terms(text or ""))
            chars[key] = [a + b for a, b in zip(chars[key], classes(text or ""), strict=True)]
    total = sum(by_lang[q.POOLED].values())
    refs = {}
    for key, counts in by_lang.items():
        n = sum(counts.values())
        if key == q.POOLED or (n >= q.REF_TERMS and n >= q.REF_SHARE * total):
            top = sorted(counts, key=lambda w: (-counts[w], w))[: q.COMMON]
            refs[key] = (top, [counts[w] / n for w in top] + [(n - sum(counts[w] for w in top)) / n], chars[key])
    out = []
    for doc_id, text, lang, _ in rows:
        text = text or ""
        key = lang or "" if (lang or "") in refs else q.POOLED
        top, shares, c = refs[key]
        found = Counter(terms(text))
        hits = [found[w] for w in top]
        word = jsd([*hits, sum(found.values()) - sum(hits)], shares, q.MIN_TERMS)
        char = jsd(classes(text), [x / sum(c) for x in c], q.MIN_CHARS)
        base = brute_base(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        fine = (char or 0) <= q.MAX_CHAR_DISTANCE and (word or 0) <= q.MAX_WORD_DISTANCE
        out.append((doc_id, *base, key, char, word, failed, not failed and fine))
    return out


def order(row):
    return (row[0] is None, row[0] or 0, row[1:7])


def agree(got, want):
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a[:7], a[9:]) == (b[:7], b[9:])
        for x, y in zip(a[7:9], b[7:9], strict=True):
            assert (x is None and y is None) or x == pytest.approx(y, abs=2e-6)


COLUMNS = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "reference",
    "char_distance", "word_distance", "base_failed", "kept",
]


def test_against_brute_force(odd_docs, odd_rows, no_docs):
    agree(q.quality(odd_docs).select(*COLUMNS).collect(), brute(odd_rows))
    assert q.quality(no_docs).select(*COLUMNS).count() == 0


def test_repeats_overlap_and_touch(spark, values):
    cells = [
        "a b c a b c", "a a a a a", "a b c d a b c e", "a b c", "a b", "", "x a b c y a b c z b c y", "a b a b a b a b",
        "one\ttwo  three\none two three",
    ]
    assert values(cells, lambda c: q.word_rules(c)["n_repeat_words"]) == [brute_base(c)[4] for c in cells]


def test_shouting_and_one_repeated_word_are_dropped(spark):
    clean = [(i, prose(i, 300), "en", "s0") for i in range(40)]
    shout = [(100 + i, prose(i, 200).upper().replace(" ", "!! "), "en", "s0") for i in range(2)]
    odd = [(200, " ".join(f"{w} x{i} y{i}" for i, w in enumerate(["river"] * 300)), "en", "s0")]
    symbols = [(300, " ".join(f"#{i}|{i * 7}" for i in range(300)), "en", "s0")]
    rows = clean + shout + odd + symbols
    got = {r.doc_id: r for r in q.quality(make_docs(spark, rows)).collect()}
    assert all(got[i].kept for i, *_ in clean)
    for i in (100, 101, 200, 300):
        assert not got[i].kept and not got[i].base_failed
    agree([tuple(got[r[0]][c] for c in COLUMNS) for r in rows], brute(rows))


def test_short_texts_have_no_distances(spark):
    rows = [(1, prose(1, 2000), "en", "s0"), (2, "ALL CAPS! " * 3, "en", "s0")]
    short = q.quality(make_docs(spark, rows)).where("doc_id = 2").first()
    assert (short.char_distance, short.word_distance, short.base_failed, short.kept) == (None, None, True, False)


def test_a_long_text_of_repeats_in_time(spark):
    text = "spam egg " * 120_000
    row = q.quality(make_docs(spark, [(1, text, "en", "s0")])).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (240_000, 240_000, False)
