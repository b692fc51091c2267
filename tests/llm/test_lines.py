"""Line dedup and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

from llm_cases import make_docs, prose

from adcorpus.llm.fingerprints import (
    ANCHOR_CHARS, ANCHORS, SPREAD, frequent_words, likeness, length_partition, neighbour_fingerprints,
)
from adcorpus.llm.line_dedup import BLOCK_WORDS, WORD_CHARS, aligned_lines, line_dedup, patience, runs


def test_patience_blocks_are_common_and_in_order():
    rng = random.Random(5)
    for n in range(5000):
        letters = range(rng.choice([3, 8, 30]))
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 15))] for _ in range(2))
        if n % 3 == 0:
            b = a[:5] + b + a[7:]
        x = y = 0
        for i, j, k in patience(a, b):
            assert i >= x and j >= y and a[i : i + k] == b[j : j + k]
            x, y = i + k, j + k
        if a:
            assert patience(a, a) == [(0, 0, len(a))]
    assert patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1, 2)]
    long = list(range(50_000))
    assert patience(long, [*long[25_000:], *long[:25_000]])[0][2] == 25_000


def brute_lines(rows):
    """Every common run of lines of every pair of documents, without hashes or alignment."""

    def size(line):
        return max(len(line.split()), len("".join(line.split())) // WORD_CHARS)

    docs = {(d, t or "") for d, t, *_ in rows if d is not None}
    lines = {key: [(i, x.strip(" ")) for i, x in enumerate(key[1].split("\n")) if x.split()] for key in docs}
    gone = defaultdict(set)
    for b in docs:
        for a in docs:
            if a[0] >= b[0]:
                continue
            ours, theirs = [x for _, x in lines[a]], [x for _, x in lines[b]]
            places = defaultdict(list)
            for i, x in enumerate(ours):
                places[x].append(i)
            for j, x in enumerate(theirs):
                for i in places[x]:
                    n = 0
                    while i + n < len(ours) and j + n < len(theirs) and ours[i + n] == theirs[j + n]:
                        n += 1
                    if sum(map(size, theirs[j : j + n])) >= BLOCK_WORDS:
                        gone[b] |= set(range(j, j + n))
    out = []
    for d, t, *_ in rows:
        raw = (t or "").split("\n")
        owner, drop = 0, set()
        if d is not None:
            worded = [i for i, _ in lines[d, t or ""]]
            for i in range(len(raw)):
                owner = max(0, bisect_right(worded, i) - 1)
                if owner in gone[d, t or ""]:
                    drop.add(i)
        out.append((d, "\n".join(x for i, x in enumerate(raw) if i not in drop), len(raw), len(drop), ",".join(map(str, sorted(drop)))))
    return Counter(out)


def cleaned(spark, rows):
    return Counter(map(tuple, line_dedup(make_docs(spark, rows)).collect()))


def test_line_dedup(spark, odd_docs, odd_rows, no_docs):
    assert Counter(map(tuple, line_dedup(odd_docs).collect())) == brute_lines(odd_rows)
    assert line_dedup(no_docs).count() == 0
    shared, short = prose(90, 24), "Only five words in here"
    rows = [(i, f"{prose(i, 30)}\n{shared}\n{prose(i + 100, 30)}\n{short}") for i in range(16)]
    rows += [(50 + i, f"{prose(200 + i, 24)}\n{prose(300 + i // 2, 48)}") for i in range(10)]
    got = line_dedup(make_docs(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute_lines(rows)
    first, last = (got.where(f"doc_id = {d}").first() for d in (0, 15))
    assert first.n_removed == 0 and shared.split("\n")[0] not in last.clean_text and short in last.clean_text


def test_repeated_crossing_and_chained_passages_go_from_all_holders(spark):
    one, two = "a passage of more than ten words that stands in many documents of this corpus", prose(91, 30)
    rows = [(0, f"{one}\nx\n{one}\n{two}")]
    rows += [(i, f"own {i}\n{two}\nown again {i}\n{one}") for i in range(1, 25)]
    # two lines below the limit, which only together are a block; their first holders differ
    rows += [(30, "one two three four five six"), (31, "seven eight nine ten eleven twelve")]
    rows += [(i, f"own {i}\none two three four five six\n\n seven eight nine ten eleven twelve \nend") for i in range(32, 36)]
    # short lines, and a script without blanks
    rows += [(i, "\n".join([f"v{i}", *"so we go on and on until the last of all".split()])) for i in range(40, 44)]
    rows += [(i, f"{i}\n" + "\u65e5\u672c\u8a9e\u306e\u6587" * 20) for i in range(50, 53)]
    got = cleaned(spark, rows)
    assert got == brute_lines(rows)
    lost = {d: n for d, _, _, n, _ in got}
    assert all(lost[i] >= 2 for i in [*range(1, 25), *range(33, 36)]) and lost[43] == 11 and lost[52] == 1


def test_line_dedup_on_random_lines(spark):
    rng = random.Random(8)
    for letters in (2, 4, 12):
        rows = []
        for i in range(40):
            words = ["", " ", *[" ".join([chr(97 + x)] * (1 + x % 5)) for x in range(letters)]]
            rows.append((i, "\n".join(rng.choice(words) for _ in range(rng.randint(0, 14)))))
        assert cleaned(spark, rows) == brute_lines(rows)


def test_runs_cover_every_block():
    rng = random.Random(3)
    for _ in range(500):
        weights = [rng.randint(1, 12) for _ in range(rng.randint(0, 20))]
        found = runs(weights, 10)
        assert all(sum(weights[i : j + 1]) >= 10 and j - i < 10 for i, j in found)
        for i in range(len(weights)):
            for j in range(i, len(weights)):
                if sum(weights[i : j + 1]) >= 10:
                    inside = {x for a, b in found if i <= a and b <= j for x in range(a, b + 1)}
                    assert inside == set(range(i, j + 1))


def test_equal_documents_of_many_lines_in_time(spark):
    text = "\n".join(f"line {i} with a few more words in it" for i in range(32_000))
    docs = make_docs(spark, [(1, text), (2, text), (3, text + "\nand some words of its own that stay where they are now")])
    start = time.perf_counter()
    got = {r.doc_id: (r.n_removed, len(r.clean_text)) for r in line_dedup(docs).collect()}
    assert time.perf_counter() - start < 30
    assert got == {1: (0, len(text)), 2: (32_000, 0), 3: (32_000, 54)}
    assert aligned_lines([(o, o, 1, o) for o in range(5)]) == set(range(5))


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]


def common_words(texts):
    counts = Counter(w for t in texts for w in words_of(t or "") if len(w) <= ANCHOR_CHARS)
    return sorted(counts, key=lambda w: (-counts[w], w))[:ANCHORS]


def spots(text, common):
    words = words_of(text)
    content = [(w, words[i - 1] if i else "^") for i, w in enumerate(words) if w not in common]
    return {
        (b, w, content[i + 1][0] if i + 1 < len(content) else "")
        for i, (w, b) in enumerate(content)
        if b in common or b == "^" or zlib.crc32(w.encode()) % SPREAD == 0
    }


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_neighbour_fingerprints(spark, no_docs):
    texts = {3: prose(1, 60), 7: None, 8: prose(2, 200), 20: "", 21: "the of", 22: prose(1, 60), 30: "\U0001f600é the x y z", 40: prose(3, 9_000)}
    rows = sorted(texts.items()) + [(8, texts[8])]
    docs = make_docs(spark, rows)
    common = common_words([t for _, t in rows])
    assert frequent_words(docs) == common
    common = ["the", "of", "and", "la"]
    got = neighbour_fingerprints(docs, anchors=common).collect()
    assert len(got) == len(rows) == neighbour_fingerprints(docs).count()
    ids = sorted(texts)
    for r in got:
        text, after = texts[r.doc_id] or "", texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]] or ""
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        a, b, c = (spots(t, common) for t in (text, edited, after))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (len(r.fingerprint), len(r.edited_fingerprint)) == (8 * len(a), 8 * len(b))
        assert abs(r.near_edited - jaccard(a, b)) < 1e-12 and abs(r.near_next - jaccard(a, c)) < 1e-12
    marks = {r.doc_id: r.fingerprint for r in got}
    assert marks[3] == marks[22] != marks[8]
    assert neighbour_fingerprints(no_docs).count() == 0
    alone = neighbour_fingerprints(make_docs(spark, [(1, "the river runs")])).first()
    assert alone.next_id == 1 and alone.near_next == 1.0


def test_every_part_of_a_text_without_common_words_counts(spark):
    rng = random.Random(11)
    unlike = [" ".join(f"{rng.randint(10**7, 10**8)}" for _ in range(400)) for _ in range(3)]
    rows = [(i, "same opening words " + t) for i, t in enumerate(unlike)]
    for r in neighbour_fingerprints(make_docs(spark, rows), anchors=["the"]).collect():
        assert r.n_signatures > 10 and 0.1 < r.near_edited < 0.8 and r.near_next < 0.2


def test_null_and_repeated_ids_have_neighbours(odd_docs, odd_rows):
    out = neighbour_fingerprints(odd_docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, *_ in odd_rows)
    assert all(r.near_next is not None and 0 <= r.near_next <= 1 for r in out)


def test_pruning_by_length_loses_no_near_pair(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    sets = [rng.sample(range(60), rng.randint(0, 50)) for _ in range(400)]
    df = spark.createDataFrame([(sets[i], sets[i + 1]) for i in range(0, 400, 2)], "a array<int>, b array<int>")
    got = df.select("a", "b", likeness(F.col("a"), F.col("b")).alias("full"), likeness(F.col("a"), F.col("b"), 0.6).alias("cut"))
    for r in got.collect():
        assert abs(r.full - jaccard(set(r.a), set(r.b))) < 1e-12
        assert r.cut == r.full or r.cut == 0 and r.full < 0.6
    sizes = spark.range(1, 400).withColumn("p", length_partition(F.col("id"), 0.8))
    parts = {r.id: r.p for r in sizes.collect()}
    assert all(abs(parts[n] - parts[m]) <= 1 for n in parts for m in range(n, min(399, int(n / 0.8)) + 1))
