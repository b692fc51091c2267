"""Columns with the names that operators use inside, rows that bend a mixture, many matches."""

from __future__ import annotations

import random
import time
from collections import Counter

from llm_cases import prose
from pyspark.sql import functions as F

from adcorpus.llm.exact_dedup import drop_copies
from adcorpus.llm.line_dedup import line_dedup
from adcorpus.llm.mixing import mixed, sample_mixture
from adcorpus.llm.near_dup import drop_near_copies
from adcorpus.llm.secrets import secret_summary
from adcorpus.llm.spans import masked, running, spans_of

NAMES = (
    "_kept", "_lost_id", "_lost_doc_id", "_lost_text_sha256", "_lost_sha", "_mix_id", "_MIX_dim_source", "_copy_sha",
    "_copy_keep", "keep_id", "text_sha256", "weight", "ref", "window", "gone", "run", "term",
)


def test_drops_keep_columns_of_any_name(spark):
    rows = [(i, prose(i // 2, 60), "en", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name in NAMES:
        docs = docs.withColumn(name, F.lit(name))
    for drop in (drop_copies, drop_near_copies, sample_mixture):
        left = drop(docs)
        assert left.columns == docs.columns
        out = left.collect()
        assert out and all(r[n] == n for r in out for n in NAMES)
        if drop is not sample_mixture:
            assert len(out) == 20
    assert {r.n_removed for r in line_dedup(docs).collect()} == {0, 6}


def test_one_odd_row_moves_a_mixture_little(spark):
    rng = random.Random(5)
    rows = [(i, prose(i, rng.randint(20, 60)), rng.choice(["en", "de"]), f"s{rng.randint(0, 4)}") for i in range(600)]
    schema = "doc_id bigint, text string, lang string, source string"

    def kept(rows):
        out = mixed(spark.createDataFrame(rows, schema)).collect()
        return sum(r.n_tokens * r.probability for r in out) / sum(r.n_tokens for r in out)

    before, after = kept(rows), kept([*rows, (9999, "ten words of a source and language of their own", "xx", "odd")])
    assert before > 0.85 and abs(before - after) < 0.03


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 10, 99, 100, 101)]
    got = [r.s for r in spark.createDataFrame(rows, "w array<int>").coalesce(1).select(running(F.col("w")).alias("s")).collect()]
    assert got == [[sum(w[:i]) for i in range(len(w))] for (w,) in rows]


def test_masked_text_keeps_its_places(values):
    cells = ["ab12cd345e", "", "12", "x", None, "é99é9"]
    assert values(cells, lambda c: masked(c, "[0-9]+")) == ["ab  cd   e", "", "  ", "x", None, "é  é "]
    assert values(cells, lambda c: masked(c, "[0-9]+", lambda h: F.length(h) > 2)) == ["ab12cd   e", "", "12", "x", None, "é99é9"]
    spans = values(["a1 22 b333"], lambda c: F.to_json(spans_of(c, "[0-9]+", "n", 1)), "string")
    assert spans == ['[{"start":1,"rank":1,"end":2,"kind":"n","value":"1"},{"start":3,"rank":1,"end":5,"kind":"n","value":"22"},'
                     '{"start":7,"rank":1,"end":10,"kind":"n","value":"333"}]']


def test_a_megabyte_of_tokens_and_matches_in_time(spark):
    rng = random.Random(7)
    token = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(20))
    text = " ".join(f"password={token()} {token()}" for _ in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    start = time.perf_counter()
    row = secret_summary(df).first()
    assert time.perf_counter() - start < 40
    assert row.n_assign == 20_000


def test_what_is_left_beside_a_base_match_is_judged(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"{prose(i, 60)} secret = '{some(30)}' {prose(i + 99, 20)}") for i in range(60)]
    rows += [(100, f"x AKIA{'Q7' * 6}/{some(40)} y")]
    got = secret_summary(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id = 100").first()
    assert Counter(s.split(":")[0] for s in got.spans.split(",")) == {"access": 1, "random": 1}
    assert got.spans.split(",")[0] == "access:2:18"
