"""Toxicity on held-out rows, mixing against its targets, and the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from llm_cases import make_docs, prose
from pyspark.sql import functions as F

import corpus_pipeline
from adcorpus.llm.mixing import chance, mixed, sample_mixture
from adcorpus.llm.toxicity import drop_toxic, features_of, fit_chain, toxicity

BAD = ("blorb", "snargle", "krunk", "vexed")


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        bad, low = i % 5 == 0, i % 3 == 0
        words = prose(i, 40).split(" ")
        for _ in range(3 if bad else 0):
            words[rng.randrange(40)] = rng.choice(BAD) + rng.choice(["", "ing", "ed"])
        if low:
            words[rng.randrange(40)] = "lorem"
        rows.append((i, " ".join(words)))
        if i < 500:
            labels.append((i, int(not low), int(bad), "extra"))
    labels += [(3, 0, 0, "again"), (None, 1, 1, None), (9999, 1, 1, None)]
    rows += [(800, None), (801, ""), (None, "blorb snargle krunk"), (None, "the quiet river"), (1, rows[1][1])]
    return make_docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, order string")


def test_toxicity_on_held_out_rows(toxic_docs):
    docs, labels = toxic_docs
    out = toxicity(docs, labels)
    assert out.columns == ["doc_id", "low_quality", "toxic", "severe", "kept"]
    got = out.collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 500 <= r.doc_id < 700]
    wrong = sum(r.kept == (r.doc_id % 5 == 0) for r in held)
    assert len(held) == 200 and wrong <= 2
    assert sum((r.low_quality >= 0.5) != (r.doc_id % 3 == 0) for r in held) <= 4
    # a later model leans on the earlier ones
    assert sum((r.severe >= 0.5) != (r.doc_id % 15 == 0) for r in held) <= 12
    assert sorted(r.kept for r in got if r.doc_id is None) == [False, True]
    assert all(r.kept for r in got if r.doc_id in (800, 801))
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)


def test_toxicity_without_rows_or_labels(spark, odd_docs, no_docs, toxic_docs):
    _, labels = toxic_docs
    assert toxicity(no_docs, labels).count() == 0
    out = toxicity(odd_docs, labels.where(F.lit(False))).collect()
    assert len(out) == odd_docs.count() and all(r.kept and r.toxic is None for r in out)
    one_class = spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert all(r.kept for r in toxicity(odd_docs, one_class).collect())
    assert fit_chain(odd_docs, labels.where(F.lit(False))).score("x") == [None, None, None]
    assert features_of("Ärger, ÄRGER running") == {"ärger", "running", "^runni"}


def mix_docs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        source = "hot" if i % 3 else f"s{rng.randint(0, 4)}"
        text = prose(i, rng.randint(1, 60)) + rng.choice(["", "", " x@y.zz", " = 4"])
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source))
    return make_docs(spark, rows)


def test_mixing_meets_its_targets(spark):
    docs = mix_docs(spark)
    goal = spark.createDataFrame([("hot", 0.4)] + [(f"s{k}", 0.12) for k in range(5)], "source string, share double")
    out = mixed(docs, targets={"source": goal}, power=0.5).collect()
    assert len(out) == 1500 and max(r.probability for r in out) == 1.0
    expected, actual = defaultdict(float), defaultdict(float)
    for r in out:
        for dim in ("source", "lang", "topic"):
            expected[dim, r[dim]] += r.n_tokens * r.probability
            actual[dim, r[dim]] += r.n_tokens
    total = sum(r.n_tokens * r.probability for r in out)
    assert abs(expected["source", "hot"] / total - 0.4) < 1e-3
    assert all(abs(expected["source", f"s{k}"] / total - 0.12) < 1e-3 for k in range(5))
    for dim in ("lang", "topic"):
        power = {k: v**0.5 for k, v in actual.items() if k[0] == dim}
        for k, v in power.items():
            assert abs(expected[k] / total - v / sum(power.values())) < 1e-3
    for r in out:
        u = int(hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.kept == (u < r.probability) or abs(u - r.probability) < 1e-6
    kept = sum(r.n_tokens for r in out if r.kept)
    assert abs(kept / total - 1) < 0.1


def test_mixing_edges(spark, odd_docs, odd_rows, no_docs):
    out = mixed(odd_docs).collect()
    assert len(out) == len(odd_rows) and all(r.kept for r in out if r.n_tokens == 0 and r.topic == "empty")
    assert mixed(no_docs).count() == 0 and sample_mixture(no_docs).count() == 0
    left = sample_mixture(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == sum(r.kept for r in out)
    capped = mixed(odd_docs, budget=10**9).collect()
    assert all(r.kept and r.probability == 1.0 for r in capped)
    u = spark.range(2000).select(chance(F.col("id"), 3).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.03 and 0 <= u[1] < u[2] < 1


def test_pipeline_stages(spark, tmp_path, toxic_docs):
    docs, labels = toxic_docs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    copies = docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 2000)
    near = docs.where("doc_id between 41 and 60").select(
        (F.col("doc_id") + 3000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"), "lang", "source", "n_chars"
    )
    docs.select(columns).union(copies.select(columns)).union(near).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in now.collect()}
    bad = {i for i in range(700) if i % 5 == 0}
    assert len(bad & kept["toxicity"]) <= 2
    assert len({i for i in range(700)} - bad - kept["toxicity"]) <= 2
    assert not {i for i in range(40)} & kept["exact dedup"]
    assert {i + 2000 for i in range(40) if i % 5} <= kept["exact dedup"]
    assert not {i + 3000 for i in range(41, 61)} & kept["near dedup"]
    assert kept["mixing"] <= kept["near dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept["mixing"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == kept["mixing"]


def test_pipeline_on_empty_tables(spark, tmp_path, no_docs):
    no_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
