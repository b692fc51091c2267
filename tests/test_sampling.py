from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from adcorpus.operators import sampling as smp


def key(seed, i):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16)


def frame(spark, partitions=3):
    rows = [(i, f"t{i}", ["hot", "hot", "b", "c"][i % 4] if i > 2 else "hot") for i in range(200)]
    rows += [(900, "x", ""), (901, "y", None)]
    return spark.createDataFrame(rows, "id int, text string, label string").repartition(partitions)


def test_one_per_label_is_the_smallest_key_whatever_the_partitioning(spark):
    rows = [r for r in frame(spark).collect() if r.label]
    want = {
        label: min((key(7, r.id), r.id) for r in rows if r.label == label)[1]
        for label in {r.label for r in rows}
    }
    for partitions in (1, 5):
        got = smp.one_per_label(frame(spark, partitions), "label", "id", "id", seed=7).collect()
        assert {r.label: r.id for r in got} == want
        assert all(r.text == f"t{r.id}" for r in got)


def test_first_labels_by_first_appearance(spark):
    got = smp.one_per_label(frame(spark), "label", "id", "id", max_labels=2).collect()
    rows = [r for r in frame(spark).collect() if r.label]
    firsts = sorted((min(r.id for r in rows if r.label == name), name) for name in {r.label for r in rows})
    assert sorted((r.first_pos, r.label) for r in got) == firsts[:2]


def test_equal_keys_fall_back_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(smp, "sample_key", lambda c, s: F.lit(1).cast("bigint"))
    got = smp.one_per_label(frame(spark), "label", "id", "id").collect()
    rows = [r for r in frame(spark).collect() if r.label]
    assert {r.label: r.id for r in got} == {
        name: min(r.id for r in rows if r.label == name) for name in {r.label for r in rows}
    }


def test_record_pairs_feed_the_samplers(spark):
    records = [
        (1, [("system", "s"), ("user", "u1"), ("assistant", "a")]),
        (2, [("user", "u2"), ("assistant", "b"), ("user", "u3")]),
        (3, [("user", "u"), ("assistant", "")]), (4, [("user", "u")]), (5, None),
    ]
    df = spark.createDataFrame(records, "id int, messages array<struct<role:string,content:string>>")
    pairs = smp.record_pairs(df, ["id"])
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, "u1", "a"), (2, "u3", "b")]
    chosen = smp.one_per_label(pairs, "category", "id", "id", max_labels=2)
    assert sorted((r.text, r.category) for r in chosen.collect()) == [("u1", "a"), ("u3", "b")]


def test_sample_k(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2).repartition(4)
    want = sorted(range(100), key=lambda i: (key(42, i), i))[:5]
    assert sorted(r.id for r in smp.sample_k(df, 5, "id").collect()) == sorted(want)
    assert smp.sample_k(df, 5, "id", seed=1).count() == 5
    assert smp.sample_k(df.limit(2), 3, "id").count() == 2
    assert smp.sample_k(df.limit(0), 3, "id").count() == 0
    plan = smp.sample_k(df, 5, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
