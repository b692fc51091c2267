"""Numbers by range, budgets by weight, answers asked once: against brute force, with hot keys."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from adcorpus.operators.conversations import conversation_budget, conversation_budget_with
from adcorpus.operators.inference import ANSWERS, generate_once
from adcorpus.operators.metrics import confusion_counts, label_universe
from adcorpus.operators.numbering import numbered, positions
from adcorpus.operators.topn import take_weight
from adcorpus.sources.scratch import shared_dir
from adcorpus.sources.snapshots import Snapshots


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "same prefix b", "same prefix c"]), rng.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = numbered(df, [F.col("g"), F.desc("v"), F.col("i")], ranges=9).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.number)] == want
    assert sorted(r.number for r in got) == list(range(3000))
    assert numbered(df.limit(0), [F.col("i")]).count() == 0


def test_a_hot_group_is_cut_into_ranges(spark):
    rows = [("hot" if i % 3 else f"g{i % 50}", i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    out = positions(df, ["g"], [F.col("v")], ranges=10)
    places = {(r.g, r.v): r.pos for r in out.collect()}
    seen = Counter()
    for g, v in sorted(rows, key=lambda r: r[1]):
        assert places[g, v] == seen[g]
        seen[g] += 1
    plain = numbered(df, [F.col("g"), F.col("v")], ranges=10)
    sizes = plain.groupBy(F.floor(F.col("number") / 4000)).count().collect()
    assert max(r["count"] for r in sizes) == 4000
    assert positions(df.limit(0), ["g"], [F.col("v")]).count() == 0


def test_labels_with_one_prefix_spread_over_ranges(spark):
    labels = [f"label {i:05d}" for i in range(2000)]
    rows = [(run, labels[i], labels[(i * 7) % 2000]) for run in ("r", None) for i in range(0, 2000, 3 if run else 1)]
    df = spark.createDataFrame(rows, "run string, truth string, pred string").repartition(4)
    got = label_universe(confusion_counts(df, "truth", "pred", ["run"]), ["run"]).collect()
    for run in ("r", None):
        known = sorted({x for r, *both in rows if r == run for x in both})
        assert {r.label: (r.pos, r.n_labels) for r in got if r.run == run} == {
            x: (i, len(known)) for i, x in enumerate(known, 1)
        }
    alone = label_universe(confusion_counts(df.where("run = 'r'"), "truth", "pred"))
    assert alone.count() == len({x for r, *both in rows if r for x in both})


def test_take_weight_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 20}", i, rng.choice([0, 1, 5, 40])) for i in rng.sample(range(100_000), 3000)]
    df = spark.createDataFrame(rows, "g string, at bigint, w bigint").repartition(6)
    want = set()
    sums = Counter()
    for g, at, w in sorted(rows, key=lambda r: r[1]):
        if w and sums[g] < 700:
            want.add((g, at, w, sums[g]))
        sums[g] += w
    for bucket in (1, 512, 10**6):
        assert {tuple(r) for r in take_weight(df, "g", "at", "w", 700, bucket).collect()} == want


def test_conversation_budget_with_a_tokenizer(spark):
    rng = random.Random(3)
    rows = [(900, t, rng.choice(["user", "assistant", None]), rng.choice(["", "é b", "x" * rng.randint(1, 30), None])) for t in range(900)]
    rows += [(c, t, "user", f"turn {t} of {c}") for c in range(60) for t in range(rng.randint(1, 9))]
    rows.append((61, None, "user", "no place"))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)

    def characters():
        return lambda texts, n: [(t[:n], len(t)) for t in texts]

    texts = {}
    for c, t, role, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[:2]):
        texts[c] = texts.get(c, "") + f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"
    for bucket in (4, 65_536):
        got = conversation_budget_with(df, characters, max_tokens=100, bucket=bucket).collect()
        assert {r.conv_id: (r.head, r.n_tokens, r.n_kept, r.truncated) for r in got} == {
            c: (t[:100], len(t), min(100, len(t)), len(t) > 100) for c, t in texts.items()
        }

    def words():
        return lambda texts, n: [(" ".join(t.split()[:n]), len(t.split())) for t in texts]

    mine = conversation_budget_with(df, words, max_tokens=40).select("conv_id", "n_tokens", "n_kept", "truncated")
    plain = conversation_budget(df.where("turn IS NOT NULL"), max_tokens=40).select("conv_id", "n_tokens", "n_kept", "truncated")
    assert {tuple(r) for r in mine.collect()} == {tuple(r) for r in plain.collect()}


def test_generate_once_asks_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = [(i, f"p{i % 7}" if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, prompt string").repartition(4)

    def build():
        return lambda prompts: [f"{p}!" for p in prompts]

    def other():
        return lambda prompts: [f"{p}?" for p in prompts]

    def refuse():
        raise AssertionError("nothing is to be asked")

    generate_once(df.where("prompt = 'p1'"), build, path, "r").collect()
    got = {r.i: r.generated_text for r in generate_once(df, other, path, "r", commits=3).collect()}
    assert got == {i: None if p is None else p + ("!" if p == "p1" else "?") for i, p in rows}
    again = {r.i: r.generated_text for r in generate_once(df, refuse, path, "r").collect()}
    assert again == got
    assert Snapshots(spark, path).read("answers", ANSWERS).count() == 7
    assert {r.generated_text for r in generate_once(df.where("prompt = 'p1'"), other, path, "s").collect()} == {"p1?"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf(dict):
        pass

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("C", (), {"master": master, "applicationId": f"app {master}"})()

    assert shared_dir(Session("yarn", **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    local = Session("local[2]")
    assert shared_dir(local) == shared_dir(local)
    for master in ("yarn", "local-cluster[2,1,1024]"):
        try:
            shared_dir(Session(master))
        except ValueError as error:
            assert "spark.checkpoint.dir" in str(error)
        else:
            raise AssertionError(master)
