from __future__ import annotations

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from adcorpus.operators import frontier as fr
from adcorpus.plans.ingest import ingest, ingest_step, prune
from adcorpus.sources.readers import read_results
from adcorpus.streaming.ingest import checkpoint_folder, stream_ingest

LISTED = "source string, pos bigint, url string"
RESULTS = "source string, url string, raw_response string"
PAGE = "<title>{0}</title><h1>Job {0}</h1><p>Text of {0}</p>"


def urls(df):
    return sorted(r.url for r in df.collect())


def listing(spark, text, source="s"):
    return spark.createDataFrame([(source, i, u) for i, u in enumerate(text)], LISTED)


def results(spark, *rows):
    return spark.createDataFrame([(s, u, raw) for s, u, raw in rows], RESULTS)


def test_duplicates_keep_the_first_position(spark):
    got = fr.distinct_urls(listing(spark, "abab")).collect()
    assert sorted((r.url, r.pos) for r in got) == [("a", 0), ("b", 1)]


def test_stale_and_pending(spark):
    listed = listing(spark, "abc")
    old = results(
        spark, ("s", "a", None), ("s", "x", None), ("s", None, '{"url": "b"}'), ("s", None, "text"),
        ("other", "c", None),
    )
    stale = fr.stale_results(old, listed)
    assert sorted((r.source, r.url, r.raw_response) for r in stale.collect() if r.url) == [
        ("other", "c", None), ("s", "x", None),
    ]
    assert [r.raw_response for r in stale.collect() if not r.url] == ["text"]
    kept = fr.keep_listed(old, listed)
    assert urls(fr.pending_urls(listed, fr.done_urls(kept))) == ["c"]
    state = {r.url: (r.listed, r.done) for r in fr.url_state(listed, old).collect() if r.source == "s"}
    assert state == {"a": (True, True), "b": (True, True), "c": (True, False), "x": (False, True)}


def test_progress(spark):
    listed = listing(spark, "abcd").unionByName(listing(spark, "ab", "t"))
    done = spark.createDataFrame([("s", u) for u in "abcd"], "source string, url string")
    got = {r.source: r for r in fr.frontier_progress(listed, done).collect()}
    assert got["s"].complete and not got["t"].complete
    assert (got["t"].n_required, got["t"].n_remaining) == (2, 2)
    half = {r.source: r for r in fr.frontier_progress(listed, done, 50).collect()}
    assert (half["t"].n_required, half["s"].n_remaining) == (1, 0)
    assert fr.frontier_progress(listed.limit(0), done).count() == 0
    state = fr.url_state(listed, done.withColumn("raw_response", F.lit(None).cast("string")))
    assert {tuple(r) for r in fr.state_progress(state, 50).collect()} == {
        tuple(r) for r in half.values()
    }


def test_quota_counts_successes_only(spark):
    remaining = spark.createDataFrame([("s", 2)], "source string, n_remaining bigint")
    got = fr.quota_take(listing(spark, "abcd"), remaining, success=F.col("url") != "a")
    assert urls(got) == ["b", "c"]


def test_quota_over_many_buckets_matches_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for source, n in (("hot", 900), ("cold", 7), ("empty", 4)):
        rows += [(source, p, f"{source}{p}") for p in rng.sample(range(100_000), n)]
    rng.shuffle(rows)
    left = {"hot": 333, "cold": 100, "empty": 0}
    remaining = spark.createDataFrame(list(left.items()), "source string, n_remaining bigint")
    pending = spark.createDataFrame(rows, LISTED).repartition(5)
    want = sorted(
        u for s in left for _, _, u in sorted(r for r in rows if r[0] == s)[: left[s]]
    )
    for bucket in (1, 64, 1_000_000):
        assert urls(fr.quota_take(pending, remaining, bucket=bucket)) == want


def stored(spark, names, broken=()):
    rows = [(u, None if u in broken else PAGE.format(u)) for u in names]
    return spark.createDataFrame(rows, "url string, html string")


def test_ingest_step_skips_done_and_failed(spark):
    listed = listing(spark, "abcdef")
    kept, fresh = ingest_step(
        listed, results(spark, ("s", "a", None), ("s", "x", None)), stored(spark, "abcde", "b"), 50
    )
    assert urls(kept) == ["a"]
    assert urls(fresh) == ["c", "d"]
    record = {r.url: r.record for r in fresh.collect()}["c"]
    assert (record.job_title, record.url) == ("Job c", "c")


def test_running_ingest_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    listed = listing(spark, "aabcd")
    pages = stored(spark, "abc")
    for _ in range(2):
        ingest(spark, listed, pages, path)
        assert urls(read_results(spark, path)) == ["a", "b", "c"]
    ingest(spark, listed, stored(spark, "d"), path)
    assert urls(read_results(spark, path)) == ["a", "b", "c", "d"]
    prune(spark, listing(spark, "bd"), path, str(tmp_path / "pruned"))
    assert urls(read_results(spark, str(tmp_path / "pruned"))) == ["b", "d"]


def test_checkpoints_go_to_the_shared_folder():
    def session(settings):
        return SimpleNamespace(conf=settings)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(session({}), "x")
    assert checkpoint_folder(session({"spark.checkpoint.dir": "/shared/"}), "x") == "/shared/x"


def test_stream_ingest_resumes(spark, tmp_path):
    lists, path = tmp_path / "lists", str(tmp_path / "results")
    lists.mkdir()
    pages = stored(spark, ["u1", "u2", "u3", "u4"])

    def run():
        query = stream_ingest(spark, str(lists), pages, path, str(tmp_path / "checkpoint"), 50)
        query.awaitTermination()
        return sorted((r.source, r.url) for r in read_results(spark, path).collect())

    (lists / "links_a.txt").write_text("u2\n\n u1 \nu2\nu3\nu9\n", encoding="utf-8")
    first = run()
    assert first == [("links_a", "u1"), ("links_a", "u2")]
    assert run() == first
    (lists / "links_b.txt").write_text("u3\nu4\n", encoding="utf-8")
    assert run() == [*first, ("links_b", "u3")]
