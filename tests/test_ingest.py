"""The snapshot store, the ingest with a model, and lists that come in batches."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adcorpus.functions import postings as po
from adcorpus.operators import pages as pg
from adcorpus.operators.answers import LEDGER, attempts_at
from adcorpus.plans.ingest import (
    add_lists, answer_ingest, bodies_of, ingest, listed_so_far, prune, select_urls, stored_once,
)
from adcorpus.sources.bucketed import drop_declaration, read_bucketed, write_bucketed
from adcorpus.sources.readers import read_results
from adcorpus.sources.snapshots import Snapshots
from adcorpus.streaming.ingest import stream_ingest

LISTED = "source string, pos bigint, url string"
ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def listing(spark, urls, source="s"):
    return spark.createDataFrame([(source, i, u) for i, u in enumerate(urls)], LISTED)


def pages(spark, urls, body="<h1>Job {}</h1>"):
    return spark.createDataFrame([(u, body.format(u)) for u in urls], "url string, html string").repartition(3)


def urls(df):
    return sorted(r.url for r in df.collect())


def test_snapshots_add_remove_and_replace(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    assert not store.exists() and store.read("t", ROW).count() == 0

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), ROW)

    def keys(*names):
        return spark.createDataFrame([(n,) for n in names], "k string")

    def seen():
        return sorted(tuple(r) for r in store.visible("t", ROW, ["k"]).collect())

    store.commit(1, {"t": [store.stage(rows(("a", 1), ("b", 2)), "t", 1)]})
    lost = store.stage(rows(("z", 9)), "t", 2)
    assert seen() == [("a", 1), ("b", 2)]
    store.commit(2, {"t": [store.stage(rows(("a", 3)), "t", 2)], "t_removed": [store.stage(keys("a"), "t_removed", 2)]})
    assert seen() == [("a", 3), ("b", 2)]
    with pytest.raises(RuntimeError, match="version 2 is taken"):
        store.commit(2, {"t": [lost]})
    store.commit(3, {"t_removed": [store.stage(keys("b"), "t_removed", 3)]})
    assert seen() == [("a", 3)]
    store.compact("t", ROW, ["k"])
    assert seen() == [("a", 3)] and store.read("t", ROW).count() == 1
    # a writer that is lost before its last line has committed nothing
    (tmp_path / "store" / "_manifests" / "000000000005.json").write_text('{"t": []')
    assert seen() == [("a", 3)] and store.next_version() == 6
    store.commit(6, {"t": [store.stage(rows(("c", 4)), "t", 6)]})
    assert seen() == [("a", 3), ("c", 4)]


def test_ingest_prunes_and_adds_in_one_commit(spark, tmp_path):
    path = str(tmp_path / "results")
    ingest(spark, listing(spark, "abc"), pages(spark, "abcd"), path)
    assert urls(read_results(spark, path)) == ["a", "b", "c"]
    ingest(spark, listing(spark, "bd"), pages(spark, "abcd"), path)
    assert urls(read_results(spark, path)) == ["b", "d"]
    ingest(spark, listing(spark, "abd"), pages(spark, "abcd"), path)
    assert urls(read_results(spark, path)) == ["a", "b", "d"]
    prune(spark, listing(spark, "d"), path)
    assert urls(read_results(spark, path)) == ["d"]


def test_one_result_per_url(spark, tmp_path):
    rows = [("a", "<h1>old</h1>", 1), ("a", "<h1>new</h1>", 2), ("a", None, 3), ("b", "<h1>b</h1>", 1), ("b", "<h1>b</h1>", 1)]
    stored = spark.createDataFrame(rows, "url string, html string, at int")
    ingest(spark, listing(spark, "ab"), stored, str(tmp_path / "one"), newest_by="at")
    got = read_results(spark, str(tmp_path / "one"))
    assert {r.record.job_title for r in got.where("url = 'a'").collect()} == {"new"}
    ingest(spark, listing(spark, "ab"), stored.drop("at"), str(tmp_path / "two"))
    got = read_results(spark, str(tmp_path / "two")).collect()
    assert sorted(r.url for r in got) == ["a", "b"]
    assert stored_once(stored).count() == 2


def test_choosing_urls_reads_no_bodies(spark, tmp_path):
    rows = [(f"u{i}", f"<h1>{i}</h1>" if i % 3 else None, i, bool(i % 3)) for i in range(12)]
    spark.createDataFrame(rows, "url string, html string, page_id int, ok boolean").write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    listed = listing(spark, [u for u, *_ in rows])
    empty = read_results(spark, str(tmp_path / "none"))
    taken = select_urls(listed, empty, stored, 50, "page_id", fetched="ok")
    assert "html" not in taken._jdf.queryExecution().executedPlan().toString()
    assert urls(taken) == sorted([u for u, h, *_ in rows if h][:6])
    ingest(spark, listed, stored, str(tmp_path / "out"), 50, "page_id", "ok")
    assert urls(read_results(spark, str(tmp_path / "out"))) == urls(taken)


def test_bodies_in_buckets_are_not_exchanged(spark, tmp_path):
    path = str(tmp_path / "pages")
    all_pages = pages(spark, [f"u{i}" for i in range(200)])
    write_bucketed(all_pages, path, buckets=4)
    drop_declaration(spark, [path])
    stored = read_bucketed(spark, path, all_pages.schema, buckets=4)
    assert stored.count() == 200
    listed = listing(spark, [f"u{i}" for i in range(0, 300, 3)])
    empty = read_results(spark, str(tmp_path / "none"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bodies = bodies_of(select_urls(listed, empty, stored), stored)
        got = bodies.collect()
        plan = bodies._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        drop_declaration(spark, [path])
    assert sorted(r.url for r in got) == sorted(f"u{i}" for i in range(0, 200, 3))
    final = plan.split("Initial Plan")[0]
    exchanges = [line for line in final.splitlines() if "Exchange" in line]
    assert exchanges and not any("html" in line for line in exchanges)
    # every exchange lies above the keys; the scan that reads the bodies has none over it but the join
    scans = [line for line in final.splitlines() if "FileScan" in line and "html" in line]
    assert any("Bucketed: true" in line for line in scans)


def test_attempts():
    calls = []

    def model(prompts):
        calls.append(list(prompts))
        if "boom" in prompts:
            raise ValueError("cannot")
        return [None if p.startswith("never") or calls.count([p]) < 1 and p == "later" else p.upper() for p in prompts]

    got = attempts_at(model, ["a", "never", "later", "b", "boom"], 3, 3)
    outcomes = [[(t["attempt"], t["outcome"], t["answer"]) for t in tries] for tries in got]
    assert outcomes[0] == [(1, "answered", "A")]
    assert outcomes[1] == [(k, "failed", None) for k in (1, 2, 3)]
    assert outcomes[2][0][1] == "failed" and outcomes[2][-1][1:] == ("answered", "LATER")
    assert outcomes[3][-1] == (2, "answered", "B") and got[3][0]["error"] == "ValueError: cannot"
    assert outcomes[4] == [(k, "failed", None) for k in (1, 2, 3)]
    assert attempts_at(model, [], 3, 2) == []
    assert [len(t) for t in attempts_at(lambda p: [], ["x"], 2, 2)] == [2]


def model_of(fails, raw=()):
    def build():
        def answer(prompts):
            out = []
            for p in prompts:
                name = p.rsplit("Job ", 1)[1]
                body = f"about {name}" if name in raw else f'```json\n{{"job_title": "T {name}", "url": "x"}}\n```'
                out.append(None if name in fails else body)
            return out

        return answer

    return build


def sequential(listed, fetched, fails, percent, done=()):
    """One URL after another, as many successes as the quota asks for."""
    required = int(len(set(listed)) * percent / 100)
    found, asked = [u for u in dict.fromkeys(listed) if u in done], []
    for u in dict.fromkeys(listed):
        if len(found) >= required:
            break
        if u in found or u not in fetched:
            continue
        asked.append(u)
        if u not in fails:
            found.append(u)
    return sorted(found), sorted(asked)


def test_answers_are_the_first_successes_in_list_order(spark, tmp_path):
    rng = random.Random(4)
    for case in range(3):
        path = str(tmp_path / f"run{case}")
        names = [f"u{i:02d}" for i in range(40)]
        listed = [rng.choice(names) for _ in range(50)]
        fetched = set(rng.sample(names, 34))
        fails = set(rng.sample(names, (4, 12, 40)[case]))
        answer_ingest(spark, listing(spark, listed), pages(spark, sorted(fetched)), model_of(fails, {"u03"}), path, 60)
        found, asked = sequential(listed, fetched, fails, 60)
        results = read_results(spark, path).collect()
        assert sorted(r.url for r in results) == found
        ledger = Snapshots(spark, path).read("ledger", LEDGER).collect()
        assert sorted({r.url for r in ledger}) == asked
        tries = {u: sorted(r.attempt for r in ledger if r.url == u) for u in asked}
        assert tries == {u: [1, 2, 3] if u in fails else [1] for u in asked}
        for r in results:
            if r.url == "u03":
                assert r.record is None and r.raw_response == "about u03"
            else:
                assert (r.record.job_title, r.record.url) == (f"T {r.url}", r.url)


def test_a_second_run_goes_on_and_gives_up(spark, tmp_path):
    path, listed = str(tmp_path / "store"), listing(spark, "abcdef")
    stored = pages(spark, "abcdef")
    assert answer_ingest(spark, listed, stored, model_of("ab"), path, 50) == 2
    assert urls(read_results(spark, path)) == ["c", "d", "e"]

    def refuse():
        raise AssertionError("nothing is to be asked")

    assert answer_ingest(spark, listed, stored, refuse, path, 50) == 1
    # a full quota asks for the failed ones again, but not for what failed too often
    answer_ingest(spark, listed, stored, model_of("a"), path, 100, give_up_after=4)
    assert urls(read_results(spark, path)) == ["b", "c", "d", "e", "f"]
    answer_ingest(spark, listed, stored, refuse, path, 100, give_up_after=4)
    answer_ingest(spark, listing(spark, "af"), stored, model_of(""), path, 100)
    assert urls(read_results(spark, path)) == ["a", "f"]


def test_batches_of_lists_are_one_list(spark, tmp_path):
    path = str(tmp_path / "store")

    def lines(names, file):
        rows = [("s", file, i, u) for i, u in enumerate(names)]
        return spark.createDataFrame(rows, "source string, file string, pos bigint, url string").repartition(2)

    stored = pages(spark, "abcdefgh")
    for batch, names in (("1", "hgf"), ("2", "edc"), ("1", "hgf"), ("3", "ba")):
        add_lists(spark, lines(names, batch), batch, path)
        ingest(spark, listed_so_far(spark, path), stored, path, percent=50)
    got = sorted((r.pos, r.url) for r in listed_so_far(spark, path).collect())
    assert got == list(enumerate("hgfedcba"))
    whole = str(tmp_path / "whole")
    ingest(spark, listing(spark, "hgfedcba"), stored, whole, percent=50)
    assert urls(read_results(spark, path)) == urls(read_results(spark, whole)) == ["e", "f", "g", "h"]


def test_stream_of_lists_equals_one_batch(spark, tmp_path):
    lists, path = tmp_path / "lists", str(tmp_path / "results")
    lists.mkdir()
    stored = pages(spark, [f"u{i}" for i in range(12)])

    def run():
        stream_ingest(
            spark, str(lists), stored, path, str(tmp_path / "checkpoint"), 50, model_of({"u1"})
        ).awaitTermination()
        return urls(read_results(spark, path))

    (lists / "a.txt").write_text("u0\nu1\nu2\nu3\n", encoding="utf-8")
    assert run() == ["u0", "u2"]
    other = tmp_path / "more"
    other.mkdir()
    (other / "a.txt").write_text("u4\nu5\n", encoding="utf-8")
    (other / "a.txt").rename(lists / "a.part2")
    # six are listed now, so three are asked for; u1 fails again and uses no quota
    assert run() == ["u0", "u2", "u3"]
    assert run() == ["u0", "u2", "u3"]


SCRIPT = """<html><script type="application/ld+json">{"@context": "https://schema.org", "@graph": [
{"@type": "WebSite", "name": "n"}, {"@type": ["JobPosting"], "title": "K&amp;S", "hiringOrganization": "ABC",
"jobLocation": {"address": {"addressRegion": "Hà Nội", "addressCountry": {"name": "VN"}}},
"baseSalary": {"currency": "VND", "value": "12 triệu"}, "skills": "Java, SQL; Go", "jobBenefits": ["a", " ", "b"],
"experienceRequirements": {"monthsOfExperience": 18}, "description": "<p>One</p><ul><li>two</li></ul>"}]}</script>
<dl><dt>Deadline</dt><dd><b>2025</b>-08-01</dd><dt>Kỹ năng mềm:</dt><dd><ul><li>x<li>y</ul></dd></dl>
<table><tr><td>Posted<td>never closed</table>"""


def test_postings_and_pairs(spark):
    broken = '<script type="application/ld+json">{"@type": "JobPosting", "title": </script><h1>H</h1>'
    rows = [("u1", SCRIPT), ("u2", broken), ("u3", "<dl><dt>Salary</dt><dd></dd></dl>")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.record.url: r.record for r in pg.page_fields(df).collect()}
    one = got["u1"]
    assert (one.job_title, one.company_name, one.location, one.country) == ("K&S", "ABC", "Hà Nội", "VN")
    assert (one.experience_required, one.technical_skills, one.benefits) == (1.5, ["Java", "SQL", "Go"], ["a", "b"])
    assert (one.deadline, one.soft_skills, one.description) == ("2025-08-01", ["x", "y"], "One ; two")
    assert one.posting_date is None and one.salary == "12 triệu VND"
    assert got["u2"].job_title == "H" and got["u3"].salary is None


@pytest.mark.parametrize(
    "unit", ["<title>", "<title", "<dt>", "<dt>x", "<dt>x</dt>", "<tr><td>", "<td ", '<script type="ld+json">', "<script ", "<dt><b>"],
)
def test_markup_of_a_megabyte_takes_linear_time(spark, unit):
    df = spark.createDataFrame([("u", unit * (1_000_000 // len(unit)) + "ld+json")], "url string, html string")
    start = time.perf_counter()
    pg.page_fields(df).select(F.length("record.job_title")).collect()
    assert time.perf_counter() - start < 8


def test_repeated_keys_and_long_json(spark):
    big = '{"job_title": "a", "job_title": "b", "url": "u", "description": "' + "x" * 25_000_000 + '"}'
    df = spark.createDataFrame([(big,), ('{"job_title": 3, "benefits": "a"}',)], "j string")
    rows = [r for r in pg.typed_parse(df, "j").select("record.job_title", F.length("record.description").alias("n"), "record.benefits").collect()]
    assert [tuple(r) for r in rows] == [("a", 25_000_000, None), ("3", None, None)]
    assert po.POSTING_PROPERTIES.keys() <= set(pg.JOB_AD.names)
