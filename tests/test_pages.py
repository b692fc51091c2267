from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from adcorpus.functions import postings as po
from adcorpus.functions.html import with_markdown
from adcorpus.operators import pages as pg
from adcorpus.plans.catalog import QUERIES
from adcorpus.sources.schemas import JOB_AD


def markdown(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r.markdown for r in with_markdown(df).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, None),
        ("", ""),
        ("<p>a</p><p>b<br>c", "a\n\nb\nc"),
        ("<h1>A</h1>x<H3 class=q> B </H3>", "# A\n\nx\n\n### B"),
        ("<ul><li>a</li><LI>b</ul>", "* a\n* b"),
        ('<a class="x" href="/u?a=1">t <i>i</i></a>', "[t _i_](/u?a=1)"),
        ("<a href=/u>t</a> <a name=n>plain</a>", "[t](/u) plain"),
        ("<a href=/1>x <a href='/2'>y</a> z</a>", "x [y](/2) z"),
        ("<b>x</b> <strong> y z </strong> <b>open", "**x** **y z** open"),
        ("<script>if (a<b) '</p>'</script>a<style>p{}</style><!-- <p>no</p> -->b", "ab"),
        ("<script>never closed <p>x</p>", ""),
        ("<head><title>T</title><meta x></head><body>x</body>", "x"),
        ("a &lt;b&gt; &amp;amp; &quot;q&quot; &copy; &euro;5 &hellip;", 'a <b> &amp; "q" © €5 …'),
        ("&#8217;&#x2019;&#65;&#0;&#99999999;&#x110000; &# &#x;", "’’A��� &# &#x;"),
        ("&#00000000065;&#x0000000041;&#000;&#65", "AA�&#65"),
        ("<title>a <b>x</b>", "**x**"),
        ("<p <p>x</p <br>y", "<p\n\nx</p\ny"),
        ("a < b and c > d", "a < b and c > d"),
        ("  a \n\t b  <br>  c  ", "a b\nc"),
        ("<p>Đ</p>\n\n\n<div><div>x</div></div>", "Đ\n\nx"),
    ],
)
def test_markdown(spark, html, want):
    assert markdown(spark, html) == [want]


def test_whole_pages_are_converted(spark):
    body = "".join(f"<p>line {i} <b>x</b></p>" for i in range(5000))
    assert markdown(spark, body)[0].count("**x**") == 5000


def test_unclosed_links_take_linear_time(spark):
    text = markdown(spark, "<a href=/u>word " * 50_000)[0]
    assert text == ("word " * 50_000).strip()


@pytest.mark.parametrize(
    "unit",
    [
        "<a href=", "<a href=x ", "<a ", " href=", "<p ", "<title>", "<title", "<script>", "<style ", "<!--", "<b>",
        "<b> ", "<li ", "<h1 ", "<", "< ", "&nbsp;", "&#", "&#0", "\x03", "\x04", "<a href=/u>", "</script ", "\n ",
    ],
)
def test_broken_pages_of_a_megabyte_take_linear_time(spark, unit):
    page = ("<a " if unit.startswith(" href") else "") + unit * (1_000_000 // len(unit))
    df = spark.createDataFrame([(page,)], "html string")
    start = time.perf_counter()
    with_markdown(df).select(F.length("markdown")).collect()
    assert time.perf_counter() - start < 5


def test_page_fields(spark):
    html = (
        "<title>T</title><h1>Kỹ sư</h1><p><b>CÔNG TY:</b> ABC<br>Salary: 10 - 15 triệu<br>"
        "Kinh nghiệm: 2.5 năm</p><p>Benefits: a, b ; c</p>"
    )
    rows = [("https://x/1", html), ("https://x/2", "<title> Only </title>"), ("https://x/3", None)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.record.url: r.record for r in pg.page_fields(df).collect()}
    assert set(got) == {"https://x/1", "https://x/2"}
    one, two = got["https://x/1"], got["https://x/2"]
    assert (one.job_title, one.company_name, one.salary) == ("Kỹ sư", "ABC", "10 - 15 triệu")
    assert (one.experience_required, one.benefits) == (2.5, ["a", "b", "c"])
    assert one.deadline is None and one.technical_skills is None
    assert (two.job_title, two.description) == ("Only", None)
    assert [f.dataType for f in pg.page_fields(df).schema["record"].dataType] == [
        f.dataType for f in JOB_AD
    ]


def test_extraction_prompt(spark):
    df = spark.createDataFrame([("md",), (None,)], "m string")
    got = [r.p for r in df.select(pg.extraction_prompt(F.col("m")).alias("p")).collect()]
    assert got[1] is None
    head, page = got[0].split("\n\nPage content:\n")
    assert page == "md"
    assert head.endswith("\nReturn only a valid JSON object.")
    schema = json.loads(head[head.index("{"): head.rindex("}") + 1])
    assert schema["required"] == ["job_title", "url", "description"]
    assert schema["properties"]["experience_required"] == {
        "anyOf": [{"type": "number"}, {"type": "null"}], "default": None, "title": "Experience Required",
        "description": "Number of years of experience required",
    }
    assert schema["properties"]["url"]["format"] == "uri" and schema["properties"]["url"]["type"] == "string"
    assert all("description" in p for p in schema["properties"].values())
    assert list(schema["properties"]) == JOB_AD.names
    own = df.select(pg.extraction_prompt(F.col("m"), "Do it.").alias("p")).first().p
    assert own == "Do it.\n\nPage content:\nmd"


def fenced(body):
    return f"Here:\n```json\n{body}\n```\nbye"


def test_record_or_raw(spark):
    answers = [
        fenced('{"job_title": "a", "url": "wrong", "experience_required": "2"}'),
        "no fence", fenced("{bad"), fenced('[{"job_title": "a"}]'), fenced("{'job_title': 'a'}"),
        fenced('{"job_title": "a"} tail'), None,
    ]
    df = spark.createDataFrame([(i, f"u{i}", a) for i, a in enumerate(answers)], "i int, url string, a string")
    got = pg.record_or_raw(df, "a", ["i"]).orderBy("i").collect()
    assert (got[0].record.job_title, got[0].record.url) == ("a", "u0")
    assert got[0].record.experience_required == 2.0 and got[0].raw_response is None
    for r in got[1:]:
        assert r.record is None and r.raw_response == answers[r.i] and r.url == f"u{r.i}"


def test_typed_parse_and_quarantine(spark):
    good = {"job_title": "t", "url": "https://e.x/1", "description": "d"}
    texts = [
        json.dumps({**good, "benefits": ["a"], "experience_required": 3}),
        json.dumps({**good, "experience_required": "2.5"}),
        json.dumps({**good, "experience_required": "two"}),
        json.dumps({**good, "job_title": " "}),
        json.dumps({**good, "url": "ftp://e.x"}),
        json.dumps({"job_title": "t"}),
        "{bad",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    parsed = pg.typed_parse(df, "j", ["i"])
    problems = {r.i: r.problems for r in parsed.collect()}
    assert problems == {
        0: [], 1: [], 2: ["number:experience_required"], 3: ["missing:job_title"], 4: ["url"],
        5: ["missing:url", "missing:description"], 6: ["malformed"], 7: ["malformed"],
    }
    valid, quarantine = pg.split_valid(parsed)
    assert sorted(r.i for r in valid.collect()) == [0, 1]
    assert {r.i: r.text for r in quarantine.collect()}[6] == "{bad"
    assert {r.i: r.record.experience_required for r in valid.collect()} == {0: 3.0, 1: 2.5}


def test_posting_pages_are_dealt_over_all_cores_and_read_once(spark, tmp_path):
    rows = [(i, f"n{i}", "b", "PROMO" if i % 2 else "SMALL", i % 50, 1.0) for i in [*range(40), 3, 3]] + [(None,) * 6]
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = QUERIES["posting_fields"](spark, str(tmp_path))
    # one row group was one task
    used = df.select(F.spark_partition_id().alias("task")).distinct().count()
    assert used == spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # 403 and 145 when each field had its own copies
    assert plan.count("get_json_object") < 60 and plan.count("regexp_replace") < 60
    got = {r.p_partkey: r for r in df.collect()}
    assert df.count() == 42 and set(got) == {*range(40)}
    one = got[3]
    assert (one.job_title, one.salary, one.experience_required) == ("n3", "3 - 10 VND/MONTH", 3.0)
    assert one.technical_skills == "Python|n3|SQL" and one.url == "https://jobs.example/3"


def test_short_cuts_keep_what_the_long_way_gives(spark):
    texts = ["a b", "a  b", " a", "a;", ";a", "a\tb", "a&amp;b", "<i>a</i>", "", "a;b", "Ê", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(po.plain(F.col("t")).alias("p")).collect()]
    assert got == ["a b", "a b", "a", "a", "a", "a b", "a&b", "a", None, "a;b", "Ê", None]
    pages = ["<TD>a</TD><td x=1>b</td>", "<li> a<LI> b", "<p", "<b/>a</b>", "a<span", "<h2 id=x> a\t\r\n b</h2 >"]
    assert markdown(spark, *pages) == ["ab", "* a\n* b", "<p", "**a**", "a<span", "## a b"]
    html = "<dl><dt>CÔNG TY</dt><dd>A</dd><dt>:</dt><dd>x</dd><dt>Salary :</dt><dd>Σ</dd></dl>"
    pairs = spark.createDataFrame([(html,), ("<td>",)], "h string").select(po.stated_pairs(F.col("h")).alias("p")).collect()
    assert [[tuple(x) for x in r.p] for r in pairs] == [[("công ty", "A"), ("salary", "Σ")], []]
