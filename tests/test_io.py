from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from adcorpus.functions.chat import chat_record
from adcorpus.operators.inference import batch_generate, token_budget_with
from adcorpus.operators.labels import label_vocabulary
from adcorpus.operators.profile import corpus_profile, counted, label_distribution
from adcorpus.plans.formatting import format_splits, write_splits
from adcorpus.sources import readers, writers
from adcorpus.sources.schemas import ADS, ADS_ALTERNATE


def test_ads_csv_with_multi_line_cells(spark, tmp_path):
    header = ",".join(ADS.names)
    cells = ["t"] * 18
    cells[12] = '"line 1\nline ""2"", x"'
    (tmp_path / "ads.csv").write_text(f"{header}\n{','.join(cells)}\n{','.join(['u'] + [''] * 17)}\n", encoding="utf-8")
    rows = readers.read_ads(spark, str(tmp_path / "ads.csv")).orderBy("job_title").collect()
    assert len(rows) == 2 and rows[0].description == 'line 1\nline "2", x'
    assert rows[1].description is None
    alternate = tmp_path / "alt.csv"
    alternate.write_text(
        "salary_avg,city,extra,job_title,job_type,experience\n5,c,e,a,b,d\n", encoding="utf-8"
    )
    row = readers.read_ads(spark, str(alternate), ADS_ALTERNATE).first()
    assert tuple(row) == ("a", "b", "c", "d", "5")
    with pytest.raises(ValueError, match="salary_min"):
        readers.read_ads(spark, str(alternate))


def test_files_with_another_header_fail(spark, tmp_path):
    for name, text in (("a", "x,y\n1,2\n"), ("b", "y,x\n3,4\n")):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv_by_header(spark, str(tmp_path / "*.csv")).collect()


def test_labelled_texts_with_byte_order_mark_and_fallback(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(
        "text,description,category\n a ,d, IT \n,x,it\n\" \",x,it\n,,it\nb,,\n", encoding="utf-8-sig"
    )
    got = readers.read_labelled_texts(spark, str(path)).collect()
    assert sorted((r.text, r.category) for r in got) == [("a", "it"), ("x", "it")]
    only = tmp_path / "g.csv"
    only.write_text("description,category\nd,it\n", encoding="utf-8-sig")
    assert [tuple(r) for r in readers.read_labelled_texts(spark, str(only)).collect()] == [("d", "it")]


def test_exemplars_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "q"\nb', "5 triệu"), ("c", " "), ("", "1")], "text string, salary string")
    writers.write_exemplars(df, str(tmp_path / "e"))
    got = readers.read_salary_exemplars(spark, str(tmp_path / "e")).collect()
    assert [tuple(r) for r in got] == [('a "q"\nb', "5 triệu")]
    raw = readers.read_csv_by_header(spark, str(tmp_path / "e"))
    assert sorted(r.salary or "" for r in raw.collect()) == [" ", "1", "5 triệu"]


def test_chat_round_trip(spark, tmp_path):
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.lit("thoả thuận").alias("content")))
    df = spark.range(2).select(chat_record(msgs).alias("r")).select("r.*")
    writers.write_chat(df, str(tmp_path / "c"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "c").glob("*.json"))
    assert "thoả thuận" in text and "expected" not in text
    assert readers.read_chat(spark, str(tmp_path / "c")).count() == 2
    array = tmp_path / "array.json"
    array.write_text(json.dumps([json.loads(line) for line in text.splitlines()], indent=4, ensure_ascii=False), encoding="utf-8")
    got = readers.read_chat(spark, str(array), lines=False).collect()
    assert len(got) == 2 and got[0].messages[0].content == "thoả thuận"


def test_url_lists_keep_line_order_over_splits(spark, tmp_path):
    lines = [f"https://e.x/{i:07d}" for i in range(400_000)]
    (tmp_path / "links_a.txt").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "links_b.txt").write_text("z\n\n  y \n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = readers.read_url_lists(spark, str(tmp_path / "*.txt"))
        assert df.rdd.getNumPartitions() > 4
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.url for r in sorted((r for r in got if r.source == "links_b"), key=lambda r: r.pos)] == ["z", "y"]
    a = sorted((r for r in got if r.source == "links_a"), key=lambda r: r.pos)
    assert [r.url for r in a] == lines
    assert len({r.pos for r in a}) == len(lines)


def test_splits_are_written_as_partitions(spark, tmp_path):
    row = ("train", "x", "it", "t", "c", "l", "n", "1", "5")
    ads = spark.createDataFrame(
        [row, ("test", *row[1:])],
        "split string, description string, category string, job_title string,"
        " contract_type string, location string, country string, experience_required string,"
        " salary_avg string",
    )
    vocabulary = label_vocabulary(ads, "category", 100, 1000)
    write_splits(format_splits(ads, None, vocabulary), str(tmp_path / "out"))
    parts = {str(p.parent.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.json")}
    assert parts == {
        f"task={t}/variant=main/shots=zero/split={s}" for t in ("category", "salary") for s in ("train", "test")
    }
    assert readers.read_chat(spark, str(tmp_path / "out" / "task=salary")).count() == 2


def test_evaluation_tables_are_partitioned_by_run(spark, tmp_path):
    scores = spark.createDataFrame(
        [("m", "a", "t", 0.5), ("m", "b", "t", 0.6)],
        "model string, adapter string, test_tag string, accuracy double",
    )
    writers.write_evaluation({"scores": scores}, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "scores"))
    assert {(r.adapter, r.accuracy) for r in back.collect()} == {("a", 0.5), ("b", 0.6)}
    assert (tmp_path / "scores" / "model=m" / "adapter=a" / "test_tag=t").is_dir()


def test_missing_results_are_empty(spark, tmp_path):
    assert readers.read_results(spark, str(tmp_path / "none")).count() == 0


def test_result_files_keep_good_records_beside_a_broken_file(spark, tmp_path):
    (tmp_path / "links_a.json").write_text(
        json.dumps([{"job_title": "t", "url": "u1", "benefits": ["x"], "other": 1},
                    {"raw_response": "text", "url": "u2"}], indent=2), encoding="utf-8")
    (tmp_path / "links_b.json").write_text('[{"job_title": "t", ', encoding="utf-8")
    good, broken = readers.read_result_files(spark, str(tmp_path / "*.json"))
    rows = {r.url: r for r in good.collect()}
    assert rows["u1"].record.benefits == ["x"] and rows["u1"].raw_response is None
    assert rows["u2"].record is None and rows["u2"].raw_response == "text"
    assert {r.source for r in rows.values()} == {"links_a"}
    assert [r.source for r in broken.collect()] == ["links_b"]


def test_counted_needs_no_extra_pass(spark, tmp_path):
    df, seen = counted(spark.range(7), "rows")
    df.write.parquet(str(tmp_path / "n"))
    assert seen.get["n_rows"] == 7


def test_profile_and_distribution(spark):
    rows = [("a b", "x", "it", "2025-07"), ("c", "x", "law", "2025-10"), (None, "y", "it", None)]
    df = spark.createDataFrame(rows, "t string, l string, c string, d string").repartition(3)
    row = corpus_profile(df, "t", "l", "c", "d").first()
    assert tuple(row) == (3, 3, 1.0, 2, 2, "2025-07", "2025-10")
    got = {r.label: (r.n, r.share) for r in label_distribution(df, "c").collect()}
    assert got == {"it": (2, pytest.approx(2 / 3)), "law": (1, pytest.approx(1 / 3))}


def test_generation_runs_in_batches_and_builds_once_per_task(spark):
    def build():
        built = id(object())

        def generate(prompts):
            assert len(prompts) <= 8
            return [f"{p}/{len(prompts)}/{built}" for p in prompts]

        return generate

    df = spark.range(100).select(F.col("id").cast("string").alias("prompt")).repartition(1)
    out = [r.generated_text.split("/") for r in batch_generate(df, build, batch_size=8).collect()]
    assert sorted(int(p) for p, _, _ in out) == list(range(100))
    assert len({b for _, _, b in out}) == 1
    assert sorted({n for _, n, _ in out}) == ["4", "8"]
    with pytest.raises(Exception, match="texts for"):
        batch_generate(df, lambda: lambda prompts: []).collect()


def test_tokenizer_hook(spark):
    def build():
        return lambda texts, n: [(" ".join(t.split()[:n]), len(t.split())) for t in texts]

    df = spark.createDataFrame([("a b c",), ("a",)], "t string")
    got = sorted((r.head, r.n_tokens, r.truncated) for r in token_budget_with(df, build, "t", 2).collect())
    assert got == [("a", 1, False), ("a b", 3, True)]
