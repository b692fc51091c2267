from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from adcorpus.constants import CATEGORY_SYSTEM_HEAD, CATEGORY_SYSTEM_TAIL, SALARY_SYSTEM
from adcorpus.operators import labels as lab
from adcorpus.operators import prompts as pr
from adcorpus.plans.formatting import format_splits

AD = "job_title string, contract_type string, location string, country string," \
    " experience_required string, salary_avg string"
LIMITS = (1000, 1 << 20)


def roles(row):
    return [m.role for m in row.messages]


def contents(row):
    return [m.content for m in row.messages]


def test_vocabulary_sorts_raw_then_lowers(spark):
    df = spark.createDataFrame([("B",), ("a",), ("A",), ("a",), (None,)], "c string")
    vocabulary = lab.label_vocabulary(df, "c", *LIMITS)
    assert vocabulary.first().labels == ["a", "b", "a"]
    rendered = vocabulary.select(lab.quoted_labels(F.col("labels")).alias("r")).first().r
    assert rendered == '"a", "b", "a"'


def test_vocabulary_sorts_by_code_point(spark):
    names = ["Đ", "z", "é", "Z", "ă", "𝒳", "￿"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert lab.label_vocabulary(df, "c", *LIMITS).first().labels == [n.lower() for n in sorted(names)]


def test_too_many_labels_raise_and_are_never_cut(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(Exception, match="label vocabulary: more than 5"):
        lab.label_vocabulary(df, "c", 5, 1000).collect()
    with pytest.raises(Exception, match="label vocabulary: more than 29 bytes"):
        lab.label_vocabulary(df, "c", 20, 29).collect()
    assert len(lab.label_vocabulary(df, "c", 20, 1000).first().labels) == 20


def test_vocabulary_beyond_ten_thousand_labels(spark):
    df = spark.range(12_000).select(F.col("id").cast("string").alias("c"))
    assert len(lab.label_vocabulary(df, "c", 12_000, 1 << 20).first().labels) == 12_000
    answers = spark.createDataFrame([("11999",), ("12000",)], "g string")
    got = sorted(r.predicted for r in lab.parse_category(answers, "g", df, "c").collect())
    assert got == ["11999", "Other"]


def test_too_large_exemplars_raise(spark):
    shots = spark.createDataFrame([(0, "x" * 100, "l")], "i int, t string, l string")
    with pytest.raises(Exception, match="exemplars: more than 50 bytes"):
        pr.exemplar_turns(shots, "i", "t", "l", 1000, 50).collect()


def test_category_messages(spark):
    ads = spark.createDataFrame(
        [(1, " x ", " IT "), (2, " ", "it"), (3, "y", ""), (4, None, "it"), (5, "z", None)],
        "id int, description string, category string",
    )
    vocabulary = lab.label_vocabulary(ads, "category", *LIMITS)
    got = pr.category_messages(ads, vocabulary, keep=["id"]).collect()
    assert [r.id for r in got] == [1]
    assert roles(got[0]) == ["system", "user", "assistant"]
    assert contents(got[0])[1:] == ["The job description is: x", "it"]
    assert contents(got[0])[0] == CATEGORY_SYSTEM_HEAD + '"", " it ", "it"' + CATEGORY_SYSTEM_TAIL
    text = pr.category_messages(ads, vocabulary, keep=["id"], null_policy="nan_text").collect()
    assert sorted(r.id for r in text) == [1, 4]


def test_fewshot_order_and_missing_prefix(spark):
    ads = spark.createDataFrame([("d", "b")], "description string, category string")
    shots = spark.createDataFrame([(2, "t2", "b"), (1, "t1", "a")], "i int, t string, l string")
    turns = pr.exemplar_turns(shots, "i", "t", "l", *LIMITS)
    row = pr.category_messages(ads, lab.label_vocabulary(ads, "category", *LIMITS), exemplars=turns).first()
    assert roles(row) == ["system"] + ["user", "assistant"] * 3
    assert contents(row)[1:] == ["t1", "a", "t2", "b", "The job description is: d", "b"]


def test_no_exemplars_leave_a_zero_shot_record(spark):
    ads = spark.createDataFrame([("d", "b")], "description string, category string")
    shots = spark.createDataFrame([], "i int, t string, l string")
    row = pr.category_messages(
        ads, lab.label_vocabulary(ads, "category", *LIMITS), exemplars=pr.exemplar_turns(shots, "i", "t", "l", *LIMITS)
    ).first()
    assert roles(row) == ["system", "user", "assistant"]


def test_salary_messages_need_all_six_fields(spark):
    good = ["kỹ sư", "Toàn thời gian", "hà nội", "Việt Nam", "1 năm", " 10-12_Triệu+ "]
    rows = [tuple(good)]
    for i in range(6):
        for blank in (" ", None):
            rows.append(tuple(blank if j == i else v for j, v in enumerate(good)))
    rows.append((*good[:5], "Thoả Thuận"))
    got = pr.salary_messages(spark.createDataFrame(rows, AD)).collect()
    assert len(got) == 1
    assert contents(got[0]) == [
        SALARY_SYSTEM,
        "Job Title: kỹ sư\nContract Type: Toàn thời gian\nLocation: hà nội\n"
        "Country: Việt Nam\nExperience Required: 1 năm",
        "10 12 triệu ",
    ]


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="salary_avg"):
        pr.salary_messages(spark.createDataFrame([("a",)], "job_title string"))


def test_alternate_schema(spark):
    ads = spark.createDataFrame(
        [("a", "b", "c", "d", "5 triệu")],
        "job_title string, job_type string, city string, experience string, salary_avg string",
    )
    row = pr.salary_messages(pr.map_alternate_schema(ads)).first()
    assert contents(row)[1] == (
        "Job Title: a\nContract Type: b\nLocation: c\nCountry: việt nam\nExperience Required: d"
    )


def test_salary_fewshot(spark):
    ads = spark.createDataFrame([("a", "b", "c", "d", "e", "5 triệu")], AD)
    shots = spark.createDataFrame([(0, "t", "9 triệu")], "i int, t string, l string")
    row = pr.salary_messages(ads, exemplars=pr.exemplar_turns(shots, "i", "t", "l", *LIMITS)).first()
    assert roles(row) == ["system", "user", "assistant", "user", "assistant"]
    assert contents(row)[1:3] == ["t", "9 triệu"]


def test_format_splits_covers_all_combinations(spark):
    main = spark.createDataFrame(
        [(s, "x", "it", "t", "c", "l", "n", "1", "5") for s in ("train", "dev", "test")],
        "split string, description string, category string, job_title string,"
        " contract_type string, location string, country string, experience_required string,"
        " salary_avg string",
    )
    alternate = spark.createDataFrame(
        [("test", "a", "b", "c", "d", "5")],
        "split string, job_title string, job_type string, city string, experience string,"
        " salary_avg string",
    )
    vocabulary = lab.label_vocabulary(main, "category", *LIMITS)
    shots = spark.createDataFrame([(1, "t", "l")], "i int, t string, l string")
    turns = pr.exemplar_turns(shots, "i", "t", "l", *LIMITS)
    zero = format_splits(main, alternate, vocabulary)
    few = format_splits(main, alternate, vocabulary, turns, turns)
    combinations = {
        *[("category", "main", s) for s in ("train", "dev", "test")],
        *[("salary", "main", s) for s in ("train", "dev", "test")],
        ("salary", "alternate", "test"),
    }
    rows = zero.unionByName(few).collect()
    assert {(r.task, r.variant, r.shots, r.split) for r in rows} == {
        (task, variant, shots, split)
        for task, variant, split in combinations
        for shots in ("zero", "few")
    }
    assert all(len(r.messages) == {"zero": 3, "few": 5}[r.shots] for r in rows)


def test_parse_category_exact_match_only(spark):
    vocabulary = spark.createDataFrame([("it",), ("luật",), ("IT",)], "label string")
    answers = [" IT\n", "it.", "Other", "luật", "", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, g string")
    want = ["it", "Other", "Other", "luật", "Other", "Other"]
    got = lab.parse_category(df, "g", vocabulary).orderBy("i").collect()
    assert [r.predicted for r in got] == want


def test_formatters_neither_shuffle_nor_join_rows(spark):
    ads = spark.createDataFrame([("x", "it")], "description string, category string")
    df = pr.category_messages(ads, lab.label_vocabulary(ads, "category", *LIMITS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Lines below a colon belong to the one-row subquery.
    main = [line for line in plan.splitlines() if not line.lstrip().startswith(":")]
    assert any("Scan" in line for line in main)
    assert not any("Join" in line or "Exchange" in line for line in main)
