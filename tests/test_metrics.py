from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adcorpus.operators import metrics as met
from adcorpus.operators.grid import RUN_COLUMNS, grid_of, run_grid, scores_on_grid
from adcorpus.plans.evaluation import (
    evaluate_categories,
    evaluate_salaries,
    save_categories,
    save_salaries,
    scorable_prompts,
)
from adcorpus.plans.training import training_texts


def predictions(spark, seed=5):
    rng = random.Random(seed)
    labels = ["a", "b", "c", "đ"]
    rows = [
        (f"run{rng.randrange(3)}", rng.choice(labels), rng.choice([*labels, "Other"]))
        for _ in range(400)
    ]
    rows += [("solo", "a", "a")]
    return rows, spark.createDataFrame(rows, "run string, t string, p string").repartition(4)


def brute(pairs):
    """Per-label precision, recall, F1 and support by definition."""
    labels = sorted({x for pair in pairs for x in pair})
    out = {}
    for name in labels:
        hit = sum(t == p == name for t, p in pairs)
        said = sum(p == name for _, p in pairs)
        real = sum(t == name for t, _ in pairs)
        precision = hit / said if said else 0.0
        recall = hit / real if real else 0.0
        f1 = 2 * precision * recall / (precision + recall) if hit else 0.0
        out[name] = (precision, recall, f1, real)
    return out


def test_micro_case(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "Other"), ("b", "b")], "t string, p string")
    counts = met.confusion_counts(df, "t", "p")
    row = met.class_scores(counts).first()
    assert row.accuracy == pytest.approx(2 / 3)
    assert row.macro_f1 == pytest.approx(5 / 9)
    assert row.weighted_f1 == pytest.approx(7 / 9)
    assert (row.n_correct, row.n_total) == (2, 3)
    f1 = {r.label: r.f1 for r in met.label_stats(counts).collect()}
    assert f1 == {"a": pytest.approx(2 / 3), "b": 1.0, "Other": 0.0}


def test_scores_report_and_matrix_match_brute_force(spark):
    rows, df = predictions(spark)
    counts = met.confusion_counts(df, "t", "p", ["run"])
    scores = {r.run: r for r in met.class_scores(counts, ["run"]).collect()}
    report, matrix = {}, {}
    for r in met.class_report(counts, ["run"]).collect():
        report.setdefault((r.run, r.kind), {})[r.label] = (r.precision, r.recall, r.f1, r.support)
    for r in met.confusion_matrix(counts, ["run"]).collect():
        matrix.setdefault(r.run, {})[(r.row, r.col)] = (r.truth, r.pred, r.n)
    runs = {r for r, _, _ in rows}
    assert set(scores) == set(matrix) == runs
    for run in runs:
        pairs = [(t, p) for r, t, p in rows if r == run]
        want, n = brute(pairs), len(pairs)
        right = sum(t == p for t, p in pairs)
        macro = np.mean([v[:3] for v in want.values()], axis=0)
        weighted = np.sum([np.array(v[:3]) * v[3] for v in want.values()], axis=0) / n
        s = scores[run]
        assert (s.n_correct, s.n_total) == (right, n)
        assert (s.accuracy, s.macro_f1, s.weighted_f1) == pytest.approx(
            (right / n, macro[2], weighted[2])
        )
        assert weighted[1] == pytest.approx(s.accuracy)
        got = report[(run, "label")]
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k]) for k in want)
        summary = report[(run, "summary")]
        assert summary["accuracy"] == (None, None, pytest.approx(right / n), n)
        assert summary["macro avg"] == pytest.approx((*macro, n))
        assert summary["weighted avg"] == pytest.approx((*weighted, n))
        names = sorted(want)
        assert matrix[run] == {
            (i + 1, j + 1): (t, p, pairs.count((t, p)))
            for i, t in enumerate(names)
            for j, p in enumerate(names)
        }


def test_no_rows_give_null_free_empty_scores(spark):
    df = spark.createDataFrame([], "run string, t string, p string")
    counts = met.confusion_counts(df, "t", "p", ["run"])
    assert met.class_scores(counts, ["run"]).collect() == []
    assert met.confusion_matrix(counts, ["run"]).collect() == []


def test_predictions_are_scanned_once(spark):
    _, df = predictions(spark)
    report = met.class_report(met.confusion_counts(df, "t", "p", ["run"]), ["run"])
    cells = met.confusion_cells(met.confusion_counts(df, "t", "p", ["run"]), ["run"])
    dense = met.confusion_matrix(met.confusion_counts(df, "t", "p", ["run"]), ["run"])
    # the report reads them in its plan; for the numbered tables their counts were written before
    for table, scans in ((report, 1), (cells, 0), (dense, 0)):
        table.collect()
        plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert sum("Scan" in line and "FileScan" not in line for line in plan.splitlines()) == scans, plan


def test_matrix_counts_every_prediction_with_null_keys(spark):
    rows = [("m", None, "t", a, b) for a, b in (("x", "x"), ("x", None), (None, "y"), (None, None))]
    rows += [("m", "q", "t", "x", "y"), (None, "q", "t", "abcd", "abce")]
    df = spark.createDataFrame(rows, "model string, adapter string, test_tag string, t string, p string")
    counts = met.confusion_counts(df, "t", "p", RUN_COLUMNS)
    dense = met.confusion_matrix(counts, RUN_COLUMNS).collect()
    assert sum(r.n for r in dense) == len(rows) == sum(r.n for r in met.confusion_cells(counts, RUN_COLUMNS).collect())
    first = [r for r in dense if r.model and r.adapter is None]
    assert len(first) == 9 and {(r.row, r.truth) for r in first} == {(1, None), (2, "x"), (3, "y")}


def test_labels_are_numbered_in_order_whatever_their_beginnings(spark):
    names = ["a", "ab", "abc", "abcd", "abce", "abd", "b", "é", "Đ", "𝒳", "", "zzzz", "zzz"]
    df = spark.createDataFrame([(n, n) for n in names], "t string, p string")
    got = met.label_universe(met.confusion_counts(df, "t", "p")).collect()
    assert [r.label for r in sorted(got, key=lambda r: r.pos)] == sorted(names)
    assert {r.pos for r in got} == set(range(1, 14)) and {r.n_labels for r in got} == {13}


def regression(spark, rows, by=()):
    df = spark.createDataFrame(rows, "run string, t bigint, p bigint").repartition(3)
    return met.regression_scores(df, "t", "p", by)


def test_regression_micro_cases(spark):
    row = regression(spark, [("r", 10, 12), ("r", 20, 16)]).first()
    assert (row.mape, row.mae, row.rmse, row.r2) == pytest.approx((20, 3, math.sqrt(10), 0.6))
    assert (row.n_scored, row.n_total, row.coverage, row.n_zero_truth) == (2, 2, 1.0, 0)


def test_regression_edges(spark):
    rows = [
        ("exact", 5, 5), ("exact", 5, 5), ("inexact", 5, 5), ("inexact", 5, 6),
        ("zero", 0, 1), ("zero", 10, 5), ("one", 3, 4), ("holes", 1, None), ("holes", None, 1),
        ("holes", 2, 2), ("holes", 4, 4), ("none", None, None),
    ]
    got = {r.run: r for r in regression(spark, rows, ["run"]).collect()}
    assert got["exact"].r2 == 1.0 and got["inexact"].r2 == 0.0
    assert got["zero"].mape == 50.0 and got["zero"].n_zero_truth == 1
    assert math.isnan(got["one"].r2)
    assert (got["holes"].n_scored, got["holes"].n_total, got["holes"].coverage) == (2, 4, 0.5)
    assert got["holes"].mae == 0.0 and got["holes"].r2 == 1.0
    assert got["none"].n_scored == 0 and got["none"].mae is None


def test_regression_matches_numpy(spark):
    rng = random.Random(1)
    rows = [("r", rng.randrange(1, 500), rng.randrange(1, 500)) for _ in range(300)]
    t, p = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2))
    row = regression(spark, rows).first()
    assert row.mape == pytest.approx(np.mean(np.abs((t - p) / t)) * 100)
    assert row.rmse == pytest.approx(math.sqrt(np.mean((t - p) ** 2)))
    assert row.r2 == pytest.approx(1 - np.sum((t - p) ** 2) / np.sum((t - t.mean()) ** 2))


def test_grid_keeps_runs_without_rows(spark):
    models = spark.createDataFrame([("m1",), ("m2",), ("m1",)], "m string")
    adapters = spark.createDataFrame([("",), (None,), ("x",)], "a string")
    tests = spark.createDataFrame([("default",)], "t string")
    grid = run_grid(models, adapters, tests, 10)
    assert sorted(r.run_id for r in grid.collect()) == [
        "m1/no-adapter/default", "m1/x/default", "m2/no-adapter/default", "m2/x/default",
    ]
    scores = spark.createDataFrame([("m1", "x", "default", 1.0)], "model string, adapter string, test_tag string, mae double")
    joined = scores_on_grid(grid, scores).collect()
    assert len(joined) == 4 and sum(r.mae is not None for r in joined) == 1
    many = spark.range(1500).select(F.lit("m").alias("model"), F.lit(None).cast("string").alias("adapter"), F.col("id").cast("string").alias("test_tag"))
    planned = spark.createDataFrame([("m9", "", "t")], "model string, adapter string, test_tag string")
    assert grid_of(many, planned).where("adapter = 'no-adapter'").count() == 1501


def test_evaluations_are_saved_by_run(spark, tmp_path):
    columns = ", ".join(f"{c} string" for c in (*RUN_COLUMNS, "ground_truth", "generated_text"))
    rows = [("m", a, "t", "it", g) for a in ("x", "y") for g in ("it", "law")]
    generations = spark.createDataFrame(rows, columns)
    vocabulary = spark.createDataFrame([("it",), ("law",)], "label string")
    save_categories(generations, vocabulary, str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells" / "matrix")).count() == 4
    save_categories(generations, vocabulary, str(tmp_path / "c"), dense=True)
    tables = {n: spark.read.parquet(str(tmp_path / "c" / n)) for n in ("predictions", "scores", "report", "matrix")}
    assert {n: df.count() for n, df in tables.items()} == {
        "predictions": 4, "scores": 2, "report": 10, "matrix": 8,
    }
    assert {r.accuracy for r in tables["scores"].collect()} == {0.5}
    # saving one run again replaces its rows and leaves the other
    again = [("m", "x", "t", "it", "it")]
    save_categories(spark.createDataFrame(again, columns), vocabulary, str(tmp_path / "c"), dense=True)
    scores = spark.read.parquet(str(tmp_path / "c" / "scores")).collect()
    assert {(r.adapter, r.accuracy, r.n_total) for r in scores} == {("x", 1.0, 1), ("y", 0.5, 2)}
    rows = [("m", "x", "t", "10 triệu", "12")]
    save_salaries(spark.createDataFrame(rows, columns), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "scores")).first().mae == 2.0


def test_scorable_prompts(spark):
    records = [
        (1, [("user", "u"), ("assistant", " X ")]), (2, [("user", "u")]), (3, []), (4, None),
        (5, [("user", "u"), ("assistant", " ")]), (6, [("assistant", "y")]),
        (7, [("user", None), ("assistant", "z")]),
    ]
    df = spark.createDataFrame(records, "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: (r.prompt, r.ground_truth) for r in scorable_prompts(df, ["id"]).collect()}
    opened = "<|im_start|>assistant\n"
    assert got == {1: (f"<|im_start|>user\nu<|im_end|>\n{opened}", "x"), 6: (opened, "y")}


def test_training_texts(spark):
    records = [(1, [("user", "a b"), ("assistant", "c")]), (2, [("user", None)]), (3, None)]
    df = spark.createDataFrame(records, "id int, messages array<struct<role:string,content:string>>")
    row = training_texts(df, ["id"], max_tokens=2).collect()
    assert len(row) == 1
    assert (row[0].head, row[0].n_tokens, row[0].truncated) == ("<|im_start|>user a", 5, True)
    assert row[0].text.endswith("<|im_start|>assistant\nc<|im_end|>\n")


def test_evaluation_plans(spark):
    base = [("m", "no-adapter", "default")]
    rows = [(*base[0], t, g) for t, g in (("it", " IT"), ("it", "law"), ("law", "??"))]
    columns = ", ".join(f"{c} string" for c in (*RUN_COLUMNS, "ground_truth", "generated_text"))
    vocabulary = spark.createDataFrame([("it",), ("law",)], "label string")
    assert evaluate_categories(spark.createDataFrame(rows, columns), vocabulary)["matrix"].count() == 3
    out = evaluate_categories(spark.createDataFrame(rows, columns), vocabulary, dense=True)
    assert sorted(r.predicted_category for r in out["predictions"].collect()) == ["Other", "it", "law"]
    assert [r.correct for r in out["predictions"].collect()].count(True) == 1
    assert out["scores"].first().accuracy == pytest.approx(1 / 3)
    assert out["matrix"].count() == 9
    no_adapter = [("m", None, "default", t, g) for t, g in (("it", "it"), (None, "law"))]
    tables = evaluate_categories(spark.createDataFrame(no_adapter, columns), vocabulary)
    assert tables["scores"].first().adapter == "no-adapter" and tables["scores"].first().n_total == 2
    assert sum(r.n for r in tables["matrix"].collect()) == 2
    huge = [("m", "a", "default", str(10**30), str(2 * 10**30))]
    assert evaluate_salaries(spark.createDataFrame(huge, columns))["scores"].first().mape == pytest.approx(100)
    rows = [(*base[0], t, g) for t, g in (("10 triệu", "12"), ("20", "x 16 y"), ("5", "không"))]
    out = evaluate_salaries(spark.createDataFrame(rows, columns))
    assert out["predictions"].count() == 2
    row = out["scores"].first()
    assert (row.mae, row.n_scored, row.n_total) == (3.0, 2, 3)
