"""Grouped evaluation metrics.

Classification: the predictions are scanned once, into confusion counts (with map-side
combine); every score, report and matrix derives from those counts. Regression: one hash
aggregate per run. ``by`` names the run columns; an empty ``by`` scores the whole frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adcorpus.operators.numbering import numbered
from adcorpus.sources.scratch import written


def confusion_counts(
    df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()
) -> DataFrame:
    """``by``, ``truth``, ``pred``, ``n`` for the pairs that occur."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(num: Column, den: Column) -> Column:
    """Quotient, and 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def label_stats(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label in truth or prediction."""
    sides = F.array(
        F.struct(
            F.col("truth").alias("label"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("hits"),
        ),
        F.struct(
            F.col("pred").alias("label"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    sums = (
        counts.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
            F.sum("s.hits").alias("hits"),
        )
    )
    return sums.select(
        *by,
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted F1, correct and total counts per run."""
    support = F.col("support")
    return (
        label_stats(counts, by)
        .groupBy(*by)
        .agg(
            _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("macro_f1"),
            _ratio(F.sum(F.col("f1") * support), F.sum("support")).alias("weighted_f1"),
            F.sum("hits").alias("n_correct"),
            F.sum("support").alias("n_total"),
        )
    )


def class_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row per label (``kind='label'``) and three summary rows (``kind='summary'``).

    The accuracy row carries the value in ``f1`` and leaves precision and recall null.
    """
    stats = label_stats(counts, by)
    columns = [*by, "kind", "label", "precision", "recall", "f1", "support"]
    weight = F.col("support")

    def macro(name: str) -> Column:
        return F.avg(name)

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * weight), F.sum(weight))

    def row(label: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.alias("f1"),
            F.sum(weight).alias("support"),
        )

    accuracy = _ratio(F.sum("hits"), F.sum(weight))
    summary = (
        stats.groupBy(*by)
        .agg(
            F.array(
                row("accuracy", F.lit(None), F.lit(None), accuracy),
                row("macro avg", macro("precision"), macro("recall"), macro("f1")),
                row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
            ).alias("rows")
        )
        .select(*by, F.inline("rows"))
        .withColumn("kind", F.lit("summary"))
    )
    labels = stats.withColumn("kind", F.lit("label"))
    return labels.select(*columns).unionByName(summary.select(*columns))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet null keys."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def label_universe(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct labels of truth and prediction per run, numbered by ascending label, null first.

    No run's labels meet in one task, whatever they begin with: they are numbered by ranges of
    their order (see :mod:`adcorpus.operators.numbering`), which runs at once and goes through the
    shared folder.
    """
    sides = counts.select(*by, F.explode(F.array("truth", "pred")).alias("label"))
    labels = sides.groupBy(*by, "label").agg(F.lit(1).alias("_one")).drop("_one")
    rows = numbered(labels, [*[F.col(c) for c in by], F.asc_nulls_first("label")], "_number")
    runs = rows.groupBy(*by).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).cast("int").alias("n_labels"))
    placed = null_safe_join(rows, runs, by) if by else rows.join(F.broadcast(runs))
    return placed.select(
        *by, "label", (F.col("_number") - F.col("_first") + 1).cast("int").alias("pos"), "n_labels"
    )


def confusion_cells(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The matrix without its empty cells: ``row``, ``col``, ``truth``, ``pred``, ``n``.

    Its size is that of the counts, whatever the number of labels. The counts are written to the
    shared folder first, so that what they are made from is read once.
    """
    counts = written(counts, "counts")
    labels = label_universe(counts, by).drop("n_labels")
    rows = labels.select(*by, F.col("label").alias("truth"), F.col("pos").cast("bigint").alias("row"))
    cols = labels.select(*by, F.col("label").alias("pred"), F.col("pos").cast("bigint").alias("col"))
    named = null_safe_join(null_safe_join(counts, rows, [*by, "truth"]), cols, [*by, "pred"])
    return named.select(*by, "row", "col", "truth", "pred", F.col("n").cast("bigint").alias("n"))


def confusion_matrix(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense matrix in long form: ``row`` and ``col`` positions, ``truth``, ``pred``, ``n``.

    It has a row per pair of a run's labels, null labels and null runs included, so that ``n``
    adds up to all predictions. Take :func:`confusion_cells` where labels are many. The counts are
    written first, as there.
    """
    counts = written(counts, "counts")
    labels = label_universe(counts, by)
    cells = labels.select(
        *by,
        F.col("label").alias("truth"),
        F.col("pos").alias("row"),
        F.explode(F.sequence(F.lit(1), F.col("n_labels"))).alias("pos"),
    )
    names = labels.select(*by, F.col("label").alias("pred"), "pos")
    named = null_safe_join(cells, names, [*by, "pos"]).withColumnRenamed("pos", "col")
    return null_safe_join(named, counts, [*by, "truth", "pred"], "left").select(
        *by,
        F.col("row").cast("bigint").alias("row"),
        F.col("col").cast("bigint").alias("col"),
        "truth",
        "pred",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def flag_correct(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per-row ``correct`` flag; a missing value is never correct."""
    return df.withColumn("correct", F.coalesce(F.col(truth) == F.col(pred), F.lit(False)))


def keep_parsable(df: DataFrame, pred: str) -> DataFrame:
    return df.where(F.col(pred).isNotNull())


def regression_scores(
    df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()
) -> DataFrame:
    """MAPE, R squared, MAE, RMSE and coverage per run.

    Rows score when both values are present; ``n_total`` counts all rows. Rows with truth 0 are
    left out of MAPE and counted in ``n_zero_truth``. R squared is 1 or 0 when all truths are
    equal (exact or not) and NaN below two rows.
    """
    scored = F.col("_t").isNotNull() & F.col("_p").isNotNull()
    # Null in either value makes both null, so every aggregate sees the same rows.
    t = F.when(scored, F.col("_t"))
    p = F.when(scored, F.col("_p"))
    sums = (
        df.select(*by, F.col(truth).cast("double").alias("_t"), F.col(pred).cast("double").alias("_p"))
        .select(*by, t.alias("t"), p.alias("p"))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count("t").alias("n_scored"),
            F.count_if((F.col("t") == 0)).alias("n_zero_truth"),
            F.avg(F.abs(F.try_divide(F.col("t") - F.col("p"), F.col("t")))).alias("ape"),
            F.avg(F.abs(F.col("t") - F.col("p"))).alias("mae"),
            F.avg((F.col("t") - F.col("p")) * (F.col("t") - F.col("p"))).alias("mse"),
            F.var_pop("t").alias("var_truth"),
        )
    )
    r2 = (
        F.when(F.col("n_scored") < 2, F.lit(float("nan")))
        .when(F.col("var_truth") > 0, 1 - F.try_divide(F.col("mse"), F.col("var_truth")))
        .when(F.col("mse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return sums.select(
        *by,
        (100 * F.col("ape")).alias("mape"),
        r2.alias("r2"),
        "mae",
        F.sqrt("mse").alias("rmse"),
        "n_scored",
        "n_total",
        F.try_divide(F.col("n_scored").cast("double"), F.col("n_total").cast("double")).alias(
            "coverage"
        ),
        "n_zero_truth",
    )
