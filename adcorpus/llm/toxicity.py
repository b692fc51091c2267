"""Toxicity by a classifier chain.

Categories are predicted one after another: every linear model sees the text's features and the
probabilities of the categories before it. While the chain is trained those probabilities are
out-of-fold, from models that did not see the row, so a later model learns how far an earlier one
can be trusted. Features are the presence of whole words and of word beginnings (for inflected
forms); the most telling ones over the labelled sample form the vocabulary.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.llm.common import as_text, documents, map_arrow, shared_dir, written

#: (category, condition on a row of labels), in the order of the chain. The labels know two marks;
#: ``low_quality`` is no kind of toxicity but tells of it, and ``severe`` is what both marks share.
#: Callers with richer labels name their own chain.
CATEGORIES = (
    ("low_quality", "quality = 0"),
    ("toxic", "toxic = 1"),
    ("severe", "toxic = 1 AND quality = 0"),
)
#: Labelled documents used at most, for each value of the deciding category.
MAX_ROWS = 3000
MAX_FEATURES = 3000
#: Features have at least this chi-square (one degree of freedom) for some category.
MIN_GAIN = 15.0
FOLDS = 3
BEGINNING = 5
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {"^" + w[:BEGINNING] for w in words if len(w) > BEGINNING}


@dataclass
class Chain:
    """Linear models in order; without labelled rows there are none and nothing is scored."""

    names: list[str]
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # category x feature
    earlier: np.ndarray | None = None  # category x earlier category
    intercepts: np.ndarray | None = None

    def score(self, text: str) -> list[float | None]:
        if self.weights is None:
            return [None] * len(self.names)
        hits = sorted(self.index[f] for f in self.index.keys() & features_of(text))
        sums = self.weights[:, hits].sum(axis=1) + self.intercepts
        out: list[float] = []
        for k in range(len(self.names)):
            z = sums[k] + float(np.dot(self.earlier[k, :k], out))
            out.append(round(float(1 / (1 + np.exp(-np.clip(z, -700, 700)))), 6))
        return out

    def probabilities(self, text: Column) -> Column:
        """A struct with one probability per category; null where nothing was trained."""
        fields = [f"c{k}" for k in range(len(self.names))]

        @F.pandas_udf(", ".join(f"{f} double" for f in fields))
        def scored(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.score(t) for t in texts], columns=fields, dtype="float64")

        return scored(text)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]], deciding: str, max_rows: int
) -> DataFrame:
    """(doc_id, text, y0, y1, ...) of at most ``max_rows`` documents for each value of the deciding
    category, the same ones at every run: those with the smallest hashed ids. A document labelled
    twice has a category if one of its labels has it."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[
            F.max(F.coalesce(F.expr(condition), F.lit(False)).cast("int")).alias(f"y{k}")
            for k, (_, condition) in enumerate(categories)
        ]
    )
    marks = marks.withColumn("order", F.xxhash64("doc_id"))
    y = f"y{[name for name, _ in categories].index(deciding)}"
    parts = [marks.where(F.col(y) == v).orderBy("order", "doc_id").limit(max_rows) for v in (0, 1)]
    sample = parts[0].union(parts[1]).drop("order")
    return docs.select("doc_id", as_text().alias("text")).join(F.broadcast(sample), "doc_id")


def detached(model: LogisticRegressionModel, spark: SparkSession) -> LogisticRegressionModel:
    """``model`` as it is read back from the shared folder. A model that was just fitted holds its
    session in its training summary, and a session that has had an observation cannot go to tasks."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[tuple[str, str]] = CATEGORIES,
    deciding: str = "toxic",
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
) -> Chain:
    """Train on a bounded sample (``max_rows`` per value of the deciding category).

    Rows are weighted so that both values of the deciding category weigh the same. So the
    probabilities do not shift when ``max_rows`` cuts one value and not the other. Every step of
    the chain is written to the shared folder and read back.
    """
    names = [name for name, _ in categories]
    ys = [f"y{k}" for k in range(len(names))]
    sample = labelled_sample(docs, labels, categories, deciding, max_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features_of(t.as_py())) for t in batch.column(1)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], found], names=["doc_id", *ys, "features"]
            )

    schema = "doc_id bigint, " + ", ".join(f"{y} int" for y in ys) + ", features array<string>"
    rows = written(map_arrow(sample.select(F.col("doc_id").cast("bigint"), "text", *ys), run, schema), "labelled")
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    if not totals["n"]:
        return Chain(names)

    # chi-square of presence against each category; the best over the categories counts
    n = float(totals["n"])
    per = rows.select(*ys, F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("d"), *[F.sum(y).alias(y) for y in ys]
    )
    gains = []
    for y in ys:
        p = totals[y] / n
        spread = F.col("d") * p * (1 - p) * (1 - F.col("d") / n) + F.lit(1e-9)
        gains.append(F.pow(F.col(y) - F.col("d") * p, 2) / spread)
    gain = F.greatest(*gains) if len(gains) > 1 else gains[0]
    best = per.where("d >= 3").where(gain >= MIN_GAIN).orderBy(gain.desc(), "feature").limit(max_features)
    vocabulary = sorted(r["feature"] for r in best.select("feature").collect())
    if not vocabulary:
        return Chain(names)

    encoder = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="features", outputCol="x")
    encoder = encoder.setBinary(True)
    data = encoder.transform(rows).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)))
    decided = ys[names.index(deciding)]
    n_true = float(totals[decided])
    if 0 < n_true < n:
        weight = F.when(F.col(decided) == 1, n / (2 * n_true)).otherwise(n / (2 * (n - n_true)))
    else:
        weight = F.lit(1.0)
    data = written(data.drop("features").withColumn("weight", weight).coalesce(1), "chain")
    weights = np.zeros((len(ys), len(vocabulary)))
    earlier, intercepts = np.zeros((len(ys), len(ys))), np.zeros(len(ys))
    for k, y in enumerate(ys):
        inputs = ["x"] + [f"p{j}" for j in range(k)]
        seen = VectorAssembler(inputCols=inputs, outputCol="z").transform(data)
        learner = LogisticRegression(
            featuresCol="z", labelCol=y, probabilityCol="p", rawPredictionCol="raw", predictionCol="hard",
            weightCol="weight", maxIter=20, regParam=0.0003, elasticNetParam=0.5,
        )
        model = learner.fit(seen)
        coefficients = model.coefficients.toArray()
        weights[k], earlier[k, :k] = coefficients[: len(vocabulary)], coefficients[len(vocabulary) :]
        intercepts[k] = model.intercept
        if k + 1 < len(ys):
            out = None
            for f in range(FOLDS):
                fitted = detached(learner.fit(seen.where(F.col("fold") != f)), docs.sparkSession)
                part = fitted.transform(seen.where(F.col("fold") == f))
                out = part if out is None else out.union(part)
            out = out.withColumn(f"p{k}", vector_to_array("p")[1]).drop("z", "p", "raw", "hard")
            data = written(out.coalesce(1), "chain")
    return Chain(names, {f: i for i, f in enumerate(vocabulary)}, weights, earlier, intercepts)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[tuple[str, str]] = CATEGORIES,
    deciding: str = "toxic",
    threshold: float = 0.5,
    **fit,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, a probability per category, and kept.

    kept is false from ``threshold`` up in the deciding category. Null and empty texts are scored
    as texts without words. Whole texts count, of any length; repeated rows and ties get equal
    scores; a null doc_id is scored like any other. Without labelled documents the probabilities
    are null and everything is kept. An empty table gives an empty result. Other columns are not
    read.
    """
    chain = fit_chain(docs, labels, categories, deciding, **fit)
    scored = docs.select("doc_id", chain.probabilities(as_text()).alias("p"))
    k = chain.names.index(deciding)
    return scored.select(
        "doc_id",
        *[F.col(f"p.c{j}").alias(name) for j, name in enumerate(chain.names)],
        F.coalesce(F.col(f"p.c{k}") < threshold, F.lit(True)).alias("kept"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, deciding: str = "toxic", threshold: float = 0.5, **fit) -> DataFrame:
    """``docs`` without the rows that ``toxicity`` rejects; all columns as they were."""
    chain = fit_chain(docs, labels, deciding=deciding, **fit)
    if chain.weights is None:
        return docs
    p = chain.probabilities(as_text())[f"c{chain.names.index(deciding)}"]
    return docs.where(p < threshold)


def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, quality int, toxic int").parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels_table(spark, sf_dir))
