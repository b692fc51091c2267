from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from adcorpus.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests",
        master="local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a function of one column over a list of cells."""

    def run(cells, expression, type_name="string"):
        rows = [(i, c) for i, c in enumerate(cells)]
        df = spark.createDataFrame(rows, f"i int, c {type_name}").repartition(3)
        out = df.select("i", expression(F.col("c")).alias("v")).collect()
        return [r.v for r in sorted(out)]

    return run
