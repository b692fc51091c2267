from __future__ import annotations

import pytest
from llm_cases import SCHEMA, make_docs, prose


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    long = prose(2, 30_000)
    return [
        (1, base, "en", "s0"),
        (2, near, "en", "s1"),
        (3, base, "de", "s0"),
        (4, None, "en", None),
        (5, "", None, "s1"),
        (6, " \t\n ", "en", "s1"),
        (7, long, "en", "s0"),
        (8, long + " more", "fr", "s0"),
        (9, "one", "en", "s2"),
        (9, "one", "en", "s2"),
        (10, "One", "en", "s2"),
        (None, base, "en", "s0"),
        (None, "only here", None, None),
        (11, "één çé 日本語 \U0001f600 the end of the río", "es", "s0"),
        (12, prose(3, 80), "en", "s0"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return make_docs(spark, odd_rows).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
