"""Session builder with the settings the library is designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "adcorpus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC time.

    ``conf`` keys use ``__`` for dots. Shuffle partitions are left to the cluster: adaptive
    execution coalesces them, so a large initial number is the safe choice for big inputs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
