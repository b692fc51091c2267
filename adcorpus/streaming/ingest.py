"""Stream form of the ingest: new URL lists trigger it, the snapshot store makes it idempotent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from adcorpus.operators.answers import Answer
from adcorpus.plans.ingest import add_lists, answer_ingest, ingest, listed_so_far
from adcorpus.sources.readers import list_lines, number_lines


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("name a checkpoint folder, or set spark.checkpoint.dir to a shared one")
    return f"{shared.rstrip('/')}/{name}"


def stream_ingest(
    spark: SparkSession,
    lists_path: str,
    pages: DataFrame,
    results_path: str,
    checkpoint: str | None = None,
    percent: float = 100,
    build: Callable[[], Answer] | None = None,
    **options,
) -> StreamingQuery:
    """Process the list files not seen before, then stop; with ``build``, by asking its model.

    ``checkpoint`` defaults to a folder under the shared one the session names in
    ``spark.checkpoint.dir``.

    Every micro-batch first adds its lines to the store's frontier and then ingests for the whole
    frontier. So a list that is spread over files or batches has one order and one quota, and the
    results are those of one batch over all lists. A batch that is repeated after a failure finds
    its lines and its results there and adds nothing.
    """

    location = checkpoint or checkpoint_folder(spark, "stream_ingest")

    def process(lines: DataFrame, number: int) -> None:
        session = lines.sparkSession
        add_lists(session, number_lines(lines), f"{location}:{number}", results_path)
        frontier = listed_so_far(session, results_path)
        if build is None:
            ingest(session, frontier, pages, results_path, percent, **options)
        else:
            answer_ingest(session, frontier, pages, build, results_path, percent, **options)

    return (
        list_lines(spark.readStream.text(lists_path))
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", location)
        .trigger(availableNow=True)
        .start()
    )
