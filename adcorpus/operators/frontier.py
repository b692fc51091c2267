"""URL frontier: what is listed, what is done, what is still to fetch.

A frontier is ``(source, pos, url)``; ``pos`` orders the URLs of a source and is unique in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adcorpus.operators.topn import BUCKET, take_first


def distinct_urls(frontier: DataFrame) -> DataFrame:
    """One row per ``(source, url)`` with its smallest ``pos``."""
    return frontier.groupBy("source", "url").agg(F.min("pos").alias("pos"))


def result_url(results: DataFrame) -> Column:
    """URL of a stored result: ``url``, else the ``url`` inside a JSON ``raw_response``."""
    url = F.nullif(F.col("url"), F.lit(""))
    if "raw_response" not in results.columns:
        return url
    return F.coalesce(url, F.get_json_object("raw_response", "$.url"))


def _keyed(results: DataFrame) -> DataFrame:
    return results.withColumn("_url", result_url(results))


def _keys(frontier: DataFrame) -> DataFrame:
    return frontier.select("source", F.col("url").alias("_url")).distinct()


def keep_listed(results: DataFrame, frontier: DataFrame) -> DataFrame:
    """Results whose URL is still listed in their source."""
    return _keyed(results).join(_keys(frontier), ["source", "_url"], "left_semi").drop("_url")


def stale_results(results: DataFrame, frontier: DataFrame) -> DataFrame:
    """Results whose URL is missing or no longer listed in their source."""
    # Results without a URL need no lookup, and as a join key they would all meet in one task.
    keyed = _keyed(results)
    gone = keyed.where(F.col("_url").isNotNull()).join(
        _keys(frontier), ["source", "_url"], "left_anti"
    )
    return gone.unionByName(keyed.where(F.col("_url").isNull())).drop("_url")


def done_urls(results: DataFrame) -> DataFrame:
    """Distinct ``(source, url)`` of the results that have a URL."""
    urls = results.select("source", result_url(results).alias("url"))
    return urls.where(F.col("url").isNotNull()).distinct()


def pending_urls(frontier: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct listed URLs that are not in ``done`` (as :func:`done_urls` gives it)."""
    return distinct_urls(frontier).join(done, ["source", "url"], "left_anti")


def url_state(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """``(source, url, pos, listed, done)``: frontier and results in one aggregate.

    Listed and not done is pending, done and not listed is stale. One shuffle on
    ``(source, url)`` replaces the separate joins, and whatever is derived from it reuses it.
    """
    listed = frontier.select(
        "source", "url", "pos", F.lit(True).alias("listed"), F.lit(False).alias("done")
    )
    finished = results.select(
        "source",
        result_url(results).alias("url"),
        F.lit(None).cast("bigint").alias("pos"),
        F.lit(False).alias("listed"),
        F.lit(True).alias("done"),
    )
    return (
        listed.unionByName(finished)
        .where(F.col("url").isNotNull())
        .groupBy("source", "url")
        .agg(
            F.min("pos").alias("pos"),
            F.max("listed").alias("listed"),
            F.max("done").alias("done"),
        )
    )


def state_progress(state: DataFrame, percent: float = 100) -> DataFrame:
    """As :func:`frontier_progress`, from :func:`url_state`; sources without a list are absent."""
    counts = state.where("listed").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_listed"), F.count_if("done").alias("n_done")
    )
    return _with_quota(counts, percent)


def frontier_progress(
    frontier: DataFrame, done: DataFrame, percent: float = 100
) -> DataFrame:
    """Listed, done, required and remaining URLs per source.

    ``complete`` follows the listed count: an empty source is never complete. ``required`` is
    the whole number of URLs the percentage asks for.
    """
    listed = distinct_urls(frontier).groupBy("source").agg(F.count(F.lit(1)).alias("n_listed"))
    finished = done.groupBy("source").agg(F.count(F.lit(1)).alias("_n_done"))
    n_done = F.coalesce("_n_done", F.lit(0)).cast("bigint")
    counted = listed.join(finished, "source", "left").withColumn("n_done", n_done)
    return _with_quota(counted, percent)


def _with_quota(counts: DataFrame, percent: float) -> DataFrame:
    quota = F.col("n_listed") * F.lit(percent) / F.lit(100)
    required = F.floor(quota).cast("bigint")
    return counts.select(
        "source",
        "n_listed",
        "n_done",
        required.alias("n_required"),
        F.greatest(required - F.col("n_done"), F.lit(0).cast("bigint")).alias("n_remaining"),
        ((F.col("n_listed") > 0) & (F.col("n_done") >= quota)).alias("complete"),
    )


def quota_take(
    pending: DataFrame,
    remaining: DataFrame,
    success: Column | None = None,
    bucket: int = BUCKET,
) -> DataFrame:
    """The first ``n_remaining`` successful pending URLs of each source, in list order.

    Rows that fail ``success`` use no quota. A source may hold most of the frontier, so it is
    never ranked in one task, see :func:`adcorpus.operators.topn.take_first`.
    """
    usable = pending if success is None else pending.where(success)
    return take_first(usable, "source", "pos", remaining, bucket)
