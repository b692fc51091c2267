"""Resumable ingest over stored pages: prune, skip what is done, respect the quota, add the rest.

State lives in one snapshot store: ``results``, the ``ledger`` of attempts, and, for lists that
arrive in batches, the ``frontier`` itself. Only URLs, positions and counts are joined and counted;
page bodies meet the chosen URLs last, and stay where they are when the pages are in buckets
(:mod:`adcorpus.sources.bucketed`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.functions.html import with_markdown
from adcorpus.operators.answers import ANSWERED, LEDGER, Answer, ask, ledger_state
from adcorpus.operators.frontier import keep_listed, quota_take, state_progress, url_state
from adcorpus.operators.numbering import positions
from adcorpus.operators.pages import extraction_prompt, page_fields, record_or_raw
from adcorpus.sources.readers import read_results
from adcorpus.sources.schemas import EXTRACTION, FRONTIER, RESULT_KEYS
from adcorpus.sources.snapshots import Snapshots
from adcorpus.sources.writers import append_results

RESULT_COLUMNS = tuple(EXTRACTION.names)


def stored_once(pages: DataFrame, newest_by: str | None = None, fetched: str | None = None) -> DataFrame:
    """``(url, _pick)``: which stored page of a URL counts, by keys alone.

    Of several stored pages the one with the largest ``newest_by`` counts (a crawl time or page
    id); without it, the one whose body has the smallest hash. Pages without a body do not count:
    the URL was not fetched. ``fetched`` names a boolean column that says so; with both columns
    bodies are not read here.
    """
    stored = pages.where(F.col(fetched) if fetched else F.col("html").isNotNull())
    if newest_by:
        return stored.groupBy("url").agg(F.max(newest_by).alias("_pick"))
    return stored.groupBy("url").agg(F.min(F.xxhash64("html")).alias("_pick"))


def _pick(newest_by: str | None) -> Column:
    return F.col(newest_by) if newest_by else F.xxhash64("html")


def bodies_of(taken: DataFrame, pages: DataFrame, newest_by: str | None = None) -> DataFrame:
    """``taken`` (with ``_pick``) and the ``html`` of its pages."""
    stored = pages.where(F.col("html").isNotNull()).select("url", _pick(newest_by).alias("_pick"), "html")
    # the URL alone is the key of the exchange, as pages in buckets are dealt by it
    joined = taken.withColumnRenamed("_pick", "_want").join(stored, "url")
    return joined.where(F.col("_pick").eqNullSafe(F.col("_want"))).drop("_pick", "_want")


def select_urls(
    frontier: DataFrame,
    results: DataFrame,
    pages: DataFrame,
    percent: float = 100,
    newest_by: str | None = None,
    barred: DataFrame | None = None,
    fetched: str | None = None,
) -> DataFrame:
    """``(source, url, pos, _pick)`` to process now.

    A page that was never stored or has no body counts as failed and uses no quota, and so do the
    ``(source, url)`` in ``barred``. Only URLs and counts move here.
    """
    state = url_state(frontier, results)
    pending = state.where("listed AND NOT done").select("source", "url", "pos")
    if barred is not None:
        pending = pending.join(barred.select("source", "url"), ["source", "url"], "left_anti")
    candidates = pending.join(stored_once(pages, newest_by, fetched), "url")
    return quota_take(candidates, state_progress(state, percent))


def extract_pages(
    taken: DataFrame, pages: DataFrame, keep: Sequence[str] = ("source",), newest_by: str | None = None
) -> DataFrame:
    """Results for the taken URLs by rule, one per URL."""
    records = page_fields(bodies_of(taken, pages, newest_by), keep=[*keep, "url"])
    fresh = records.withColumn("raw_response", F.lit(None).cast("string")).select(*RESULT_COLUMNS)
    # equal bodies of one URL give equal results; where pages have an order there are none
    return fresh if newest_by else fresh.dropDuplicates([*keep, "url"])


def ingest_step(
    frontier: DataFrame,
    results: DataFrame,
    pages: DataFrame,
    percent: float = 100,
    newest_by: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The results that stay and the results to add."""
    taken = select_urls(frontier, results, pages, percent, newest_by)
    return keep_listed(results, frontier), extract_pages(taken, pages, newest_by=newest_by)


def stale_keys(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """``(source, url)`` of results that are no longer listed."""
    return url_state(frontier, results).where("done AND NOT listed").select("source", "url")


def ingest(
    spark: SparkSession,
    frontier: DataFrame,
    pages: DataFrame,
    results_path: str,
    percent: float = 100,
    newest_by: str | None = None,
    fetched: str | None = None,
) -> None:
    """Bring the results at ``results_path`` up to the frontier, by rule.

    What is no longer listed goes and what is pending comes in one commit: a reader sees all of it
    or nothing, and a run that is lost leaves the results as they were. Running it again adds
    nothing, as what was written is found as done. For ``newest_by`` and ``fetched`` see
    :func:`stored_once`.
    """
    store = Snapshots(spark, results_path)
    version = store.next_version()
    results = store.visible("results", EXTRACTION, RESULT_KEYS)
    taken = select_urls(frontier, results, pages, percent, newest_by, fetched=fetched)
    fresh = extract_pages(taken, pages, newest_by=newest_by)
    store.commit(
        version,
        {
            "results": [store.stage(fresh, "results", version)],
            "results_removed": [store.stage(stale_keys(frontier, results), "results_removed", version)],
        },
    )


def prune(spark: SparkSession, frontier: DataFrame, results_path: str, pruned_path: str | None = None) -> None:
    """Take back the results that are no longer listed, for every reader; with ``pruned_path``,
    write the others to a table there instead."""
    if pruned_path:
        append_results(keep_listed(read_results(spark, results_path), frontier), pruned_path)
        return
    store = Snapshots(spark, results_path)
    version = store.next_version()
    gone = stale_keys(frontier, store.visible("results", EXTRACTION, RESULT_KEYS))
    store.commit(version, {"results_removed": [store.stage(gone, "results_removed", version)]})


def answer_ingest(
    spark: SparkSession,
    frontier: DataFrame,
    pages: DataFrame,
    build: Callable[[], Answer],
    path: str,
    percent: float = 100,
    max_attempts: int = 3,
    instruction: str | None = None,
    batch_size: int = 64,
    give_up_after: int | None = None,
    newest_by: str | None = None,
    fetched: str | None = None,
) -> int:
    """As :func:`ingest`, with the records of a model; returns the number of rounds.

    A round takes the first pending URLs of every source that its quota has room for, asks for each
    at most ``max_attempts`` times and commits attempts and results together. URLs whose attempts
    all failed use no quota: the next round takes as many further ones, until quotas are met or
    nothing is left, so the results are the first successes in list order. A later run asks for
    failed URLs again, unless ``give_up_after`` attempts have failed in all. An answer that holds
    no fenced JSON object is kept as text and counts as a success.

    A lost run keeps the rounds it committed; the model is then asked again for one round at most.
    """
    store = Snapshots(spark, path)
    run = store.next_version()
    rounds = 0
    while True:
        version = store.next_version()
        results = store.visible("results", EXTRACTION, RESULT_KEYS)
        known = ledger_state(store.read("ledger", LEDGER), run)
        barred = known.where("failed_now")
        if give_up_after is not None:
            barred = known.where(F.col("failed_now") | (F.col("n_failed") >= give_up_after))
        taken = select_urls(frontier, results, pages, percent, newest_by, barred, fetched)
        bodies = with_markdown(bodies_of(taken, pages, newest_by)).select("source", "url", "markdown")
        if not newest_by:
            bodies = bodies.dropDuplicates(["source", "url"])
        asked = ask(bodies.withColumn("prompt", extraction_prompt(F.col("markdown"), instruction)), build,
                    "prompt", max_attempts, batch_size)
        tries = asked.select("source", "url", F.lit(run).cast("bigint").alias("run"), F.inline("tries"))
        # staged once and read back, since a model need not answer twice alike
        ledger = store.stage(tries.select(*LEDGER.names), "ledger", version)
        answered = store.staged(ledger, LEDGER).where(F.col("outcome") == ANSWERED)
        fresh = record_or_raw(answered, "answer", ["source"]).select(*RESULT_COLUMNS)
        add = {"ledger": [ledger], "results": [store.stage(fresh, "results", version)]}
        if not rounds:
            add["results_removed"] = [store.stage(stale_keys(frontier, results), "results_removed", version)]
        asked_any = bool(store.staged(ledger, LEDGER).limit(1).count())
        if asked_any or not rounds:
            store.commit(version, add)
            rounds += 1
        if not asked_any:
            return rounds


def add_lists(spark: SparkSession, lines: DataFrame, batch: str, path: str) -> None:
    """Append the URLs of a batch of lists to the store's frontier.

    ``lines`` has source, url and the columns ``file`` and ``pos`` that order it. Positions go on
    from those of earlier batches, so a list that comes in several files or batches is one list
    with one quota. A batch that is already there is left out.
    """
    store = Snapshots(spark, path)
    version = store.next_version()
    known = store.read("frontier", BATCHED_FRONTIER)
    if known.where(F.col("batch") == batch).limit(1).count():
        return
    before = known.groupBy("source").agg((F.max("pos") + 1).alias("_before"))
    rows = positions(lines.withColumnRenamed("pos", "_at"), ["source"], [F.col("file"), F.col("_at")], "_place")
    rows = rows.join(before, "source", "left").select(
        "source", (F.col("_place") + F.coalesce("_before", F.lit(0))).alias("pos"), "url", F.lit(batch).alias("batch")
    )
    store.commit(version, {"frontier": [store.stage(rows, "frontier", version)]})


BATCHED_FRONTIER = type(FRONTIER)(FRONTIER.fields).add("batch", "string")


def listed_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The frontier of all batches that :func:`add_lists` was given."""
    return Snapshots(spark, path).read("frontier", BATCHED_FRONTIER).select(*FRONTIER.names)
