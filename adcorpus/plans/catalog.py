"""Every operator as a query over the driver's tables; each returns flat scalar columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.functions import chat, text
from adcorpus.functions.bounded import attach
from adcorpus.functions.html import with_markdown
from adcorpus.operators import conversations as conv
from adcorpus.operators import frontier as fr
from adcorpus.operators import labels as lab
from adcorpus.operators import metrics as met
from adcorpus.operators import pages as pg
from adcorpus.operators import profile as prof
from adcorpus.operators import prompts as pr
from adcorpus.operators import sampling as smp
from adcorpus.operators.grid import RUN_COLUMNS, run_grid, scores_on_grid
from adcorpus.operators.answers import ANSWERED, LEDGER
from adcorpus.operators.inference import ANSWERS, batch_generate, token_budget_with
from adcorpus.operators.inference import generate_once as generate
from adcorpus.plans import bindings as b
from adcorpus.plans.evaluation import evaluate_categories, evaluate_salaries, scorable_prompts
from adcorpus.plans.formatting import FANOUT_COLUMNS, format_splits
from adcorpus.plans.ingest import add_lists, ingest, ingest_step, listed_so_far
from adcorpus.plans.ingest import answer_ingest as answer_pages
from adcorpus.plans.training import training_texts
from adcorpus.sources.readers import labelled_texts, read_results, salary_exemplars
from adcorpus.sources.schemas import EXTRACTION, JOB_AD, LIST_FIELDS, RESULT_KEYS
from adcorpus.sources.scratch import shared_dir
from adcorpus.sources.snapshots import Snapshots

Query = Callable[[SparkSession, str], DataFrame]

# What one message may hold: entries and bytes.
VOCABULARY_LIMITS = (100_000, 16 << 20)
EXEMPLAR_LIMITS = (1_000, 64 << 20)
# Turns per rendered part.
PART_TURNS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(b.TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def bound(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def _category_ads(spark: SparkSession, sf: str) -> DataFrame:
    return bound(table(spark, sf, "documents"), b.CATEGORY_ADS)


def _salary_ads(spark: SparkSession, sf: str) -> DataFrame:
    return bound(table(spark, sf, "part"), b.SALARY_ADS)


def _alternate_ads(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return bound(joined, b.ALTERNATE_ADS)


def _vocabulary(ads: DataFrame) -> DataFrame:
    return lab.label_vocabulary(ads, "category", *VOCABULARY_LIMITS)


def _category_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "category")
    complete = docs.where(text.is_present(F.col("text")) & text.is_present(F.col("category")))
    usable = complete.select(
        "doc_id",
        text.clean(F.col("text")).alias("text"),
        text.category_label(F.col("category")).alias("category"),
    )
    chosen = smp.one_per_label(usable, "category", "doc_id", "doc_id", max_labels=16)
    return pr.exemplar_turns(chosen, "first_pos", "text", "category", *EXEMPLAR_LIMITS)


def _salary_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    records = pr.salary_messages(_salary_ads(spark, sf), keep=["p_partkey"])
    # Formatted records always have both texts, so sampling may come first.
    chosen = smp.sample_k(records, 3, "p_partkey")
    chosen = smp.record_pairs(chosen, ["p_partkey"], "salary")
    return pr.exemplar_turns(chosen, "p_partkey", "text", "salary", *EXEMPLAR_LIMITS)


# --- prompts ---------------------------------------------------------------------------------


def category_prompts(spark: SparkSession, sf: str) -> DataFrame:
    ads = _category_ads(spark, sf)
    records = pr.category_messages(ads, _vocabulary(ads), keep=["doc_id"])
    return pr.explode_messages(records, ["doc_id"])


def category_prompts_fewshot(spark: SparkSession, sf: str) -> DataFrame:
    ads = _category_ads(spark, sf)
    records = pr.category_messages(
        ads,
        _vocabulary(ads),
        keep=["doc_id"],
        exemplars=_category_exemplars(spark, sf),
    )
    return pr.explode_messages(records, ["doc_id"])


def salary_prompts(spark: SparkSession, sf: str) -> DataFrame:
    records = pr.salary_messages(_salary_ads(spark, sf), keep=["p_partkey"])
    return pr.explode_messages(records, ["p_partkey"])


def salary_prompts_fewshot(spark: SparkSession, sf: str) -> DataFrame:
    records = pr.salary_messages(
        _salary_ads(spark, sf), keep=["p_partkey"], exemplars=_salary_exemplars(spark, sf)
    )
    return pr.explode_messages(records, ["p_partkey"])


def _alternate_records(spark: SparkSession, sf: str, exemplars: DataFrame | None) -> DataFrame:
    mapped = pr.map_alternate_schema(_alternate_ads(spark, sf), keep=["s_suppkey"])
    return pr.salary_messages(mapped, keep=["s_suppkey"], exemplars=exemplars)


def alt_schema_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return pr.explode_messages(_alternate_records(spark, sf, None), ["s_suppkey"])


def alt_schema_prompts_fewshot(spark: SparkSession, sf: str) -> DataFrame:
    records = _alternate_records(spark, sf, _salary_exemplars(spark, sf))
    return pr.explode_messages(records, ["s_suppkey"])


def merged_corpus(spark: SparkSession, sf: str) -> DataFrame:
    main = pr.salary_messages(_salary_ads(spark, sf), keep=["p_partkey"])
    alternate = _alternate_records(spark, sf, None)
    merged = pr.merge_variants(
        main=main.withColumnRenamed("p_partkey", "id"),
        alternate=alternate.withColumnRenamed("s_suppkey", "id"),
    )
    return pr.explode_messages(merged, ["variant", "id"])


def split_fanout(spark: SparkSession, sf: str) -> DataFrame:
    main = bound(
        table(spark, sf, "part"),
        {
            **b.SALARY_ADS,
            "id": "p_partkey",
            "description": "p_name || ' ' || p_brand",
            "category": "p_type",
            "split": b.SPLIT_OF_PART,
        },
    )
    joined = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    alternate = bound(
        joined, {**b.ALTERNATE_ADS, "id": "s_suppkey", "split": b.SPLIT_OF_SUPPLIER}
    )
    vocabulary = _vocabulary(main)
    zero = format_splits(main, alternate, vocabulary, keep=["id"])
    shots = _salary_exemplars(spark, sf)
    few = format_splits(main, alternate, vocabulary, salary_exemplars=shots, keep=["id"])
    formatted = zero.unionByName(few.where("shots = 'few'"))
    return pr.explode_messages(formatted, [*FANOUT_COLUMNS, "id"])


def chat_records(spark: SparkSession, sf: str) -> DataFrame:
    ads = _category_ads(spark, sf)
    records = pr.category_messages(ads, _vocabulary(ads), keep=["doc_id"])
    record = chat.chat_record(F.col("messages"), expected=chat.ground_truth(F.col("messages")))
    return records.select("doc_id", record.alias("r")).select(
        "doc_id",
        F.size("r.messages").cast("bigint").alias("n_messages"),
        F.col("r.expected").alias("expected"),
    )


def label_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").selectExpr(f"{b.MIXED_CASE_LANG} AS category")
    vocabulary = _vocabulary(docs)
    return vocabulary.select(
        F.posexplode("labels").alias("pos", "label"),
        lab.quoted_labels(F.col("labels")).alias("rendered"),
    ).select(F.col("pos").cast("bigint").alias("pos"), "label", "rendered")


# --- sampling --------------------------------------------------------------------------------


def sample_one_per_label(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return smp.one_per_label(docs, "source", "doc_id", "doc_id", max_labels=16)


def sample_one_per_every_label(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return smp.one_per_label(docs, "lang", "doc_id", "doc_id")


def sample_k(spark: SparkSession, sf: str) -> DataFrame:
    pairs = conv.last_user_assistant(table(spark, sf, "conversations"))
    return smp.sample_k(pairs, 3, "conv_id")


# --- conversations ---------------------------------------------------------------------------


def last_user_assistant(spark: SparkSession, sf: str) -> DataFrame:
    return conv.last_user_assistant(table(spark, sf, "conversations"))


def prompt_truth_split(spark: SparkSession, sf: str) -> DataFrame:
    return conv.prompt_truth_split(table(spark, sf, "conversations"))


def record_prompt_truth(spark: SparkSession, sf: str) -> DataFrame:
    records = pr.salary_messages(_salary_ads(spark, sf), keep=["p_partkey"])
    return scorable_prompts(records, ["p_partkey"]).withColumnRenamed("ground_truth", "truth")


def training_text_rows(spark: SparkSession, sf: str) -> DataFrame:
    records = pr.salary_messages(_salary_ads(spark, sf), keep=["p_partkey"])
    return training_texts(records, ["p_partkey"], max_tokens=40)


def valid_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    broken = rows.withColumn("text", F.when(F.col("role") != "system", F.col("text")))
    return conv.valid_conversations(broken)


def chat_render(spark: SparkSession, sf: str) -> DataFrame:
    return conv.render_conversations(table(spark, sf, "conversations"), PART_TURNS)


def chat_render_genprompt(spark: SparkSession, sf: str) -> DataFrame:
    return conv.render_conversations(
        table(spark, sf, "conversations"), PART_TURNS, generation_prompt=True
    )


def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", chat.budget(F.col("text")).alias("b")).select("doc_id", "b.*")


def conversation_budget(spark: SparkSession, sf: str) -> DataFrame:
    return conv.conversation_budget(table(spark, sf, "conversations"), max_tokens=128)


def token_budget_hook(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def build():
        def characters(texts: list[str], max_tokens: int) -> list[tuple[str, int]]:
            return [(t[:max_tokens], len(t)) for t in texts]

        return characters

    return token_budget_with(docs, build, "text", 512).drop("text")


def conversation_budget_hook(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        # a tokenizer of characters
        return lambda texts, n: [(t[:n], len(t)) for t in texts]

    return conv.conversation_budget_with(table(spark, sf, "conversations"), build, max_tokens=512)


# --- parsing and metrics ---------------------------------------------------------------------


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "source AS run", "lang AS truth", f"{b.ANSWERED_LANG} AS answer"
    )


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    answers = _answers(spark, sf)
    return lab.parse_category(answers, "answer", table(spark, sf, "documents"), "lang")


def parse_category(spark: SparkSession, sf: str) -> DataFrame:
    return met.flag_correct(_classified(spark, sf), "truth", "predicted").select(
        "doc_id", "answer", "predicted", "correct"
    )


def parse_category_large(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "documents").select("lang")
    return lab.parse_category(_answers(spark, sf), "answer", known, "lang").select(
        "doc_id", "predicted"
    )


def parse_salary(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "part").selectExpr("p_partkey", f"{b.ANSWERED_SALARY} AS answer")
    return answers.withColumn("predicted", text.parse_integer(F.col("answer")))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return met.confusion_counts(_classified(spark, sf), "truth", "predicted", ["run"])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = met.class_scores(_counts(spark, sf), ["run"])
    return _rounded(scores, "accuracy", "macro_f1", "weighted_f1")


def class_scores_overall(spark: SparkSession, sf: str) -> DataFrame:
    counts = met.confusion_counts(_classified(spark, sf), "truth", "predicted")
    return _rounded(met.class_scores(counts), "accuracy", "macro_f1", "weighted_f1")


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(met.class_report(_counts(spark, sf), ["run"]), "precision", "recall", "f1")


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return met.confusion_matrix(_counts(spark, sf), ["run"])


def confusion_cells(spark: SparkSession, sf: str) -> DataFrame:
    return met.confusion_cells(_counts(spark, sf), ["run"])


def evaluation_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Records to scores: prompts from labelled documents, answers, parsed and scored per run; one
    run has no adapter, and some documents have no label, so no truth."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    generations = docs.selectExpr(
        "CASE WHEN source < 'src5' THEN 'm1' ELSE 'm2' END AS model",
        "CASE WHEN lang = 'en' THEN NULL ELSE lang END AS adapter",
        "'docs' AS test_tag",
        "CAST(quality AS STRING) AS ground_truth",
        "CASE WHEN n_chars % 3 = 0 THEN ' 1 ' WHEN n_chars % 3 = 1 THEN '0' ELSE 'x' END AS generated_text",
    )
    known = table(spark, sf, "labels").selectExpr("CAST(quality AS STRING) AS label")
    return evaluate_categories(generations, known, dense=True)["matrix"]


def salary_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Records, prompts, batched generation, parsed amounts and scores in one job."""
    records = pr.salary_messages(_salary_ads(spark, sf), keep=["p_partkey", "contract_type"])
    prompts = scorable_prompts(records, ["contract_type"]).selectExpr(
        "'echo' AS model", "CAST(NULL AS STRING) AS adapter", "contract_type AS test_tag",
        "prompt", "ground_truth",
    )

    def build():
        # A stand-in model: the length of the prompt as a salary.
        return lambda texts: [f"about {len(t) * 4} triệu" for t in texts]

    scores = evaluate_salaries(batch_generate(prompts, build))["scores"]
    return _rounded(scores, *SCORE_COLUMNS)


def label_universe(spark: SparkSession, sf: str) -> DataFrame:
    universe = met.label_universe(_counts(spark, sf), ["run"])
    return universe.select(
        "run",
        "label",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("n_labels").cast("bigint").alias("n_labels"),
    )


def _salary_answers(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"
    )
    joined = lines.join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    stated = joined.selectExpr(
        "l_returnflag AS model",
        "l_linestatus AS adapter",
        "p_type AS test_tag",
        f"{b.TRUE_SALARY} AS truth_text",
        f"{b.GUESSED_SALARY} AS answer",
    )
    return stated.select(
        *RUN_COLUMNS,
        text.parse_integer(F.col("truth_text")).alias("truth"),
        text.parse_integer(F.col("answer")).alias("pred"),
    )


SCORE_COLUMNS = ("mape", "r2", "mae", "rmse", "coverage")


def regression_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        met.regression_scores(_salary_answers(spark, sf), "truth", "pred"), *SCORE_COLUMNS
    )


def run_grid_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    grid = run_grid(
        lines.select("l_returnflag"), lines.select("l_linestatus"),
        table(spark, sf, "part").select("p_type"), max_choices=1000,
    )
    scores = met.regression_scores(_salary_answers(spark, sf), "truth", "pred", RUN_COLUMNS)
    return _rounded(scores_on_grid(grid, scores), *SCORE_COLUMNS)


# --- frontier and pages ----------------------------------------------------------------------


def _frontier(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    pages = table(spark, sf, "pages").where(where)
    return pages.selectExpr(f"{b.PAGE_SOURCE} AS source", "page_id AS pos", "url")


def _results(spark: SparkSession, sf: str, where: str) -> DataFrame:
    """Earlier results; half of them carry their URL inside the raw answer."""
    pages = table(spark, sf, "pages").where(where)
    raw = "'{\"url\": \"' || url || '\"}'"
    return pages.selectExpr(
        f"{b.PAGE_SOURCE} AS source",
        f"CASE WHEN {b.PAGE_FETCHED} THEN url END AS url",
        f"CASE WHEN {b.PAGE_FETCHED} THEN NULL ELSE {raw} END AS raw_response",
    )


def distinct_urls(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "pages").selectExpr(
        f"{b.PAGE_SOURCE} AS source", "page_id AS pos", f"{b.PAGE_HOST} AS url"
    )
    return fr.distinct_urls(hosts)


def pending_urls(spark: SparkSession, sf: str) -> DataFrame:
    done = fr.done_urls(_results(spark, sf, b.PAGE_DONE))
    return fr.pending_urls(_frontier(spark, sf), done)


def stale_results(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf, "true")
    listed = _frontier(spark, sf, b.PAGE_LISTED)
    kept = fr.keep_listed(results, listed).withColumn("status", F.lit("kept"))
    stale = fr.stale_results(results, listed).withColumn("status", F.lit("stale"))
    both = kept.unionByName(stale)
    return both.select("source", fr.result_url(both).alias("url"), "status")


def frontier_progress(spark: SparkSession, sf: str) -> DataFrame:
    done = fr.done_urls(_results(spark, sf, b.PAGE_DONE))
    return fr.frontier_progress(_frontier(spark, sf), done, percent=30)


def quota_take(spark: SparkSession, sf: str) -> DataFrame:
    # one aggregate on (source, url) gives what is pending and what the quota leaves
    state = fr.url_state(_frontier(spark, sf), _results(spark, sf, b.PAGE_DONE))
    pending = state.where("listed AND NOT done").select("source", "url", "pos")
    return fr.quota_take(pending, fr.state_progress(state, percent=60), success=F.expr(b.PAGE_FETCHED))


def resume_ingest(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    listed = _frontier(spark, sf, b.PAGE_LISTED)
    results = _results(spark, sf, b.PAGE_DONE)
    kept, fresh = ingest_step(listed, results, pages, percent=80)
    return kept.select(
        "source", fr.result_url(kept).alias("url"), F.lit("kept").alias("status"),
        F.lit(None).cast("string").alias("job_title"),
    ).unionByName(
        fresh.select(
            "source", "url", F.lit("new").alias("status"), F.col("record.job_title")
        )
    )


def _fresh_store(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def snapshot_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results added, taken back and added again; a commit may do both at once."""
    store = Snapshots(spark, _fresh_store(spark))
    rows = table(spark, sf, "pages").selectExpr(
        "page_id", f"{b.PAGE_SOURCE} AS source", "url", "CAST(page_id AS STRING) AS raw_response"
    )

    def staged(where: str, name: str, version: int) -> str:
        chosen = rows.where(where)
        if name == "results":
            record = F.lit(None).cast(EXTRACTION["record"].dataType).alias("record")
            noted = F.concat_ws(" ", F.lit(f"v{version}"), "raw_response").alias("raw_response")
            return store.stage(chosen.select("source", "url", record, noted), name, version)
        return store.stage(chosen.select(*RESULT_KEYS), name, version)

    store.commit(1, {"results": [staged("page_id % 3 <> 0", "results", 1)]})
    store.commit(2, {
        "results": [staged("page_id % 3 = 0", "results", 2)],
        "results_removed": [staged("page_id % 2 = 0", "results_removed", 2)],
    })
    store.commit(3, {"results": [staged("page_id % 10 = 0 AND page_id % 3 <> 0", "results", 3)]})
    return store.visible("results", EXTRACTION, RESULT_KEYS).select("source", "url", "raw_response")


def batched_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Lists that come in two batches, one of them twice, under one quota per source."""
    path = _fresh_store(spark)
    pages = table(spark, sf, "pages")
    for batch in (0, 1, 0):
        lines = pages.where(F.col("page_id") % 2 == batch).selectExpr(
            f"{b.PAGE_SOURCE} AS source", "'list' AS file", "page_id AS pos", "url"
        )
        add_lists(spark, lines, f"batch {batch}", path)
        ingest(spark, listed_so_far(spark, path), pages, path, percent=40, newest_by="page_id")
    return read_results(spark, path).select("source", "url", F.col("record.job_title").alias("job_title"))


def answer_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier results pruned, pending pages answered by a stand-in model: some prompts always
    fail, some at the first attempt, some answers hold no JSON. Kept, new and failed URLs."""
    store = Snapshots(spark, _fresh_store(spark))
    pages = table(spark, sf, "pages")
    earlier = _results(spark, sf, b.PAGE_DONE).withColumn("record", F.lit(None).cast(EXTRACTION["record"].dataType))
    store.commit(1, {"results": [store.stage(earlier.select(*EXTRACTION.names), "results", 1)]})

    def build():
        seen: set[str] = set()

        def answer(prompts: list[str]) -> list[str | None]:
            out: list[str | None] = []
            for p in prompts:
                n = len(p)
                fails = n % 7 == 0 or (n % 5 == 0 and p not in seen)
                seen.add(p)
                body = f'{{"job_title": "T{n}", "url": "x", "experience_required": {n % 10}}}'
                text = f"about {n}" if n % 3 == 0 else f"Here:\n```json\n{body}\n```"
                out.append(None if fails else text)
            return out

        return answer

    listed = _frontier(spark, sf, b.PAGE_LISTED)
    answer_pages(spark, listed, pages, build, store.path, percent=80, newest_by="page_id")
    results = read_results(spark, store.path)
    tries = store.read("ledger", LEDGER).groupBy("source", "url").agg(
        F.max("attempt").cast("bigint").alias("n_attempts"), F.max(F.col("outcome") == ANSWERED).alias("answered")
    )
    rows = results.select("source", fr.result_url(results).alias("url"), "record", "raw_response")
    rows = rows.join(tries.drop("answered"), ["source", "url"], "left")
    status = F.when(F.col("n_attempts").isNull(), "kept").when(F.col("record").isNotNull(), "record").otherwise("raw")
    done = rows.select(
        "source", "url", status.alias("status"), "n_attempts", F.col("record.job_title").alias("job_title"),
        F.col("record.experience_required").alias("experience_required"),
        F.when(F.col("n_attempts").isNotNull(), F.col("raw_response")).alias("raw_response"),
    )
    failed = tries.where(~F.col("answered")).select("source", "url", F.lit("failed").alias("status"), "n_attempts")
    return done.unionByName(failed, allowMissingColumns=True)


def posting_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Job pages that state all fields, in a JSON script or as label/value markup."""
    # a page is many times its part's row, and one row group holds a million of these
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pages = table(spark, sf, "part").repartition(tasks).selectExpr(
        "p_partkey", f"{b.STATED_URL} AS url", f"{b.posting_page(pg.PAIR_LABELS)} AS html"
    )
    fields = pg.page_fields(pages, keep=["p_partkey"])
    columns = [
        F.array_join(f"record.{n}", "|").alias(n) if n in LIST_FIELDS else F.col(f"record.{n}")
        for n in JOB_AD.names
    ]
    return fields.select("p_partkey", *columns)


def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return with_markdown(table(spark, sf, "pages").select("page_id", "html")).drop("html")


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = pg.page_fields(table(spark, sf, "pages"), keep=["page_id"])
    columns = [
        F.array_join(f"record.{n}", "|").alias(n) if n in LIST_FIELDS else F.col(f"record.{n}")
        for n in JOB_AD.names
    ]
    return fields.select("page_id", *columns)


def extraction_prompt(spark: SparkSession, sf: str) -> DataFrame:
    pages = with_markdown(table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", pg.extraction_prompt(F.col("markdown")).alias("prompt"))


def fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").selectExpr("event_id", f"{b.ANSWERED_JSON} AS answer")
    return pg.answered_json(events, "answer").select("event_id", "json")


def record_or_raw(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").selectExpr(
        "event_id", "'https://e.example/' || CAST(user_id AS STRING) AS url",
        f"{b.ANSWERED_JSON} AS answer",
    )
    schema = "k bigint, url string"
    rows = pg.record_or_raw(events, "answer", ["event_id"], spark.createDataFrame([], schema).schema)
    return rows.select(
        "event_id", "url", F.col("record.k").alias("k"),
        F.col("record.url").alias("record_url"), "raw_response",
    )


def typed_parse_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type")
    events = events.selectExpr("event_id", f"{b.AD_JSON} AS ad")
    rows = pg.typed_parse(events, "ad", ["event_id"])
    return rows.select(
        "event_id",
        F.col("record.job_title").alias("job_title"),
        F.col("record.url").alias("url"),
        F.col("record.experience_required").alias("experience_required"),
        F.array_join("record.qualifications", "|").alias("qualifications"),
        F.array_join("problems", ",").alias("problems"),
        (F.size("problems") == 0).alias("valid"),
    )


# --- literals, profile, generation -----------------------------------------------------------


def list_literal(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").selectExpr("p_partkey", f"{b.LIST_TEXT} AS cell")
    parsed = parts.withColumn("items", text.list_literal(F.col("cell")))
    return parsed.select(
        "p_partkey",
        F.when(F.col("items").isNotNull(), F.size("items").cast("bigint")).alias("n_items"),
        F.array_join("items", "|").alias("items"),
    )


def salary_range(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").selectExpr("p_partkey", f"{b.RANGE_TEXT} AS cell")
    return parts.withColumn("r", text.salary_range(F.col("cell"))).select("p_partkey", "r.*")


def labelled_text_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").selectExpr(
        "CASE WHEN source = 'src1' THEN '' WHEN source = 'src2' THEN ' ' ELSE text END AS text",
        "text AS description", "upper(lang) AS category",
    )
    return labelled_texts(docs)


def salary_exemplar_rows(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").selectExpr(
        "' ' || p_name AS text", f"CASE WHEN p_type = 'PROMO' THEN ' ' ELSE {b.RANGE_TEXT} END AS salary"
    )
    return salary_exemplars(parts)


def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("text", "source", "lang")
    return _rounded(prof.corpus_profile(docs, "text", "source", "lang"), "avg_words")


def corpus_profile_period(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return _rounded(
        prof.corpus_profile(events, "props", "user_id", "event_type", "ts"), "avg_words"
    )


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rated = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    label = F.concat_ws("/", F.col("lang"), F.col("quality").cast("string"))
    return _rounded(prof.label_distribution(rated.select(label.alias("l")), "l"), "share")


def salary_value_range(spark: SparkSession, sf: str) -> DataFrame:
    ranges = salary_range(spark, sf)
    return prof.value_range(ranges, "salary_min", "salary_max")


def generate_batches(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))

    def build():
        return lambda prompts: [f"{len(p)} characters" for p in prompts]

    return batch_generate(docs, build).drop("prompt")


def generate_once(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over one store: the second asks nothing, and equal texts were asked once."""
    path = _fresh_store(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))

    def build():
        return lambda prompts: [f"{len(p)} characters" for p in prompts]

    def refuse():
        raise ValueError("everything has been answered")

    generate(docs.where("doc_id % 2 = 0"), build, path, "r1", commits=2)
    generate(docs, build, path, "r1")
    rows = generate(docs, refuse, path, "r1").drop("prompt")
    n = Snapshots(spark, path).read("answers", ANSWERS).agg(F.count(F.lit(1)).alias("n_answers"))
    return attach(rows, "n_answers", n)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        category_prompts, category_prompts_fewshot, salary_prompts, salary_prompts_fewshot,
        alt_schema_prompts, alt_schema_prompts_fewshot, merged_corpus, split_fanout,
        chat_records, label_vocabulary, sample_one_per_label, sample_one_per_every_label,
        sample_k, last_user_assistant, prompt_truth_split, record_prompt_truth,
        training_text_rows,
        valid_conversations, chat_render, chat_render_genprompt, token_budget,
        conversation_budget, conversation_budget_hook, token_budget_hook, parse_category, parse_category_large,
        parse_salary, class_scores, class_scores_overall, class_report, confusion_matrix,
        confusion_cells, evaluation_runs, salary_end_to_end,
        label_universe, regression_scores, run_grid_scores, distinct_urls, pending_urls,
        stale_results, frontier_progress, quota_take, resume_ingest, snapshot_results,
        batched_ingest, answer_ingest, posting_fields, html_to_markdown,
        page_fields, extraction_prompt, fenced_json, record_or_raw, typed_parse_quarantine,
        list_literal, salary_range, labelled_text_rows, salary_exemplar_rows, corpus_profile,
        corpus_profile_period, label_distribution, salary_value_range, generate_batches, generate_once,
    )
}
