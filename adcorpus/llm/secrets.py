"""Secrets: known shapes, and strings that look random to a character model.

Two Markov models of characters, one of random strings and one of ordinary identifiers, are
trained on strings of this corpus that the base rules label: values of base matches on one side,
words outside them on the other, from a bounded number of documents. A token is a secret when its
log-likelihood ratio between the models is high enough. Everything is column expressions: one pass
over the texts leaves spans and candidate tokens, and the model is a table of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.llm.common import as_text, documents, written
from adcorpus.llm.spans import SPAN, joined, masked, none, spans_of

# The base patterns, kinds in order.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: Strings that are judged. Below 16 characters dates, numbers and names with digits reach the
#: likelihood ratios of random strings, so shorter ones are left to the base rules.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
#: Documents (not strings) from which strings are taken for training, at most, on either side.
MAX_TRAINING = 2000
#: A token's log-likelihood ratio, in nats: in total and per character.
MIN_TOTAL, MIN_MEAN = 8.0, 0.4
#: Characters of the models: ASCII, 0 before the first.
ALPHABET = 128


def long_value(hit: Column) -> Column:
    """An assignment whose value has 8 characters or more."""
    return F.length(F.regexp_extract(hit, ASSIGN, 1)) >= 8


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    low = F.lower(text)
    keyed = (
        low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key")
        | low.contains("apikey")
    )
    assign = F.filter(
        spans_of(text, ASSIGN, "assign", 0),
        lambda s: long_value(s["value"]),
    )
    access = F.filter(spans_of(text, ACCESS, "access", 1), lambda s: F.length(s["value"]) >= 16)
    # runs of 32 and more are the long ones among all maximal runs
    hexes = spans_of(text, r"[0-9a-f]{32,}", "hex", 2)
    return (
        F.when(keyed, assign).otherwise(none()),
        F.when(text.contains("AKIA"), access).otherwise(none()),
        F.when(text.rlike("[0-9a-f]{32}"), hexes).otherwise(none()),
    )


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, assign, access, hex, tokens) per row; texts stay behind."""
    text = as_text("text")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # outside the base matches: what is left of a longer string is judged by itself
    rest = masked(masked(masked(text, ASSIGN, long_value), ACCESS, lambda h: F.length(h) >= 16), r"[0-9a-f]{32,}")
    tokens = F.when(text.rlike(TOKEN), spans_of(rest, TOKEN, "random", 3)).otherwise(none())
    assign, access, hexes = base_spans(text)
    return rows.select(
        "doc_id",
        F.xxhash64("doc_id", text).alias("key"),
        assign.alias("assign"),
        access.alias("access"),
        hexes.alias("hex"),
        F.filter(tokens, lambda s: ~s["value"].rlike("^[0-9]+$")).alias("tokens"),
    )


def secret_values(assign: Column, others: Column) -> Column:
    named = F.transform(assign, lambda s: F.regexp_extract(s["value"], ASSIGN, 1))
    return F.concat(named, F.transform(others, lambda s: s["value"]))


def characters(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))


def bigrams(value: Column) -> Column:
    """Codes previous * ALPHABET + current of a string, the first after 0."""
    codes = F.concat(F.array(F.lit(0)), characters(value))
    return F.transform(
        F.sequence(F.lit(1), F.size(codes) - 1),
        lambda i: F.get(codes, i - 1) * ALPHABET + F.get(codes, i),
    )


def markov_ratio(scan: DataFrame, docs: DataFrame, id_col: str, text_col: str, pull: float = 16.0) -> DataFrame:
    """One row (ratio array<double>): log P(random) - log P(ordinary) of each character after each
    other, indexed previous * ALPHABET + current. No row content depends on the number of
    documents beyond ``MAX_TRAINING`` on each side. Without labelled strings the array is null."""
    found = F.size("assign") + F.size("access") + F.size("hex") > 0
    random = (
        scan.where(found)
        .orderBy("key")
        .limit(MAX_TRAINING)
        .select(F.explode(secret_values(F.col("assign"), F.concat("access", "hex"))).alias("value"))
    )
    chosen = scan.select("key").distinct().orderBy("key").limit(MAX_TRAINING)
    texts = docs.select(
        as_text(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("bigint"), as_text(text_col)).alias("key"),
    ).join(F.broadcast(chosen), "key", "left_semi")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), r"[0-9a-f]{32,}", " ")
    ordinary = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))).alias("value"))
    # numbers are no identifiers, and a string that is to be judged tells nothing about words
    ordinary = ordinary.where(F.col("value").rlike("[A-Za-z]") & ~F.col("value").rlike(TOKEN))
    strings = random.withColumn("r", F.lit(1)).union(ordinary.withColumn("r", F.lit(0)))
    counts = (
        strings.select("r", F.explode(bigrams(F.col("value"))).alias("code"))
        .groupBy("code")
        .agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("o"))
    )
    counts = written(counts, "bigrams")
    counts = counts.select("code", "r", "o", F.floor(F.col("code") / ALPHABET).alias("before"), (F.col("code") % ALPHABET).alias("char"))
    cells = docs.sparkSession.range(ALPHABET * ALPHABET).select(F.col("id").cast("int").alias("code"))
    cells = cells.select("code", F.floor(F.col("code") / ALPHABET).alias("before"), (F.col("code") % ALPHABET).alias("char"))
    cells = cells.join(counts.select("code", "r", "o"), "code", "left")
    for side, name in (("before", "of"), ("char", "as")):
        sums = counts.groupBy(side).agg(F.sum("r").alias(f"r_{name}"), F.sum("o").alias(f"o_{name}"))
        cells = cells.join(sums, side, "left")
    totals = counts.agg(F.sum("r").alias("r"), F.sum("o").alias("o"))
    cells = cells.na.fill(0)

    def share(n: str) -> Column:
        """Log of a bigram's share, drawn towards its character's overall share."""
        whole = F.coalesce(totals.select(n).scalar(), F.lit(0))
        single = (F.col(f"{n}_as") + 0.5) / (whole + 0.5 * ALPHABET)
        return F.log((F.col(n) + pull * single) / (F.col(f"{n}_of") + pull))

    cells = cells.select("code", "r", "o", (share("r") - share("o")).alias("ratio"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("code", "ratio"))), lambda c: c["ratio"])
    usable = (F.sum("r") > 0) & (F.sum("o") > 0)
    return cells.agg(F.when(usable, ordered).alias("ratio"))


def log_ratio(value: Column, ratio: Column) -> Column:
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        characters(value),
        start,
        lambda s, c: F.struct(c.alias("before"), (s["sum"] + F.get(ratio, s["before"] * ALPHABET + c)).alias("sum")),
        lambda s: s["sum"],
    )


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, random) per row: arrays of spans."""
    scan = written(scanned(docs, id_col, text_col), "secrets")
    ratio = written(markov_ratio(scan, docs, id_col, text_col), "markov").scalar()
    rows = scan.select("doc_id", "assign", "access", "hex", "tokens", ratio.alias("ratio"))

    def secret(t: Column) -> Column:
        total = log_ratio(t["value"], F.col("ratio"))
        return F.coalesce((total >= MIN_TOTAL) & (total >= MIN_MEAN * F.length(t["value"])), F.lit(False))

    some = F.when(F.size("tokens") > 0, F.filter("tokens", secret)).otherwise(none())
    return rows.select("doc_id", "assign", "access", "hex", some.cast(SPAN).alias("random"))


def secret_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (of the joined
    base spans), spans (all of them, joined) and n_random.

    Null counts as empty: no spans. Whole texts are searched, of any length; repeated rows give
    repeated results; a null doc_id stays null. Without base matches to train on, no spans are
    added. Strings of less than 16 characters outside the base matches are not judged. An empty table gives an empty result; other columns are not read.
    """
    found = found_spans(docs, id_col, text_col)
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "random")).alias("spans"),
        F.size("random").cast("bigint").alias("n_random"),
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end, value; edge cases as in secret_summary."""
    found = found_spans(docs, id_col, text_col)
    spans = F.explode(F.array_sort(F.concat("assign", "access", "hex", "random"))).alias("s")
    return found.select("doc_id", spans).select("doc_id", "s.kind", "s.start", "s.end", "s.value")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_summary(documents(spark, sf_dir))
