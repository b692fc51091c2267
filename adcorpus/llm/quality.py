"""Quality rules by distribution divergence.

Every document is compared with a reference of its language, counted over all documents of that
language: the shares of character classes, and the shares of the language's most common words with
all other words as one more entry. The measure is the Jensen-Shannon distance (base 2, 0 to 1).
Shouting, tables, code or one word repeated lie far from the reference of any prose.

A short text lies far from every reference by chance: k shares estimated from n draws diverge by
about (k - 1) / (8 n ln 2). That much is forgiven before the distance is taken, and below a least
number of draws no verdict is given at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adcorpus.llm.common import as_text, documents, written

WORD, BLANK, SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]+"
#: Disjoint classes in the order in which they are taken out of a text; what is left is the last.
CLASSES = (r"[a-z]+", BLANK, r"[A-Z]+", r"[.,;:!?'\x22()-]+", r"[0-9]+", SYMBOL, r"[\x00-\x7F]+")
#: What lies between the terms of the word histogram, after lower-casing.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
#: Words of a reference.
COMMON = 32
#: A language has its own reference from this share of all terms (so there are at most 1000
#: references) and from this many terms; all others are held against all documents together.
REF_SHARE, REF_TERMS = 0.001, 1000
#: The guards: characters and terms from which the distances count.
MIN_CHARS, MIN_TERMS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.33
POOLED = "*"
REFERENCE = ("classes", "words", "shares")


def class_counts(text: Column) -> Column:
    """An array of code points per class. Each pass sees only what the ones before left."""
    rest, out = text, []
    for pattern in CLASSES:
        left = F.regexp_replace(rest, pattern, "")
        out.append(F.length(rest) - F.length(left))
        rest = left
    return F.array(*out, F.length(rest)).cast("array<bigint>")


def terms_of(text: Column) -> Column:
    """The lower-case terms of a text."""
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def window_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the array, first ones included.

    Most texts repeat no window: where all hashes of windows differ, nothing is sorted. Else hashes
    are sorted with their places, so that equal ones are neighbours, which are compared word by
    word; a word is counted with the last repeated window that holds it.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def twice(ordered: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            i, y = x["i"], F.get(ordered, j)
            equal = x["h"] == y["h"]
            for k in range(3):
                equal = equal & (F.get(words, i + k) == F.get(words, y["i"] + k))
            return F.coalesce(equal, F.lit(False))

        hits = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.array_sort(F.transform(hits, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def counted(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = F.transform(F.transform(F.array(ordered), twice), covered)[0]
        return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(found)

    # a one-element array binds its value to a name, so that it is computed once per row
    return F.when(F.size(words) > 3, F.transform(F.array(hashes), counted)[0]).otherwise(0).cast("bigint")


def word_rules(text: Column) -> Column:
    """``struct<n_words, n_repeat_words>`` of a text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(
        F.array(words),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), window_words(w).alias("n_repeat_words")),
    )[0]


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("bigint")


def references(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", common: int = COMMON
) -> DataFrame:
    """(ref, classes, words, shares): one row per language that has enough terms, and one for all
    documents. ``shares`` has one entry more than ``words``: all other words."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), as_text(text_col).alias("text"))
    n = len(CLASSES) + 1
    classes = rows.select("lang", class_counts(F.col("text")).alias("c")).groupBy("lang").agg(
        *[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(n)]
    )
    terms = rows.select("lang", F.explode(terms_of(F.col("text"))).alias("word"))
    counts = written(terms.groupBy("lang", "word").agg(F.count("*").alias("n")), "terms")
    classes = written(classes, "classes")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("total")), "term-totals")
    everything = totals.agg(F.sum("total")).scalar()
    own = totals.where((F.col("total") >= REF_TERMS) & (F.col("total") >= REF_SHARE * everything))
    pooled = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("ref"), "word", "n")
    each = counts.join(F.broadcast(own.select("lang")), "lang").select(F.col("lang").alias("ref"), "word", "n")
    order = Window.partitionBy("ref").orderBy(F.desc("n"), "word")
    # the limit on the row number is applied before rows are shuffled, so a language sends few
    top = each.union(pooled).withColumn("k", F.row_number().over(order)).where(F.col("k") <= common)
    top = top.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    sums = own.select(F.col("lang").alias("ref"), "total").union(
        totals.agg(F.sum("total").alias("total")).select(F.lit(POOLED).alias("ref"), "total")
    )
    parts = classes.select(F.col("lang").alias("ref"), *[f"c{k}" for k in range(n)])
    parts = parts.union(
        classes.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]).select(F.lit(POOLED).alias("ref"), "*")
    )
    chars = sum((F.col(f"c{k}") for k in range(1, n)), F.col("c0"))
    found = F.aggregate("top", F.lit(0).cast("bigint"), lambda a, t: a + t["n"])
    shares = F.concat(
        F.transform("top", lambda t: t["n"] / F.col("total")), F.array((F.col("total") - found) / F.col("total"))
    )
    return top.join(sums, "ref").join(parts, "ref").select(
        "ref",
        F.array(*[F.col(f"c{k}") / chars for k in range(n)]).alias("classes"),
        F.transform("top", lambda t: t["word"]).alias("words"),
        shares.alias("shares"),
    )


def divergence(counts: Column, shares: Column, total: Column) -> Column:
    """Jensen-Shannon divergence in bits between counts / total and shares of equal length."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / ((a + b) / 2))).otherwise(0.0)

    terms = F.zip_with(counts, shares, lambda n, q: part(n / total, q) + part(q, n / total))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2


def added(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, b: a + b)


def distance(counts: Column, shares: Column, least: int) -> Column:
    """The distance after chance is forgiven; null where fewer than ``least`` draws were counted.
    ``counts`` is used several times, so it is to be a column of an earlier projection."""
    total = added(counts)
    chance = (F.size(shares) - 1) / (8 * math.log(2) * total)
    apart = F.sqrt(F.greatest(F.lit(0.0), divergence(counts, shares, total) - chance))
    return F.when(total >= least, F.round(apart, 6))


def word_counts(text: Column, words: Column) -> Column:
    """How often each of ``words`` occurs among the terms, and how often others do. Terms longer
    than any of them are left out before they are looked for."""

    def count(terms: Column) -> Column:
        longest = F.array_max(F.transform(words, lambda w: F.length(w)))
        short = F.transform(F.array(longest), lambda m: F.filter(terms, lambda t: F.length(t) <= m))[0]
        hits = F.transform(
            F.array(short),
            lambda s: F.transform(words, lambda w: (F.size(s) - F.size(F.array_remove(s, w))).cast("bigint")),
        )[0]
        with_rest = F.transform(F.array(hits), lambda h: F.concat(h, F.array(F.size(terms) - added(h))))
        return with_rest[0]

    return F.transform(F.array(terms_of(text)), count)[0]


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    common: int = COMMON,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, reference,
    char_distance, word_distance and kept.

    Null text is empty; an empty text fails the base rules for want of words. A distance is null
    where the text has too few characters or terms, and then does not speak against the text; nor
    does one equal to its limit. Null languages are one language. Words equally common are taken in
    order of the alphabet. Texts count whole, of any length. Repeated rows get equal results and
    count as often as they are there. An empty table gives an empty result; other columns are not
    read.
    """
    refs = written(references(docs, lang_col, text_col, common), "references")
    pooled = refs.where(F.col("ref") == POOLED)
    own = refs.where(F.col("ref") != POOLED)
    # at most 1 / REF_SHARE rows of ``common`` words each
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text")
    ).join(F.broadcast(own), F.col("lang") == F.col("ref"), "left")
    rows = rows.withColumns({name: F.coalesce(F.col(name), pooled.select(name).scalar()) for name in REFERENCE})
    text = as_text()
    rows = rows.select(
        "doc_id",
        word_rules(text).alias("_words"),
        F.length(text).alias("_length"),
        duplicate_lines(text).alias("n_dup_lines"),
        F.coalesce("ref", F.lit(POOLED)).alias("reference"),
        class_counts(text).alias("_chars"),
        word_counts(text, F.col("words")).alias("_terms"),
        "classes",
        "shares",
    )
    counted = rows.select(
        "doc_id",
        "_words.n_words",
        (F.col("_length") - F.col("_chars")[CLASSES.index(BLANK)]).alias("word_chars"),
        F.col("_chars")[CLASSES.index(SYMBOL)].alias("n_symbols"),
        "n_dup_lines",
        "_words.n_repeat_words",
        "reference",
        distance(F.col("_chars"), F.col("classes"), MIN_CHARS).alias("char_distance"),
        distance(F.col("_terms"), F.col("shares"), MIN_TERMS).alias("word_distance"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance
    )
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def _op11_sql() -> str:
    rest, steps = "t", []
    for pattern in CLASSES:
        left = f"regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
        steps.append(f"length({rest}) - length({left})")
        rest = left
    classes = ", ".join([*steps, f"length({rest})"])
    n = len(CLASSES) + 1
    sums = ", ".join(f"sum(h[{k}])" for k in range(1, n + 1))

    def jsd(counts: str, shares: str, least: int) -> str:
        p, q = f"({counts}[i] / list_sum({counts}))", f"{shares}[i]"
        m = f"(({p} + {q}) / 2)"
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / {1}) ELSE 0.0 END"
        total = f"list_sum({counts})"
        terms = f"list_sum([{part.format(p, m)} + {part.format(q, m)} for i in range(1, len({shares}) + 1)]) / 2"
        chance = f"(len({shares}) - 1) / (8 * {math.log(2)!r}::DOUBLE * {total})"
        return f"CASE WHEN {total} >= {least} THEN round(sqrt(greatest(0.0, {terms} - {chance})), 6) END"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS ws FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
rep AS (SELECT r, count(DISTINCT i + o) AS n_repeat FROM grams, range(3) AS s(o) WHERE n > 1 GROUP BY r),
c AS (SELECT r, lang, [{classes}] AS h, regexp_extract_all(lower(t), '[^\x00-\x60\x7B-\x7F]+') AS terms FROM d),
n AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(terms) AS word FROM c) GROUP BY ALL),
tot AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
own AS (SELECT * FROM tot WHERE total >= {REF_TERMS} AND total >= {REF_SHARE} * (SELECT sum(total) FROM tot)),
cnt AS (SELECT lang AS ref, word, n, total FROM n JOIN own USING (lang) UNION ALL
  SELECT '{POOLED}', word, sum(n), (SELECT sum(total) FROM tot) FROM n GROUP BY word),
top AS (SELECT ref, word, n, total FROM cnt QUALIFY row_number() OVER (PARTITION BY ref ORDER BY n DESC, word) <= {COMMON}),
wr AS (SELECT ref, list(word ORDER BY n DESC, word) AS words,
  list_append(list(n / total ORDER BY n DESC, word), (any_value(total) - sum(n)) / any_value(total)) AS shares FROM top GROUP BY ref),
cs AS (SELECT lang AS ref, [{sums}] AS s FROM c GROUP BY lang UNION ALL SELECT '{POOLED}', [{sums}] FROM c),
refs AS (SELECT ref, words, shares, [x / list_sum(s) for x in s] AS classes FROM wr JOIN cs USING (ref)),
m AS (SELECT c.r, ref, h, classes, shares, words, terms
  FROM c JOIN refs ON ref = CASE WHEN lang IN (SELECT lang FROM own) THEN lang ELSE '{POOLED}' END),
hits AS (SELECT r, list_transform(words, lambda x: len(list_filter(terms, lambda y: y = x))) AS k, len(terms) AS total FROM m),
f AS (SELECT m.r, ref, h, classes, shares, list_append(k, total - coalesce(list_sum(k), 0)) AS counts FROM m JOIN hits USING (r)),
o AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '{SYMBOL}', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
    - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
  coalesce(n_repeat, 0) AS n_repeat_words, ref AS reference,
  {jsd('h', 'classes', MIN_CHARS)} AS char_distance, {jsd('counts', 'shares', MIN_TERMS)} AS word_distance
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) JOIN f USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM o
"""


OP11_SQL = _op11_sql()
