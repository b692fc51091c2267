"""Column helpers for text cells: cleaning, labels, numbers and literals found in text.

All of them are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from adcorpus.constants import PANDAS_NA_WORDS, SALARY_UNIT, WHITESPACE, WHITESPACE_CLASS

TOKEN = f"[^{WHITESPACE_CLASS}]+"
FENCED_JSON = r"(?s)```json\n(.*?)\n```"
INTEGER_TOKEN = (
    f"(?:^|[{WHITESPACE_CLASS}])([+-]?[0-9]+(?:_[0-9]+)*)(?:[{WHITESPACE_CLASS}]|\\z)"
)
SALARY_RANGE = r"([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    Inside branches and lambdas an expression named twice is computed twice, and nested ones 2 ** depth
    times.
    """
    return F.transform(F.array(c), use)[0]


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.get(F.filter(F.array(c), lambda v: v != ""), 0)


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace.

    A trim with an explicit character set only looks at the ends of the value; a regular
    expression would walk through the whole text.
    """
    return F.trim(c, F.lit(WHITESPACE))


def tokens(c: Column) -> Column:
    """Whitespace tokens of the whole text."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("bigint")


def clean(c: Column, null_policy: str = "drop") -> Column:
    """Cast to string and strip.

    ``drop`` turns a missing cell into ``''``, which the required-field filters remove.
    ``nan_text`` turns it into the text ``nan``, as a pandas reader followed by ``str`` does;
    there a cell holding one of pandas' missing-value words counts as missing too.
    """
    text = c.cast("string")
    if null_policy == "drop":
        return F.coalesce(strip(text), F.lit(""))
    if null_policy == "nan_text":
        missing = text.isNull() | text.isin(PANDAS_NA_WORDS)
        return F.when(missing, F.lit("nan")).otherwise(strip(text))
    raise ValueError(f"unknown null_policy {null_policy!r}; use 'drop' or 'nan_text'")


def is_present(c: Column, null_policy: str = "drop") -> Column:
    """True when :func:`clean` gives a non-empty text.

    A left trim stops at the first other character, so a filter on this does not walk through
    the texts that the projection then strips.
    """
    text = c.cast("string")
    found = F.ltrim(text, F.lit(WHITESPACE)) != ""
    if null_policy == "nan_text":
        return F.coalesce(found | text.isin(PANDAS_NA_WORDS), F.lit(True))
    return F.coalesce(found, F.lit(False))


def category_label(c: Column, null_policy: str = "drop") -> Column:
    return F.lower(clean(c, null_policy))


def salary_label(c: Column) -> Column:
    """Strip and lower; ``_``, ``-`` and ``+`` become spaces, which are not stripped again."""
    return F.translate(F.lower(clean(c)), "_-+", "   ")


def is_not_negotiable(c: Column, sentinel: str) -> Column:
    """False (or null) for the sentinel; the cell is lowered but not stripped."""
    return F.lower(c) != F.lit(sentinel)


def parse_integer(c: Column) -> Column:
    """The first whitespace token that is a whole integer, else null.

    Signs and single underscores between digits are allowed. The value is a double, so that an
    integer of any length is scored; whole numbers up to 2 ** 53 are exact.
    """
    found = F.nullif(F.regexp_extract(c, INTEGER_TOKEN, 1), F.lit(""))
    return F.replace(found, F.lit("_"), F.lit("")).try_cast("double")


def fenced_json(c: Column) -> Column:
    """Body of the first ```` ```json ```` block, or null."""
    return F.nullif(F.regexp_extract(c, FENCED_JSON, 1), F.lit(""))


def list_literal(c: Column) -> Column:
    """``"['a', 'b']"`` to an array; blank or malformed text gives null."""
    return F.from_json(F.nullif(strip(c), F.lit("")), "array<string>")


def salary_range(c: Column, unit: str = SALARY_UNIT) -> Column:
    """``"9.4 - 12.0 <unit>"`` to ``struct<salary_min, salary_max, salary_avg>``; else null."""
    low = F.floor(F.regexp_extract(c, SALARY_RANGE, 1).try_cast("double")).cast("bigint")
    high = F.floor(F.regexp_extract(c, SALARY_RANGE, 2).try_cast("double")).cast("bigint")
    middle = F.floor((low + high) / 2).cast("bigint")
    return F.when(
        low.isNotNull(),
        F.struct(
            low.alias("salary_min"),
            high.alias("salary_max"),
            F.concat(middle.cast("string"), F.lit(f" {unit}")).alias("salary_avg"),
        ),
    )
