"""Spans of a pattern as column expressions, and their written form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), use)[0]


def running(widths: Column) -> Column:
    """The sums of an array before each of its items. Sums are taken over blocks of about the root
    of the length and then within blocks, as an aggregate copies what it has gathered so far."""

    def sums(items: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            items,
            first,
            lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )

    def by_blocks(w: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(w))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), size)
        blocks = F.transform(starts, lambda s: F.slice(w, s + 1, size))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        begun = F.arrays_zip(blocks.alias("b"), sums(totals, F.lit(0)).alias("s"))
        return F.flatten(F.transform(begun, lambda x: sums(x["b"], x["s"])))

    return bound(widths, by_blocks)


def spans_of(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All matches, leftmost and not overlapping, in code points with the end exclusive.

    The pieces between the matches and the matches themselves give the positions; the pattern
    must not match the empty string.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(both: Column) -> Column:
        begins = running(F.transform(both, lambda p: F.length(p["gap"]) + F.length(p["hit"])))
        return F.zip_with(
            both,
            begins,
            lambda p, at: F.struct(
                (at + F.length(p["gap"])).alias("start"),
                F.lit(rank).alias("rank"),
                (at + F.length(p["gap"]) + F.length(p["hit"])).alias("end"),
                F.lit(kind).alias("kind"),
                p["hit"].alias("value"),
            ),
        )

    both = bound(hits, lambda h: F.arrays_zip(F.slice(pieces, 1, F.size(h)).alias("gap"), h.alias("hit")))
    return bound(both, placed).cast(SPAN)


def masked(text: Column, pattern: str, holds=None) -> Column:
    """``text`` with blanks in place of the matches, or of those that ``holds`` is true for; all
    other characters stay where they are."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def blank(hit: Column) -> Column:
        spaces = F.repeat(F.lit(" "), F.length(hit))
        return spaces if holds is None else F.when(holds(hit), spaces).otherwise(hit)

    def mended(parts: Column) -> Column:
        filled = F.zip_with(parts, hits, lambda piece, hit: F.concat(piece, F.coalesce(blank(hit), F.lit(""))))
        return F.array_join(filled, "")

    return F.when(text.rlike(pattern), bound(pieces, mended)).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then rank of the kind, comma-joined."""
    each = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(each, ",")
