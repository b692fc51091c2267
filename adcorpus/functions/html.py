"""HTML to markdown text by one tokenisation of built-in expressions.

Hidden parts are cut out, then a page is split at ``<`` once; every piece is a tag with the text after
it, which its name turns into markdown and marks; the pieces are joined, and only pages that have
links or emphasis look at their marks again. Pages are often broken, so nothing depends on tags
being closed or nested properly, and every pattern takes linear time on any page: the inside of a
tag ends at the next ``<`` as well as at ``>``, and runs are taken whole. (An attribute that holds a
``<`` is therefore read as text.) Characters of the marks' kind do not survive in a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adcorpus.functions.text import once, strip

# --- fixed values: hidden parts, and names of tags that break a line or a block --------------
INVISIBLE = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script\b.*?(?:</script\s*>|\z)"
    r"|style\b.*?(?:</style\s*>|\z)"
    r"|noscript\b.*?(?:</noscript\s*>|\z)"
    r"|template\b.*?(?:</template\s*>|\z)"
    r"|title\b[^<>]*>[^<]*(?:</title\s*>)?)"
)
BLANKS = r"[\t\r\n\f ](?:[\t\r\n\f ]++|(?<! ))"
BLOCKS = (
    "p", "div", "article", "section", "main", "aside", "nav", "header", "footer", "ul", "ol", "dl", "dt", "dd",
    "table", "tr", "blockquote", "pre", "form", "figure", "hr", "h1", "h2", "h3", "h4", "h5", "h6",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Common tags that leave nothing behind.
BARE = (
    "span", "li", "td", "th", "thead", "tbody", "button", "label", "svg", "path", "html", "head", "body", "small", "code",
    "font", "u", "sup", "sub", "select", "option",
)
ALONE = ("img", "meta", "link", "input")
#: A tag's name; what ends emphasis or a link counts only when nothing else is in the tag.
TAG_KEY = r"^(?:/(?:[aA]|[bB]|[iI]|(?i:strong|em)) ?>|/?\w+)"
HREF = r"""(?i)^a\b[^>]*? href ?= ?["']?([^"'> ]*+)"""
#: Marks: a link's start, its address's end and its end; emphasis on and off; any other tag; a tag that
#: takes one space after it along.
LINK_START, LINK_TEXT, LINK_END = "\x03", "\x04", "\x05"
BOLD_ON, BOLD_OFF, ITALIC_ON, ITALIC_OFF, OTHER_TAG, NO_SPACE = "\x0e", "\x0f", "\x10", "\x11", "\x12", "\x13"
LINK = r"\x03([^\x03-\x05]*+)\x04([^\x03\x05]*+)\x05"
LINK_REST = r"\x03[^\x03\x04]*+\x04|\x05"
PLAIN = r"[^<\x0e-\x12]"
BOLD = rf"\x0e ?({PLAIN}*[^<\x0e-\x12 ]) ?\x0f"
ITALIC = rf"\x10 ?({PLAIN}*[^<\x0e-\x12 ]) ?\x11"
LINE_ENDS = r"(?<! ) ++\n *|\n +"
BLANK_LINES = r"\n{3,}"
#: What is left of the marks, and the space that one of them takes along.
MARKS = rf"{NO_SPACE} ?|[{OTHER_TAG}{BOLD_ON}{BOLD_OFF}{ITALIC_ON}{ITALIC_OFF}]"

# --- fixed values: named entities; the ampersand comes last --------------------------------
RARE_ENTITIES = {
    "&apos;": "'", "&reg;": "®", "&trade;": "™", "&bull;": "•", "&hellip;": "…", "&ndash;": "–",
    "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&laquo;": "«", "&raquo;": "»", "&euro;": "€",
}
COMMON_ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·",
    "&amp;": "&",
}


def _code_point(number: Column) -> Column:
    """The character of a code point, or U+FFFD where there is none."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    hex_text = F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0")
    return F.decode(F.unhex(hex_text), "UTF-32")


def _numeric_entities(c: Column) -> Column:
    """Decode ``&#8217;`` and ``&#x2019;``; anything that is no code is left as it is."""

    def decode(part: Column) -> Column:
        decimal = F.regexp_extract(part, r"^#(?=[0-9])(0*+[0-9]*+);", 1)
        hexed = F.regexp_extract(part, r"^#[xX](?=[0-9a-fA-F])(0*+[0-9a-fA-F]*+);", 1)
        # Leading zeros are legal; what is too long after them is no code point.
        digits, hexes = (F.ltrim(x, F.lit("0")) for x in (decimal, hexed))
        none = F.lit(0).cast("bigint")
        number = F.when(
            decimal != "", F.when(F.length(digits).between(1, 7), digits.cast("bigint")).otherwise(none)
        ).when(
            hexed != "", F.when(F.length(hexes).between(1, 6), F.conv(hexes, 16, 10).cast("bigint")).otherwise(none)
        )
        rest = F.regexp_replace(part, r"^#[xX]?[0-9a-fA-F]++;", "")
        return F.when(number.isNotNull(), F.concat(_code_point(number), rest)).otherwise(
            F.concat(F.lit("&"), part)
        )

    parts = F.split(c, "&(?=#)")
    decoded = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decode)
    return F.array_join(F.concat(F.slice(parts, 1, 1), decoded), "")


def _has(c: Column, *parts: str) -> Column:
    out = F.contains(c, F.lit(parts[0]))
    for part in parts[1:]:
        out = out | F.contains(c, F.lit(part))
    return out


def _tag_texts() -> dict[str, str]:
    """What a tag becomes, by its key; keys that are not here become OTHER_TAG."""
    out = {"br": "\n", "li": f"\n* {NO_SPACE}"}
    out |= {name: "\n\n" for b in BLOCKS for name in (b, f"/{b}")}
    out |= {h: f"\n\n{'#' * level} {NO_SPACE}" for level, h in enumerate(HEADINGS, 1)}
    out = {key: OTHER_TAG + text for key, text in out.items()}
    for on, off, names in ((BOLD_ON, BOLD_OFF, ("b", "strong")), (ITALIC_ON, ITALIC_OFF, ("i", "em")), ("", LINK_END, ("a",))):
        for n in names:
            out |= {f"/{n}>": off, f"/{n} >": off} | ({n: on} if on else {})
    return out


def _common(piece: Column) -> Column:
    """What a common tag in small letters becomes, by its name alone; null for all others.

    Links, and what ends emphasis, need more than a name. Sets are looked up by hash, a map is not.
    """
    name = F.substring_index(F.substring_index(piece, ">", 1), " ", 1)
    texts = {k: v for k, v in _tag_texts().items() if not k.endswith(">")}
    blocks = [k for k, v in texts.items() if v == f"{OTHER_TAG}\n\n"]
    rest = F.create_map(*[F.lit(x) for k in texts if k not in blocks for x in (k, texts[k])])
    bare = [*ALONE, *[x for b in BARE for x in (b, f"/{b}") if x not in texts]]
    mark = F.when(name.isin(bare), F.lit(OTHER_TAG)).when(name.isin(blocks), F.lit(f"{OTHER_TAG}\n\n"))
    return F.when(_has(piece, ">"), mark.otherwise(F.try_element_at(rest, name)))


def _piece(piece: Column) -> Column:
    """What follows a ``<``: a tag and its text as markdown and marks, or text as it is."""

    text = F.substr(piece, F.instr(piece, ">") + 1)
    return once(
        _common(piece), lambda mark: F.when(mark.isNotNull(), F.concat(mark, text)).otherwise(_any_piece(piece))
    )


def _any_piece(piece: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in _tag_texts().items() for x in pair])

    def as_tag(b: Column) -> Column:
        text = F.substr(piece, b["end"] + 1)
        linked = F.concat(F.lit(LINK_START), F.regexp_extract(piece, HREF, 1), F.lit(LINK_TEXT), text)
        plain = F.concat(F.coalesce(F.try_element_at(texts, b["key"]), F.lit(OTHER_TAG)), text)
        named = (b["key"] != "") | piece.rlike("^[/!?]")
        tag = F.when((b["key"] == "a") & piece.rlike(HREF), linked).otherwise(plain)
        return F.when((b["end"] > 0) & named, tag).otherwise(F.concat(F.lit("<"), piece))

    key = F.lower(F.regexp_extract(piece, TAG_KEY, 0)).alias("key")
    return once(F.struct(key, F.instr(piece, ">").alias("end")), as_tag)


def _structure(html: Column) -> Column:
    """Hidden parts out, and the pieces between tags joined with marks in their places."""
    visible = F.regexp_replace(html, INVISIBLE, "")
    pieces = F.split(F.regexp_replace(visible, BLANKS, " "), "<", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_piece(p))), "")


def _replace_all(c: Column, entities: dict[str, str]) -> Column:
    for entity, text in entities.items():
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def with_markdown(df: DataFrame, html: str = "html", name: str = "markdown") -> DataFrame:
    """Add the markdown text of a page: headings, links, list items, emphasis, paragraphs.

    A null page gives null. Bold and italic are kept where the tag pair holds plain text. The
    steps are separate projections because later ones use their input several times; only pages that
    have links or emphasis, a numeric or rare entity, or blanks at line ends take the slower paths.
    """
    rare = "|".join(entity[1:] for entity in RARE_ENTITIES)
    md = F.col("_md")
    staged = df.withColumn("_md", _structure(F.col(html)))
    links = F.regexp_replace(F.regexp_replace(md, LINK, "[$2]($1)"), LINK_REST, "")
    staged = staged.withColumn("_md", F.when(_has(md, LINK_START, LINK_END), links).otherwise(md))
    strong = F.regexp_replace(md, BOLD, "**$1**")
    staged = staged.withColumn("_md", F.when(_has(md, BOLD_OFF), strong).otherwise(md))
    staged = staged.withColumn("_md", F.when(_has(md, ITALIC_OFF), F.regexp_replace(md, ITALIC, "_$1_")).otherwise(md))
    staged = staged.withColumn("_md", F.regexp_replace(md, MARKS, ""))
    slow = _replace_all(_numeric_entities(md), RARE_ENTITIES)
    decoded = F.when(_has(md, "&") & F.rlike("_md", F.lit(f"&(?:#|{rare})")), slow).otherwise(md)
    staged = staged.withColumn("_md", decoded)
    staged = staged.withColumn("_md", F.when(_has(md, "&"), _replace_all(md, COMMON_ENTITIES)).otherwise(md))
    # most line ends have one blank at most; what is left takes the pattern
    few = F.replace(F.replace(md, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    staged = staged.withColumn("_md", few)
    ended = F.when(_has(md, " \n", "\n "), F.regexp_replace(md, LINE_ENDS, "\n")).otherwise(md)
    staged = staged.withColumn("_md", ended)
    short = F.when(_has(md, "\n\n\n"), F.regexp_replace(md, BLANK_LINES, "\n\n")).otherwise(md)
    return staged.withColumn(name, strip(short)).drop("_md")
