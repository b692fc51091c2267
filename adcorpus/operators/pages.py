"""Stored pages and model answers to structured ad records."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adcorpus.constants import DEFAULT_INSTRUCTION, PAGE_INTRO, SCHEMA_INTRO, SCHEMA_OUTRO
from adcorpus.functions.html import with_markdown
from adcorpus.functions.postings import job_posting, pair_value, posting_items, posting_values, split_items, stated_pairs
from adcorpus.functions.text import fenced_json, filled, strip
from adcorpus.sources.schemas import JOB_AD, LIST_FIELDS, REQUIRED_FIELDS

# --- fixed values: labels that introduce a field on a line of its own -----------------------
FIELD_LABELS: dict[str, tuple[str, ...]] = {
    "company_name": ("Company", "Công ty"),
    "job_category": ("Category", "Ngành nghề"),
    "sub_category": ("Sub-category", "Chuyên ngành"),
    "industry": ("Industry", "Lĩnh vực"),
    "location": ("Location", "Địa điểm"),
    "country": ("Country", "Quốc gia"),
    "posting_date": ("Posted", "Ngày đăng"),
    "deadline": ("Deadline", "Hạn nộp"),
    "qualifications": ("Qualifications", "Bằng cấp"),
    "technical_skills": ("Technical skills", "Kỹ năng chuyên môn"),
    "soft_skills": ("Soft skills", "Kỹ năng mềm"),
    "languages_required": ("Languages", "Ngôn ngữ"),
    "experience_required": ("Experience", "Kinh nghiệm"),
    "salary": ("Salary", "Mức lương"),
    "contract_type": ("Contract type", "Hình thức"),
    "working_hours": ("Working hours", "Thời gian làm việc"),
    "benefits": ("Benefits", "Phúc lợi"),
    "requirements_text": ("Requirements", "Yêu cầu"),
}
#: Labels of fields that only markup names; in running text they head whole sections.
PAIR_LABELS: dict[str, tuple[str, ...]] = {
    **FIELD_LABELS,
    "job_title": ("Job title", "Chức danh"),
    "description": ("Job description", "Mô tả công việc"),
}
TITLE_TAG = r"(?i)<title\b[^<>]*>([^<]*)"
FIRST_HEADING = r"(?:^|\n)# ([^\n]+)"
LIST_SEPARATOR = r"\s*[,;]\s*"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
NUMBER_TEXT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
WEB_URL = r"^(?i)https?://[^\s/?#]+[^\s]*$"


def _blank_to_null(c: Column) -> Column:
    return filled(strip(c))


def _line_pattern(labels: Sequence[str], value: str) -> str:
    names = "|".join(labels)
    return rf"(?iu)(?:^|\n)([*_ ]*(?:{names})[*_ ]*:[*_ ]*){value}"


def labelled_lines(markdown: Column, labels: Mapping[str, Sequence[str]]) -> Column:
    """All lines that read ``label: value`` for any of the labels, joined by newlines.

    One pass over the page; the fields are then looked up in these few lines.
    """
    names = [label for group in labels.values() for label in group]
    pattern = _line_pattern(names, r"[^\n]*")
    return F.array_join(F.regexp_extract_all(markdown, F.lit(pattern), F.lit(0)), "")


def labelled_line(lines: Column, labels: Sequence[str]) -> Column:
    """Value of the first line that reads ``label: value``, or null; labels ignore case."""
    return filled(F.regexp_extract(lines, _line_pattern(labels, r"([^\n]*[^\n*_ ])"), 2))


def page_fields(
    pages: DataFrame,
    keep: Sequence[str] = (),
    labels: Mapping[str, Sequence[str]] = FIELD_LABELS,
    pair_labels: Mapping[str, Sequence[str]] = PAIR_LABELS,
) -> DataFrame:
    """``keep`` columns and ``record``, a :data:`JOB_AD` struct, for pages with html.

    Only what a page states is filled in, from the first of these that states it: a JobPosting in
    the page's JSON scripts, label/value markup, lines of text that name a field; then headings
    and title for the job title and the whole text for the description. All else is null. List
    fields are split at commas and semicolons. ``pages`` needs ``url`` and ``html``.
    """
    staged = pages.where(F.col("html").isNotNull()).withColumns(
        {"_posting": job_posting(F.col("html")), "_pairs": stated_pairs(F.col("html"))}
    )
    stated_names = [n for n in JOB_AD.names if n != "url"]
    posted, listed = posting_values(F.col("_posting"), stated_names), posting_items(F.col("_posting"), LIST_FIELDS)
    staged = staged.withColumns({"_posted": posted, "_listed": listed})
    staged = with_markdown(staged).withColumn("_lines", labelled_lines(F.col("markdown"), labels))
    heading = _blank_to_null(F.regexp_extract("markdown", FIRST_HEADING, 1))
    title = _blank_to_null(F.regexp_extract("html", TITLE_TAG, 1))
    last = {"job_title": F.coalesce(heading, title), "description": _blank_to_null(F.col("markdown"))}

    def field(name: str) -> Column:
        if name == "url":
            return F.col("url")
        in_posting = F.get("_posted", stated_names.index(name))
        in_pairs = pair_value(F.col("_pairs"), pair_labels.get(name, ()))
        in_lines = labelled_line(F.col("_lines"), labels[name]) if name in labels else F.lit(None).cast("string")
        if name in LIST_FIELDS:
            return F.coalesce(
                F.get("_listed", LIST_FIELDS.index(name)),
                split_items(in_posting, LIST_SEPARATOR),
                split_items(in_pairs, LIST_SEPARATOR),
                F.split(in_lines, LIST_SEPARATOR),
            )
        stated = F.coalesce(in_posting, in_pairs, in_lines)
        if name == "experience_required":
            return filled(F.regexp_extract(stated, NUMBER, 1)).try_cast("double")
        return F.coalesce(stated, last[name]) if name in last else stated

    record = F.struct(*[field(f.name).cast(f.dataType).alias(f.name) for f in JOB_AD.fields])
    return staged.select(*keep, record.alias("record"))


def json_schema_text(schema: T.StructType = JOB_AD) -> str:
    """A JSON schema document for a struct of strings, numbers and string lists.

    A column's metadata goes into its entry; a nullable column is optional: its type or null, null
    by default.
    """

    def kind(field: T.StructField) -> dict:
        if isinstance(field.dataType, T.ArrayType):
            return {"type": "array", "items": {"type": "string"}}
        return {"type": "number" if isinstance(field.dataType, T.DoubleType) else "string"}

    def entry(field: T.StructField) -> dict:
        out = {"anyOf": [kind(field), {"type": "null"}], "default": None} if field.nullable else kind(field)
        return dict(sorted({**out, **field.metadata, "title": field.name.replace("_", " ").title()}.items()))

    document = {
        "type": "object",
        "properties": {f.name: entry(f) for f in schema.fields},
        "required": [f.name for f in schema.fields if not f.nullable],
    }
    return json.dumps(document, ensure_ascii=False, indent=2)


def full_instruction(
    instruction: str = DEFAULT_INSTRUCTION, schema: T.StructType = JOB_AD
) -> str:
    return f"{instruction}{SCHEMA_INTRO}{json_schema_text(schema)}{SCHEMA_OUTRO}"


def extraction_prompt(markdown: Column, instruction: str | None = None) -> Column:
    """Instruction, JSON schema and page text; null for a null page."""
    head = full_instruction() if instruction is None else instruction
    return F.concat(F.lit(head + PAGE_INTRO), markdown)


#: Texts of any length; keys and strings in double quotes only.
JSON_OPTIONS = {"allowSingleQuotes": "false", "maxStringLen": str(2**31 - 1), "maxNestingDepth": "10000"}


def json_members(c: Column) -> Column:
    """``map<string, string>`` of the members of a text that holds one well-formed JSON object and
    nothing around it, nested values as JSON text; else null. Of a repeated key the first counts."""
    body = strip(c)
    framed = F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}"))
    return F.from_json(F.when(framed, body), "map<string,string>", JSON_OPTIONS)


def answered_json(df: DataFrame, answer: str, name: str = "json") -> DataFrame:
    """Add the JSON object inside the first fenced block of ``answer``, or null."""
    staged = df.withColumn("_block", fenced_json(F.col(answer)))
    whole = json_members(F.col("_block")).isNotNull()
    return staged.withColumn(name, F.when(whole, F.col("_block"))).drop("_block")


def _number(c: Column) -> Column:
    """Text to double; the shape is tested first because a failing cast is very slow."""
    return F.when(F.rlike(c, F.lit(NUMBER_TEXT)), c.try_cast("double"))


def _typed(members: Column, schema: T.StructType, **override: Column) -> Column:
    """A struct of ``schema`` from the members of one parse; what does not fit its type is null."""

    def value(f: T.StructField) -> Column:
        if f.name in override:
            return override[f.name]
        text = F.try_element_at(members, F.lit(f.name))
        if isinstance(f.dataType, T.StringType):
            return text
        if isinstance(f.dataType, T.DoubleType):
            return _number(text)
        if isinstance(f.dataType, T.ArrayType):
            return F.from_json(F.when(F.startswith(text, F.lit("[")), text), f.dataType, JSON_OPTIONS)
        return text.try_cast(f.dataType)

    return F.struct(*[value(f).alias(f.name) for f in schema.fields])


def record_or_raw(
    df: DataFrame, answer: str, keep: Sequence[str] = (), schema: T.StructType = JOB_AD
) -> DataFrame:
    """``keep``, ``url``, ``record`` and ``raw_response``; exactly one of the last two is set.

    The record is the fenced JSON object with the page's own ``url`` put in; an answer without
    a well-formed object is kept as text. Needs a ``url`` column.
    """
    staged = df.withColumn("_members", json_members(fenced_json(F.col(answer))))
    has_url = "url" in schema.names
    record = _typed(F.col("_members"), schema, **({"url": F.col("url")} if has_url else {}))
    found = F.col("_members").isNotNull()
    return staged.select(
        *keep,
        "url",
        F.when(found, record).alias("record"),
        F.when(~found, F.col(answer)).alias("raw_response"),
    )


def typed_parse(
    df: DataFrame, text: str, keep: Sequence[str] = (), schema: T.StructType = JOB_AD,
    required: Sequence[str] = tuple(REQUIRED_FIELDS),
) -> DataFrame:
    """``keep``, ``record`` and ``problems`` (empty for a valid record).

    Problems: ``malformed``, ``missing:<field>``, ``url`` (not a web address) and
    ``number:<field>`` (present but not a number).
    """
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    staged = df.withColumn("_members", json_members(F.col(text)))
    ok = F.col("_members").isNotNull()

    def member(name: str) -> Column:
        return F.try_element_at("_members", F.lit(name))

    checks = [F.when(~ok, F.lit("malformed"))]
    for name in required:
        absent = F.coalesce(strip(member(name)), F.lit("")) == ""
        checks.append(F.when(ok & absent, F.lit(f"missing:{name}")))
    if "url" in schema.names:
        checks.append(F.when(~F.rlike(strip(member("url")), F.lit(WEB_URL)), F.lit("url")))
    for name in numbers:
        bad = member(name).isNotNull() & _number(member(name)).isNull()
        checks.append(F.when(bad, F.lit(f"number:{name}")))
    return staged.select(
        *keep,
        F.when(ok, _typed(F.col("_members"), schema)).alias("record"),
        F.array_compact(F.array(*checks)).alias("problems"),
        F.col(text).alias("text"),
    )


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records and the quarantine of a :func:`typed_parse` result."""
    return parsed.where(F.size("problems") == 0), parsed.where(F.size("problems") > 0)
