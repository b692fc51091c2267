"""What a page states about its job outside running text: embedded JSON and label/value markup.

Both are read from the page as it is stored, before scripts and tags are dropped. Every pattern
ends at the next mark of its kind, closed or not, so it takes linear time on broken pages too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from adcorpus.functions.text import filled, once, strip

# --- fixed values: property names of schema.org's JobPosting ------------------------------
POSTING_TYPE = "JobPosting"
POSTING_PROPERTIES: dict[str, tuple[str, ...]] = {
    "job_title": ("title",),
    "company_name": ("hiringOrganization",),
    "job_category": ("occupationalCategory",),
    "sub_category": ("relevantOccupation",),
    "industry": ("industry",),
    "location": ("jobLocation",),
    "country": ("jobLocation", "applicantLocationRequirements"),
    "posting_date": ("datePosted",),
    "deadline": ("validThrough",),
    "qualifications": ("qualifications", "educationRequirements"),
    "technical_skills": ("skills",),
    "soft_skills": ("softSkills",),
    "languages_required": ("inLanguage",),
    "experience_required": ("experienceRequirements",),
    "salary": ("baseSalary",),
    "contract_type": ("employmentType",),
    "working_hours": ("workHours",),
    "benefits": ("jobBenefits",),
    "description": ("description",),
    "requirements_text": ("responsibilities",),
}
NAMES = ("$.name", "$.credentialCategory", "$.value")
LOCALITIES = ("$.address.addressLocality", "$.address.addressRegion", "$.address", "$.name")
COUNTRIES = ("$.address.addressCountry.name", "$.address.addressCountry")

SCRIPT = r"(?is)<script\b[^<>]*\bld\+json[^<>]*+>(.*?)(?:</script|\z)"
CELL_TEXT = r"[^<]*+(?:<(?!/?(?:dt|dd|th|td|tr|dl|table)\b)[^<]*+)*+"
PAIR = rf"(?i)<(?:dt|th|td)\b[^<>]*+>({CELL_TEXT})</(?:dt|th|td)\s*+>\s*+<(?:dd|td)\b[^<>]*+>({CELL_TEXT})"
ITEM_MARK = r"(?i)<(?:li|br)\b[^<>]*+>"
INLINE_TAG = r"(?i)</?(?:a|b|i|u|em|strong|span|font|small|mark|code)\b[^<>]*+>"
TAG = r"</?[a-zA-Z!][^<>]*+>"
#: Text that :func:`plain` leaves as it is.
PLAIN = r"\A(?!;)[^\s<&]++(?: [^\s<&]++)*+(?<!;)\z"


def _is_object(c: Column) -> Column:
    return F.startswith(c, F.lit("{"))


def _first_item(c: Column) -> Column:
    """The first item of a JSON array, anything else as it is."""
    return F.when(F.startswith(c, F.lit("[")), F.get_json_object(c, "$[0]")).otherwise(c)


def _path_or_text(c: Column, paths: Sequence[str]) -> Column:
    return once(c, lambda v: F.when(_is_object(v), _first_path(v, paths)).otherwise(v))


def _first_path(c: Column, paths: Sequence[str]) -> Column:
    return F.coalesce(*[filled(F.get_json_object(c, p)) for p in paths])


def job_posting(html: Column) -> Column:
    """The properties of the first JobPosting in the page's JSON scripts, nested ones as JSON
    text; null without one. A script that holds a list or a ``@graph`` is looked through."""
    bodies = F.transform(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), lambda s: strip(s))

    def objects(body: Column) -> Column:
        listed = F.when(F.startswith(body, F.lit("[")), body).otherwise(F.get_json_object(body, "$['@graph']"))
        found = F.from_json(listed, "array<map<string,string>>")
        one = F.from_json(F.when(_is_object(body), body), "map<string,string>")
        return F.when(listed.isNotNull(), F.coalesce(found, F.array(one))).otherwise(F.array(one))

    def is_posting(properties: Column) -> Column:
        kind = F.try_element_at(properties, F.lit("@type"))
        return F.coalesce((kind == POSTING_TYPE) | F.contains(kind, F.lit(f'"{POSTING_TYPE}"')), F.lit(False))

    found = F.filter(F.flatten(F.transform(bodies, objects)), is_posting)
    return F.when(F.contains(html, F.lit("ld+json")), F.get(found, 0))


def plain(text: Column) -> Column:
    """Text without tags and entities, white space as single spaces."""

    def cleaned(c: Column) -> Column:
        c = F.regexp_replace(F.regexp_replace(c, ITEM_MARK, "; "), INLINE_TAG, "")
        c = once(F.regexp_replace(c, TAG, " "), lambda x: F.when(F.contains(x, F.lit("&")), decoded(x)).otherwise(x))
        return filled(F.trim(F.regexp_replace(c, r"\s++", " "), F.lit(" ;")))

    def decoded(c: Column) -> Column:
        for entity, character in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
            c = F.replace(c, F.lit(entity), F.lit(character))
        return c

    return once(text, lambda c: F.when(c.rlike(PLAIN), c).otherwise(cleaned(c)))


def posting_values(posting: Column, fields: Sequence[str]) -> Column:
    """The values of a record's fields in a posting, as an array of texts; null without a posting.

    All fields go through one expression for each kind of value, so plans stay small.
    """
    special = {"location": _location, "country": _country, "salary": _salary, "experience_required": _experience}
    values = {f: [F.try_element_at(posting, F.lit(p)) for p in POSTING_PROPERTIES.get(f, ())] for f in fields}
    at = [f for f in fields if f not in special for _ in values[f]]
    as_is = [i for i, f in enumerate(fields) if f == "experience_required"]
    named = F.array(*[v for f in fields if f not in special for v in values[f]])

    def texts(found: Column) -> Column:
        def raw(f: str) -> Column:
            if not values[f]:
                return F.lit(None).cast("string")
            return special[f](*values[f]) if f in special else F.coalesce(*[found[i] for i, g in enumerate(at) if g == f])

        # a number is looked for in the text as it is
        return F.transform(F.array(*[raw(f) for f in fields]), lambda v, i: F.when(i.isin(as_is), v).otherwise(plain(v)))

    return F.when(posting.isNotNull(), once(F.transform(named, lambda v: filled(_path_or_text(v, NAMES))), texts))


def _location(place: Column) -> Column:
    return _path_or_text(_first_item(place), LOCALITIES)


def _country(place: Column, allowed: Column) -> Column:
    first = once(_first_item(place), lambda v: F.when(_is_object(v), _first_path(v, COUNTRIES)))
    return F.coalesce(first, _path_or_text(_first_item(allowed), NAMES))


def _experience(value: Column) -> Column:
    months = F.get_json_object(value, "$.monthsOfExperience").try_cast("double")
    return F.coalesce((months / 12).cast("string"), _path_or_text(value, NAMES))


def _salary(value: Column) -> Column:
    """``low - high currency/unit`` as far as stated, or the text."""

    def stated(v: Column) -> Column:
        amount = _first_path(v, ("$.value.value", "$.value.minValue", "$.minValue"))
        high = _first_path(v, ("$.value.maxValue", "$.maxValue")).alias("high")
        bare = once(F.get_json_object(v, "$.value"), lambda x: F.when(x.rlike(r"^[0-9]"), x))
        ends = F.struct(F.coalesce(amount, bare).alias("amount"), high)
        unit = _first_path(v, ("$.value.unitText", "$.unitText"))

        def text(numbers: Column) -> Column:
            priced = F.concat_ws("/", F.concat_ws(" ", numbers, F.get_json_object(v, "$.currency")), unit)
            return F.when(numbers.isNotNull(), priced)

        return once(once(ends, _range), text)

    return once(value, lambda v: F.when(_is_object(v), stated(v)).otherwise(v))


def _range(ends: Column) -> Column:
    amount, high = ends["amount"], ends["high"]
    return F.when(high.isNotNull() & ~high.eqNullSafe(amount), F.concat_ws(" - ", amount, high)).otherwise(amount)


def posting_items(posting: Column, fields: Sequence[str]) -> Column:
    """For each of the list fields the items of its JSON array in a posting, or null."""

    def items(value: Column) -> Column:
        return _kept(F.transform(F.from_json(F.when(F.startswith(value, F.lit("[")), value), "array<string>"), plain))

    values = [F.coalesce(*[F.try_element_at(posting, F.lit(p)) for p in POSTING_PROPERTIES[f]]) for f in fields]
    return F.when(posting.isNotNull(), F.transform(F.array(*values), items))


def _kept(items: Column) -> Column:
    return once(F.filter(items, lambda x: x.isNotNull()), lambda kept: F.when(F.size(kept) > 0, kept))


def split_items(text: Column, separator: str) -> Column:
    return _kept(F.transform(F.split(text, separator), lambda x: filled(F.trim(x))))


def stated_pairs(html: Column) -> Column:
    """``array<struct<label, value>>`` of ``dt``/``dd`` and two-cell ``tr`` markup, as plain text;
    null where the page has none."""
    labels, values = (F.regexp_extract_all(html, F.lit(PAIR), F.lit(group)) for group in (1, 2))
    labels = F.transform(labels, lambda x: F.coalesce(F.rtrim(plain(x), F.lit(" :")), F.lit("")))
    # plain text has no line ends; a page's labels are lowered in one go
    lowered = F.split(F.lower(F.array_join(labels, "\n")), "\n", -1)
    pairs = F.zip_with(lowered, values, lambda x, value: F.struct(x.alias("label"), plain(value).alias("value")))
    kept = F.filter(pairs, lambda p: (p["label"] != "") & p["value"].isNotNull())
    return F.when(F.rlike(html, F.lit(r"(?i)<(?:dd|td)\b")), kept)


def pair_value(pairs: Column, labels: Sequence[str]) -> Column:
    """The value of the first pair that has one of the labels; case does not count."""
    names = [label.lower() for label in labels]
    return F.get(F.filter(pairs, lambda p: p["label"].isin(names)), 0)["value"]

