"""How the driver's tables stand in for ads, pages and model answers.

Every binding is a SQL expression that both engines read the same way, so a query and its
oracle start from identical inputs. Bindings cover whole tables and whole texts.
"""

from __future__ import annotations

# Scan schemas: stating them saves a pass over the file footers.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}

# documents as category ads
CATEGORY_ADS = {"doc_id": "doc_id", "description": "text", "category": "lang"}

# part as salary ads: some negotiable, some with a blank location
SALARY_ADS = {
    "p_partkey": "p_partkey",
    "job_title": "p_name",
    "contract_type": "p_type",
    "location": "CASE WHEN p_brand = 'Brand#13' THEN ' ' ELSE p_brand END",
    "country": "'Việt Nam'",
    "experience_required": "CAST(p_size AS STRING) || ' năm'",
    "salary_avg": "CASE WHEN p_type = 'PROMO' THEN 'Thoả Thuận' ELSE ' '"
    " || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || '-'"
    " || CAST(CAST(floor(p_retailprice) AS BIGINT) + p_size AS STRING) || '_Triệu+ ' END",
}

# supplier with its nation as the alternate salary table
ALTERNATE_ADS = {
    "s_suppkey": "s_suppkey",
    "job_title": "s_name",
    "job_type": "CASE WHEN n_regionkey = 0 THEN 'Bán thời gian' ELSE 'Toàn thời gian' END",
    "city": "n_name",
    "experience": "CAST(s_nationkey AS STRING) || ' năm'",
    "salary_avg": "CASE WHEN s_acctbal < 0 THEN 'thoả thuận' ELSE"
    " CAST(CAST(floor(s_acctbal) AS BIGINT) AS STRING) || ' triệu' END",
}

SPLIT_OF_PART = "CASE WHEN p_size <= 40 THEN 'train' WHEN p_size <= 45 THEN 'dev' ELSE 'test' END"
SPLIT_OF_SUPPLIER = (
    "CASE WHEN s_nationkey <= 19 THEN 'train' WHEN s_nationkey <= 22 THEN 'dev' ELSE 'test' END"
)

# labels that differ in case only
MIXED_CASE_LANG = "CASE WHEN source = 'src0' THEN upper(lang) ELSE lang END"

# a keyword rule stands in for the model that answers with a category
ANSWERED_LANG = (
    "CASE WHEN contains(text, ' the ') THEN ' EN' || chr(10)"
    " WHEN contains(text, ' le ') THEN 'FR'"
    " WHEN contains(text, ' der ') THEN chr(9) || 'de '"
    " WHEN contains(text, ' el ') THEN 'es.'"
    " WHEN contains(text, ' la ') THEN 'ES' ELSE 'unknown' END"
)

# answers of a salary model, in every shape the parser has a rule for
ANSWERED_SALARY = (
    "CASE p_type WHEN 'ECONOMY' THEN 'khoảng ' ||"
    " CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || ' triệu'"
    " WHEN 'STANDARD' THEN CAST(p_size AS STRING) || '.0 ' || CAST(p_size AS STRING)"
    " WHEN 'PROMO' THEN 'Thoả thuận'"
    " WHEN 'MEDIUM' THEN chr(9) || '-' || CAST(p_size AS STRING) || chr(10) || 'x'"
    " WHEN 'LARGE' THEN 'từ ' || CAST(p_size AS STRING) || '_000 vnd'"
    " ELSE p_brand || ' ' || CAST(p_size AS STRING) || 'triệu +' ||"
    " CAST(p_size AS STRING) END"
)

# lineitem with its part: stated salary and model answer as text
TRUE_SALARY = "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || ' triệu'"
GUESSED_SALARY = (
    "CASE WHEN l_discount = 0 THEN 'không rõ' ELSE"
    " CAST(CAST(floor(l_quantity * p_retailprice) AS BIGINT) AS STRING) || ' triệu' END"
)

# pages as a frontier: language section as source
PAGE_SOURCE = r"regexp_extract(url, '/([a-z][a-z])/', 1)"
PAGE_HOST = r"regexp_extract(url, '^https?://([^/]+)', 1)"
PAGE_DONE = "contains(url, '?')"
PAGE_LISTED = "NOT contains(url, '#')"
PAGE_FETCHED = "contains(url, 'https:')"

# events as model answers: fenced, unfenced, cut off, and a list instead of an object
ANSWERED_JSON = (
    "CASE event_type WHEN 'error' THEN props"
    " WHEN 'signup' THEN 'Here:' || chr(10) || '```json' || chr(10)"
    " || replace(props, '}', '') || chr(10) || '```'"
    " WHEN 'view' THEN '```json' || chr(10) || '[' || props || ']' || chr(10) || '```'"
    " ELSE 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10)"
    " || 'done' END"
)

# events as ad records in JSON, with every kind of fault
AD_JSON = (
    "CASE event_type"
    " WHEN 'view' THEN '{\"job_title\": \"view\", \"url\": \"https://e.example/'"
    " || CAST(event_id AS STRING) || '\", \"description\": \"d\","
    " \"experience_required\": 3.5, \"qualifications\": [\"a\", \"b\"]}'"
    " WHEN 'click' THEN '{\"url\": \"http://e.example/'"
    " || CAST(event_id AS STRING) || '\", \"description\": \"d\","
    " \"experience_required\": \"2.5\"}'"
    " WHEN 'error' THEN '{\"job_title\": \"x\", '"
    " WHEN 'signup' THEN '{\"job_title\": \"s\", \"url\": \"ftp://e.example\","
    " \"description\": \" \"}'"
    " ELSE '{\"job_title\": \"p\", \"url\": \"https://e.example\", \"description\": \"d\","
    " \"experience_required\": \"two\"}' END"
)

# part as the text columns of the published sample
LIST_TEXT = (
    "CASE WHEN p_type = 'PROMO' THEN '' WHEN p_type = 'SMALL' THEN p_name"
    " ELSE '[''' || p_name || ''', ''' || p_brand || ''']' END"
)
RANGE_TEXT = (
    "CASE WHEN p_type = 'PROMO' THEN 'Thoả thuận' ELSE"
    " CAST(p_size AS STRING) || '.4 - ' || CAST(p_size + 7 AS STRING) || '.0 triệu' END"
)

# part as job pages that state every field: a JSON script, an English list, a Vietnamese table
STATED = {
    "job_title": "p_name",
    "company_name": "p_brand",
    "job_category": "p_type",
    "sub_category": "p_type || ' junior'",
    "industry": "'Industry ' || CAST(p_size AS STRING)",
    "location": "'City ' || CAST(p_size AS STRING)",
    "country": "CASE WHEN p_size > 25 THEN 'Việt Nam' ELSE 'Vietnam' END",
    "posting_date": "'2025-07-' || CAST(10 + p_size % 20 AS STRING)",
    "deadline": "'2025-08-' || CAST(10 + p_size % 20 AS STRING)",
    "qualifications": ("'Degree ' || p_brand", "'Certificate'"),
    "technical_skills": ("'Python'", "p_name", "'SQL'"),
    "soft_skills": ("'Teamwork'", "p_type"),
    "languages_required": ("'Tiếng Việt'", "'English'"),
    "experience_required": "CAST(p_size AS STRING)",
    "salary": "CAST(p_size AS STRING) || ' - ' || CAST(p_size + 7 AS STRING) || ' VND/MONTH'",
    "contract_type": "CASE WHEN p_type = 'PROMO' THEN 'Part time' ELSE 'Full time' END",
    "working_hours": "CAST(p_size AS STRING) || ' h'",
    "benefits": ("'Bảo hiểm'", "'Bonus ' || CAST(p_size AS STRING)"),
    "description": "'Build & test ' || p_name",
    "requirements_text": "'Knows ' || p_brand",
}
STATED_URL = "'https://jobs.example/' || CAST(p_partkey AS STRING)"


def _text(field: str, separator: str) -> str:
    value = STATED[field]
    return value if isinstance(value, str) else f" || '{separator}' || ".join(value)


def _json_list(field: str) -> str:
    return "'[\"' || " + " || '\", \"' || ".join(STATED[field]) + " || '\"]'"


def _posting() -> str:
    quoted = {
        "title": "job_title", "occupationalCategory": "job_category", "relevantOccupation": "sub_category",
        "industry": "industry", "datePosted": "posting_date", "validThrough": "deadline",
        "employmentType": "contract_type", "workHours": "working_hours", "description": "description",
        "responsibilities": "requirements_text",
    }
    members = [f"'\"{key}\": \"' || {STATED[field]} || '\"'" for key, field in quoted.items()]
    members += [
        f"'\"{key}\": ' || {_json_list(field)}"
        for key, field in {
            "qualifications": "qualifications", "skills": "technical_skills", "softSkills": "soft_skills",
            "inLanguage": "languages_required", "jobBenefits": "benefits",
        }.items()
    ]
    members += [
        f"'\"hiringOrganization\": {{\"@type\": \"Organization\", \"name\": \"' || {STATED['company_name']} || '\"}}'",
        f"'\"jobLocation\": [{{\"address\": {{\"addressLocality\": \"' || {STATED['location']}"
        f" || '\", \"addressCountry\": \"' || {STATED['country']} || '\"}}}}]'",
        "'\"experienceRequirements\": {\"monthsOfExperience\": ' || CAST(p_size * 12 AS STRING) || '}'",
        "'\"baseSalary\": {\"currency\": \"VND\", \"value\": {\"minValue\": ' || CAST(p_size AS STRING)"
        " || ', \"maxValue\": ' || CAST(p_size + 7 AS STRING) || ', \"unitText\": \"MONTH\"}}'",
    ]
    body = " || ', ' || ".join(members)
    return (
        "'<script type=\"application/ld+json\">[{\"@type\": \"WebSite\"}, {\"@type\": \"JobPosting\", ' || "
        + body + " || '}]</script>'"
    )


def _pairs(language: int, labels: dict, row: tuple[str, str, str]) -> str:
    before, between, after = row
    cells = [
        f"'{before}{labels[f][language]}{between}' || replace({_text(f, '; ')}, '&', '&amp;') || '{after}'"
        for f in STATED
    ]
    return " || ".join(cells)


def posting_page(labels: dict) -> str:
    """The html of a part's job page; ``labels`` are those of the fields, by language."""
    english = _pairs(0, labels, ("<dt>", ":</dt>\n<dd>", "</dd>"))
    vietnamese = _pairs(1, labels, ("<tr class=\"x\"><th>", "</th> <td><span>", "</span></td></tr>"))
    return (
        "'<html><head><title>Jobs</title>' || CASE p_partkey % 3"
        f" WHEN 0 THEN {_posting()} || '</head><body><h1>Welcome</h1>'"
        f" WHEN 1 THEN '</head><body><h1>Welcome</h1><dl>' || {english} || '</dl>'"
        f" ELSE '</head><body><h1>Welcome</h1><table>' || {vietnamese} || '</table>' END || '<p>Apply now</p></body>'"
    )
