"""The same queries as plain SQL, for checking against a second engine."""

from __future__ import annotations

from adcorpus import constants as k
from adcorpus.functions import html as h
from adcorpus.operators.pages import (
    FIELD_LABELS, FIRST_HEADING, LIST_SEPARATOR, NUMBER, TITLE_TAG, WEB_URL, full_instruction,
)
from adcorpus.plans import bindings as b
from adcorpus.sources.schemas import JOB_AD, LIST_FIELDS

W = f"[{k.WHITESPACE_CLASS}]"
TOKEN = f"[^{k.WHITESPACE_CLASS}]+"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{W}+|{W}+\z', '', 'g')"


def clean(x: str) -> str:
    return f"coalesce({strip(f'CAST({x} AS VARCHAR)')}, '')"


def bound(columns: dict[str, str], source: str, extra: str = "") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source} {extra}"


def parse_integer(x: str) -> str:
    # Every token is tested, as the parser's definition has it.
    first = (
        f"list_filter(regexp_extract_all(lower({x}), '{TOKEN}'),"
        " lambda w: regexp_full_match(w, '[+-]?[0-9]+(_[0-9]+)*'))[1]"
    )
    return f"TRY_CAST(replace({first}, '_', '') AS DOUBLE)"


def sample_key(column: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({column} AS VARCHAR)), 1, 15) AS BIGINT)"


# --- prompts ---------------------------------------------------------------------------------

CATEGORY = f"""
ads AS ({bound(b.CATEGORY_ADS, 'documents')}),
system AS (SELECT {q(k.CATEGORY_SYSTEM_HEAD)} || string_agg('"' || lower(c) || '"', ', ' ORDER BY c)
  || {q(k.CATEGORY_SYSTEM_TAIL)} AS s
  FROM (SELECT DISTINCT category AS c FROM ads WHERE category IS NOT NULL)),
ok AS (SELECT doc_id, {clean('description')} AS t, lower({clean('category')}) AS l FROM ads),
rows AS (SELECT * FROM ok WHERE t <> '' AND l <> '')"""

CATEGORY_EXEMPLARS = f"""
first AS (SELECT l, min(doc_id) AS first_pos FROM rows GROUP BY l ORDER BY first_pos, l LIMIT 16),
ranked AS (SELECT r.l, first_pos, t, row_number() OVER (PARTITION BY r.l
  ORDER BY {sample_key('doc_id')}, doc_id) AS rn FROM rows r JOIN first USING (l)),
shots AS (SELECT t AS st, l AS sl, row_number() OVER (ORDER BY first_pos, t, l) - 1 AS i
  FROM ranked WHERE rn = 1),
turns AS (SELECT 2 * i + 1 AS p, 'user' AS role, st AS content FROM shots
  UNION ALL SELECT 2 * i + 2, 'assistant', sl FROM shots),
n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM turns)"""


def _messages(ids: str, system: str, user: str, label: str, source: str, shots: bool) -> str:
    """Long-form messages; ``shots`` puts the exemplar turns after the system message."""
    n = "(SELECT n FROM n)" if shots else "0"
    exemplars = (
        f"UNION ALL SELECT {ids}, CAST(p AS BIGINT), role, content FROM {source}, turns"
        if shots else ""
    )
    return f"""
SELECT {ids}, CAST(0 AS BIGINT) AS pos, 'system' AS role, {system} AS content FROM {source}
{exemplars}
UNION ALL SELECT {ids}, CAST({n} + 1 AS BIGINT), 'user', {user} FROM {source}
UNION ALL SELECT {ids}, CAST({n} + 2 AS BIGINT), 'assistant', {label} FROM {source}"""


def _category(shots: bool) -> str:
    user = f"{q(k.CATEGORY_USER_PREFIX)} || t"
    return f"WITH {CATEGORY}{',' + CATEGORY_EXEMPLARS if shots else ''}" + _messages(
        "doc_id", "(SELECT s FROM system)", user, "l", "rows", shots
    )


def _salary_rows(ids: list[str], source: str) -> str:
    """Cleaned fields and label of the ads in ``source`` that pass every filter."""
    label = f"lower({clean('salary_avg')})"
    fields = ", ".join(f"{clean(f)} AS {f}" for f in k.SALARY_LINES)
    present = " AND ".join(f"{f} <> ''" for f in [*k.SALARY_LINES, "label"])
    return f"""SELECT * FROM (SELECT {', '.join(ids)}, {fields},
  translate({label}, '_-+', '   ') AS label FROM {source}
  WHERE lower(salary_avg) <> {q(k.NEGOTIABLE_SALARY)}) WHERE {present}"""


USER = " || chr(10) || ".join(f"{q(head)} || {f}" for f, head in k.SALARY_LINES.items())
SUPPLIERS = "supplier JOIN nation ON s_nationkey = n_nationkey"


def _as_main(columns: dict[str, str], extra: dict[str, str] | None = None) -> str:
    """Alternate ads under the main column names."""
    mapped = {ours: columns[theirs] for ours, theirs in k.ALT_SALARY_COLUMNS.items()}
    ids = {"s_suppkey": "s_suppkey", **(extra or {})}
    return bound({**ids, **mapped, "country": q(k.ALT_COUNTRY)}, SUPPLIERS)


MAIN_ROWS = f"main_ads AS ({bound(b.SALARY_ADS, 'part')}), main AS ({_salary_rows(['p_partkey'], 'main_ads')})"
ALT_ROWS = f"alt_ads AS ({_as_main(b.ALTERNATE_ADS)}), alt AS ({_salary_rows(['s_suppkey'], 'alt_ads')})"
SALARY_EXEMPLARS = f"""
picked AS (SELECT p_partkey, {USER} AS st, label AS sl FROM main
  ORDER BY {sample_key('p_partkey')}, p_partkey LIMIT 3),
shots AS (SELECT st, sl, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM picked),
turns AS (SELECT 2 * i + 1 AS p, 'user' AS role, st AS content FROM shots
  UNION ALL SELECT 2 * i + 2, 'assistant', sl FROM shots),
n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM turns)"""


def _salary(ids: str, source: str, shots: bool = False) -> str:
    return _messages(ids, q(k.SALARY_SYSTEM), USER, "label", source, shots)


SPLIT_ADS = bound(
    {**b.SALARY_ADS, "id": "p_partkey", "description": "p_name || ' ' || p_brand",
     "category": "p_type", "split": b.SPLIT_OF_PART}, "part",
)
SPLIT_FANOUT = f"""WITH {MAIN_ROWS}, {SALARY_EXEMPLARS}, ads AS ({SPLIT_ADS}),
other_ads AS ({_as_main(b.ALTERNATE_ADS, {'id': 's_suppkey', 'split': b.SPLIT_OF_SUPPLIER})}),
system AS (SELECT {q(k.CATEGORY_SYSTEM_HEAD)} || string_agg('"' || lower(c) || '"', ', ' ORDER BY c)
  || {q(k.CATEGORY_SYSTEM_TAIL)} AS s FROM (SELECT DISTINCT category AS c FROM ads)),
cat AS (SELECT 'category' AS task, 'main' AS variant, split, id, {clean('description')} AS t,
  lower({clean('category')}) AS l FROM ads),
sal AS (SELECT 'salary' AS task, 'main' AS variant, * FROM ({_salary_rows(['split', 'id'], 'ads')})
  UNION ALL SELECT 'salary', 'alternate', * FROM ({_salary_rows(['split', 'id'], 'other_ads')}))
{_messages("task, variant, 'zero' AS shots, split, id", '(SELECT s FROM system)',
           f"{q(k.CATEGORY_USER_PREFIX)} || t", 'l', 'cat', False)}
UNION ALL {_salary("task, variant, 'zero', split, id", 'sal')}
UNION ALL {_salary("task, variant, 'few', split, id", 'sal', True)}"""

# --- conversations ---------------------------------------------------------------------------

SEGMENT = (
    f"{q(k.CHATML_MESSAGE[0])} || role || {q(k.CHATML_MESSAGE[1])} || text || "
    f"{q(k.CHATML_MESSAGE[2])}"
)
LAST_PAIR = """SELECT conv_id,
  arg_max(coalesce(text, ''), turn) FILTER (role = 'user') AS user_text,
  arg_max(coalesce(text, ''), turn) FILTER (role = 'assistant') AS assistant_text
  FROM conversations GROUP BY conv_id"""
LAST_PAIRS = f"SELECT * FROM ({LAST_PAIR}) WHERE user_text <> '' AND assistant_text <> ''"
TRUTHS = f"""SELECT conv_id, turn, role, lower({strip('text')}) AS content FROM conversations
  JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) USING (conv_id, turn)
  WHERE role = 'assistant' AND {strip('text')} <> ''"""


def _rendered(source: str) -> str:
    return f"""SELECT conv_id, CAST(turn // 1024 AS BIGINT) AS part,
  string_agg(segment, '' ORDER BY turn) AS text, count(*) OVER (PARTITION BY conv_id) AS n_parts
  FROM ({source}) GROUP BY conv_id, turn // 1024"""


def _budget(id_column: str, source: str, n: int) -> str:
    """Token budget of ``source(id, text)``."""
    return f"""SELECT {id_column}, array_to_string(toks[1:{n}], ' ') AS head,
  CAST(len(toks) AS BIGINT) AS n_tokens, CAST(least(len(toks), {n}) AS BIGINT) AS n_kept,
  len(toks) > {n} AS truncated
  FROM (SELECT {id_column}, regexp_extract_all(text, '{TOKEN}') AS toks FROM ({source}))"""


# --- metrics ---------------------------------------------------------------------------------

CLASSIFIED = f"""answers AS (SELECT doc_id, source AS run, lang AS truth, {b.ANSWERED_LANG} AS answer
  FROM documents),
known AS (SELECT DISTINCT lower(lang) AS v FROM documents WHERE lang IS NOT NULL),
parsed AS (SELECT doc_id, run, truth, answer, CASE WHEN lower({strip('answer')}) IN
  (SELECT v FROM known) THEN lower({strip('answer')}) ELSE {q(k.UNKNOWN_CATEGORY)} END AS pred
  FROM answers)"""
PER_LABEL = """labels_of AS (SELECT run, truth AS label FROM parsed UNION SELECT run, pred FROM parsed),
stats AS (SELECT l.run, l.label,
  count(*) FILTER (p.truth = l.label AND p.pred = l.label) AS hits,
  count(*) FILTER (p.pred = l.label) AS predicted,
  count(*) FILTER (p.truth = l.label) AS support
  FROM labels_of l JOIN parsed p ON p.run = l.run GROUP BY l.run, l.label),
report AS (SELECT run, label, support, hits,
  CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / support END AS recall,
  CASE WHEN hits = 0 THEN 0.0::DOUBLE ELSE
    2 * (hits::DOUBLE / predicted) * (hits::DOUBLE / support)
    / (hits::DOUBLE / predicted + hits::DOUBLE / support) END AS f1 FROM stats)"""


def _weighted(c: str) -> str:
    return f"round(sum({c} * support) / sum(support), 6)"


SCORES = f"""round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  {_weighted('f1')} AS weighted_f1, CAST(sum(hits) AS BIGINT) AS n_correct,
  CAST(sum(support) AS BIGINT) AS n_total FROM report"""
CLASS_REPORT = f"""WITH {CLASSIFIED}, {PER_LABEL}
SELECT run, 'label' AS kind, label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM report
UNION ALL SELECT run, 'summary', 'accuracy', NULL, NULL, round(sum(hits)::DOUBLE / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM report GROUP BY run
UNION ALL SELECT run, 'summary', 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
  round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM report GROUP BY run
UNION ALL SELECT run, 'summary', 'weighted avg', {_weighted('precision')}, {_weighted('recall')},
  {_weighted('f1')}, CAST(sum(support) AS BIGINT) FROM report GROUP BY run"""

SALARIES = f"""texts AS (SELECT l_returnflag AS model, l_linestatus AS adapter, p_type AS test_tag,
  {b.TRUE_SALARY} AS truth_text, {b.GUESSED_SALARY} AS answer
  FROM lineitem JOIN part ON l_partkey = p_partkey),
parsed AS (SELECT model, adapter, test_tag, {parse_integer('truth_text')} AS t,
  {parse_integer('answer')} AS p FROM texts),
mean AS (SELECT model AS m, adapter AS a, test_tag AS g, avg(t) AS mt FROM parsed
  WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"""
REGRESSION = """round(100 * avg(abs((t - p) / nullif(t, 0)::DOUBLE)) FILTER (ok), 6) AS mape,
  round(CASE WHEN count(*) FILTER (ok) < 2 THEN 'nan'::DOUBLE
    WHEN sum((t - mt) * (t - mt)) FILTER (ok) > 0 THEN
      1 - sum((t - p)::DOUBLE * (t - p)) FILTER (ok) / sum((t - mt) * (t - mt)) FILTER (ok)
    WHEN sum((t - p)::DOUBLE * (t - p)) FILTER (ok) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2,
  round(avg(abs(t - p)) FILTER (ok), 6) AS mae,
  round(sqrt(avg((t - p)::DOUBLE * (t - p)) FILTER (ok)), 6) AS rmse,
  count(*) FILTER (ok) AS n_scored, count(*) AS n_total,
  round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS coverage,
  count(*) FILTER (ok AND t = 0) AS n_zero_truth"""
FLAGGED = "SELECT *, t IS NOT NULL AND p IS NOT NULL AS ok FROM parsed"

# --- frontier and pages ----------------------------------------------------------------------

FRONTIER = f"SELECT {b.PAGE_SOURCE} AS source, page_id AS pos, url FROM pages"
LISTED = f"{FRONTIER} WHERE {b.PAGE_LISTED}"
DONE = f"SELECT DISTINCT {b.PAGE_SOURCE} AS source, url FROM pages WHERE {b.PAGE_DONE}"


def _progress(listed: str, done: str, percent: int) -> str:
    return f"""SELECT source, n_listed, coalesce(n_done, 0) AS n_done,
  CAST(floor(n_listed * {percent}.0 / 100) AS BIGINT) AS n_required,
  CAST(greatest(floor(n_listed * {percent}.0 / 100) - coalesce(n_done, 0), 0) AS BIGINT) AS n_remaining,
  n_listed > 0 AND coalesce(n_done, 0) >= n_listed * {percent}.0 / 100 AS complete
  FROM (SELECT source, count(DISTINCT url) AS n_listed FROM ({listed}) GROUP BY source)
  LEFT JOIN (SELECT source, count(*) AS n_done FROM ({done}) GROUP BY source) USING (source)"""


PENDING = f"""SELECT source, url, pos FROM (SELECT source, url, min(pos) AS pos FROM ({FRONTIER})
  GROUP BY source, url) ANTI JOIN ({DONE}) USING (source, url)"""

# Own patterns: hidden parts one by one, and tags in the form that HTML itself has.
HIDDEN = [
    rf"(?is)<{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "noscript", "template")
]
BLOCKS_OF_TEXT = (
    "p div article section main aside nav header footer ul ol dl dt dd table tr blockquote pre form"
    " figure hr h1 h2 h3 h4 h5 h6"
)
MARKDOWN_STEPS = [
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    *[(p, "") for p in HIDDEN],
    (r"(?i)<title\b[^<>]*>[^<]*(?:</title\s*>)?", ""),
    (r"[ \t\r\n\f]+", " "),
    (r"""(?i)<a\b[^<>]*? href ?= ?["']?([^"'<> ]*)[^<>]*>""", "\x03\\1\x04"),
    (r"(?i)</a ?>", "\x05"),
    (r"\x03([^\x03-\x05]*)\x04([^\x03\x05]*)\x05", r"[\2](\1)"),
    (r"\x03[^\x03\x04]*\x04|\x05", ""),
    (r"(?i)<(?:b|strong)\b[^<>]*> ?([^<]*[^< ]) ?</(?:b|strong) ?>", r"**\1**"),
    (r"(?i)<(?:i|em)\b[^<>]*> ?([^<]*[^< ]) ?</(?:i|em) ?>", r"_\1_"),
    *[(rf"(?i)<h{n}\b[^<>]*> ?", f"\n\n{'#' * n} ") for n in range(1, 7)],
    (r"(?i)<li\b[^<>]*> ?", "\n* "),
    (r"(?i)<br\b[^<>]*>", "\n"),
    (rf"(?i)</?(?:{'|'.join(BLOCKS_OF_TEXT.split())})\b[^<>]*>", "\n\n"),
    (r"<[/!?a-zA-Z][^<>]*>", ""),
]


def markdown(x: str) -> str:
    for pattern, text in MARKDOWN_STEPS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(text)}, 'g')"
    # The pages hold no numeric entities; unit tests cover those.
    for entity, text in {**h.RARE_ENTITIES, **h.COMMON_ENTITIES}.items():
        x = f"replace({x}, {q(entity)}, {q(text)})"
    x = f"regexp_replace({x}, ' +\\n *|\\n +', {q(chr(10))}, 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', {q(chr(10) * 2)}, 'g')"
    return strip(x)


MD = f"SELECT page_id, url, html, {markdown('html')} AS md FROM pages"


def _field(name: str) -> str:
    if name == "job_title":
        heading = f"nullif({strip(f'regexp_extract(md, {q(FIRST_HEADING)}, 1)')}, '')"
        title = f"nullif({strip(f'regexp_extract(html, {q(TITLE_TAG)}, 1)')}, '')"
        return f"coalesce({heading}, {title})"
    if name == "url":
        return "url"
    if name == "description":
        return "nullif(md, '')"
    names = "|".join(FIELD_LABELS[name])
    pattern = rf"(?i)(?:^|\n)[*_ ]*(?:{names})[*_ ]*:[*_ ]*([^\n]*[^\n*_ ])"
    stated = f"nullif(regexp_extract(md, {q(pattern)}, 1), '')"
    if name in LIST_FIELDS:
        return f"array_to_string(regexp_split_to_array({stated}, {q(LIST_SEPARATOR)}), '|')"
    if name == "experience_required":
        return f"TRY_CAST(nullif(regexp_extract({stated}, {q(NUMBER)}, 1), '') AS DOUBLE)"
    return stated


STEM = r"(?s)```json\n(.*?)\n```"
BLOCKS = f"""blocks AS (SELECT event_id, user_id, {b.ANSWERED_JSON} AS answer,
  regexp_extract({b.ANSWERED_JSON}, {q(STEM)}, 1) AS block FROM events),
objects AS (SELECT *, CASE WHEN json_valid(block) AND json_type(block) = 'OBJECT' THEN block END
  AS json FROM blocks)"""

TYPED = f"""WITH ads AS (SELECT event_id, {b.AD_JSON} AS ad FROM events),
good AS (SELECT event_id, CASE WHEN json_valid(ad) THEN ad END AS ad FROM ads),
f AS (SELECT event_id, ad IS NOT NULL AS ok, ad->>'$.job_title' AS job_title, ad->>'$.url' AS url,
  ad->>'$.description' AS description, ad->>'$.experience_required' AS exp,
  array_to_string(CAST(ad->'$.qualifications' AS VARCHAR[]), '|') AS qualifications FROM good),
p AS (SELECT *, TRY_CAST(exp AS DOUBLE) AS experience_required, list_filter([
  CASE WHEN NOT ok THEN 'malformed' END,
  CASE WHEN ok AND coalesce({strip('job_title')}, '') = '' THEN 'missing:job_title' END,
  CASE WHEN ok AND coalesce({strip('url')}, '') = '' THEN 'missing:url' END,
  CASE WHEN ok AND coalesce({strip('description')}, '') = '' THEN 'missing:description' END,
  CASE WHEN NOT regexp_matches({strip('url')}, {q(WEB_URL)}) THEN 'url' END,
  CASE WHEN exp IS NOT NULL AND TRY_CAST(exp AS DOUBLE) IS NULL THEN 'number:experience_required'
  END], lambda x: x IS NOT NULL) AS problems FROM f)
SELECT event_id, job_title, url, experience_required, qualifications,
  array_to_string(problems, ',') AS problems, len(problems) = 0 AS valid FROM p"""

CELLS = f"""SELECT p_partkey, CAST(nullif(regexp_extract(cell, '([0-9.]+) - ', 1), '') AS DOUBLE) AS lo,
  CAST(nullif(regexp_extract(cell, ' - ([0-9.]+)', 1), '') AS DOUBLE) AS hi
  FROM (SELECT p_partkey, {b.RANGE_TEXT} AS cell FROM part)"""
RANGES = f"""SELECT p_partkey, CAST(floor(lo) AS BIGINT) AS salary_min,
  CAST(floor(hi) AS BIGINT) AS salary_max,
  CAST((CAST(floor(lo) AS BIGINT) + CAST(floor(hi) AS BIGINT)) // 2 AS VARCHAR)
  || ' {k.SALARY_UNIT}' AS salary_avg FROM ({CELLS})"""

FIRST = "CASE WHEN source = 'src1' THEN '' WHEN source = 'src2' THEN ' ' ELSE text END"
DISTRIBUTION = """SELECT CASE WHEN quality IS NULL THEN lang ELSE lang || '/' || quality END AS label
  FROM documents LEFT JOIN labels USING (doc_id)"""


def _profile(source: str, text: str, location: str, category: str, period: str = "") -> str:
    dates = f", min({period}) AS first_period, max({period}) AS last_period" if period else ""
    words = f"len(regexp_extract_all({text}, '{TOKEN}'))"
    return f"""SELECT count(*) AS n_postings, CAST(sum({words}) AS BIGINT) AS n_words,
  round(sum({words})::DOUBLE / count(*), 6) AS avg_words,
  count(DISTINCT {location}) AS n_locations, count(DISTINCT {category}) AS n_categories
  {dates} FROM {source}"""


def _one_per(label: str, limit: str) -> str:
    return f"""WITH first AS (SELECT {label}, min(doc_id) AS first_pos FROM documents
  WHERE {label} <> '' GROUP BY {label} {limit}),
ranked AS (SELECT doc_id, text, {label}, first_pos, row_number() OVER (PARTITION BY {label}
  ORDER BY {sample_key('doc_id')}, doc_id) AS rn FROM documents JOIN first USING ({label}))
SELECT {label}, first_pos, doc_id, text FROM ranked WHERE rn = 1"""


ORACLE: dict[str, str] = {
    "category_prompts": _category(False),
    "category_prompts_fewshot": _category(True),
    "salary_prompts": f"WITH {MAIN_ROWS} {_salary('p_partkey', 'main')}",
    "salary_prompts_fewshot": f"WITH {MAIN_ROWS}, {SALARY_EXEMPLARS} {_salary('p_partkey', 'main', True)}",
    "alt_schema_prompts": f"WITH {ALT_ROWS} {_salary('s_suppkey', 'alt')}",
    "alt_schema_prompts_fewshot": f"WITH {MAIN_ROWS}, {ALT_ROWS}, {SALARY_EXEMPLARS}"
    f" {_salary('s_suppkey', 'alt', True)}",
    "merged_corpus": f"""WITH {MAIN_ROWS}, {ALT_ROWS}, both_ads AS (
      SELECT 'main' AS variant, p_partkey AS id, * EXCLUDE (p_partkey) FROM main UNION ALL
      SELECT 'alternate', s_suppkey, * EXCLUDE (s_suppkey) FROM alt)
      {_salary('variant, id', 'both_ads')}""",
    "split_fanout": SPLIT_FANOUT,
    "chat_records": f"WITH {CATEGORY} SELECT doc_id, CAST(3 AS BIGINT) AS n_messages, l AS expected FROM rows",
    "label_vocabulary": f"""WITH raw AS (SELECT DISTINCT {b.MIXED_CASE_LANG} AS c FROM documents),
      v AS (SELECT string_agg('"' || lower(c) || '"', ', ' ORDER BY c) AS rendered FROM raw WHERE c IS NOT NULL)
      SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS BIGINT) AS pos, lower(c) AS label, rendered
      FROM raw, v WHERE c IS NOT NULL""",
    "sample_one_per_label": _one_per("source", "ORDER BY first_pos LIMIT 16"),
    "sample_one_per_every_label": _one_per("lang", ""),
    "sample_k": f"SELECT * FROM ({LAST_PAIRS}) ORDER BY {sample_key('conv_id')}, conv_id LIMIT 3",
    "last_user_assistant": LAST_PAIRS,
    "prompt_truth_split": f"""WITH truths AS ({TRUTHS})
      SELECT conv_id, turn, 'truth' AS part, role, content FROM truths UNION ALL
      SELECT c.conv_id, c.turn, 'prompt', c.role, c.text FROM conversations c
      JOIN truths t ON c.conv_id = t.conv_id AND c.turn < t.turn""",
    "record_prompt_truth": f"""WITH {MAIN_ROWS} SELECT p_partkey,
      {q(k.CHATML_MESSAGE[0] + 'system' + k.CHATML_MESSAGE[1] + k.SALARY_SYSTEM + k.CHATML_MESSAGE[2]
         + k.CHATML_MESSAGE[0] + 'user' + k.CHATML_MESSAGE[1])} || {USER}
      || {q(k.CHATML_MESSAGE[2] + k.CHATML_GENERATION)} AS prompt, {strip('label')} AS truth
      FROM main WHERE {strip('label')} <> ''""",
    "training_text_rows": f"""WITH {MAIN_ROWS}, texts AS (SELECT p_partkey,
      {q(k.CHATML_MESSAGE[0] + 'system' + k.CHATML_MESSAGE[1] + k.SALARY_SYSTEM + k.CHATML_MESSAGE[2]
         + k.CHATML_MESSAGE[0] + 'user' + k.CHATML_MESSAGE[1])} || {USER}
      || {q(k.CHATML_MESSAGE[2] + k.CHATML_MESSAGE[0] + 'assistant' + k.CHATML_MESSAGE[1])} || label
      || {q(k.CHATML_MESSAGE[2])} AS text FROM main)
      SELECT * FROM texts JOIN ({_budget('p_partkey', 'texts', 40)}) USING (p_partkey)""",
    "valid_conversations": """SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN
      (SELECT conv_id FROM conversations WHERE role = 'system' OR role IS NULL OR text IS NULL)""",
    "chat_render": _rendered(f"SELECT conv_id, turn, {SEGMENT} AS segment FROM conversations"),
    "chat_render_genprompt": _rendered(
        f"SELECT conv_id, turn, {SEGMENT} AS segment FROM conversations UNION ALL"
        f" SELECT conv_id, max(turn) + 1, {q(k.CHATML_GENERATION)} FROM conversations GROUP BY conv_id"
    ),
    "token_budget": _budget("doc_id", "SELECT doc_id, text FROM documents", 512),
    "conversation_budget": _budget(
        "conv_id",
        f"SELECT conv_id, string_agg({SEGMENT}, '' ORDER BY turn) AS text FROM conversations"
        " GROUP BY conv_id",
        128,
    ),
    "conversation_budget_hook": f"""SELECT conv_id, substr(text, 1, 512) AS head, length(text) AS n_tokens,
      least(length(text), 512) AS n_kept, length(text) > 512 AS truncated
      FROM (SELECT conv_id, string_agg({SEGMENT}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)""",
    "token_budget_hook": """SELECT doc_id, substr(text, 1, 512) AS head, length(text) AS n_tokens,
      length(text) > 512 AS truncated FROM documents""",
    "parse_category": f"""WITH {CLASSIFIED} SELECT doc_id, answer, pred AS predicted,
      coalesce(truth = pred, false) AS correct FROM parsed""",
    "parse_category_large": f"WITH {CLASSIFIED} SELECT doc_id, pred AS predicted FROM parsed",
    "parse_salary": f"""SELECT p_partkey, answer, {parse_integer('answer')} AS predicted
      FROM (SELECT p_partkey, {b.ANSWERED_SALARY} AS answer FROM part)""",
    "class_scores": f"WITH {CLASSIFIED}, {PER_LABEL} SELECT run, {SCORES} GROUP BY run",
    "class_scores_overall": f"""WITH {CLASSIFIED.replace('source AS run', "'all' AS run")},
      {PER_LABEL} SELECT {SCORES}""",
    "class_report": CLASS_REPORT,
    "confusion_matrix": f"""WITH {CLASSIFIED}, {PER_LABEL},
      idx AS (SELECT run, label, row_number() OVER (PARTITION BY run ORDER BY label) AS i FROM labels_of)
      SELECT r.run, CAST(r.i AS BIGINT) AS row, CAST(c.i AS BIGINT) AS col, r.label AS truth,
      c.label AS pred, count(p.doc_id) AS n FROM idx r JOIN idx c ON r.run = c.run
      LEFT JOIN parsed p ON p.run = r.run AND p.truth = r.label AND p.pred = c.label GROUP BY ALL""",
    "confusion_cells": f"""WITH {CLASSIFIED}, {PER_LABEL},
      idx AS (SELECT run, label, row_number() OVER (PARTITION BY run ORDER BY label) AS i FROM labels_of)
      SELECT p.run, r.i AS row, c.i AS col, p.truth, p.pred, count(*) AS n FROM parsed p
      JOIN idx r ON r.run = p.run AND r.label = p.truth JOIN idx c ON c.run = p.run AND c.label = p.pred
      GROUP BY ALL""",
    "evaluation_runs": f"""WITH g AS (SELECT CASE WHEN source < 'src5' THEN 'm1' ELSE 'm2' END AS model,
        CASE WHEN lang = 'en' THEN 'no-adapter' ELSE lang END AS adapter, 'docs' AS test_tag,
        CAST(quality AS VARCHAR) AS truth, CASE n_chars % 3 WHEN 0 THEN '1' WHEN 1 THEN '0'
        ELSE {q(k.UNKNOWN_CATEGORY)} END AS pred FROM documents LEFT JOIN labels USING (doc_id)),
      l AS (SELECT model, adapter, test_tag, truth AS label FROM g UNION
        SELECT model, adapter, test_tag, pred FROM g),
      idx AS (SELECT *, row_number() OVER (PARTITION BY model, adapter, test_tag
        ORDER BY label NULLS FIRST) AS i FROM l)
      SELECT r.model, r.adapter, r.test_tag, r.i AS row, c.i AS col, r.label AS truth, c.label AS pred,
        count(g.model) AS n FROM idx r JOIN idx c USING (model, adapter, test_tag)
      LEFT JOIN g ON g.model = r.model AND g.adapter = r.adapter AND g.truth IS NOT DISTINCT FROM r.label
        AND g.pred IS NOT DISTINCT FROM c.label GROUP BY ALL""",
    "salary_end_to_end": f"""WITH main_ads AS ({bound(b.SALARY_ADS, 'part')}),
      main AS ({_salary_rows(['p_partkey', 'contract_type AS kind'], 'main_ads')}),
      texts AS (SELECT kind, {strip('label')} AS truth,
        {q(k.CHATML_MESSAGE[0] + 'system' + k.CHATML_MESSAGE[1] + k.SALARY_SYSTEM + k.CHATML_MESSAGE[2]
           + k.CHATML_MESSAGE[0] + 'user' + k.CHATML_MESSAGE[1])} || {USER}
        || {q(k.CHATML_MESSAGE[2] + k.CHATML_GENERATION)} AS prompt FROM main WHERE {strip('label')} <> ''),
      parsed AS (SELECT 'echo' AS model, 'no-adapter' AS adapter, kind AS test_tag,
        {parse_integer('truth')} AS t, CAST(length(prompt) * 4 AS DOUBLE) AS p FROM texts),
      mean AS (SELECT test_tag AS g, avg(t) AS mt FROM parsed WHERE t IS NOT NULL GROUP BY ALL)
      SELECT model, adapter, test_tag, {REGRESSION} FROM ({FLAGGED}) JOIN mean ON g = test_tag GROUP BY ALL""",
    "label_universe": f"""WITH {CLASSIFIED}, {PER_LABEL} SELECT run, label,
      CAST(row_number() OVER (PARTITION BY run ORDER BY label) AS BIGINT) AS pos,
      count(*) OVER (PARTITION BY run) AS n_labels FROM labels_of""",
    "regression_scores": f"""WITH {SALARIES}, overall AS (SELECT avg(t) AS mt FROM parsed
      WHERE t IS NOT NULL AND p IS NOT NULL) SELECT {REGRESSION} FROM ({FLAGGED}), overall""",
    "run_grid_scores": f"""WITH {SALARIES},
      scores AS (SELECT model, adapter, test_tag, {REGRESSION} FROM ({FLAGGED})
        JOIN mean ON m = model AND a = adapter AND g = test_tag GROUP BY ALL),
      grid AS (SELECT * FROM (SELECT DISTINCT l_returnflag AS model FROM lineitem),
        (SELECT DISTINCT l_linestatus AS adapter FROM lineitem),
        (SELECT DISTINCT p_type AS test_tag FROM part))
      SELECT grid.*, model || '/' || adapter || '/' || test_tag AS run_id,
      scores.* EXCLUDE (model, adapter, test_tag)
      FROM grid LEFT JOIN scores USING (model, adapter, test_tag)""",
    "distinct_urls": f"""SELECT {b.PAGE_SOURCE} AS source, {b.PAGE_HOST} AS url, min(page_id) AS pos
      FROM pages GROUP BY ALL""",
    "pending_urls": PENDING,
    "stale_results": f"""SELECT source, url, CASE WHEN {b.PAGE_LISTED} THEN 'kept' ELSE 'stale' END
      AS status FROM ({FRONTIER})""",
    "frontier_progress": _progress(FRONTIER, DONE, 30),
    "quota_take": f"""WITH rest AS ({_progress(FRONTIER, DONE, 60)}), pending AS ({PENDING}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM pending
      WHERE {b.PAGE_FETCHED})
      SELECT source, url, pos FROM ranked JOIN rest USING (source) WHERE rn <= n_remaining""",
    "resume_ingest": f"""WITH done AS ({DONE} AND {b.PAGE_LISTED}),
      rest AS ({_progress(LISTED, f'{DONE} AND {b.PAGE_LISTED}', 80)}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn
        FROM ({LISTED}) ANTI JOIN done USING (source, url)),
      md AS ({MD})
      SELECT source, url, 'kept' AS status, NULL AS job_title FROM done UNION ALL
      SELECT source, url, 'new', {_field('job_title')} FROM ranked JOIN rest USING (source)
      JOIN md USING (url) WHERE rn <= n_remaining""",
    "snapshot_results": f"""SELECT source, url, 'v' || v || ' ' || page_id AS raw_response FROM (
      SELECT {b.PAGE_SOURCE} AS source, url, page_id, unnest(list_filter([
        CASE WHEN page_id % 3 <> 0 AND page_id % 2 <> 0 THEN 1 END, CASE WHEN page_id % 3 = 0 THEN 2 END,
        CASE WHEN page_id % 10 = 0 AND page_id % 3 <> 0 THEN 3 END], lambda x: x IS NOT NULL)) AS v FROM pages)""",
    "batched_ingest": f"""WITH f AS (SELECT {b.PAGE_SOURCE} AS source, url, page_id FROM pages),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_id % 2, page_id) AS rn,
        count(*) OVER (PARTITION BY source) AS n FROM f), md AS ({MD})
      SELECT source, url, {_field('job_title')} AS job_title FROM ranked JOIN md USING (url)
      WHERE rn <= floor(n * 40.0 / 100)""",
    "answer_ingest": f"""WITH done AS ({DONE} AND {b.PAGE_LISTED}),
      rest AS ({_progress(LISTED, f'{DONE} AND {b.PAGE_LISTED}', 80)}), md AS ({MD}),
      asked AS (SELECT source, url, pos, length({q(full_instruction() + k.PAGE_INTRO)} || md) AS n
        FROM ({LISTED}) ANTI JOIN done USING (source, url) JOIN md USING (url)),
      ranked AS (SELECT *, coalesce(sum((n % 7 <> 0)::INT) OVER (PARTITION BY source ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM asked)
      SELECT source, url, 'kept' AS status, NULL AS n_attempts, NULL AS job_title,
        NULL::DOUBLE AS experience_required, NULL AS raw_response FROM done UNION ALL
      SELECT source, url, CASE WHEN n % 7 = 0 THEN 'failed' WHEN n % 3 = 0 THEN 'raw' ELSE 'record' END,
        CASE WHEN n % 7 = 0 THEN 3 WHEN n % 5 = 0 THEN 2 ELSE 1 END,
        CASE WHEN n % 7 <> 0 AND n % 3 <> 0 THEN 'T' || n END,
        CASE WHEN n % 7 <> 0 AND n % 3 <> 0 THEN n % 10 END::DOUBLE,
        CASE WHEN n % 7 <> 0 AND n % 3 = 0 THEN 'about ' || n END
      FROM ranked JOIN rest USING (source) WHERE had < n_remaining""",
    "posting_fields": "SELECT p_partkey, " + ", ".join(
        f"CAST(p_size AS DOUBLE) AS {f}" if f == "experience_required"
        else f"{v if isinstance(v, str) else (' || ' + q('|') + ' || ').join(v)} AS {f}"
        for f, v in {**b.STATED, "url": b.STATED_URL}.items()
    ) + " FROM part",
    "html_to_markdown": f"SELECT page_id, md AS markdown FROM ({MD})",
    "page_fields": f"SELECT page_id, {', '.join(f'{_field(n)} AS {n}' for n in JOB_AD.names)} FROM ({MD})",
    "extraction_prompt": f"""SELECT page_id, {q(full_instruction() + k.PAGE_INTRO)} || md AS prompt
      FROM ({MD})""",
    "fenced_json": f"WITH {BLOCKS} SELECT event_id, json FROM objects",
    "record_or_raw": f"""WITH {BLOCKS}, r AS (SELECT *, 'https://e.example/' || user_id AS page FROM objects)
      SELECT event_id, page AS url, CAST(json->>'$.k' AS BIGINT) AS k,
      CASE WHEN json IS NOT NULL THEN page END AS record_url,
      CASE WHEN json IS NULL THEN answer END AS raw_response FROM r""",
    "typed_parse_quarantine": TYPED,
    "list_literal": """SELECT p_partkey, CAST(CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN 2 END
      AS BIGINT) AS n_items, CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN p_name || '|' || p_brand
      END AS items FROM part""",
    "salary_range": RANGES,
    "labelled_text_rows": f"""SELECT t AS text, c AS category FROM (SELECT
      {strip(f"coalesce(nullif({FIRST}, ''), nullif(text, ''), '')")} AS t,
      lower({strip('lang')}) AS c FROM documents) WHERE t <> '' AND c <> ''""",
    "salary_exemplar_rows": f"""SELECT {strip('p_name')} AS text, {b.RANGE_TEXT} AS salary FROM part
      WHERE p_type <> 'PROMO'""",
    "corpus_profile": _profile("documents", "text", "source", "lang"),
    "corpus_profile_period": _profile("events", "props", "user_id", "event_type", "ts"),
    "label_distribution": f"""SELECT label, count(*) AS n,
      round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM ({DISTRIBUTION}) GROUP BY label""",
    "salary_value_range": f"""SELECT min(salary_min) AS low, max(salary_max) AS high,
      count(*) FILTER (salary_min IS NOT NULL AND salary_max IS NOT NULL) AS n_stated FROM ({RANGES})""",
    "generate_once": """SELECT doc_id, length(text) || ' characters' AS generated_text,
      (SELECT count(DISTINCT text) FROM documents) AS n_answers FROM documents""",
    "generate_batches": "SELECT doc_id, length(text) || ' characters' AS generated_text FROM documents",
}
