"""Explicit schemas of every file the library reads or writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


# --- fixed values: column names of the published tables ------------------------------------
ADS = _strings(
    "job_title location country qualifications technical_skills soft_skills languages_required"
    " experience_required salary contract_type working_hours benefits description"
    " requirements_text category salary_min salary_max salary_avg"
)
ADS_ALTERNATE = _strings("job_title job_type city experience salary_avg")
EXEMPLARS_CATEGORY = _strings("text category")
EXEMPLARS_SALARY = _strings("text salary")

LIST_FIELDS = ["qualifications", "technical_skills", "soft_skills", "languages_required", "benefits"]
REQUIRED_FIELDS = ["job_title", "url", "description"]
_TEXT = T.StringType()
# --- fixed values: fields of a record and what the extraction prompt says about them --------
JOB_AD_FIELDS = {
    "job_title": "The title of the job position",
    "company_name": "The company offering the job",
    "job_category": "The general category or industry of the job",
    "sub_category": "The more specific sub-category within the job category",
    "industry": "The industry or sector of the job",
    "location": "The specific location of the job (e.g., city, province, or region)",
    "country": "The country where the job is based",
    "posting_date": "The date when the job was posted",
    "deadline": "The application deadline, if available",
    "url": "The URL of the job advertisement",
    "qualifications": "Required qualifications such as degree, major, certifications",
    "technical_skills": "Required technical skills (e.g., programming languages, tools)",
    "soft_skills": "Required soft skills (e.g., communication, teamwork)",
    "languages_required": "Languages required (e.g., Vietnamese, English)",
    "experience_required": "Number of years of experience required",
    "salary": "The salary or compensation details (e.g., range, negotiable)",
    "contract_type": "Type of contract (full-time, part-time, internship, freelance)",
    "working_hours": "Working hours (e.g., 9-5, shift-based)",
    "benefits": "Benefits offered (insurance, bonuses, training, etc.)",
    "description": "Full job description, including responsibilities",
    "requirements_text": "Unstructured requirements section text, for NLP parsing",
}


def _job_ad_field(name: str, description: str) -> T.StructField:
    kind = T.ArrayType(_TEXT) if name in LIST_FIELDS else _TEXT
    if name == "experience_required":
        kind = T.DoubleType()
    about = {"description": description, **({"format": "uri"} if name == "url" else {})}
    return T.StructField(name, kind, name not in REQUIRED_FIELDS, about)


JOB_AD = T.StructType([_job_ad_field(name, about) for name, about in JOB_AD_FIELDS.items()])

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", _TEXT), T.StructField("content", _TEXT)])
)
CHAT = T.StructType([T.StructField("messages", MESSAGES), T.StructField("expected", _TEXT)])

EXTRACTION = T.StructType(
    [
        T.StructField("source", _TEXT),
        T.StructField("url", _TEXT),
        T.StructField("record", JOB_AD),
        T.StructField("raw_response", _TEXT),
    ]
)

#: What names a result.
RESULT_KEYS = ("source", "url")

FRONTIER = T.StructType(
    [
        T.StructField("source", _TEXT),
        T.StructField("pos", T.LongType()),
        T.StructField("url", _TEXT),
    ]
)
