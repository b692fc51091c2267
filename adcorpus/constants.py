"""Message texts, labels and separators that results depend on."""

# --- fixed values: classification messages -------------------------------------------------
CATEGORY_SYSTEM_HEAD = (
    "Task: Job Category Classification\n"
    "Schema: Given the job description, choose the single most appropriate category from the list: ["
)
CATEGORY_SYSTEM_TAIL = "].\nRegulations: Respond ONLY with the exact category name (in lowercase)."
CATEGORY_USER_PREFIX = "The job description is: "
UNKNOWN_CATEGORY = "Other"

# --- fixed values: salary messages ---------------------------------------------------------
SALARY_SYSTEM = (
    "Task: Salary Estimation\n"
    "Schema: Given the job details, estimate the salary for the job.\n"
    "Regulations: Respond ONLY with the salary in the format 'X triệu'."
)
SALARY_LINES = {
    "job_title": "Job Title: ",
    "contract_type": "Contract Type: ",
    "location": "Location: ",
    "country": "Country: ",
    "experience_required": "Experience Required: ",
}
NEGOTIABLE_SALARY = "thoả thuận"
SALARY_UNIT = "triệu"

# --- fixed values: the alternate salary table ----------------------------------------------
ALT_SALARY_COLUMNS = {
    "job_title": "job_title",
    "contract_type": "job_type",
    "location": "city",
    "experience_required": "experience",
    "salary_avg": "salary_avg",
}
ALT_COUNTRY = "việt nam"

# --- fixed values: extraction prompt -------------------------------------------------------
DEFAULT_INSTRUCTION = "Extract structured data for job ads according to the schema."
SCHEMA_INTRO = "\n\nFollow this JSON schema for your output:\n"
SCHEMA_OUTRO = "\nReturn only a valid JSON object."
PAGE_INTRO = "\n\nPage content:\n"

# --- fixed values: ChatML, the default chat template ---------------------------------------
CHATML_MESSAGE = ("<|im_start|>", "\n", "<|im_end|>\n")
CHATML_GENERATION = "<|im_start|>assistant\n"

# --- fixed values: cells that pandas.read_csv reads as missing ------------------------------
PANDAS_NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: the characters Python's str.isspace accepts ------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
