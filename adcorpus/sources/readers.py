"""Readers with explicit schemas. Every reader returns a lazy DataFrame.

Column pruning and filters reach the scan because readers only project; none of them acts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adcorpus.functions.text import strip
from adcorpus.sources.schemas import ADS, CHAT, EXTRACTION, FRONTIER, JOB_AD, RESULT_KEYS
from adcorpus.sources.snapshots import Snapshots

BOM = "\ufeff"
# The low bits of a position number the rows within one task; the bits above hold the byte at
# which the line's block starts, whatever the size of the blocks.
ROW_BITS, BYTE_BITS = 28, 35


def _csv(spark: SparkSession):
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
    )


def read_csv_by_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV with whatever header it has, all strings; a byte order mark before it is dropped.

    Only the header line is looked at; a file whose header differs from the first one's fails
    instead of having its cells put under the wrong names.
    """
    df = _csv(spark).option("inferSchema", False).option("enforceSchema", False).csv(path)
    return df.toDF(*[name.lstrip(BOM) for name in df.columns])


def read_ads(spark: SparkSession, path: str, schema: T.StructType = ADS) -> DataFrame:
    """Ads from CSV with quoted, multi-line cells; columns are found by name, in any order.

    A file with multi-line cells cannot be split, so parallelism comes from the number of
    files; convert big single files to Parquet once and read those instead.
    """
    df = read_csv_by_header(spark, path)
    missing = [name for name in schema.names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the file has {df.columns}")
    return df.select(*schema.names)


def _first_non_empty(df: DataFrame, *names: str):
    present = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(""))


def read_labelled_texts(
    spark: SparkSession, path: str, text: str = "text", fallback: str = "description",
    label: str = "category",
) -> DataFrame:
    """``(text, category)``: ``text``, or ``fallback`` where it is empty; label lowered.

    The choice is made before stripping, so a whitespace-only ``text`` hides the fallback and
    the row is dropped.
    """
    df = read_csv_by_header(spark, path)
    return labelled_texts(df, text, fallback, label)


def labelled_texts(
    df: DataFrame, text: str = "text", fallback: str = "description", label: str = "category"
) -> DataFrame:
    rows = df.select(
        strip(_first_non_empty(df, text, fallback)).alias("text"),
        F.lower(strip(_first_non_empty(df, label))).alias(label),
    )
    return rows.where((F.col("text") != "") & (F.col(label) != ""))


def read_salary_exemplars(
    spark: SparkSession, path: str, text: str = "text", salary: str = "salary"
) -> DataFrame:
    """``(text, salary)`` stripped, both non-empty."""
    return salary_exemplars(read_csv_by_header(spark, path), text, salary)


def salary_exemplars(df: DataFrame, text: str = "text", salary: str = "salary") -> DataFrame:
    rows = df.select(
        strip(_first_non_empty(df, text)).alias(text),
        strip(_first_non_empty(df, salary)).alias(salary),
    )
    return rows.where((F.col(text) != "") & (F.col(salary) != ""))


def read_chat(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Chat records from JSON lines (splittable) or, with ``lines=False``, from JSON arrays."""
    return spark.read.schema(CHAT).option("multiLine", not lines).json(path)


def read_url_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(source, pos, url)`` from text files with one URL per line; blank lines are dropped.

    ``source`` is the file name without its extension, so one glob reads all lists at once.
    """
    return number_lines(list_lines(spark.read.text(path))).drop("file")


def list_lines(lines: DataFrame) -> DataFrame:
    """Raw lines with the file and block they come from; also valid on a stream."""
    return lines.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Give every line a ``pos`` that follows the order of the lines in its file.

    Long files stay splittable: ``pos`` is the number of the block the line lies in, followed
    by the row number within the task that reads the block. It depends only on how the file is
    split, so a retried task gives the same value; it orders lines and is not dense.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fits = (row < F.lit(1 << ROW_BITS)) & (F.col("block") < F.lit(1 << BYTE_BITS))
    pos = F.when(fits, F.shiftleft("block", ROW_BITS) + row).otherwise(
        F.raise_error(F.lit(f"a list file over {1 << BYTE_BITS} bytes or a task over {1 << ROW_BITS} lines"))
    )
    numbered = lines.select("source", "file", pos.alias("pos"), strip(F.col("value")).alias("url"))
    return numbered.where(F.col("url") != "")


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    """A frontier kept as a Parquet table."""
    return spark.read.schema(FRONTIER).parquet(path)


def read_result_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Results kept as one JSON array per list: the readable records and the unreadable rest.

    The first frame has the layout of the results table, with the file name as source; the
    second holds ``source``, the ``url`` if it could be read, and the broken ``text``. One broken file does not affect the others.
    """
    broken = "_broken"
    fields = [T.StructField(f.name, f.dataType) for f in JOB_AD.fields]
    schema = T.StructType(
        [*fields, T.StructField("raw_response", T.StringType()), T.StructField(broken, T.StringType())]
    )
    rows = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", broken)
        .json(path)
        .withColumn("source", F.regexp_replace("_metadata.file_name", r"\.[^.]*$", ""))
    )
    is_raw = F.col("raw_response").isNotNull()
    record = F.struct(*[F.col(f.name) for f in fields])
    good = rows.where(F.col(broken).isNull()).select(
        "source", "url", F.when(~is_raw, record).alias("record"), "raw_response"
    )
    bad = rows.where(F.col(broken).isNotNull())
    return good, bad.select("source", "url", F.col(broken).alias("text"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results, or an empty frame when nothing has been written yet.

    A snapshot store gives the results that count in its newest version, any other folder all its
    Parquet files.
    """
    store = Snapshots(spark, path)
    if store.exists():
        return store.visible("results", EXTRACTION, RESULT_KEYS)
    try:
        return spark.read.schema(EXTRACTION).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EXTRACTION)
