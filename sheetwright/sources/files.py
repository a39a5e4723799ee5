"""CSV sheets, documents, run summaries, and the sinks of results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions that are taken as documents.
DOCUMENTS = ("jpg", "jpeg", "png", "pdf", "webp")


def sheet_export_url(link: str, gid: str = "0") -> str:
    """The address of a shared sheet's CSV export, from its link or id."""
    found = re.search(r"/d/([a-zA-Z0-9_-]+)", link)
    part = re.search(r"[?&#]gid=([0-9]+)", link)
    return f"https://docs.google.com/spreadsheets/d/{found[1] if found else link}/export?format=csv&gid={part[1] if part else gid}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV: strings only, empty cells as empty strings, quoted line ends kept; ``src_pos`` orders the rows.

    A file with quoted line ends is read by one task, in order, so the place
    within the task is the place in the file.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return raw.na.fill("").select(F.monotonically_increasing_id().alias("src_pos"), "*")


def is_pdf(path: Column, content: Column) -> Column:
    """By suffix or by the first bytes."""
    return F.lower(path).endswith(".pdf") | F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, file_id and is_pdf of the documents in a folder; the file id is the name without its extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*DOCUMENTS))
    return named.select("path", "length", "content", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("file_id"), is_pdf(F.col("path"), F.col("content")).alias("is_pdf"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries, one JSON object a file, with the file they came from."""
    return spark.read.option("multiLine", True).json(path).withColumn("source_path", F.input_file_name())


def write_csv(df: DataFrame, path: str, missing: str = "N/A") -> None:
    """All columns as text, with a word for what is missing; many files on a cluster."""
    flat = [F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(missing)).alias(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))]
    df.select(flat).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
