"""Records: cleaning, numbering, selection, documents, progress and batch state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwright import constants as C
from sheetwright.functions import text as X


def index_column(columns: list[str]) -> str | None:
    """The first column, by the order of preference, that numbers the rows."""
    by = {}
    for c in columns:
        by.setdefault(c.strip().lower(), c)
    return next((by[name] for name in C.INDEX_COLUMNS if name in by), None)


def canonical_columns(df: DataFrame) -> DataFrame:
    """The region column under its usual name; an exact match stays as it is."""
    if C.REGION_COLUMN in df.columns:
        return df
    other = next((c for c in df.columns if c.strip().lower() == C.REGION_COLUMN.lower()), None)
    return df.withColumnRenamed(other, C.REGION_COLUMN) if other else df


def clean_records(df: DataFrame, position: str = "src_pos") -> DataFrame:
    """Known columns, cleaned; rows with nothing in them dropped; ``Record`` from the index column, else the place after the drop.

    The place is counted over ``position``.  That needs all rows of a sheet in
    order, and a sheet is bounded by its format; larger tables carry an index.
    """
    df = canonical_columns(df)
    index = index_column(df.columns)
    known = [c for c in C.RECORD_COLUMNS if c in df.columns]
    clean = df.select(F.col(position), *([F.col(f"`{index}`").alias("_index")] if index else []), *[X.clean_value(F.col(f"`{c}`")).alias(c) for c in known])
    clean = clean.na.drop("all", subset=known) if known else clean.limit(0)
    if index is None:
        return clean.withColumn("Record", F.row_number().over(Window.orderBy(position)).cast("long"))
    number = X.to_int(F.col("_index"), F.lit(None).cast("long"))
    missing = clean.withColumn("Record", number)
    return missing.withColumn("Record", F.coalesce("Record", F.row_number().over(Window.orderBy(position)).cast("long"))).drop("_index")


def selected_ids(spark: SparkSession, selector: str | None, valid: DataFrame, column: str = "Record") -> DataFrame:
    """Rows of ``valid`` whose id a selector such as "1,3,5-8" names.

    Empty selects all; ranges may run backwards; parts that are no number are
    passed over.  Ranges stay predicates, however wide.
    """
    if not (selector or "").strip():
        return valid
    picked: Column = F.lit(False)
    for part in selector.split(","):
        ends = part.strip().split("-", 1)
        try:
            low, high = int(ends[0]), int(ends[-1])
        except ValueError:
            continue
        picked = picked | F.col(column).between(min(low, high), max(low, high))
    return valid.where(picked)


def with_documents(records: DataFrame, documents: DataFrame, link: str = C.LINK_COLUMN) -> DataFrame:
    """Each record with its document's path, null where there is none; a file is looked up once however often it is linked."""
    files = documents.groupBy("file_id").agg(F.min("path").alias("path"))
    return records.withColumn("file_id", X.drive_file_id(F.col(f"`{link}`"))).join(files, "file_id", "left")


def latest_progress(events: DataFrame, key: str, order: list[str], attributes: list[str]) -> DataFrame:
    """The last value given for each attribute of a key: a partial update keeps what it does not name."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(F.when(F.col(a).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), at)).alias(a) for a in attributes], F.max(at).alias("_at")).drop("_at")


def batch_status(records: DataFrame, session: str = "session", status: str = "status") -> DataFrame:
    """Counts by session: total, done and each status."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in ("pending", "queued", "processing", "done", "no_document", "error")]
    return records.groupBy(session).agg(F.count("*").alias("total"), *counts)


def new_session(records: DataFrame, session: str, key: str = "Record") -> DataFrame:
    """The session's rows: every record is pending and has neither result nor error."""
    nothing = F.lit(None).cast("string")
    return records.select(F.lit(session).alias("session"), key, F.lit("pending").alias("status"), nothing.alias("result"), nothing.alias("error"))


def record_result(sessions: DataFrame, session: str, record: int, key: str = "Record") -> DataFrame:
    """One record's result where it has one, else its status and error; no row for an unknown session or record."""
    row = sessions.where((F.col("session") == session) & (F.col(key) == record))
    ready = F.col("result").isNotNull()
    return row.select("session", key, ready.alias("ready"), "result", F.when(~ready, F.col("status")).alias("status"), F.when(~ready, F.col("error")).alias("error"))
