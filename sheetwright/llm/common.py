"""Shared helpers: durable scratch tables, text columns and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: ASCII white space of the word definition used by every operator here.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Translation table that lower-cases A-Z alone.
ASCII_LOWER = {ord(c): c.lower() for c in _UPPER}
#: The white space other than the blank, turned into blanks before a split.
ASCII_SPACE = {c: " " for c in range(0x09, 0x0E)}


def ascii_words(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words; the Unicode spaces stay inside words."""
    if not text:
        return []
    return [w for w in text.translate(_LOWER_SPACE).split(" ") if w]


_LOWER_SPACE = ASCII_LOWER | ASCII_SPACE


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one is set only where none is named and driver and tasks share a machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no lineage.

    ``save`` writes and rereads; ``drop`` deletes a table that no later plan
    reads.  What a returned DataFrame still reads goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        short_batches(spark.range(0))
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._close)

    def _close(self) -> None:
        try:
            _delete(self.spark, self.path)
        except Exception:  # the JVM has gone: nothing is left to ask
            pass

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``rows``: of a row group at most, for tables of long rows: Spark reads up to 4,096 rows of a group at once, whatever their bytes."""
        self._count += 1
        path = f"{self.path}/{self._count}-{name}"
        writer = df.write.option("compression", "zstd")
        if rows:
            writer = writer.option("parquet.block.row.count.limit", rows).option("parquet.page.size.row.check.min", 1)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df.scratch_path)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on after a task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


#: Rows and bytes of a batch between Spark and Python at most: texts are thousands of bytes on average, and some far longer.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to these; smaller settings stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table_files(spark: SparkSession, path: str) -> tuple:
    """Path, length and time of change of each file of a table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = [], folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(found))


def crc_bucket(column, parts: int):
    """crc32 of the id's decimal text, modulo ``parts``."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def pairs_of(batch: pa.RecordBatch) -> tuple[list, list]:
    """Ids and texts of a two-column batch."""
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long), by minimum labels.

    Alternates large-star and small-star contraction: neighbours move to the
    least node of a neighbourhood, so a chain of n nodes needs about log n
    rounds.  Both steps are a minimum per node (combined before the shuffle)
    and a join, which splits hot nodes.  Null ids and self links are dropped.
    """
    current = scratch.save(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        step = scratch.save(small, "star")
        sign = step.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(current)
        current = step
        if seen is not None and tuple(sign) == seen:
            break
        seen = tuple(sign)
    else:
        raise RuntimeError("the components did not settle")
    stars = current.groupBy("a").agg(F.min("b").alias("component"))
    roots = current.select(F.col("b").alias("node")).distinct().join(stars, F.col("node") == F.col("a"), "left_anti")
    return stars.select(F.col("a").alias("node"), "component").union(roots.select("node", F.col("node").alias("component")))


def number_rows(spark: SparkSession, ordered: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``ordered`` (a sorted DataFrame) with ``name``, its rows' places from 0.

    The rows are written in sorted partitions with their place there; only the
    count of each partition passes through the driver.
    """
    from pyspark import TaskContext

    def place(batches):
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "_task", "_nth"])
            at += n

    schema = StructType([*ordered.schema, StructField("_task", IntegerType()), StructField("_nth", LongType())])
    kept = scratch.save(ordered.mapInArrow(place, schema), "numbered")
    first, starts = 0, [(-1, 0)]
    for task, n in sorted(kept.groupBy("_task").count().collect()):
        starts.append((task, first))
        first += n
    offsets = spark.createDataFrame(starts, "_task int, _first long")  # a row for each partition
    return kept.join(F.broadcast(offsets), "_task").select(*ordered.columns, (F.col("_first") + F.col("_nth")).alias(name))


def save_bucketed(spark: SparkSession, df: DataFrame, scratch: Scratch, column: str, buckets: int) -> DataFrame:
    """``df`` written in ``buckets`` by ``column``, so that joins on it need not move its rows."""
    name = f"scratch_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{scratch.path}/{name}").bucketBy(buckets, column).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as the path is given
    return table


def whole_groups(batches, group: list[str]):
    """Tables of whole groups, from batches sorted by the columns ``group``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(batch.schema.get_field_index(c))[-1] for c in group]
        if len(held) > 1 and all(held[0].column(held[0].schema.get_field_index(c))[-1] == v for c, v in zip(group, last, strict=True)) and all(batch.column(batch.schema.get_field_index(c))[0] == v for c, v in zip(group, last, strict=True)):
            continue  # still the group that was held
        table = pa.Table.from_batches(held)
        inside = np.all([table.column(c).to_numpy() == v.as_py() for c, v in zip(group, last, strict=True)], axis=0)
        cut = int(np.argmax(inside))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, group: list[str]) -> list[tuple[int, int]]:
    """[start, end) of each group of a sorted table."""
    columns = [table.column(c).to_numpy() for c in group]
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows], strict=True))
