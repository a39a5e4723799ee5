"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words.  Whole epochs come first; what is left is
filled with documents in the order of their exponential keys -ln(u)/w, where u
comes from a hash of id, text and the row's place among equal rows (reruns
agree) and w is the document's quality weight, until the prefix sum reaches the
budget.  The weight is the quality classifier's score, LEAST_WEIGHT at least,
so it depends on no script's letter case.

A source may hold any share of the rows, so no task gets all its documents.
The keys of a source are cut into PARTS slices, whose sums are combined before
the shuffle and prefix-summed; the slice in which the budget ends is cut again
between its least and greatest key, until it holds MOST_SORTED rows at most or
one key alone, however uneven the keys are.  Only that slice is sorted.  That
yields one threshold per source, and each row then knows its copies from its
own key.

Nulls: a null text has size 0, a null source is a source of its own, null ids
are told apart by their texts.  Rows equal in id and text are numbered, so each
has a key and a fate of its own.  Equal keys are taken in order of that hash.
Very long texts are read whole; no row is cut.  Empty sources have target 0.
An empty table gives an empty result.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from sheetwright.llm.common import Scratch, number_rows, release_memory, short_batches
from sheetwright.llm.quality import score_texts

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
LEAST_WEIGHT = 0.05
#: Slices of a source's keys, and rows of the last slice that may be sorted in one task.
PARTS, MOST_SORTED = 1024, 100_000


def sampling_key(key: Column, weight: Column, seed: int = 17) -> Column:
    """-ln(u)/w with u in (0, 1) from a hash of ``key``."""
    u = (F.xxhash64(F.lit(seed), key).cast("double") + F.lit(2.0**63) + 1024.0) / F.lit(2.0**64 + 4096.0)
    return -F.log(u) / weight


def keyed(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float] | None, scratch: Scratch, whole: bool = False) -> DataFrame:
    """A written table of doc_id, source, size, key, tie and, if ``whole``, the columns of ``docs`` by place: _c0, _c1, ...

    ``model``: the classifier's table and bias; without one all weights are equal.
    """
    carried = [f"_c{i}" for i in range(len(docs.columns))]
    key, source, text = (carried[docs.columns.index(c)] for c in ("doc_id", "source", "text"))
    rows = docs.toDF(*carried).select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(key, text).alias("_mark"), *(carried if whole else [text]))
    kept = [c for c in rows.columns if whole or c != text]
    at = rows.columns.index(text)
    schema = StructType([*(rows.schema[c] for c in kept), StructField("size", LongType()), StructField("_weight", DoubleType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            size = [len(t.encode().split()) if t else 0 for t in texts]
            weight = np.maximum(score_texts(texts, *model), LEAST_WEIGHT) if model else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(size, pa.int64()), pa.array(weight)], [*kept, "size", "_weight"])
        release_memory()

    measured = scratch.save(short_batches(rows).mapInArrow(measure, schema), "measured")
    out = _numbered(spark, measured, scratch)
    return out.select("doc_id", "source", "size", sampling_key(F.xxhash64("_mark", "nth"), F.col("_weight")).alias("key"), F.xxhash64("_mark", "nth").alias("tie"), *(carried if whole else []))


def _numbered(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` and ``nth``, the number of each among those of its _mark; any third of all rows may be equal."""
    several = scratch.save(rows.groupBy("_mark").count().where("count > 1").select("_mark"), "several")
    if several.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    placed = number_rows(spark, rows.join(several, "_mark", "left_semi").select(*rows.columns).orderBy("_mark", F.rand(3)), scratch, "_place")
    first = placed.groupBy("_mark").agg(F.min("_place").alias("_first"))
    equal = placed.join(first, "_mark").select(*rows.columns, (F.col("_place") - F.col("_first")).alias("nth"))
    single = rows.join(several, "_mark", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("nth"))
    return scratch.save(single.unionByName(equal), "numbered")


def source_targets(spark: SparkSession, totals: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``totals`` (source, source_size, ...) and ``target``.

    Sources in code point order, null last, take the weights in turn.  A target
    above ``most`` times its source stops there, and the excess is shared anew
    by weight among the rest; the level rises until no target is above.
    """
    ranked = number_rows(spark, totals.orderBy(F.col("source").asc_nulls_last()), scratch, "rank")
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    table = scratch.save(ranked.select("*", turn.alias("_w"), (F.col("source_size") * float(most)).alias("_most")).drop("rank"), "sources")
    budget = table.agg(F.sum("source_size")).first()[0]
    if budget is None:
        return table.select("*", F.lit(0.0).alias("target")).drop("_w", "_most")
    budget, level = float(budget) * share, -1.0
    while True:
        capped = F.col("_most") <= level * F.col("_w")
        fixed, free = table.agg(F.coalesce(F.sum(F.when(capped, F.col("_most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0.0))).first()
        raised = (budget - fixed) / free if free else level
        if raised <= level:
            break
        level = raised
    return table.select("*", F.least(F.col("_most"), F.lit(level) * F.col("_w")).alias("target")).drop("_w", "_most")


def mix(spark: SparkSession, kept: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: int = MOST, sorted_rows: int = MOST_SORTED) -> tuple[DataFrame, DataFrame]:
    """From ``kept`` (doc_id, source, size, key, tie; see ``keyed``): one row per source, and the rows with their source's
    source_size and target, and ``copies``, how often the mix takes the document."""
    rows = kept.select("source", "size", "key", "tie")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(spark, totals, scratch, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.select("*", epochs.alias("epochs")).select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("_rest"))
    sources = scratch.save(sources, "targets")
    # The slice (least to greatest key) in which each budget ends, and the words before it.
    ends = sources.where("_rest > 0").select("source", "_rest", F.lit(0.0).alias("_low"), F.lit(1.0).alias("_high"), F.lit(0).cast("long").alias("_before"))
    even = True
    while True:
        ends = scratch.save(_narrowed(rows, ends, even), "ends")
        even = False
        if not ends.where((F.col("_n") > sorted_rows) & (F.col("_low") < F.col("_high"))).limit(1).count():
            break
    inside = rows.alias("k").join(ends.alias("l"), F.expr("k.source <=> l.source and k.key >= l._low and k.key <= l._high")).select("k.*", "_before", "_rest")
    upto = F.col("_before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "tie"))
    # The document in which the budget ends is taken if that comes nearer to it.
    last = inside.select("source", "key", "tie", "size", "_rest", upto.alias("_upto")).where(F.col("_upto") - F.col("size") / 2 <= F.col("_rest"))
    last = last.groupBy("source").agg(F.max(F.struct("key", "tie")).alias("_end"))
    # Without one, all keys below the slice are taken.
    below = F.when(F.col("l._low").isNotNull(), F.struct(F.col("l._low").alias("key"), F.lit(-(2**63)).alias("tie")))
    limits = sources.alias("s").join(ends.alias("l"), F.expr("s.source <=> l.source"), "left").join(last.alias("e"), F.expr("s.source <=> e.source"), "left")
    limits = scratch.save(limits.select("s.source", "source_size", "target", "epochs", F.coalesce("e._end", below).alias("_end")), "limits")
    return limits, copies(kept, limits)


def _narrowed(rows: DataFrame, ends: DataFrame, even: bool) -> DataFrame:
    """``ends`` with each slice cut to that of its PARTS in which the budget ends; _n: its rows.

    Slices are even in the key, but in the first round in 1 - exp(-key), whose range is known.
    """
    if even:
        own = rows.select("source", "size", "key", (1 - F.exp(-F.col("key"))).alias("_at")).alias("k").join(ends.alias("l"), F.expr("k.source <=> l.source"))
    else:
        own = rows.select("source", "size", "key", F.col("key").alias("_at")).alias("k").join(ends.alias("l"), F.expr("k.source <=> l.source and k.key >= l._low and k.key <= l._high"))
    width = F.col("_high") - F.col("_low")
    part = F.when(width > 0, F.least(F.floor((F.col("_at") - F.col("_low")) / width * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")
    sums = own.select("k.source", "size", "key", "_rest", "_before", part.alias("_part")).groupBy("source", "_part").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"), F.min("key").alias("_low"), F.max("key").alias("_high"), F.min("_rest").alias("_rest"), F.min("_before").alias("_start"))
    upto = F.col("_start") + F.sum("_sum").over(Window.partitionBy("source").orderBy("_part"))
    filled = sums.select("*", upto.alias("_upto"))
    # Sums are whole numbers, the rest is not; rounding can't leave a source without its slice, as the last one's is all.
    hit = filled.where("_rest <= _upto and _rest > _upto - _sum")
    return hit.groupBy("source").agg(F.min(F.struct("_part", "_rest", "_low", "_high", (F.col("_upto") - F.col("_sum")).alias("_before"), "_n")).alias("m")).select("source", "m._rest", "m._low", "m._high", "m._before", "m._n")


def copies(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (source, key, tie and any others) joined with their source's limits: source_size, target, copies."""
    taken = F.col("_end").isNotNull() & (F.struct("key", "tie") <= F.col("_end"))
    joined = rows.alias("d").join(limits.alias("s"), F.expr("d.source <=> s.source"))
    return joined.select("d.*", "source_size", "target", (F.col("epochs") + F.when(taken, 1).otherwise(0)).cast("long").alias("copies"))


def mix_documents(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """doc_id, source, size, key, source_size, target and copies of every document."""
    scratch = Scratch(spark, "mixing")
    _, rows = mix(spark, keyed(spark, docs.select("doc_id", "source", "text"), model, scratch), scratch)
    return rows


def mixed_corpus(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    scratch = Scratch(spark, "mixing")
    _, rows = mix(spark, keyed(spark, docs, model, scratch, whole=True), scratch)
    carried = [f"_c{i}" for i in range(len(docs.columns))]
    taken = rows.where("copies > 0").select(*carried, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select(*carried).toDF(*docs.columns)
