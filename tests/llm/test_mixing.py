import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwright.llm import mixing, quality


def targets(sizes: dict) -> dict:
    """Shares by weight, raised until none is above twice its source."""
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(order)}
    left, budget, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        level = (budget - sum(out.values())) / sum(weight[k] for k in left)
        over = {k for k in left if 2 * sizes[k] <= level * weight[k]}
        if not over:
            return out | {k: level * weight[k] for k in left}
        out |= {k: 2.0 * sizes[k] for k in over}
        left -= over
    return out


def check(rows, texts, sources):
    size = {k: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for k, t in texts.items()}
    total, taken, most, listed = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for r in rows:
        assert r["size"] == size[r["doc_id"]]
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        listed[r["source"]].append(r)
        assert 0 <= r["copies"] <= 2
    want = targets(dict(total))
    for source, mine in listed.items():
        assert all(r["source_size"] == total[source] and r["target"] == pytest.approx(want[source]) for r in mine)
        assert abs(taken[source] - want[source]) <= most[source]
        copies = {r["copies"] for r in mine if r["size"]}
        assert len(copies) <= 2  # whole epochs first


def test_against_brute_force(spark, docs, texts):
    rows = mixing.mix_documents(spark, docs).collect()
    check(rows, texts, None)
    again = mixing.mix_documents(spark, docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)


def ordered(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["key"], r["tie"], r["copies"]))
    for rows in by.values():  # no later key is taken more often than an earlier one
        copies = [c for *_, c in sorted(rows)]
        assert copies == sorted(copies, reverse=True)


@pytest.mark.parametrize("sorted_rows", [1, 10, 100_000])
def test_hot_source_and_order_of_keys(spark, sorted_rows):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    scratch = mixing.Scratch(spark, "t")
    _, rows = mixing.mix(spark, mixing.keyed(spark, docs, None, scratch), scratch, sorted_rows=sorted_rows)
    rows = rows.collect()
    ordered(rows)
    check(rows, {r["doc_id"]: "w " * (r["doc_id"] % 50) for r in rows}, None)


def test_uneven_keys_leave_few_rows_to_sort(spark, monkeypatch):
    """Weights over many magnitudes: the slice that is sorted stays small."""
    slices = []
    narrowed = mixing._narrowed

    def watch(rows, ends, even):
        out = narrowed(rows, ends, even)
        slices.append(max([r["_n"] for r in out.collect()]))
        return out

    monkeypatch.setattr(mixing, "_narrowed", watch)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("中文").alias("source"), F.lit(3).cast("long").alias("size"), mixing.sampling_key(F.col("id"), F.pow(F.lit(10.0), -(F.col("id") % 9))).alias("key"), F.xxhash64("id").alias("tie"))
    rows = rows.unionByName(rows.limit(5).withColumn("source", F.lit("b")))
    out = mixing.mix(spark, rows, mixing.Scratch(spark, "t"), sorted_rows=200)[1].collect()
    ordered(out)
    assert slices[-1] <= 200
    taken = sum(r["size"] * r["copies"] for r in out if r["source"] == "中文")
    assert abs(taken - out[0]["target"]) <= 3 or abs(taken - out[-1]["target"]) <= 3


def test_rows_of_one_id_and_text_have_their_own_fates(spark):
    hot = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("w w w").alias("text"))
    rest = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("w w").alias("text"))
    rows = mixing.mix_documents(spark, hot.unionByName(rest)).collect()
    for source in "ab":
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 3
    assert len(rows) == 9000 and len({r["copies"] for r in rows if r["doc_id"] is None}) == 2
    corpus = mixing.mixed_corpus(spark, hot.unionByName(rest)).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in corpus} == {s: sum(r["copies"] for r in rows if r["source"] == s) for s in "ab"}


def test_odd_rows(spark, odd, none):
    rows = mixing.mix_documents(spark, odd).collect()
    check(rows, {r["doc_id"]: r["text"] for r in odd.collect()}, None)
    mixed = mixing.mixed_corpus(spark, odd)
    assert mixed.columns == odd.columns
    want = sum(r["copies"] for r in rows)
    assert mixed.count() == want
    assert mixing.mix_documents(spark, none).count() == 0 and mixing.mixed_corpus(spark, none).count() == 0


def test_weights_are_the_scores_in_any_script(spark):
    table = np.zeros(quality.BUCKETS, np.float32)
    for text, value in (("好 的 文 字", 9.0), ("plain words", 9.0), ("bad bad", -9.0)):
        table[np.unique(quality.features([text])[0])] = value
    docs = spark.createDataFrame([(i, t, "s") for i in range(900) for t in ("好 的 文 字", "plain words", "bad bad")], "doc_id long, text string, source string")
    rows = mixing.keyed(spark, docs, (table, 0.0), mixing.Scratch(spark, "t")).collect()
    mean = {n: np.mean([r["key"] for r in rows if r["size"] == n]) for n in (4, 2)}
    assert mean[4] == pytest.approx(1, rel=0.1) and mean[2] > 5
