"""Each stage on what its predecessor kept, written and read again, against a plain version."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_neardup import groups

from sheetwright.llm import quality, secrets


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "best_fit_packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        kept.append((docs, out := spark.read.parquet(str(tmp_path / name))))
        docs = out
    (first, good), (_, unique), (_, clean), (_, mixed), (_, packed) = kept
    table, bias = quality.fit_quality(spark, first, small)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.score(first, table, bias).where("score >= 0.7").collect()}
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    component, _ = groups(texts)
    assert {r["doc_id"] for r in unique.collect()} == {k for k in texts if component[k] == k}
    for r in clean.collect():
        assert r["text"] == secrets.redact(texts[r["doc_id"]], secrets.find_spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= {r["doc_id"] for r in clean.collect()} and max(copies.values()) <= 2
    rows = packed.collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == copies
    ends = Counter()
    for r in rows:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096


def test_run_and_names(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    assert corpus_pipeline.run(spark, small).count() > 0


def test_odd_documents(spark, odd, small):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small)
    assert docs.count() >= 0 and "sequence_id" in docs.columns
    assert before.columns == odd.columns


def test_columns_of_any_name(spark, docs, small):
    """Equal rows are numbered and copied with their columns, whatever these are called and hold."""
    inner = F.struct(F.lit(1).alias("my part"), F.lit("p").alias("a.b:c"))
    rows = docs.select("*", F.col("doc_id").alias("x`y"), F.lit("z").alias("my col"), inner.alias("a.b"), F.lit(2).alias("_row"), F.lit(3).alias("copies"))
    twice = rows.union(rows)
    out = corpus_pipeline.mixing_stage(spark, twice, small)
    assert out.dtypes == twice.dtypes
    own = {r["doc_id"]: r for r in rows.collect()}
    mixed = out.collect()
    taken = Counter(r["doc_id"] for r in mixed)
    assert mixed and all(r == own[r["doc_id"]] for r in mixed) and max(taken.values()) <= 4


def test_one_model(spark, small, tmp_path, monkeypatch):
    """The mixture takes the first stage's model, once, and only while the tables are the same."""
    fits = []
    fit = quality.fit_quality
    monkeypatch.setattr(quality, "fit_quality", lambda *a: fits.append(1) or fit(*a))
    folder = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def mixed(first) -> Counter:
        kept = corpus_pipeline.quality_stage(spark, first, folder)
        return Counter(r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, kept, folder).collect())

    taken = mixed(docs)
    assert len(fits) == 1
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    corpus_pipeline._MODEL.clear()
    assert Counter(r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, kept, folder).collect()) == taken and len(fits) == 3
    mixed(docs.where("doc_id % 2 = 0"))  # not the whole table: its model is not the mixture's
    assert len(fits) == 5
    corpus_pipeline.quality_stage(spark, docs, folder)
    spark.read.parquet(f"{small}/labels.parquet").limit(50).write.mode("append").parquet(f"{folder}/labels.parquet")
    corpus_pipeline.mixing_stage(spark, kept, folder)
    assert len(fits) == 7 and not corpus_pipeline.mixing_stage(spark, kept, folder).isEmpty()
