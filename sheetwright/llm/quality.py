"""Quality classifier: supervised subword embeddings trained by numpy stochastic gradient descent.

A document is the average of the learned vectors of its hashed words and of the
character n-grams (3 and 4) inside them, and a softmax layer reads that average.
At scoring time the layer is folded into the table, so a feature is one number
and a whole text is a few passes over its characters.

Training takes a bounded sample of labelled rows: ``per_class`` of each label in
the order of a hash of the id, of these as many as hold MOST_FEATURES distinct
features together.  Features are counted where the texts are, so only counts
reach the task that trains.  The class priors come from all labelled rows; an
id with both labels counts as 1.

Null and empty texts have no feature and get the prior.  With labels of one
kind only, or none, every score is that of the prior.  Repeated rows are scored
each for itself; null labels and ids teach nothing; equal hashes of ids are
taken in order of the id.  Very long texts are read whole, a piece of their own.
Only the id and the text are read, so other columns can't clash.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwright.llm.common import Scratch, crc_bucket, release_memory, short_batches

BUCKETS = 1 << 17
DIM = 16
PER_CLASS = 3000
#: Distinct features of the sampled rows at most, eight bytes each.
MOST_FEATURES = 48_000_000
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.7
#: Texts are read in pieces of about so many characters; each piece holds whole texts.
CHUNK_CHARS = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(64 - 17)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature, and the text it belongs to."""
    data = np.frombuffer((" " + " ".join(texts) + " \0\0").encode("utf-32-le"), np.uint32)
    n = len(data) - 2
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    b = np.where(space, np.uint32(0x20), data).astype(np.uint64)
    inner = ~space
    owner_ends = np.cumsum(lengths)
    found, places = [], []
    # A code point has 21 bits, so three of them are a number below 2**63.
    two = b[:-1] << np.uint64(21) | b[1:]
    # 3-grams around an inner character, 4-grams around two; their ends may be the space beside a word.
    at = np.flatnonzero(inner[1 : n - 1])
    three = (two[at] << np.uint64(21) | b[at + 2]) * _MIX
    found.append((three ^ (three >> np.uint64(32))) * _ODD >> _SHIFT)
    places.append(at)
    at = np.flatnonzero(inner[1 : n - 2] & inner[2 : n - 1])
    four = (two[at] * _ODD ^ (two[at + 2] + np.uint64(1 << 50))) * _MIX
    found.append((four ^ (four >> np.uint64(32))) * _ODD >> _SHIFT)
    places.append(at)
    starts = np.flatnonzero(inner[1:n] & space[: n - 1]) + 1
    ends = np.flatnonzero(space[1:n] & inner[: n - 1]) + 1
    if len(starts):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b[:n] * _powers(n, _ODD), dtype=np.uint64)])
        words = (sums[ends] - sums[starts]) * _powers(n, _INVERSE)[starts]
        found.append(((words ^ (words >> np.uint64(29))) * _MIX) >> _SHIFT)
        places.append(starts)
    return np.concatenate(found).astype(np.int64), np.searchsorted(owner_ends, np.concatenate(places), "right")


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and the share of each."""
    unique, counts = np.unique(features([text])[0], return_counts=True)
    return unique.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """The folded table (a number for each bucket) and the bias of the logit of label 1, from the ``shares`` of texts."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    layer, bias = np.zeros((2, dim)), np.zeros(2)
    steps, done = epochs * max(1, len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            unique, share = docs[i][0], docs[i][1][:, None]
            step = rate * (1 - done / steps)
            done += 1
            if not len(unique):
                continue
            hidden = (vectors[unique] * share).sum(0)
            scores = layer @ hidden + bias
            p = np.exp(scores - scores.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = layer.T @ error
            layer -= step * np.outer(error, hidden)
            bias -= step * error
            vectors[unique] -= step * len(unique) ** 0.5 * share * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on at most ``per_class`` rows of each label (a documented bound); the table is 512 KB whatever the corpus."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(BUCKETS, np.float32)
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    if len(counts) < 2:
        return none, prior
    order = F.xxhash64(F.lit(3), "doc_id")
    parts = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    scratch = Scratch(spark, "labels")
    chosen = scratch.save(parts[0].unionByName(parts[1]), "chosen")  # 2 * per_class ids: small enough to send to all
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "quality", "n", "buckets", "share"]
        for batch in batches:
            for i in range(batch.num_rows):
                buckets, share = shares(batch.column(2)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in (0, 1)), pa.array([len(buckets)], pa.int64()), pa.array([buckets.tobytes()]), pa.array([share.tobytes()])], names)
        release_memory()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((k, b, s, q) for batch in batches for k, q, b, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[:3])
        if not rows:
            return
        truth = np.array([r[3] for r in rows])
        table, bias = train([(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in rows], truth)
        del rows
        release_memory()
        shift = np.log((truth.sum() + 0.5) / (len(truth) - truth.sum() + 0.5))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()]), pa.array([bias - float(shift)])], ["model", "bias"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = scratch.save(sample.mapInArrow(count, f"doc_id {kind}, quality int, n long, buckets binary, share binary"), "features")
    within = F.sum("n").over(Window.orderBy(order, "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0))  # the sample's rows
    upto = counted.select("doc_id", "n", within.alias("_upto")).where(F.col("_upto") > MOST_FEATURES).select("doc_id").distinct()
    fits = counted.join(F.broadcast(upto), "doc_id", "left_anti").select("doc_id", "quality", "buckets", "share")
    got = fits.repartition(1).mapInArrow(learn, "model binary, bias double").collect()
    if not got:
        return none, prior
    return np.frombuffer(got[0]["model"], np.float32), got[0]["bias"] + prior


def score_texts(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 for each whole text."""
    out, at = np.full(len(texts), float(bias)), 0
    while at < len(texts):
        part, held = [], 0
        while at + len(part) < len(texts) and (not part or held < CHUNK_CHARS):
            part.append(texts[at + len(part)] or "")
            held += len(part[-1])
        buckets, owner = features(part)
        count = np.bincount(owner, minlength=len(part))
        total = np.bincount(owner, weights=table[buckets], minlength=len(part))
        out[at : at + len(part)] += total / np.maximum(count, 1)
        at += len(part)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, table: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1).to_pylist(), table, bias))], [id_col, "score"])
        release_memory()

    return short_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_quality(docs: DataFrame, table: np.ndarray, bias: float, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text scores ``threshold`` at least."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(at).to_pylist(), table, bias) >= threshold))
        release_memory()

    return short_batches(docs).mapInArrow(run, docs.schema)


def fit_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    """The production model: labels of rows whose crc32 of the id modulo 4 is not 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_bucket(F.col("doc_id"), 4) != 2)
    return fit(spark, docs, labels)


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score(docs, *fit_quality(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
