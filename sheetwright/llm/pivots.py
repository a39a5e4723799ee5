"""Embedding near-duplicates by a pivot-permutation index.

Reference vectors are a bounded sample, ordered so that near ones are
neighbours and cut into bins.  A vector is a member of the bin of its nearest
reference, and visits each later bin with a reference that can be the nearest
one of a vector within the threshold's angle: a vector nearest to p lies on
p's side of the plane between p and any other reference q, so one nearest to q
whose distance from that plane is greater has no partner there.  That bound
holds whatever the density of references, so every pair at the threshold meets
in one bin, once, and is compared by cosine in double precision.  Bins longer
than BLOCK are dealt in pairs of blocks, so no bin meets in one task, and a
block pair emits a link count per vector and one edge per vector to the least
member of its local component, never its pairs.

Where the bound rules nothing out (vectors without clusters, in many
dimensions), the comparisons grow with the square of a label's size.

Equal vectors of a label are one entry with a multiplicity.  Vectors that are
null, zero or hold null or non-finite components, and rows without a label,
link with nothing; vectors of different lengths are never compared.  Lengths
without a reference share one bin.  Rows with equal ids are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm.common import BATCH_ROWS, Scratch, connected_components, group_bounds, whole_groups

THRESHOLD = 0.93
#: References: one for PER_PIVOT entries, within these bounds (4096 vectors at most reach the driver).
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 200, 64, 4096
BLOCK = 1024
#: Room for rounding in the bound.
SLACK = 1e-9


def usable(embedding):
    """Whether a vector can be compared."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Double precision rows of length one; scaled first, so that no square overflows."""
    rows = vectors.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def near_order(rows: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): ``rows`` halved along their longest axis again and again, into ``parts`` of about equal size."""
    order, starts = np.arange(len(rows)), []

    def cut(a: int, b: int, n: int) -> None:
        if n == 1:
            starts.append(a)
            return
        part = rows[order[a:b]]
        axis = np.linalg.eigh(np.cov(part, rowvar=False).reshape(part.shape[1], -1))[1][:, -1]
        order[a:b] = order[a:b][np.argsort(part @ axis, kind="stable")]
        middle = a + (b - a) * (n // 2) // n
        cut(a, middle, n // 2)
        cut(middle, b, n - n // 2)

    cut(0, len(rows), min(parts, len(rows)))
    return order, np.array(starts)


def bins_of(rows: np.ndarray, pivots: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(own, visits): the bin of each row's nearest reference, and which later bins can hold a partner."""
    cosine = rows @ pivots.T
    nearest = cosine.argmax(1)
    own = np.searchsorted(starts, nearest, "right") - 1
    if threshold > 0:
        apart = np.sqrt(np.maximum(2 - 2 * (pivots[nearest] @ pivots.T), 0))
        reach = cosine[np.arange(len(rows)), nearest, None] - cosine <= np.sqrt(max(1 - threshold * threshold, 0)) * apart + SLACK
    else:
        reach = np.ones(cosine.shape, bool)
    visits = np.logical_or.reduceat(reach, starts, axis=1)
    return own, visits & (np.arange(len(starts)) > own[:, None])


def local_components(linked: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id reachable from each row, where ``linked`` joins the rows ``left`` with the rows ``right``."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    label = np.empty(n, np.int32)
    label[order] = np.arange(n, dtype=np.int32)
    while True:
        least = label.copy()
        least[left] = np.minimum(least[left], np.where(linked, label[right][None, :], n).min(1, initial=n))
        least[right] = np.minimum(least[right], np.where(linked, least[left][:, None], n).min(0, initial=n))
        least = least[order[least]]
        if (least == label).all():
            return ids[order[label]]
        label = least


def _postings(entries: DataFrame, references: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float) -> DataFrame:
    names = ["label", "dim", "bin", "own", "id", "copies", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, ids, copies, vectors = (batch.column(i) for i in range(4))
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                rows = np.array([vectors[int(i)].as_py() for i in at], np.float64)
                own, visits = bins_of(unit_rows(rows), *references[int(dim)], threshold) if int(dim) in references else (np.zeros(len(at), np.int64), np.zeros((len(at), 1), bool))
                who, where = np.nonzero(visits)
                who, bins, mine = np.append(np.arange(len(at)), who), np.append(own, where), np.arange(len(at) + len(who)) < len(at)
                vector = pa.array([r.tobytes() for r in rows], pa.binary())
                for a in range(0, len(who), BATCH_ROWS):
                    some = slice(a, a + BATCH_ROWS)
                    take = pa.array(at[who[some]])
                    yield pa.RecordBatch.from_arrays([label.take(take), pa.array(np.full(len(take), dim, np.int32)), pa.array(bins[some].astype(np.int32)), pa.array(mine[some]), ids.take(take), copies.take(take), vector.take(pa.array(who[some]))], names)

    return entries.select(F.col("label").cast("long"), "id", "copies", "embedding").mapInArrow(run, "label long, dim int, bin int, own boolean, id long, copies long, vector binary")


def _links(postings: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, n, b: for each entry of a block pair its links counted there, and the least entry it is joined to."""
    names = ["a", "n", "b"]
    bins = ["label", "dim", "bin"]
    sizes = postings.groupBy(*bins).agg(F.count_if("own").alias("_own"), F.count_if(~F.col("own")).alias("_visits")).where("_own > 0 and _own + _visits > 1")
    blocks = [F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("_own", "_visits")]
    me = F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("_own")).otherwise(F.col("_visits"))).cast("int")
    listed = postings.join(sizes.select(*bins, *blocks), bins).withColumn("me", me)

    def pairs(number: str, visited: bool, i, j, right):
        """The block pairs (i, j) of a row with the blocks o of a number, and whether it is on the right."""
        each = F.transform(F.sequence(F.lit(0), F.col(number) - 1), lambda o: F.struct(F.lit(visited).alias("visited"), i(o).alias("i"), j(o).alias("j"), right(o).alias("right")))
        return F.when(F.col(number) > 0, each).otherwise(F.slice(each, 1, 0))

    mine = F.col("me")
    inside = pairs("_own", False, lambda o: F.least(mine, o), lambda o: F.greatest(mine, o), lambda o: mine > o)
    visited = pairs("_visits", True, lambda o: mine, lambda o: o, lambda o: F.lit(False))
    visiting = pairs("_own", True, lambda o: o, lambda o: mine, lambda o: F.lit(True))
    dealt = listed.select(*bins, "id", "copies", "vector", F.explode(F.when(F.col("own"), F.concat(inside, visited)).otherwise(visiting)).alias("_pair")).select(*bins, "id", "copies", "vector", "_pair.*")
    group = [*bins, "visited", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            ids, copies, right, visited, i, j = (table.column(c).to_numpy() for c in ("id", "copies", "right", "visited", "i", "j"))
            vector = table.column("vector").to_pylist()
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in group_bounds(table, group):
                if b - a < 2:
                    continue
                rows = unit_rows(np.frombuffer(b"".join(vector[a:b]), np.float64).reshape(b - a, -1))
                one_block = not visited[a] and i[a] == j[a]
                x, y = (np.arange(b - a),) * 2 if one_block else (np.flatnonzero(~right[a:b]), np.flatnonzero(right[a:b]))
                linked = rows[x] @ rows[y].T >= threshold
                if one_block:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                n, times = np.zeros(b - a, np.int64), copies[a:b].astype(np.float32 if copies[a:b].sum() < 1 << 24 else np.float64)
                n[x] += (linked @ times[y]).astype(np.int64)
                if not one_block:
                    n[y] += (times[x] @ linked).astype(np.int64)
                some = np.flatnonzero(n)
                for column, values in zip(out, (ids[a:b][some], n[some], local_components(linked, x, y, ids[a:b])[some]), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, n long, b long")


def references_of(entries: DataFrame, number: int, block: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: unit references, the entries with the least hashes of their ids, by bin, and where each bin starts.

    There are as many bins as the largest label has blocks.
    """
    rows = entries.select("id", "embedding").orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(number).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["embedding"]), []).append(r["embedding"])
    labels = entries.groupBy("label", F.size("embedding").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n"))
    largest = {r["dim"]: r["n"] for r in labels.where(F.col("dim").isin(list(by))).collect()}
    out = {}
    for dim, vectors in by.items():
        pivots = unit_rows(np.array(vectors, np.float64))
        order, starts = near_order(pivots, -(-largest[dim] // block))
        out[dim] = pivots[order], starts
    return out


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""
    scratch = Scratch(spark, "pivots")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # Zeros of either sign are one value to the grouping, as they are to the cosine.
    entries = scratch.save(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "entries")
    number = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, entries.count() // PER_PIVOT))
    posted = scratch.save(_postings(entries, references_of(entries, number, block), threshold), "postings")
    links = scratch.save(_links(posted, threshold, block), "links")
    scratch.drop(posted)
    components = scratch.save(connected_components(spark, links.select("a", "b"), scratch), "components")
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    found = entries.join(counts, F.col("id") == F.col("a"), "left").join(components, F.col("id") == F.col("node"), "left")
    found = found.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    joined = good.join(found, ["label", "embedding"]).select("vec_id", "n_links", "component")
    rest = rows.where(~F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")), F.lit(False)))
    out = joined.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component")))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
