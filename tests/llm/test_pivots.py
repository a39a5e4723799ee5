import numpy as np
import pytest

from sheetwright.llm import pivots as P

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows):
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: 0 for r in rows}
    root = {r[0]: r[0] for r in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= P.THRESHOLD:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = top(a[0]), top(b[0])
                    root[max(p, q)] = min(p, q)
    return {k: (links[k], top(k)) for k in root if k is not None}


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return P.near_vectors(spark, frame, **kw).collect()


def test_given_vectors(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in P.near_vectors(spark, frame).collect()}
    want = brute(rows)
    found, all_links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.9 * all_links


@pytest.mark.parametrize("block", [1024, 8])
def test_clusters_and_copies(spark, block):
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 7)):
                rows.append((n, (centre + rng.normal(size=16) * 0.05).tolist(), label))
                n += 1
    rows += [(n + i, rows[0][1], 1) for i in range(9)] + [(n + 20 + i, [2 * x for x in rows[0][1]], 1) for i in range(2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, rows, block=block)}
    want = brute(rows)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())
    assert sum(got[k] == want[k] for k in want) >= 0.9 * len(want) and all(got[k][0] <= want[k][0] for k in want)


def test_odd_rows(spark):
    a = [1.0, 0.0, 0.0]
    rows = [(1, a, 1), (2, a, 1), (3, a, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [float("inf"), 1.0, 0.0], 1), (9, [], 1), (10, [1.0, 0.0], 1), (11, [2.0, 0.0], 1), (12, [1.0, -0.0, 0.0], 1), (13, [3e38, 3e38, 0.0], 2), (14, [1.0, 1.0, 0.0], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, rows)}
    assert got == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in run(spark, rows))
    assert run(spark, [(None, a, 1), (1, a, 1)])  # a row without an id links with nothing
    assert P.near_vectors(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_lengths_without_references_share_a_list(spark):
    rows = [(i, [float(i % 3), 1.0, 2.0], 1) for i in range(30)] + [(100, [1.0, 2.0], 1), (101, [1.0, 2.001], 1)]
    got = {r["vec_id"]: r["n_links"] for r in run(spark, rows, pivots=3)}
    assert got[100] == got[101] == 1


def test_a_dense_group_is_found_whole(spark):
    rng = np.random.default_rng(7)
    near = rng.normal(size=64) + rng.normal(size=(1000, 64)) * 0.22  # cosines from 0.9 to 0.98
    vectors = np.concatenate([near, rng.normal(size=(2000, 64))]).astype(np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= P.THRESHOLD
    np.fill_diagonal(linked, False)
    for block in (1024, 100):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, [(i, v, 1) for i, v in enumerate(vectors.tolist())], pivots=600, block=block)}
        assert [got[i][0] for i in range(3000)] == linked.sum(1).tolist()
        assert len({got[i][1] for i in np.flatnonzero(linked[0])}) == 1
