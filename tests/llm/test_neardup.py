import random
import re
from collections import Counter

import numpy as np
import pytest

from sheetwright.llm import neardup
from sheetwright.llm.common import Scratch, connected_components

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(texts: dict) -> tuple[dict, dict]:
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {k: top(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def check(spark, frame, texts):
    rows = neardup.near_duplicates(spark, frame).collect()
    component, sizes = groups(texts)
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {k: got[k]["component_id"] for k in texts} == component
    assert {k: got[k]["n_shingles"] for k in texts} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return rows


def test_against_all_pairs(spark, docs, texts):
    check(spark, docs, texts)


def near_copies(n, seed, words=120, edits=6):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    out = {}
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randint(0, 10**9)}"
        out[i] = " ".join(copy)
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_a_group_of_near_copies_around_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    if block == 16:
        monkeypatch.setattr(neardup, "SET_IDS", 5)
        monkeypatch.setattr(neardup, "SET_BYTES", 2000)
    texts = near_copies(150, 4) | {1000 + k: v for k, v in near_copies(40, 5, words=40, edits=3).items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check(spark, frame, texts)


def test_odd_rows(spark, odd, none):
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    rows = check(spark, odd, texts)
    assert len(rows) == odd.count()
    kept = neardup.keep_one(spark, odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    component, _ = groups(texts)
    assert ids == Counter({k: 1 for k in texts if component[k] == k} | {None: 1})
    assert neardup.near_duplicates(spark, none).count() == 0 and neardup.keep_one(spark, none).count() == 0


def test_shingles_do_not_cross_texts_and_lower_case():
    alone = [neardup.shingle_sets([t])[0].tolist() for t in (b"a b c d e f", b"", b"A b", b"g h i j k")]
    assert [s.tolist() for s in neardup.shingle_sets([b"a b c d e f", b"", b"A b", b"g h i j k"])] == alone
    assert neardup.shingle_sets([b"a B"])[0].tolist() == alone[2] and len(alone[0]) == 2 and not alone[1]


def test_keys_within_reach():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, neardup.COMPONENTS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.COMPONENTS, rng.integers(0, neardup.REACH + 1), replace=False)] += 1
    x, y = neardup.chunk_keys(a), neardup.chunk_keys(b)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))
    first = neardup.first_key(a, b)
    assert all(f in {k >> 48 for k in set(p) & set(q)} for f, p, q in zip(first.tolist(), x.tolist(), y.tolist(), strict=True))


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (9, 9)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_unlike_bins_do_not_drop_a_pair(spark):
    members = spark.createDataFrame([(5, 1, 1), (5, 2, 1), (5, 3, 1)], "key long, id long, lead long")
    components = spark.createDataFrame([], "node long, component long")
    sig = bytes(range(2 * neardup.COMPONENTS))
    bins = [bytes([b]) * neardup.BINS for b in (1, 1, 9)]
    entries = spark.createDataFrame([(i + 1, bytearray(sig), bytearray(b), 9) for i, b in enumerate(bins)], "id long, sig binary, bins binary, n long")
    listed = []
    for r in neardup._cross_pairs(members, components, entries, None).collect():
        listed += [frozenset(r["ids"][int(x)] for x in p) for p in np.frombuffer(r["pairs"], np.int32).reshape(2, -1).T]
    assert set(listed) == {frozenset(p) for p in ((1, 2), (1, 3), (2, 3))}


def test_set_groups_are_bounded_and_lose_no_pair(monkeypatch):
    monkeypatch.setattr(neardup, "SET_IDS", 7)
    monkeypatch.setattr(neardup, "SET_BYTES", 4000)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 200, 60)
    sizes[11] = 5000
    x, y = rng.integers(0, 60, (2, 400))
    found = []
    for _, rows, places in neardup.in_set_groups(x, y, sizes):
        assert len(rows) <= 14 and 8 * sizes[rows].sum() <= 2 * (4000 + 8 * 200) + (8 * 5000 if 11 in rows else 0)
        found += list(zip(rows[places[: len(places) // 2]].tolist(), rows[places[len(places) // 2 :]].tolist(), strict=True))
    assert sorted(found) == sorted(zip(x.tolist(), y.tolist(), strict=True))
    assert not list(neardup.in_set_groups(x[:0], y[:0], sizes))
