import itertools
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from sheetwright.llm import markov as M

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), ""]


def check(rows, texts):
    listed = [(k, tokens(t)) for k, t in texts]
    counts = Counter(w for k, t in listed if not M.is_held_out(k) for w in t)
    n, v = sum(counts.values()), len(counts)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for k, t in listed:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        for r in by[k]:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (M.is_held_out(k), len(t), sum(counts[w] > 0 for w in t), n)
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"])


def test_documents_and_gain_on_held_out_rows(spark, docs, texts):
    rows = M.score_documents(spark, docs, block_bytes=100_000).collect()
    check(rows, list(texts.items()))
    held = [r for r in rows if r["held_out"]]
    print(sum(r["score"] for r in held), sum(r["base_score"] for r in held))
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_blocks_do_not_matter(spark, docs):
    a, b = ({r["doc_id"]: r["score"] for r in M.score_documents(spark, docs.limit(60), block_bytes=n, rounds=2).collect()} for n in (1 << 23, 20_000))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)


def test_odd_rows(spark, odd, none):
    rows = M.score_documents(spark, odd).collect()
    assert len(rows) == odd.count()
    listed = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(rows, listed)
    assert M.score_documents(spark, none).count() == 0


def model(k, seed):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.uniform(0.2, 3, (M.CLASSES, k))
    return start, move, emit


def paths(classes, start, move, emit):
    k = len(start)
    for path in itertools.product(range(k), repeat=len(classes)):
        p = start[path[0]] * emit[classes[0], path[0]]
        for a, b, c in zip(path, path[1:], classes[1:], strict=False):
            p *= move[a, b] * emit[c, b]
        yield path, p


@pytest.fixture(params=[512, 2, 1])
def stretch(request, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", request.param)


def test_likelihood_is_the_sum_over_all_paths(stretch):
    start, move, emit = model(3, 1)
    sequences = [[5], [1, 2, 3, 1], [9, 9], [4, 1, 4, 1, 4, 2]]
    flat, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    got = M.log_ratios(flat, np.ones(len(flat), bool), sizes, start, move, emit)
    assert np.allclose(got, [math.log10(sum(p for _, p in paths(s, start, move, emit))) for s in sequences])


def test_expected_counts_are_those_over_all_paths(stretch):
    start, move, emit = model(2, 2)
    sequences = [[5, 1, 5], [1], [7, 7, 1, 5], [5, 5, 1, 7, 1]]
    flat, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    firsts, moves, emissions, log = M.expected_counts(flat, sizes, start, move, emit)
    f, m, e, total = np.zeros(2), np.zeros((2, 2)), np.zeros((M.CLASSES, 2)), 0.0
    for s in sequences:
        z = sum(p for _, p in paths(s, start, move, emit))
        total += math.log(z)
        for path, p in paths(s, start, move, emit):
            f[path[0]] += p / z
            for a, b in zip(path, path[1:], strict=False):
                m[a, b] += p / z
            for c, i in zip(s, path, strict=True):
                e[c, i] += p / z
    assert np.allclose(firsts, f) and np.allclose(moves, m) and np.allclose(emissions, e) and log == pytest.approx(total)


def plain_counts(s, start, move, emit):
    """Forward and backward over a whole sequence, one token at a time."""
    alpha, scale = [], []
    for t, c in enumerate(s):
        row = (start if not t else alpha[-1] @ move) * emit[c]
        scale.append(row.sum())
        alpha.append(row / row.sum())
    beta, moves, emissions = np.ones(len(start)), np.zeros_like(move), np.zeros_like(emit)
    for t in range(len(s) - 1, -1, -1):
        emissions[s[t]] += alpha[t] * beta
        if t:
            weighted = emit[s[t]] * beta / scale[t]
            moves += move * np.outer(alpha[t - 1], weighted)
            beta = move @ weighted
        else:
            firsts = alpha[0] * beta
    return firsts, moves, emissions, np.log(scale).sum()


def test_long_texts_are_not_cut():
    start, move, emit = model(3, 7)
    rng = np.random.default_rng(8)
    sequences = [rng.integers(0, 40, n) for n in (1, 511, 512, 513, 1024, 1025, 5000, 3, 2500, 1537)]
    flat, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    got = M.expected_counts(flat, sizes, start, move, emit)
    one_by_one = [plain_counts(s, start, move, emit) for s in sequences]
    for i in range(4):
        assert np.allclose(got[i], sum(one[i] for one in one_by_one), rtol=1e-9)
    assert np.allclose(M.log_ratios(flat, np.ones(len(flat), bool), sizes, start, move, emit), [one[3] / math.log(10) for one in one_by_one])
    assert np.isclose(got[0].sum(), len(sequences)) and np.isclose(got[1].sum(), sizes.sum() - len(sequences))


def fitted(docs, rounds):
    blocks = M.encode(docs).cache()
    total = blocks.agg({"tokens": "sum"}).first()[0]
    known = M.corpus_counts(blocks, 6, 5).where("kind = 1").collect()
    head = np.sort(np.frombuffer(b"".join(r["known"] for r in known), np.uint64))
    counts = M.symbol_counts(blocks, head)
    assert counts.sum() == total
    out = M.train(blocks, head, counts, 1 / (total + sum(r["distinct"] for r in known) + 1), rounds=rounds)
    blocks.unpersist()
    return head, counts, out


def test_training_raises_the_likelihood(spark, docs):
    *_, (_, _, _, logs) = fitted(docs.limit(80), 4)
    assert len(logs) > 1 and all(b > a - 1e-6 * abs(a) for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0]


def test_the_model_sums_to_one(docs, texts):
    few = docs.limit(80)
    head, counts, (start, move, ratio, _) = fitted(few, 2)
    kept = Counter(w for r in few.collect() if not M.is_held_out(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(kept.values()), len(kept)
    words = [w.encode() for w in kept]
    symbols = M.symbols_of(np.array([M.xxhash.xxh3_64_intdigest(w) for w in words], np.uint64), np.array([M.word_class(w) for w in words], np.uint16), head)
    own = {kept[w.decode()] for w, s in zip(words, symbols, strict=True) if s >= M.CLASSES}
    assert own and min(own) >= 5 and len(head) == sum(c >= 5 for c in kept.values())
    total = sum(ratio[s] * kept[w.decode()] / n for w, s in zip(words, symbols, strict=True)) + 1 / (n + v + 1)
    assert np.allclose(total, 1) and np.isclose(start.sum(), 1) and np.allclose(move.sum(1), 1)


def test_states_tell_words_of_one_ending_apart(spark):
    rows = [(i, " ".join(["nation law state"] * 40 if i % 2 else ["station rail train"] * 40)) for i in range(60)]
    head, _, (_, _, ratio, _) = fitted(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    at = [M.CLASSES + int(np.searchsorted(head, M.xxhash.xxh3_64_intdigest(w))) for w in (b"nation", b"station")]
    assert M.word_class(b"nation") == M.word_class(b"station") and np.abs(np.log(ratio[at[0]] / ratio[at[1]])).max() > 1


def test_one_very_long_text(spark):
    text = "some words of a very long text " * 60_000
    rows = M.score_documents(spark, spark.createDataFrame([(1, text), (2, "some words"), (None, None)], "doc_id long, text string"), rounds=1).collect()
    check(rows, [(1, text), (2, "some words"), (None, None)])


def test_long_rows_are_read_few_at_once(spark, docs, monkeypatch):
    """A task reads many rows of a row group at once, so groups of megabyte rows are short however much one task wrote."""
    made, scratch = [], M.Scratch
    monkeypatch.setattr(M, "Scratch", lambda *a: made.append(scratch(*a)) or made[-1])
    empty = spark.range(3000).selectExpr("-1 - id as doc_id", "'' as text")
    rows = M.score_documents(spark, docs.select("doc_id", "text").unionByName(empty).coalesce(1), rounds=1, block_bytes=20_000).count()
    assert rows == docs.count() + 3000
    groups = {}
    for name in ("blocks", "known"):
        files = Path(made[0].path.removeprefix("file://")).glob(f"*-{name}/*.parquet")
        meta = [pq.ParquetFile(f).metadata for f in files]
        groups[name] = [m.row_group(i).num_rows for m in meta for i in range(m.num_row_groups)]
    assert len(groups["blocks"]) > 20 and max(groups["blocks"]) == M.BLOCKS_AT_ONCE
    assert max(groups["known"]) <= M.COUNTS_AT_ONCE < sum(groups["known"])
    widest = spark.read.parquet(f"{made[0].path}/*-blocks").selectExpr("max(size(doc_ids)) as n").first()["n"]
    assert widest <= 20_000 // M.ROW_BYTES
