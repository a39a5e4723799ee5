import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from sheetwright.llm import packing


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(packing.default_tokenizer_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def check(rows, texts, plain, capacity):
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, text in texts.items():
        ids = plain(text)
        pieces = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[key]})
        assert [p[1:] for p in pieces] == [(s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for s in range(0, len(ids), capacity)]
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_against_the_tokenizer(spark, docs, texts, plain):
    rows = packing.pack_documents(spark, docs).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    n = check(rows, texts, plain, packing.CAPACITY)
    assert n == -(-sum(r["length"] for r in rows) // packing.CAPACITY)


def test_odd_rows(spark, odd, none, plain):
    rows = packing.pack_documents(spark, odd, capacity=64).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    check(rows, texts, plain, 64)
    assert sum(r["doc_id"] == 2 for r in rows) == 2 * sum(r["doc_id"] == 1 for r in rows)
    assert [r["length"] for r in rows if r["doc_id"] == 4] == [1]
    assert packing.pack_documents(spark, none).count() == 0


def test_cache_that_overflows(plain, monkeypatch):
    monkeypatch.setattr(packing.ChunkTokenizer, "MAX_CHUNKS", 50)
    t = packing.ChunkTokenizer(packing.default_tokenizer_path())
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdé!.,1 😂'", k=rng.randint(1, 9))) for _ in range(400)] + ["<|endoftext|>", "it's", " 　"]
    for _ in range(6):
        texts = [" ".join(rng.choices(words, k=30)) for _ in range(40)]
        for text, ids in zip(texts, t.encode(texts), strict=True):
            assert ids.tolist() == plain(text).tolist()[:-1]


def test_special_strings_give_special_ids(plain):
    texts = ["a<|endoftext|>b", "<|startoftext|> the end <|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "<|startoftext|>" * 3, "x " * 40_000 + "<|endoftext|>"]
    found = list(packing.ChunkTokenizer(packing.default_tokenizer_path()).encode(texts))
    assert [x.tolist() for x in found] == [plain(t).tolist()[:-1] for t in texts]
    assert {49406, 49407} <= set(np.concatenate(found).tolist())


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_best_subset(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 30) for _ in range(9)]
    space = rng.randint(5, 90)
    counts = {x: items.count(x) for x in items}
    best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= space)
    used = packing.fullest(counts, space)
    assert sum(k * v for k, v in used.items()) == best and all(counts[k] >= v for k, v in used.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    histogram = {x: rng.randint(1, 10**7) for x in rng.sample(range(1, 4097), 600)} | {4096: 10**9}
    plans = packing.plan_bins(histogram)
    used: dict[int, int] = {}
    for times, uses in plans:
        assert sum(k * v for k, v in uses.items()) <= 4096
        for k, v in uses.items():
            used[k] = used.get(k, 0) + times * v
    assert used == histogram
    assert len(plans) < 13 * 4096


@pytest.mark.parametrize("seed", range(5))
def test_no_more_sequences_than_first_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = sorted((min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(800)), reverse=True)
    bins: list[int] = []
    for n in lengths:
        at = next((i for i, used in enumerate(bins) if used + n <= 4096), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    histogram = {x: lengths.count(x) for x in lengths}
    assert sum(t for t, _ in packing.plan_bins(histogram)) <= len(bins)


def test_spellings_of_a_word_are_learned_once(plain, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéßñøth", k=rng.randint(2, 12))) for _ in range(300)]
    texts = [" ".join(w + tail for w in words) for tail in ("", ",", ".", '!!")', "<|")] + [" ".join(f(w) + ";" for w in words) for f in (str.title, str.upper)]
    t = packing.ChunkTokenizer(packing.default_tokenizer_path())
    sent, ids = [], t._ids
    monkeypatch.setattr(t, "_ids", lambda text: sent.append(text) or ids(text))
    for text, found in zip(texts, t.encode(texts), strict=True):
        assert found.tolist() == plain(text).tolist()[:-1]
    assert sum(map(len, sent)) < 2 * len(texts[0])


@pytest.mark.parametrize("seed", range(5))
def test_chunks_of_any_make(plain, seed, monkeypatch):
    monkeypatch.setattr(packing.ChunkTokenizer, "MAX_CHUNKS", 200)
    rng = random.Random(seed)
    letters = "aAbStTéÉßẞİıǅªºµÿŸ×÷ſKÅéक़ﬁ中0²'’_-.,;:!?\"()[]{}|<>@#`~^  \x1c\x85😂"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(500)] + ["It's", "IT'S,", "we'Ve", "don't.", "a<|endoftext|>b", "É.", "éß,"]
    t = packing.ChunkTokenizer(packing.default_tokenizer_path())
    assert t.ends is not None
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    for at in range(0, 60, 20):
        for text, found in zip(texts[at : at + 20], t.encode(texts[at : at + 20]), strict=True):
            assert found.tolist() == plain(text).tolist()[:-1]


def test_a_tokenizer_by_other_rules(tmp_path):
    text = open(packing.default_tokenizer_path(), encoding="utf-8").read()
    assert '"Lowercase"' in text
    other = tmp_path / "cased.json"
    other.write_text(text.replace('"Lowercase"', '"NFD"'), encoding="utf-8")
    t, want = packing.ChunkTokenizer(str(other)), Tokenizer.from_file(str(other))
    texts = ["The the THE, the. Été été", "A cat, a CAT"]
    assert t.ends is None
    assert [x.tolist() for x in t.encode(texts)] == [want.encode(x, add_special_tokens=False).ids for x in texts]
