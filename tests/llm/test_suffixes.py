import hashlib
import os
import random

import numpy as np
import pytest

from sheetwright.llm import suffixes as S


def brute(texts: dict) -> dict:
    first: dict[bytes, int] = {}
    for key in sorted(texts):
        data = texts[key]
        for i in range(len(data) - S.LENGTH + 1):
            first.setdefault(data[i : i + S.LENGTH], key)
    out = {}
    for key, data in texts.items():
        gone = [False] * len(data)
        for i in range(len(data) - S.LENGTH + 1):
            if first[data[i : i + S.LENGTH]] < key:
                gone[i : i + S.LENGTH] = [True] * S.LENGTH
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows(spark, frame, **kw):
    return S.repeat_digest(S.remove_repeats(spark, frame, **kw)).collect()


def check(spark, texts, **kw):
    frame = spark.createDataFrame([(k, v.decode()) for k, v in texts.items()], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, frame, **kw)}
    assert got == brute(texts)


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 3000, "hot_blocks": 1}, {"block_bytes": 2000}, {"block_bytes": 400, "hot_blocks": 2}])
def test_passages_copies_and_periods(spark, kw):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, edge = prose(30), prose(12)[:50].ljust(50, "z")
    texts = {}
    for k in rng.sample(range(1000), 60):
        kind = rng.randrange(6)
        texts[k] = {0: lambda: prose(40), 1: lambda: prose(5) + passage + prose(5), 2: lambda: passage[rng.randint(0, 60) :] + prose(3), 3: lambda: edge + prose(2) if rng.random() < 0.5 else prose(4) + edge, 4: lambda: "ab" * rng.randint(20, 60) + "c" * rng.randint(0, 70), 5: lambda: passage}[kind]().encode()
    check(spark, texts, **kw)


def test_documents(spark, docs, texts):
    some = {k: t.encode() for k, t in texts.items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, docs)}
    assert got == brute(some)


def test_odd_rows(spark, odd, none):
    got = rows(spark, odd)
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    known = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    want = brute({k: v for k, v in known.items() if k is not None and len(v) < 20_000})
    for k in (1, 2, 3, 4, 5, 6, 12, 13, 14):
        assert (by[k]["n_bytes"], by[k]["n_removed"], by[k]["n_spans"], by[k]["kept_sha256"]) == want[k]
    assert by[10]["n_removed"] == by[11]["n_removed"] == by[None]["n_removed"] == 0
    assert rows(spark, none) == []


def test_known_prefixes_are_not_read_again():
    class Watched(bytes):
        def __getitem__(self, at):
            assert (at.start if isinstance(at, slice) else at) >= 5
            return bytes.__getitem__(self, at)

    for a, b in ((b"12345678", b"12345678"), (b"123456789012345x", b"123456789012345y"), (b"12345", b"123456"), (b"12345a", b"12345b")):
        assert S.shared(Watched(a), Watched(b), 5) == len(os.path.commonprefix([a, b]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_merged_in_levels_give_the_answers_of_one_merge(spark, seed):
    rng = random.Random(seed)
    letters = [bytes(rng.choices(b"ab", k=S.GRAM)) for _ in range(3)]

    def key():
        right, left = S.LENGTH - rng.randint(0, 2), rng.randint(2, 4)
        body = rng.choice(letters) + bytes(rng.choices(b"xy", k=1)) * (right - S.GRAM) + bytes(rng.choices(b"uv", k=left))
        return body + bytes([right])

    rows = []
    for block in range(23):
        for part in range(2):
            keys = sorted({key() for _ in range(rng.randint(1, 9))})
            table = np.zeros((len(keys), S.KEY), np.uint8)
            for row, k in zip(table, keys, strict=True):
                row[: len(k)] = np.frombuffer(k, np.uint8)
            coded = S.front_code(table, np.array([len(k) for k in keys], np.int64))
            rows.append((part, block, bytearray(coded[0]), bytearray(coded[1]), bytearray(np.array([rng.randint(0, 99) for _ in keys], np.int64).tobytes())))
    frame = spark.createDataFrame(rows, "part long, block long, run_sizes binary, rest binary, docs binary")
    found = lambda out: {(r["part"], r["block"]): (bytes(r["least"]), bytes(r["detail"])) for r in out.collect()}
    assert found(S._merge_in_levels(frame, S.Scratch(spark, "t"), 23, 3)) == found(S._merge(frame))


@pytest.mark.parametrize("seed", range(8))
def test_merge_is_a_merge(seed):
    rng = random.Random(seed)
    runs = [sorted({bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 30))}) for _ in range(rng.randint(0, 9))]
    coded = []
    for run in runs:
        keys = np.zeros((len(run), 16), np.uint8)
        for row, key in zip(keys, run, strict=True):
            row[: len(key)] = np.frombuffer(key, np.uint8)
        back, lcps = S.unfold(*S.front_code(keys, np.array([len(k) for k in run], np.int64)))
        assert back == run
        coded.append((back, lcps))
    merged = list(S.merge_runs(coded))
    assert [m[0] for m in merged] == sorted(k for run in runs for k in run)
    for before, (key, lcp, run, place) in zip([b"", *[m[0] for m in merged]], merged, strict=False):
        assert lcp == S.shared(before, key, 0) and runs[run][place] == key


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(3)
    text = bytes(rng.choices(b"abc ", k=400))

    def places(data):
        position, _, first, last = S.anchors(data, np.array([len(data)]))
        return {data[s : s + S.LENGTH]: int(p) - s for p, a, b in zip(position, first, last, strict=True) for s in range(a, b + 1)}

    whole, part = places(text), places(text[37:250])
    assert len(whole) == 351 and all(whole[k] == v for k, v in part.items())
