import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwright.llm import quality
from sheetwright.llm.common import crc_bucket


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = quality.quality_scores(spark, docs, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(scored) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) >= 0.95
    assert not [r for r in scored if r["quality"] == 1 and not r["predicted"]]


def test_held_out_rows_teach_nothing(spark, odd):
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 6, 8, 12, 14)] + [(3, None), (None, 1)], "doc_id long, quality int")
    held = {r[0] for r in labels.where(crc_bucket(F.col("doc_id"), 4) == 2).select("doc_id").collect()}
    flipped = labels.select("doc_id", F.when(F.col("doc_id").isin(*held), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality")) if held else labels
    use = lambda frame: quality.fit(spark, odd, frame.where(crc_bucket(F.col("doc_id"), 4) != 2))
    (a, x), (b, y) = use(labels), use(flipped)
    assert (a == b).all() and x == y


def test_odd_rows(spark, odd, none):
    table, bias = np.linspace(-1, 1, quality.BUCKETS).astype(np.float32), 0.5
    rows = quality.score(odd, table, bias).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2] and by[3] == by[4] == by[5] == 1 / (1 + np.exp(-0.5))
    kept = quality.keep_quality(odd, table, bias, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.keep_quality(odd, table, bias, 1.1).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    table, bias = quality.fit(spark, odd, labels)
    assert not table.any() and bias == 0.0
    assert quality.score(none, table, bias).count() == 0


def test_features_do_not_cross_texts():
    alone = [np.sort(quality.features([t])[0]).tolist() for t in ("one two", "", "three")]
    buckets, owner = quality.features(["one two", "", "three"])
    assert [np.sort(buckets[owner == i]).tolist() for i in range(3)] == alone
    assert not alone[1]


def test_pieces_do_not_change_a_score(monkeypatch):
    table = np.random.default_rng(2).normal(size=quality.BUCKETS).astype(np.float32)
    texts = ["a few words", None, "more words here " * 50, "é ü"] * 5
    whole = quality.score_texts(texts, table, 0.1)
    monkeypatch.setattr(quality, "CHUNK_CHARS", 10)
    assert np.allclose(whole, quality.score_texts(texts, table, 0.1))


def plain_features(text):
    """One hash at a time, over characters."""
    mask, odd, mix = (1 << 64) - 1, int(quality._ODD), int(quality._MIX)
    chars = [0x20 if c in " \t\n\v\f\r" else ord(c) for c in f" {text} "]
    mixed = lambda h: ((h ^ h >> 32) * odd & mask) >> int(quality._SHIFT)
    out = []
    for i in range(len(chars) - 2):
        if chars[i + 1] != 0x20:
            out.append(mixed((chars[i] << 42 | chars[i + 1] << 21 | chars[i + 2]) * mix & mask))
            if i + 3 < len(chars) and chars[i + 2] != 0x20:
                first, last = chars[i] << 21 | chars[i + 1], (chars[i + 2] << 21 | chars[i + 3]) + (1 << 50)
                out.append(mixed((first * odd & mask ^ last) * mix & mask))
    for word in "".join(map(chr, chars)).split(" "):
        if word:
            h = sum(ord(c) * pow(odd, i + 1, 1 << 64) for i, c in enumerate(word)) & mask
            out.append(h)
    return out


def test_features_are_words_and_character_grams():
    for text in ("ab é中文 x", "", "one\ttwo\x0bthree", "😂😂😂", "\u3000 a"):
        words = len([w for w in text.replace("\t", " ").replace("\x0b", " ").split(" ") if w])
        got, want = quality.features([text])[0].tolist(), plain_features(text)
        assert len(got) == len(want) and sorted(got[: len(got) - words]) == sorted(want[: len(want) - words])
    assert len(quality.features(["中"])[0]) == 2 and quality.features(["中文"])[0].tolist() != quality.features(["中化"])[0].tolist()


def test_training_equals_plain_gradient_descent(monkeypatch):
    """Word by word, without vectorised updates."""
    monkeypatch.setattr(quality, "BUCKETS", 1 << 17)
    texts, labels = ["good prose here", "bad junk", "more good prose", "junk junk bad", ""], np.array([1, 0, 1, 0, 1])
    docs = [quality.shares(t) for t in texts]
    table, bias = quality.train(docs, labels, dim=3, epochs=2, rate=0.3, seed=5)
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / 3, 1 / 3, (quality.BUCKETS, 3)).tolist()
    used = {int(b) for d in docs for b in d[0]}
    layer, biases, done = [[0.0] * 3, [0.0] * 3], [0.0, 0.0], 0
    for _ in range(2):
        for i in rng.permutation(len(docs)):
            step = 0.3 * (1 - done / 10)
            done += 1
            pairs = [(int(b), float(x)) for b, x in zip(*docs[i], strict=True)]
            if not pairs:
                continue
            hidden = [sum(vectors[b][d] * x for b, x in pairs) for d in range(3)]
            scores = [sum(layer[c][d] * hidden[d] for d in range(3)) + biases[c] for c in range(2)]
            e = [np.exp(v - max(scores)) for v in scores]
            error = [v / sum(e) - (c == labels[i]) for c, v in enumerate(e)]
            back = [sum(layer[c][d] * error[c] for c in range(2)) for d in range(3)]
            for c in range(2):
                layer[c] = [layer[c][d] - step * error[c] * hidden[d] for d in range(3)]
                biases[c] -= step * error[c]
            for b, x in pairs:
                vectors[b] = [vectors[b][d] - step * len(pairs) ** 0.5 * x * back[d] for d in range(3)]
    assert bias == pytest.approx(biases[1] - biases[0], rel=1e-6)
    for b in used:
        assert table[b] == pytest.approx(sum(vectors[b][d] * (layer[1][d] - layer[0][d]) for d in range(3)), rel=1e-4, abs=1e-6)
    score = quality.score_texts(texts, table, bias)
    assert score[4] == pytest.approx(1 / (1 + np.exp(-bias))) and score[0] > score[1]


def test_conflicting_labels_long_texts_and_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good word{i % 7} " * 5 if i % 2 else f"bad junk{i % 7} " * 5) for i in range(60)] + [(60, "good " * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(60, 1), (1, 0), (1, 1)], "doc_id long, quality int")
    table, bias = quality.fit(spark, docs, labels)
    score = quality.score_texts(["good word1", "bad junk2", None], table, bias)
    assert score[0] > 0.5 > score[1]
    monkeypatch.setattr(quality, "MOST_FEATURES", 300)
    few, _ = quality.fit(spark, docs, labels)
    assert few.any() and np.abs(few).sum() != np.abs(table).sum()
