"""Operators on small inputs, edge cases first."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetwright import constants as C
from sheetwright.operators import associate, layout, metrics, reconcile, records, resolve
from sheetwright.verify import field_rows, verify


@pytest.mark.parametrize(("selector", "want"), [("1,3,5-8", [1, 3, 5, 6]), ("4-2", [2, 3, 4]), ("-3", []), (",", []), ("", [1, 2, 3, 4, 5, 6]), (None, [1, 2, 3, 4, 5, 6]), ("2-999999999999", [2, 3, 4, 5, 6])])
def test_selector(spark, selector, want):
    valid = spark.range(1, 7).withColumnRenamed("id", "Record")
    assert sorted(r[0] for r in records.selected_ids(spark, selector, valid).collect()) == want


def test_clean_records(spark):
    rows = [(0, "2", " A ", "urban", "x"), (1, "x", "-", "n/a", "x"), (2, "1.9", "B", None, "x"), (3, None, "C", "", "x")]
    got = records.clean_records(spark.createDataFrame(rows, "src_pos long, `No.` string, `Nama Nasabah` string, URBAN string, extra string")).orderBy("src_pos").collect()
    assert [(r["Record"], r["Nama Nasabah"], r["Urban"]) for r in got] == [(2, "A", "urban"), (1, "B", None), (3, "C", None)]
    assert "extra" not in got[0].asDict()
    empty = spark.createDataFrame([], "src_pos long, `Nama Nasabah` string")
    assert records.clean_records(empty).count() == 0


@pytest.mark.parametrize(
    ("scores", "want"),
    [((0.02, 0, 0), ("1", "detected", "single_mark")), ((0.02, 0.02, 0), ("6", "detected", "cross_out")), ((0, 0, 0), (None, "blank", "belum_diisi")), ((0.02, 0.02, 0.02), (None, "review", "ambiguous_mark")), ((0.011, 0.0095, 0), (None, "review", "single_mark_low_gap")), ((0.02,), (None, "blank", "insufficient_options"))],
)
def test_choice(spark, scores, want):
    labels = ("1", "3", "6")
    marks = spark.createDataFrame([(1, f"o{i}", i, labels[i], float(s), False) for i, s in enumerate(scores)], "doc int, option string, ord int, label string, score double, out_of_frame boolean")
    row = resolve.choices(marks, ["doc"]).first()
    assert (row["value"], row["status"], row["reason"]) == want


@pytest.mark.parametrize(("scores", "want"), [((0, 0), "blank"), ((0.02, 0), "review"), ((0.02, 0.02), "review")])
def test_two_options_never_decide(spark, scores, want):
    marks = spark.createDataFrame([(1, f"o{i}", i, "l", float(s), False) for i, s in enumerate(scores)], "doc int, option string, ord int, label string, score double, out_of_frame boolean")
    row = resolve.choices(marks, ["doc"]).first()
    assert (row["value"], row["status"]) == (None, want)


def test_one_option_out_of_frame_takes_the_group_out(spark):
    marks = spark.createDataFrame([(1, "a", 0, "1", 0.5, False), (1, "b", 1, "3", 0.0, True), (1, "c", 2, "6", 0.0, False)], "doc int, option string, ord int, label string, score double, out_of_frame boolean")
    assert resolve.choices(marks, ["doc"]).first()["status"] == "out_of_frame"


def test_neighbour_limits(spark):
    want = {
        "nama_nasabah": (0.1478, 0.0), "nomor_rekening": (0.1585, 0.1478), "unit_kerja_pengelola_rekening": (0.2441, 0.1585), "nominal_penempatan": (0.2673, 0.1704),
        "rentang_tenor": (0.2900, 0.2568), "reward_non_tunai": (0.3130, 0.2798), "reward_tunai": (0.7756, 0.3025), "tempat_tanggal_surat": (0.7981, 0.3246),
    }
    assert {r["field"]: (r["next_top"], r["prev_bottom"]) for r in layout.neighbour_limits(spark).collect()} == want


def test_bands_and_chunks(spark):
    bands = associate.ink_bands(spark.createDataFrame([(1, y) for y in (0, 3, 10, 3)], "doc int, y int"), ["doc"], "y").orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in bands] == [(0, 4), (10, 11)]
    crops = spark.createDataFrame([(1, i, 10) for i in range(5)], "doc int, i int, h int")
    assert [r["chunk"] for r in associate.canvas_chunks(crops, "doc", ["i"], 50).orderBy("i").collect()] == [1, 1, 2, 2, 3]


@given(st.lists(st.integers(1, 90), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_chunks_keep_to_the_budget(spark, heights):
    crops = spark.createDataFrame([(1, i, h) for i, h in enumerate(heights)], "doc int, i int, h int")
    rows = associate.canvas_chunks(crops, "doc", ["i"], 100).groupBy("chunk").agg(F.sum(F.col("h") + 10).alias("used"), F.count("*").alias("n")).collect()
    assert all(r["used"] <= 100 or r["n"] == 1 for r in rows)
    assert sum(r["n"] for r in rows) == len(heights)


@pytest.mark.parametrize("kind", ["OK", "REVIEW"])
def test_a_rejection_never_improves_the_decision(spark, kind):
    rank = {"OK": 0, "REVIEW": 1, "TOLAK": 2}
    base = [(1, "urban", "nama_nasabah", kind, "a")]
    more = [*base, (1, "urban", "bentuk_reward", "TOLAK", "b"), (1, "urban", "signature_nasabah", "TOLAK", "not decisive")]
    schema = "Record int, mode string, check string, status string, reason string"
    before, after = (reconcile.decide(spark.createDataFrame(rows, schema), layout.checks(spark), "Record").first() for rows in (base, more))
    assert rank[after["decision"]] >= rank[before["decision"]]
    assert after["reasons"] == ["b"]


def test_rural_notes_and_missing_signature(spark):
    assert spark.range(1).select(reconcile.signature_check("signature_atasan", F.lit(None).cast("string"))["status"]).first()[0] == "TOLAK"
    checks = spark.createDataFrame([(1, "rural", "tenor_penempatan", "TOLAK", "x")], "Record int, mode string, check string, status string, reason string")
    notes = spark.createDataFrame([(1, ["OCR Kurang Yakin"])], "Record int, notes array<string>")
    assert reconcile.rural_notes(checks, notes, "Record").first()["notes"] == ["OCR Kurang Yakin", "Tenor Tidak Sesuai"]


def test_verify(spark):
    texts = [
        (1, "nama_nasabah", "Nama Nasabah : Budi Santoso", 0.9), (1, "nomor_rekening", "12345", 0.9), (1, "nominal_penempatan", "Rp 5.000", 0.9),
        (1, "rentang_tenor", "1 Januari 2025 - 1 April 2025", 0.9), (1, "reward_tunai", "Rp 100", 0.9), (2, "nama_nasabah", "Siti", 0.9),
    ]
    tokens = spark.createDataFrame([(*t, False) for t in texts], "Record long, field string, text string, confidence double, out_of_frame boolean")
    groups = spark.createDataFrame([(1, "tenor_penempatan", "3", "detected"), (1, "bentuk_reward", None, "review")], "Record long, grp string, value string, status string")
    inks = spark.createDataFrame([(1, "signature_nasabah", "present"), (1, "signature_atasan", "present")], "Record long, name string, status string")
    rows = [(1, "Urban", "12345", "budi  santosa", "5000", "3 bulan", "Cashback"), (2, None, "9", "Siti", "1", "1", "Emas"), (3, "urban", "1", "x", "1", "1", "x")]
    recs = spark.createDataFrame(rows, "Record long, Urban string, `Nomor Rekening` string, `Nama Nasabah` string, `Nominal Penempatan` string, `Tenor Hold` string, `Pilihan Hadiah` string")
    got = {r["Record"]: r for r in verify(spark, field_rows(tokens), groups, inks, recs).collect()}
    assert (got[1]["decision"], got[1]["export"], got[1]["final_status"]) == ("OK", "OK Lanjut Proses", "PASSED")
    assert got[2]["mode"] == "rural" and got[2]["decision"] == "TOLAK" and "Tanda tangan Nasabah tidak ditemukan" in got[2]["reasons"]
    assert got[3]["export"] == "Belum Diproses"


def test_runs_and_labels(spark):
    rows = [("run1", "acc", 0, "0.5"), ("run2", "acc", 0, "0.75"), ("run2", "flag", 1, "N/A"), ("run1", "run_label", 2, "x")]
    got = {(r["metric"], r["run"]): r["delta"] for r in metrics.compare_runs(spark.createDataFrame(rows, "run string, metric string, ord int, value string"), "run1").collect()}
    assert got == {("acc", "run1"): "=", ("acc", "run2"): "+0.2500", ("flag", "run2"): ""}
    names = spark.createDataFrame([("a", "other", "p/x.json"), ("a", "pipeline", "p"), (None, None, "p\\q/s.v1.json")], "l string, m string, p string")
    assert [r[0] for r in names.select(metrics.run_label(F.col("l"), F.col("m"), F.col("p"))).collect()] == ["a (other)", "a", "s.v1"]
    assert metrics.summary_kind(["funnel", "decision_accuracy"]) == "stage_evaluation"


def test_layout_tables(spark):
    assert layout.checks(spark).count() == sum(map(len, C.DECISIVE.values()))
    box = spark.range(1).select(layout.clip_box(*[F.lit(v) for v in (-3.0, 2.5, 1.0, 900.0)], F.lit(100), F.lit(50))).first()[0]
    assert tuple(box) == (0, 2, 1, 50)


@pytest.mark.parametrize("block", [4, 1000])
def test_ratio_matches_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    key = [int(k) for k in rng.integers(0, 3, 60)]
    frame = spark.createDataFrame([(key[i], i, vectors[i].tolist()) for i in range(60)] + [(9, 99, vectors[0].tolist())], "key int, id long, e array<double>")
    left, right = (frame.select("key", F.col("id").alias(f"{s}_id"), F.col("e").alias(f"{s}_e")) for s in "lr")
    want = {}
    for i in range(60):
        near = sorted((round(float(1 - vectors[i] @ vectors[j]), 6), j) for j in range(60) if j != i and key[j] == key[i])[:2]
        if len(near) == 2 and near[0][0] < 0.78 * near[1][0]:
            want[i] = (near[0][1], near[0][0], near[1][0])
    got = {r["l_id"]: (r["r_id"], r["d1"], r["d2"]) for r in associate.ratio_matches(left, right, 0.78, block).collect()}
    assert got == want and want


def test_an_unreadable_signature_does_not_fail_the_others(spark):
    from sheetwright.vision import backends

    row = spark.createDataFrame([(bytearray(b"x"), bytearray(b"y")), (None, None)], "a binary, b binary").select(backends.signature_ink("a", "b").alias("s")).collect()
    assert all(r["s"] is None or set(r["s"]) == {None} for r in row)
