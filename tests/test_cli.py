import json

import pytest

from sheetwright import cli
from sheetwright.plans import catalogue


def test_evaluate_and_compare(spark, small, tmp_path):
    rows = str(tmp_path / "rows")
    catalogue._evaluated(spark, small).write.parquet(rows)
    assert cli.main(["evaluate", rows, "--label", "a", "--output", str(tmp_path / "a")]) == 0
    assert cli.main(["evaluate", rows, "--label", "b", "--limit", "50", "--output", str(tmp_path / "b")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "a" / "results")).count() == spark.read.parquet(rows).count()
    runs = [str(tmp_path / r / "summary") for r in "ab"]
    assert cli.main(["compare", *runs, str(tmp_path / "missing"), "--output", str(tmp_path / "c")]) == 0
    table = spark.read.option("header", True).csv(str(tmp_path / "c" / "kind=evaluation")).collect()
    assert {r["run"] for r in table} == {"a", "b"}
    assert {r["delta"] for r in table if r["metric"] == "documents_total" and r["run"] == "a"} == {"="}
    assert cli.main(["compare", str(tmp_path / "missing"), "--output", str(tmp_path / "d")]) == 1


def test_funnel(spark, tmp_path):
    rows = str(tmp_path / "rows")
    spark.createDataFrame([(1, "PASS", "PASS", "PASS"), (2, "FAIL", "PASS", "PREPROCESSING"), (3, "PASS", "CUT_OFF", "ROI")], "doc int, gate string, roi string, stage string").write.parquet(rows)
    assert cli.main(["funnel", rows, "--output", str(tmp_path / "f")]) == 0
    got = json.loads(spark.read.text(str(tmp_path / "f" / "summary")).first()[0])["funnel"]
    assert (got["total_input"], got["preprocessing_pass"], got["roi_pass"], got["ocr_pass"]) == (3, 2, 1, 1)


def test_verify(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("No,Nama Nasabah,Nomor Rekening,Urban\n1,Budi,123,urban\n2,Siti,9,\n", "utf-8")
    spark.createDataFrame([(1, "nama_nasabah", "text", "Budi", "Budi", 0.9, "read", True, "ocr_primary")], "Record long, field string, kind string, value string, raw string, confidence double, status string, valid boolean, source string").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([(1, "tenor_penempatan", "3", "detected")], "Record long, grp string, value string, status string").write.parquet(str(tmp_path / "g"))
    spark.createDataFrame([(1, "signature_nasabah", "present")], "Record long, name string, status string").write.parquet(str(tmp_path / "s"))
    args = [x for n, p in (("fields", "f"), ("groups", "g"), ("signatures", "s"), ("records", "sheet.csv")) for x in (f"--{n}", str(tmp_path / p))]
    assert cli.main(["verify", *args, "--select", "1", "--output", str(tmp_path / "o")]) == 0
    (row,) = spark.read.parquet(str(tmp_path / "o" / "decisions")).collect()
    assert row["Record"] == 1 and row["decision"] in ("REVIEW", "TOLAK")
    with pytest.raises(SystemExit):
        cli.main(["verify"])
