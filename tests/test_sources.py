import numpy as np


from pyspark.sql import functions as F

from sheetwright.sources import files, xlsx
from sheetwright.streaming import batches


def test_xlsx_round_trip(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxSource)
    path = str(tmp_path / "in.xlsx")
    xlsx.write_book(path, {"first": [["No", "Nama Nasabah", "x"], ["1", "A <&> \"b\"", None], [], ["3", "tiga\nbaris", 7]], "second": [["a"], ["z"]]})
    rows = spark.read.format("xlsx").load(path).orderBy("src_pos").collect()
    assert [(r["src_pos"], r["No"], r["Nama Nasabah"], r["x"]) for r in rows] == [(0, "1", 'A <&> "b"', ""), (1, "", "", ""), (2, "3", "tiga\nbaris", "7")]
    assert spark.read.format("xlsx").option("sheet", "second").load(path).first()["a"] == "z"
    out = str(tmp_path / "out")
    spark.createDataFrame([(1, "x"), (2, None)], "k int, v string").coalesce(1).write.format("xlsx").mode("overwrite").save(out)
    assert [tuple(r)[1:] for r in spark.read.format("xlsx").load(out).orderBy("src_pos").collect()] == [("1", "x"), ("2", "")]
    assert xlsx.column_number(xlsx.column_name(701)) == 701


def test_csv_and_documents(spark, tmp_path):
    (tmp_path / "s.csv").write_text('No,Nama Nasabah\n1,"A, ""B""\nC"\n2,\n', "utf-8")
    rows = files.read_csv(spark, str(tmp_path / "s.csv")).orderBy("src_pos").collect()
    assert [(r["No"], r["Nama Nasabah"]) for r in rows] == [("1", 'A, "B"\nC'), ("2", "")]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "F1.PDF").write_bytes(b"x")
    (docs / "F2.jpg").write_bytes(b"%PDF-1.4")
    (docs / "F3.png").write_bytes(b"x")
    (docs / "F4.txt").write_bytes(b"no")
    got = {r["file_id"]: r["is_pdf"] for r in files.read_documents(spark, str(docs)).collect()}
    assert got == {"F1": True, "F2": True, "F3": False}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    files.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {("1", "N/A"), ("2", "b")}
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_incremental_batch_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    verify = lambda df: df.withColumn("double", F.col("v") * 2)
    spark.createDataFrame([(1, 1), (2, 5), (2, 5)], "Record long, v int").write.parquet(source)
    batches.run_available(spark, source, "Record long, v int", verify, target, str(tmp_path / "cp"))
    spark.createDataFrame([(3, 7)], "Record long, v int").write.mode("append").parquet(source)
    batches.run_available(spark, source, "Record long, v int", verify, target, str(tmp_path / "cp"))
    got = sorted((r["Record"], r["double"]) for r in spark.read.parquet(target).collect())
    assert got == [(1, 2), (2, 10), (3, 14)]


def test_progress_stream(spark, tmp_path):
    source = str(tmp_path / "events")
    schema = "id long, at double, status string, percent double"
    rows = [(1, 1.0, "queued", 0.0), (1, 3.0, None, 50.0), (1, 2.0, "processing", 10.0), (2, 1.0, "done", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    merged = batches.progress_stream(spark.readStream.schema(schema).parquet(source), "id", "at", ["status", "percent"])
    query = merged.writeStream.outputMode("update").format("memory").queryName("progress_test").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    got = {r["id"]: (r["status"], r["percent"]) for r in spark.sql("select * from progress_test").collect()}
    assert got[1] == ("processing", 50.0)
    assert got[2][0] == "done" and (got[2][1] is None or np.isnan(got[2][1]))
