import bisect

import duckdb
import pytest
from pyspark.sql import functions as F

from sheetwright.llm import warc
from sheetwright.llm.common import Scratch

SCHEMA = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, target long, key string"


def make(spark, rows):
    return spark.createDataFrame([(*r, 7, "k") for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://User@WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "example.com/a/b?a=1&b=2"), ("https://example.com/", "example.com"), ("example.com/A?ref=1", "example.com/A"), ("", None), (None, None), ("https://e.com:8080/x?refer=1", "e.com:8080/x?refer=1")],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def test_verdicts_and_headers(spark):
    h = {"Content-Type": "text/html", "ETag": '"a"', "Content-Length": "9", "Date": "1"}
    rows = [
        (1, "http://e.com/x", 10, "response", 200, '"a"', "m", "d1", h), (2, "http://e.com/x#f", 20, "response", 404, '"z"', None, "d2", None), (3, "https://www.e.com/x/", 30, "revisit", 304, 'W/"a"', None, None, {"date": "2", "Content-Length": "0", "X-Odd": "1"}),
        (4, "http://e.com/x", 40, "revisit", 304, '"b"', "m", None, None), (5, "http://e.com/x", 50, "revisit", 304, None, "m", None, None), (6, "http://e.com/x", 60, "revisit", 304, None, None, None, None), (7, "http://e.com/x", 10, "revisit", 304, '"a"', None, None, None),
        (8, None, 99, "revisit", 304, '"a"', None, None, None), (9, "http://e.com/x", None, "revisit", 304, '"a"', None, None, None), (10, "http://e.com/x", 70, "revisit", 304, None, "other", None, None), (10, "http://e.com/x", 70, "revisit", 304, None, "other", None, None), (11, None, None, None, None, None, None, None, None),
    ]
    got = {}
    for r in warc.resolve_revisits(spark, make(spark, rows)).collect():
        got.setdefault(r["record_id"], []).append(r)
    assert {k: v[0]["verdict"] for k, v in got.items()} == {3: "etag", 4: "mismatch", 5: "last_modified", 6: "unchecked", 7: "orphan", 8: "orphan", 9: "orphan", 10: "mismatch"}
    assert len(got[10]) == 2 and all(r["target"] == 1 for k in (3, 4, 5, 6) for r in got[k])
    assert got[3][0]["headers"] == {"content-type": "text/html", "etag": '"a"', "content-length": "9", "date": "2"} and got[3][0]["digest"] == "d1"
    assert got[4][0]["headers"] is None and got[4][0]["digest"] is None
    assert warc.resolve_revisits(spark, make(spark, [])).count() == 0


def test_repeated_rows_null_ids_and_names_that_differ_in_case(spark):
    h = {"Date": "1", "date": "2", "X": "a" * 200_000, "x": "b"}
    url = "http://e.com/" + "long/" * 40_000
    rows = [
        *[(1, url, 10, "response", 200, '"a"', None, "d1", h)] * 3, (1, url, 10, "response", 200, '"b"', None, "d9", None), (None, "http://n.com", 5, "response", 200, None, None, "dn", {"A": "1"}),
        (None, url, 30, "revisit", 304, None, None, None, {"DATE": "8", "Date": "9"}), (2, url, 30, "revisit", 304, None, None, None, None), (2, url, 30, "revisit", 304, None, None, None, None), (3, "http://n.com/", 7, "revisit", 304, None, None, None, None), (4, "http://n.com/", 5, "revisit", 304, None, None, None, None),
    ]
    got = sorted(warc.resolve_revisits(spark, make(spark, rows)).collect(), key=lambda r: r["record_id"] or 0)
    assert [(r["record_id"], r["target"], r["target_ts"], r["verdict"]) for r in got] == [(None, 1, 10, "unchecked"), (2, 1, 10, "unchecked"), (2, 1, 10, "unchecked"), (3, None, 5, "unchecked"), (4, None, None, "orphan")]
    assert got[3]["digest"] == "dn" and got[3]["headers"] == {"a": "1"} and len({r["digest"] for r in got[:3]}) == 1
    if got[0]["digest"] == "d1":
        assert got[0]["headers"] == {"date": "9", "x": "b"} and got[1]["headers"] == {"date": "2", "x": "b"}
    only = warc.resolve_revisits(spark, make(spark, [rows[0], rows[5]])).first()
    assert only["headers"] == {"date": "9", "x": "b"}


@pytest.mark.parametrize("size", [7, 1000])
def test_as_of_join_over_ranges_of_a_hot_url(spark, size):
    records = spark.range(400).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 11)).alias("key"), (F.xxhash64("id") % 150).alias("ts"), (F.xxhash64("id", F.lit(1)) % 4 == 0).alias("is_response"))
    rows = records.collect()
    want = {}
    for r in rows:
        if not r["is_response"]:
            before = sorted((x["ts"], x["record_id"]) for x in rows if x["is_response"] and x["key"] == r["key"])
            at = bisect.bisect_left(before, (r["ts"], -1))
            if at:
                want[r["key"], r["ts"]] = (before[at - 1][0], max(i for t, i in before if t == before[at - 1][0]))
    got = {(r["key"], r["ts"]): (r["target_ts"], r["target"]) for r in warc.latest_before(spark, records, Scratch(spark, "t"), size).collect()}
    assert got == want


def test_pages_against_sql(spark, small):
    from sheetwright.llm.queries import op1_revisit_resolution

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    got = sorted(map(str, (tuple(r) for r in op1_revisit_resolution(spark, small).collect())))
    want = sorted(map(str, con.sql(warc.ORACLE).fetchall()))
    assert got == want
