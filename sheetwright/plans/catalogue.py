"""Queries over the driver's tables, each with the SQL that gives the same rows.

None of the tables holds forms, so form-shaped columns are derived from them by
fixed expressions, the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwright import constants as C
from sheetwright.functions import dates, text as X
from sheetwright.functions.python import repair_json
from sheetwright.operators import associate, layout, metrics, reconcile, records, regions, resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bigint_counts(sql: str) -> str:
    """``count_if(x)`` spelled so that it is a bigint, as Spark's is."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = bigint_counts(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# ---- cells and scalars


@query(f"""
SELECT c_custkey, CASE WHEN lower(trim(cell)) IN ({sql_list(C.MISSING)}) THEN NULL ELSE trim(cell) END AS cell
FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN '--' WHEN 2 THEN ' NaN' WHEN 3 THEN '  ' ELSE '  ' || c_name || ' ' END AS cell FROM customer)
""")
def clean_cells(spark, sf_dir):
    k = F.col("c_custkey") % 7
    cell = F.when(k == 0, " N/A ").when(k == 1, "--").when(k == 2, " NaN").when(k == 3, "  ").otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.clean_value(cell).alias("cell"))


@query("""
SELECT row_number() OVER (ORDER BY c_custkey) AS "Record", c_custkey AS src_pos, nm AS "Nama Nasabah", seg AS "Urban"
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS nm, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)
WHERE nm IS NOT NULL OR seg IS NOT NULL
""")
def clean_records(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select(F.col("c_custkey").alias("src_pos"), F.when(F.col("c_custkey") % 5 == 0, " - ").otherwise(F.col("c_name")).alias("Nama Nasabah"), F.when(F.col("c_custkey") % 10 == 0, "None").otherwise(F.col("c_mktsegment")).alias("URBAN"), F.lit("x").alias("other"))
    return records.clean_records(raw)


@query("""
SELECT c_custkey, nullif(regexp_replace(translate(raw, 'OoIlSB', '001158'), '[^0-9]', '', 'g'), '') AS account
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'xyz' ELSE translate(c_name, '015', 'OlS') || ' - B' END AS raw FROM customer)
""")
def normalize_account(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 4 == 0, "xyz").otherwise(F.concat(F.translate("c_name", "015", "OlS"), F.lit(" - B")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalize_numeric(raw).alias("account"))


@query("""
SELECT o_orderkey, CAST(TRY_CAST(nullif(regexp_replace(translate(split_part(regexp_replace(raw, 'rp\\.?', '', 'gi'), '(', 1), 'OoIlSB', '001158'), '[^0-9]', '', 'g'), '') AS DECIMAL(38,0)) AS VARCHAR) AS amount
FROM (SELECT o_orderkey, 'Rp. ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.000 (' || o_orderpriority || ' 99)' AS raw FROM orders)
""")
def normalize_amount(spark, sf_dir):
    raw = F.concat(F.lit("Rp. "), F.floor("o_totalprice").cast("long").cast("string"), F.lit(".000 ("), F.col("o_orderpriority"), F.lit(" 99)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.normalize_currency(raw).cast("string").alias("amount"))


_FIELD_SQL = """
SELECT o_orderkey, kind, raw, conf,
       CASE kind WHEN 'numeric' THEN nullif(regexp_replace(translate(raw, 'OoIlSB', '001158'), '[^0-9]', '', 'g'), '')
                 WHEN 'currency' THEN CAST(TRY_CAST(nullif(regexp_replace(translate(raw, 'OoIlSB', '001158'), '[^0-9]', '', 'g'), '') AS DECIMAL(38,0)) AS VARCHAR)
                 ELSE nullif(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '') END AS value
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'numeric' WHEN 1 THEN 'currency' WHEN 2 THEN 'text' ELSE 'optional_text' END AS kind,
             CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '12' WHEN o_orderkey % 11 = 0 THEN 'a' ELSE o_orderpriority || '  ' || CAST(o_custkey AS VARCHAR) || '77' END AS raw,
             CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0 END AS conf FROM orders)
"""


def _fields(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "numeric").when(k % 4 == 1, "currency").when(k % 4 == 2, "text").otherwise("optional_text")
    raw = F.when(k % 5 == 0, "").when(k % 7 == 0, "12").when(k % 11 == 0, "a").otherwise(F.concat(F.col("o_orderpriority"), F.lit("  "), F.col("o_custkey").cast("string"), F.lit("77")))
    conf = F.when(k % 3 != 0, (k % 100) / 100.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), raw.alias("raw"), conf.alias("conf")).withColumn("value", X.normalize_value(F.col("raw"), F.col("kind")))


@query(f"""
WITH f AS ({_FIELD_SQL}), v AS (
  SELECT *, coalesce(CASE kind WHEN 'numeric' THEN regexp_matches(value, '^[0-9]{{4,30}}$') WHEN 'currency' THEN TRY_CAST(value AS DECIMAL(38,0)) > 0 AND TRY_CAST(value AS DECIMAL(38,0)) < 1000000000000000000 ELSE length(value) >= 2 END, false) AS valid FROM f)
SELECT o_orderkey, kind, value, valid, CASE WHEN raw = '' THEN CASE WHEN kind = 'optional_text' THEN 'blank' ELSE 'not_detected' END WHEN NOT valid THEN 'review' WHEN conf < 0.6 THEN 'review' ELSE 'read' END AS status FROM v
""")
def field_status(spark, sf_dir):
    f = _fields(spark, sf_dir)
    f = f.withColumn("valid", X.validate_value(F.col("value"), F.col("kind")))
    return f.select("o_orderkey", "kind", "value", "valid", X.field_status(F.col("raw"), F.col("valid"), F.col("conf"), F.col("kind")).alias("status"))


_ENDS = sql_list(C.LABEL_ENDS)


@query(f"""
WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'asabah : ' || p_name WHEN 1 THEN 'asabah ' || p_name WHEN 2 THEN 'bah ' || p_name WHEN 3 THEN 'Ekening. ' || p_name WHEN 4 THEN p_name || ':' ELSE p_name END AS raw FROM part),
w AS (SELECT *, lower(regexp_replace(split_part(trim(raw), ' ', 1), '^[.,]+|[.,]+$', '', 'g')) AS w1 FROM r),
b AS (SELECT *, length(w1) >= 5 AND len(list_filter([{_ENDS}], lambda x: suffix(x, w1))) > 0 AS is_end FROM w)
SELECT p_partkey, CASE WHEN contains(raw, ':') THEN trim(string_split(raw, ':')[-1]) WHEN is_end THEN trim(CASE WHEN contains(trim(raw), ' ') THEN regexp_replace(trim(raw), '^[^ ]* ', '') ELSE '' END) ELSE trim(raw) END AS text,
       contains(raw, ':') OR is_end AS bleeds FROM b
""")
def label_bleed(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit("asabah : "), n)).when(k == 1, F.concat(F.lit("asabah "), n)).when(k == 2, F.concat(F.lit("bah "), n)).when(k == 3, F.concat(F.lit("Ekening. "), n)).when(k == 4, F.concat(n, F.lit(":"))).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_label_bleed(raw).alias("text"), X.looks_like_label_bleed(raw).alias("bleeds"))


@query("""
SELECT p_partkey, trim(regexp_replace(regexp_replace('RP ' || p_name || ' rp.5', 'rp', ' ', 'gi'), '\\s+', ' ', 'g')) AS text FROM part
""")
def strip_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_terms(F.concat(F.lit("RP "), F.col("p_name"), F.lit(" rp.5")), ("rp",)).alias("text"))


@query("""
WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Nama  Nasabah : ' || s_name WHEN 1 THEN 'nasabah' WHEN 2 THEN 'asa' ELSE s_name END AS token FROM supplier),
l AS (SELECT *, regexp_replace(lower(token), '[^a-z]', '', 'g') AS a, 'namanasabah' AS b FROM t)
SELECT s_suppkey, coalesce(a <> '' AND (contains(b, a) OR contains(a, substr(b, 1, 9))), false) AS is_label, nullif(trim(regexp_extract(token, '(?is)nama\\s*nasabah[ :.–—-]*(.*)$', 1)), '') AS rest FROM l
""")
def label_match(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    token = F.when(k == 0, F.concat(F.lit("Nama  Nasabah : "), F.col("s_name"))).when(k == 1, "nasabah").when(k == 2, "asa").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.fuzzy_contains(token, F.lit("nama nasabah")).alias("is_label"), X.label_remainder(token, "nama nasabah").alias("rest"))


@query("""
SELECT page_id, coalesce(nullif(regexp_extract(u, '/d/([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(u, '[?&]id=([a-zA-Z0-9_-]+)', 1), '')) AS file_id
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/d/F' || CAST(page_id AS VARCHAR) || '/view' WHEN 1 THEN 'https://x.example/open?a=1&id=G_' || CAST(page_id AS VARCHAR) ELSE url END AS u FROM pages)
""")
def drive_file_id(spark, sf_dir):
    k, p = F.col("page_id") % 3, F.col("page_id").cast("string")
    u = F.when(k == 0, F.concat(F.col("url"), F.lit("/d/F"), p, F.lit("/view"))).when(k == 1, F.concat(F.lit("https://x.example/open?a=1&id=G_"), p)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", X.drive_file_id(u).alias("file_id"))


@query("""
WITH m AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Errno 13 at C:\\data\\x.pdf' WHEN 1 THEN 'cannot open /srv/in/' || c_name || '.pdf now' WHEN 2 THEN 'PaddleX failed' WHEN 3 THEN '' ELSE repeat('long text ', 20) END AS msg FROM customer),
s AS (SELECT c_custkey, msg, regexp_replace(regexp_replace(msg, '[A-Za-z]:[\\\\/][^\\s"'']*', '<berkas>', 'g'), '(^|[^\\w.<])/[^\\s"'']*', '\\1<berkas>', 'g') AS t FROM m)
SELECT c_custkey, CASE WHEN regexp_matches(t, '(?i)permission|access is denied|errno 13') THEN 'Server tidak memiliki izin mengakses berkas. [E]'
  WHEN regexp_matches(t, '(?i)paddle|ocr') THEN 'Mesin OCR gagal membaca dokumen. [E]'
  ELSE 'Gagal memproses dokumen [E]' || CASE WHEN trim(t) = '' THEN '' ELSE ': ' || CASE WHEN length(trim(t)) > 140 THEN substr(trim(t), 1, 140) || '…' ELSE trim(t) END END END AS message
FROM s
""")
def sanitize_error(spark, sf_dir):
    k = F.col("c_custkey") % 5
    msg = F.when(k == 0, "Errno 13 at C:\\data\\x.pdf").when(k == 1, F.concat(F.lit("cannot open /srv/in/"), F.col("c_name"), F.lit(".pdf now"))).when(k == 2, "PaddleX failed").when(k == 3, "").otherwise("long text " * 20)
    return table(spark, sf_dir, "customer").select("c_custkey", X.sanitize_error(msg, F.lit("E")).alias("message"))


@query("""
SELECT doc_id, CASE WHEN contains(t, 'ocr') THEN 'OCR' WHEN contains(t, 'choice') OR contains(t, 'pilihan') THEN 'VISUAL_CHOICE' WHEN contains(t, 'signature') OR contains(t, 'tanda tangan') THEN 'SIGNATURE' WHEN contains(t, 'normal') THEN 'NORMALIZATION' WHEN contains(t, 'anchor') OR contains(t, 'roi') OR contains(t, 'localiz') THEN 'LOCALIZATION' ELSE 'OCR' END AS stage
FROM (SELECT doc_id, lower(text) AS t FROM documents)
""")
def failure_stage(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.failure_stage(F.col("text")).alias("stage"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 1 AND 1 OR o_orderkey BETWEEN 3 AND 3 OR o_orderkey BETWEEN 5 AND 80 OR o_orderkey BETWEEN 200 AND 300
""")
def record_selector(spark, sf_dir):
    return records.selected_ids(spark, "1, 3,5-80,300-200,x,-3", table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey")


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, CASE event_id % 3 WHEN 0 THEN 'fenced' WHEN 1 THEN 'wrapped' ELSE 'loose' END AS form FROM events
""")
def json_contract(spark, sf_dir):
    k, p = F.col("event_id") % 3, F.col("props")
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), p, F.lit(" done."))).otherwise(F.regexp_replace(p, r"\}$", ",}"))
    form = F.when(k == 0, "fenced").when(k == 1, "wrapped").otherwise("loose")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(X.json_object(reply), "$.k").alias("k"), form.alias("form"))


@query()
def json_repair(spark, sf_dir):
    cut = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "rest": "unfin'))
    rows = table(spark, sf_dir, "events").select("event_id", X.json_object(cut).alias("parsed"), cut.alias("cut"))
    return rows.where("parsed is null").select("event_id", repair_json("cut").alias("object"))


# ---- dates, terms, rewards, marks


_RANGE = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 9 AS INTEGER)) AS DATE) AS b, o_orderkey % 5 AS form FROM orders"""


def _ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    o = o.select("o_orderkey", "a", F.add_months("a", (F.col("o_orderkey") % 9).cast("int")).alias("b"), (F.col("o_orderkey") % 5).alias("form"))
    names = F.array(*[F.lit(m) for m in C.MONTHS])
    word = lambda d: F.concat_ws(" ", F.day(d).cast("string"), F.initcap(F.element_at(names, F.month(d))), F.year(d).cast("string"))
    digit = lambda d, sep: F.concat_ws(sep, F.day(d).cast("string"), F.month(d).cast("string"), F.year(d).cast("string"))
    text = F.when(F.col("form") == 0, F.concat(word("a"), F.lit(" - "), word("b"))).when(F.col("form") == 1, F.concat(digit("a", "/"), F.lit(" s.d "), digit("b", "."))).when(F.col("form") == 2, F.concat(word("a"), F.lit(" sampai "), digit("b", "-"))).when(F.col("form") == 3, F.concat(F.lit("31/02/2025 "), word("a"))).otherwise(F.lit(""))
    return o.withColumn("text", text)


@query(f"""
WITH r AS ({_RANGE}), m AS (SELECT *, abs((year(b) - year(a)) * 12 + month(b) - month(a)) AS months FROM r)
SELECT o_orderkey, CASE WHEN form > 2 OR months = 0 THEN NULL WHEN months <= 2 THEN 1 WHEN months <= 4 THEN 3 WHEN months <= 7 THEN 6 END AS term,
  CASE WHEN form = 4 THEN 'rentang_tenor_kosong' WHEN form = 3 THEN 'tidak_bisa_ekstrak_2_tanggal_dari_rentang_tenor' WHEN months = 0 THEN 'selisih_tanggal_tidak_valid'
       WHEN months > 7 THEN 'selisih_' || months || '_bulan_tidak_dekat_opsi_manapun' ELSE 'derived_dari_rentang_tenor_' || months || '_bulan_kalender' END AS reason FROM m
""")
def term_of_range(spark, sf_dir):
    r = _ranges(spark, sf_dir).withColumn("t", dates.term_of_range(F.col("text")))
    return r.select("o_orderkey", F.col("t.value").alias("term"), F.col("t.reason").alias("reason"))


@query(f"""
WITH r AS ({_RANGE}), m AS (SELECT *, abs((year(b) - year(a)) * 12 + month(b) - month(a)) AS months FROM r),
d AS (SELECT *, CASE WHEN form > 2 OR months = 0 THEN NULL WHEN months <= 2 THEN 1 WHEN months <= 4 THEN 3 WHEN months <= 7 THEN 6 END AS term,
             CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE [1, 3, 6][1 + o_orderkey % 3] END AS choice, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'blank' ELSE 'review' END ELSE 'detected' END AS st FROM m)
SELECT o_orderkey, coalesce(choice, term) AS value, CASE WHEN choice IS NOT NULL THEN 'choice' WHEN term IS NOT NULL THEN 'rentang_tenor' ELSE 'none' END AS source,
  CASE WHEN choice IS NOT NULL AND term IS NOT NULL AND term <> choice THEN 'conflict' WHEN choice IS NOT NULL OR term IS NOT NULL THEN 'detected' WHEN st = 'blank' AND form = 4 THEN 'blank' ELSE 'review' END AS status FROM d
""")
def term_source(spark, sf_dir):
    k = F.col("o_orderkey")
    choice = F.when(k % 4 != 0, F.element_at(F.array(F.lit(1), F.lit(3), F.lit(6)), (1 + k % 3).cast("int")))
    state = F.when(k % 4 != 0, "detected").when(k % 8 == 0, "blank").otherwise("review")
    r = _ranges(spark, sf_dir).withColumn("t", resolve.term_source(choice, state, F.lit("single_mark"), F.col("text")))
    return r.select("o_orderkey", "t.value", "t.source", "t.status")


@query("""
WITH e AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'tunai' WHEN 1 THEN 'non_tunai' END AS choice, CASE WHEN o_orderkey % 3 < 2 THEN 'detected' ELSE 'review' END AS st, o_orderkey % 2 = 0 AS goods, o_orderkey % 5 < 2 AS cash FROM orders)
SELECT o_orderkey, CASE WHEN choice IS NOT NULL THEN choice WHEN goods AND cash THEN NULL WHEN goods THEN 'non_tunai' WHEN cash THEN 'tunai' END AS value,
  CASE WHEN choice IS NOT NULL THEN 'choice' WHEN goods AND cash THEN 'evidence' WHEN goods THEN 'evidence_reward_non_tunai' WHEN cash THEN 'evidence_reward_tunai' ELSE 'none' END AS source,
  CASE WHEN choice = 'tunai' AND goods AND NOT cash OR choice = 'non_tunai' AND cash AND NOT goods THEN 'conflict' WHEN choice IS NOT NULL THEN 'detected' WHEN goods AND cash THEN 'uncertain' WHEN goods OR cash THEN 'detected' ELSE st END AS status FROM e
""")
def reward_source(spark, sf_dir):
    k = F.col("o_orderkey")
    choice = F.when(k % 3 == 0, "tunai").when(k % 3 == 1, "non_tunai")
    row = resolve.reward_source(choice, F.when(k % 3 < 2, "detected").otherwise("review"), F.lit("x"), k % 2 == 0, k % 5 < 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", row.alias("r")).select("o_orderkey", "r.value", "r.source", "r.status")


_MARKS = """SELECT l_orderkey AS doc, row_number() OVER w AS ord, CAST(row_number() OVER w AS VARCHAR) AS label, 'o' || row_number() OVER w AS option, (l_partkey * 7 % 23) / 1000.0 AS score, l_suppkey % 97 = 0 AS out FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"""


def _marks(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("ord"), n.cast("string").alias("label"), F.concat(F.lit("o"), n.cast("string")).alias("option"), (F.col("l_partkey") * 7 % 23 / 1000.0).alias("score"), (F.col("l_suppkey") % 97 == 0).alias("out_of_frame"))


@query(f"""
WITH m AS ({_MARKS}), g AS (SELECT doc, count(*) AS n, count(*) FILTER (score >= 0.01) AS k, bool_or(out) AS out, list({{'s': score, 'o': ord, 'l': label}} ORDER BY score, ord) AS r, min_by(option, ord) FILTER (score >= 0.01) AS f FROM m GROUP BY doc),
h AS (SELECT *, r[-1].s - r[-2].s >= 0.004 AS lone, r[2].s - r[1].s >= 0.004 AS clean, CASE WHEN n >= 2 THEN round(r[-1].s - r[-2].s, 4) END AS margin FROM g),
v AS (SELECT *, CASE WHEN out THEN 'out_of_frame' WHEN n = 2 THEN CASE k WHEN 0 THEN 'belum_diisi' WHEN 2 THEN 'kedua_opsi_bertanda_kemungkinan_coretan_ganda' ELSE 'satu_dari_dua_opsi_bertanda_ambigu_konvensi:' || f END
  WHEN n < 2 THEN 'insufficient_options' WHEN k = 1 AND lone THEN 'single_mark' WHEN k = 1 THEN 'single_mark_low_gap' WHEN k = n - 1 AND clean THEN 'cross_out' WHEN k = 0 THEN 'belum_diisi' ELSE 'ambiguous_mark' END AS reason FROM h)
SELECT doc, reason, CASE reason WHEN 'single_mark' THEN r[-1].l WHEN 'cross_out' THEN r[1].l END AS value, margin,
  CASE WHEN reason = 'out_of_frame' THEN reason WHEN reason IN ('belum_diisi', 'insufficient_options') THEN 'blank' WHEN reason IN ('single_mark', 'cross_out') THEN 'detected' ELSE 'review' END AS status FROM v
""")
def choice_groups(spark, sf_dir):
    return resolve.choices(_marks(spark, sf_dir), ["doc"])


@query("""
WITH s AS (SELECT event_id, event_id % 4 AS comp, (event_id % 40) / 1000.0 AS area, (event_id % 30) / 100.0 AS sx, (event_id % 7) / 100.0 AS sy FROM events)
SELECT event_id, CASE WHEN comp = 0 OR area < 0.004 THEN 'absent' WHEN area >= 0.012 AND greatest(sx, sy) >= 0.15 THEN 'present' ELSE 'uncertain' END AS state FROM s
""")
def signature_state(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", resolve.signature_state(k % 4, k % 40 / 1000.0, k % 30 / 100.0, k % 7 / 100.0).alias("state"))


# ---- reconciliation


_SLICE = """
SELECT o_orderkey AS doc, o_orderkey AS k, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'urban' ELSE 'rural' END AS mode, substr(c_name, 10) AS ref_no,
  CASE WHEN o_orderkey % 7 = 0 THEN translate(substr(c_name, 10), '015', 'OlS') WHEN o_orderkey % 11 = 0 THEN '000000' ELSE substr(c_name, 10) END AS raw_no,
  c_name AS ref_name, CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN c_mktsegment ELSE c_name END AS name,
  CAST(floor(o_totalprice) AS BIGINT) AS ref_amount, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END END AS amount,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 9) END AS months, o_orderkey % 8 + 1 AS ref_m,
  o_orderkey % 3 = 0 AS money, (o_orderkey % 3 <> 0 AND o_orderkey % 61 <> 0) OR o_orderkey % 43 = 0 AS goods, (o_orderkey % 3 = 0 AND o_orderkey % 47 <> 0) OR o_orderkey % 59 = 0 AS cash,
  CASE WHEN o_orderkey % 17 = 0 THEN 'absent' WHEN o_orderkey % 19 = 0 THEN 'uncertain' ELSE 'present' END AS sig,
  CASE WHEN o_orderkey % 67 = 0 THEN NULL WHEN o_orderkey % 71 = 0 THEN 'out_of_frame' ELSE 'present' END AS chief
FROM orders JOIN customer ON o_custkey = c_custkey
"""
_CHECKS = f"""
WITH s AS ({_SLICE}), t AS (SELECT *, nullif(regexp_replace(translate(raw_no, 'OoIlSB', '001158'), '[^0-9]', '', 'g'), '') AS no, CASE WHEN months IN (1, 2) THEN 1 WHEN months IN (3, 4) THEN 3 WHEN months IN (5, 6, 7) THEN 6 END AS term FROM s),
c AS (
  SELECT doc, mode, 1 AS ord, 'nama_nasabah' AS "check", CASE WHEN name IS NULL THEN 'REVIEW' WHEN name = ref_name THEN 'OK' ELSE 'TOLAK' END AS status FROM t
  UNION ALL SELECT doc, mode, 2, 'nomor_rekening', CASE WHEN no IS NULL THEN 'REVIEW' WHEN no = ref_no THEN 'OK' ELSE 'TOLAK' END FROM t
  UNION ALL SELECT doc, mode, 3, 'nominal_penempatan', CASE WHEN amount IS NULL THEN 'REVIEW' WHEN amount = ref_amount THEN 'OK' ELSE 'TOLAK' END FROM t
  UNION ALL SELECT doc, mode, 4, 'tenor_penempatan', CASE WHEN term IS NULL THEN 'REVIEW' WHEN term = ref_m THEN 'OK' ELSE 'TOLAK' END FROM t
  UNION ALL SELECT doc, mode, 5, 'bentuk_reward', CASE WHEN k % 41 = 0 THEN 'REVIEW' WHEN money AND goods AND NOT cash THEN 'TOLAK' WHEN money AND NOT cash THEN 'REVIEW'
    WHEN NOT money AND cash AND NOT goods THEN 'TOLAK' WHEN NOT money AND NOT goods THEN 'REVIEW' WHEN k % 53 = 0 AND NOT money THEN 'TOLAK' ELSE 'OK' END FROM t
  UNION ALL SELECT doc, mode, 6, 'signature_nasabah', CASE sig WHEN 'present' THEN 'OK' WHEN 'absent' THEN 'TOLAK' ELSE 'REVIEW' END FROM t
  UNION ALL SELECT doc, mode, 7, 'signature_atasan', CASE coalesce(chief, 'absent') WHEN 'present' THEN 'OK' WHEN 'absent' THEN 'TOLAK' ELSE 'REVIEW' END FROM t),
d AS (SELECT * FROM c WHERE ord <= 3 OR (mode = 'urban') = (ord <= 5))
"""


def slice_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, mode, check, status, reason: the seven checks of each order as if it were a form."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k, ref, price = F.col("o_orderkey"), F.substring("c_name", 10, 100), F.floor("o_totalprice").cast("long")
    choice = F.when(k % 3 == 0, "tunai").otherwise("non_tunai")
    goods, cash = ((k % 3 != 0) & (k % 61 != 0)) | (k % 43 == 0), ((k % 3 == 0) & (k % 47 != 0)) | (k % 59 == 0)
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        k.alias("doc"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "urban").otherwise("rural").alias("mode"), ref.alias("ref_no"),
        F.when(k % 7 == 0, F.translate(ref, "015", "OlS")).when(k % 11 == 0, "000000").otherwise(ref).alias("raw_no"),
        F.col("c_name").alias("ref_name"), F.when(k % 23 != 0, F.when(k % 29 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))).alias("name"),
        price.alias("ref_amount"), F.when(k % 31 != 0, price + F.when(k % 37 == 0, 1).otherwise(0)).alias("amount"),
        dates.nearest_term(F.when(k % 13 != 0, k % 9)).alias("term"), (k % 8 + 1).alias("ref_m"),
        reconcile.reward_check(choice, F.when(k % 41 == 0, "uncertain").otherwise("detected"), goods, cash, F.when(k % 53 == 0, "tunai").otherwise(choice))["status"].alias("reward"),
        F.when(k % 17 == 0, "absent").when(k % 19 == 0, "uncertain").otherwise("present").alias("sig"),
        F.when(k % 67 != 0, F.when(k % 71 == 0, "out_of_frame").otherwise("present")).alias("chief"),
    )
    three = lambda value, ref: F.when(value.isNull(), "REVIEW").when(value == ref, "OK").otherwise("TOLAK")
    status = {
        "nama_nasabah": three(F.col("name"), F.col("ref_name")),
        "nomor_rekening": three(X.normalize_numeric(F.col("raw_no")), F.col("ref_no")),
        "nominal_penempatan": three(F.col("amount"), F.col("ref_amount")),
        "tenor_penempatan": three(F.col("term"), F.col("ref_m")),
        "bentuk_reward": F.col("reward"),
        "signature_nasabah": reconcile.signature_check("signature_nasabah", F.col("sig"))["status"],
        "signature_atasan": reconcile.signature_check("signature_atasan", F.col("chief"))["status"],
    }
    checks = F.array(*[F.struct(F.lit(name).alias("check"), s.alias("status")) for name, s in status.items()])
    return rows.select("doc", "mode", F.explode(checks).alias("c")).select("doc", "mode", "c.*", F.concat_ws(" ", "c.check", "c.status").alias("reason"))


@query(_CHECKS + """
SELECT doc, mode, CASE WHEN bool_or(status = 'TOLAK') THEN 'TOLAK' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'OK' END AS decision,
  coalesce(string_agg("check" || ' ' || status, '; ' ORDER BY ord) FILTER (status = CASE WHEN st THEN 'TOLAK' ELSE 'REVIEW' END), '') AS reasons
FROM (SELECT *, bool_or(status = 'TOLAK') OVER (PARTITION BY doc) AS st FROM d) GROUP BY doc, mode
""")  # fmt: skip
def decision_rollup(spark, sf_dir):
    decided = reconcile.decide(slice_checks(spark, sf_dir), layout.checks(spark), "doc")
    return decided.select("doc", "mode", "decision", F.array_join("reasons", "; ").alias("reasons"))


@query(_CHECKS + """, e AS (SELECT doc, mode, CASE WHEN bool_or(status = 'TOLAK') THEN 'TOLAK' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'OK' END AS decision FROM d GROUP BY doc, mode)
SELECT mode, decision, count(*) AS n FROM e GROUP BY mode, decision
""")  # fmt: skip
def decision_by_mode(spark, sf_dir):
    return reconcile.decide(slice_checks(spark, sf_dir), layout.checks(spark), "doc").groupBy("mode", "decision").agg(F.count("*").alias("n"))


@query(_CHECKS + """, e AS (SELECT doc, bool_or(status = 'TOLAK') AS t, bool_or(status = 'REVIEW') AS r, string_agg("check" || ' ' || status, '; ' ORDER BY ord) FILTER (status = 'TOLAK') AS a,
  string_agg("check" || ' ' || status, '; ' ORDER BY ord) FILTER (status = 'REVIEW') AS b FROM d GROUP BY doc)
SELECT o_orderkey AS doc, CASE WHEN doc IS NULL THEN 'Belum Diproses' WHEN t THEN 'Tolak – ' || a WHEN r THEN 'Tolak – ' || b ELSE 'OK Lanjut Proses' END AS export
FROM orders LEFT JOIN e ON o_orderkey = doc AND o_orderkey % 10 <> 0
""")  # fmt: skip
def export_text(spark, sf_dir):
    decided = reconcile.decide(slice_checks(spark, sf_dir), layout.checks(spark), "doc").where("doc % 10 <> 0")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc")).join(decided, "doc", "left")
    return rows.select("doc", reconcile.export_text(F.col("decision"), F.col("reasons")).alias("export"))


_KINDS = {"numeric": "nomor_rekening", "currency": "nominal_penempatan", "tenor": "tenor_penempatan", "choice": "bentuk_reward"}


def _compared(spark, sf_dir):
    """doc, field, ocr_result, status, reason, source, valid: four fields of each order."""
    k = F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("long").cast("string")
    state = F.when(k % 6 == 0, "review").when(k % 7 == 0, "not_detected").when(k % 31 == 0, "error").otherwise("read")
    row = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("ocr_result"))
    values = F.array(
        row("nomor_rekening", F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string"))),
        row("nominal_penempatan", F.concat(F.lit("Rp "), price)),
        row("tenor_penempatan", (k % 4).cast("string")),
        row("bentuk_reward", F.when(k % 2 == 0, "tunai").otherwise("non_tunai")),
    )
    return table(spark, sf_dir, "orders").select(k.alias("doc"), state.alias("status"), (k % 5 == 0).alias("valid"), F.when(k % 4 == 0, "roi_template").otherwise("ocr_primary").alias("source"), F.lit(None).cast("string").alias("reason"), F.explode(values).alias("v")).select("doc", "status", "valid", "source", "reason", "v.*")


def _records(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("doc"), F.when(k % 8 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("-1"))).otherwise(F.col("o_custkey").cast("string")).alias("Nomor Rekening"),
        F.concat(F.lit("00"), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" (x 1)")).alias("Nominal Penempatan"), F.concat((k % 5).cast("string"), F.lit(" bulan")).alias("Tenor Hold"),
        F.when(k % 3 == 0, "Cash Back").when(k % 3 == 1, "Non Tunai").otherwise("Emas").alias("Pilihan Hadiah"),
    )


_ATTACHED = """
WITH o AS (SELECT o_orderkey AS doc, o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS cust, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price,
  CASE WHEN o_orderkey % 6 = 0 THEN 'review' WHEN o_orderkey % 7 = 0 THEN 'not_detected' WHEN o_orderkey % 31 = 0 THEN 'error' ELSE 'read' END AS status FROM orders),
f AS (
  SELECT doc, k, status, 'nomor_rekening' AS field, CASE WHEN k % 9 = 0 THEN NULL ELSE cust END AS ocr, CASE WHEN k % 8 = 0 THEN cust || '-1' ELSE cust END AS entry FROM o
  UNION ALL SELECT doc, k, status, 'nominal_penempatan', 'Rp ' || price, '00' || price || ' (x 1)' FROM o
  UNION ALL SELECT doc, k, status, 'tenor_penempatan', CAST(k % 4 AS VARCHAR), CAST(k % 5 AS VARCHAR) || ' bulan' FROM o
  UNION ALL SELECT doc, k, status, 'bentuk_reward', CASE WHEN k % 2 = 0 THEN 'tunai' ELSE 'non_tunai' END, CASE k % 3 WHEN 0 THEN 'Cash Back' WHEN 1 THEN 'Non Tunai' ELSE 'Emas' END FROM o),
n AS (SELECT *, CASE field WHEN 'nomor_rekening' THEN ocr WHEN 'nominal_penempatan' THEN substr(ocr, 4) WHEN 'tenor_penempatan' THEN ocr ELSE replace(ocr, '_', '') END AS a,
  CASE field WHEN 'nomor_rekening' THEN replace(entry, '-', '') WHEN 'nominal_penempatan' THEN regexp_replace(split_part(entry, ' ', 1), '^0+', '') WHEN 'tenor_penempatan' THEN split_part(entry, ' ', 1) ELSE CASE entry WHEN 'Cash Back' THEN 'tunai' WHEN 'Non Tunai' THEN 'nontunai' ELSE 'emas' END END AS b FROM f),
m AS (SELECT *, CASE WHEN ocr IS NULL THEN NULL ELSE a <> '' AND b <> '' AND a = CASE WHEN field = 'nominal_penempatan' AND b = '' THEN '0' ELSE b END END AS is_match FROM n)
"""


@query(_ATTACHED + """SELECT doc, field, entry, is_match, CASE WHEN is_match THEN 'sesuai' WHEN NOT is_match THEN 'tidak_sesuai' ELSE status END AS display_status,
  CASE WHEN NOT is_match THEN 'data spreadsheet=''' || entry || ''' vs dokumen=''' || ocr || '''' END AS reason FROM m""")
def attach_entry(spark, sf_dir):
    return reconcile.attach_entries(_compared(spark, sf_dir), _records(spark, sf_dir), "doc").select("doc", "field", "entry", "is_match", "display_status", "reason")


@query(_ATTACHED + """SELECT doc, CASE WHEN bool_or(status = 'error') THEN 'ERROR' WHEN bool_or(coalesce(NOT is_match, false)) THEN 'MISMATCH' WHEN bool_or(status = 'not_detected') THEN 'INCOMPLETE' WHEN bool_or(status = 'review') THEN 'UNCERTAIN' ELSE 'PASSED' END AS final_status FROM m GROUP BY doc""")
def final_status(spark, sf_dir):
    return reconcile.final_status(reconcile.attach_entries(_compared(spark, sf_dir), _records(spark, sf_dir), "doc"), "doc")


@query("""
SELECT o_orderkey AS doc, concat_ws('|', CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 5 <> 0 OR o_orderkey % 6 <> 0 AND o_orderkey % 7 = 0 THEN 'ROI Bermasalah' END, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 5 = 0 THEN 'OCR Kurang Yakin' END, CASE WHEN o_orderkey % 4 = 0 THEN 'Fallback OCR Digunakan' END) AS notes FROM orders
""")
def diagnostic_notes(spark, sf_dir):
    return reconcile.diagnostic_notes(_compared(spark, sf_dir), "doc").select("doc", F.array_join("notes", "|").alias("notes"))


@query("""
WITH e AS (SELECT o_orderkey AS doc, [1, 3, 6][1 + o_orderkey % 3] AS choice, CASE WHEN o_orderkey % 4 = 0 THEN 'review' ELSE 'detected' END AS st, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE [1, 3, 6][1 + o_orderkey % 2] END AS d, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey % 4 AS VARCHAR) || ' bulan' END AS ref FROM orders)
SELECT doc, CASE WHEN st = 'review' OR d IS NULL THEN 'REVIEW' WHEN d <> choice THEN 'TOLAK' WHEN ref = '' THEN 'REVIEW' WHEN CAST(choice AS VARCHAR) <> split_part(ref, ' ', 1) THEN 'TOLAK' ELSE 'OK' END AS status,
  CASE WHEN st = 'review' THEN 'Pilihan tenor (1/3/6) tidak terbaca dgn yakin' WHEN d IS NULL THEN 'Rentang tanggal tenor tidak terbaca/ambigu (r)' WHEN d <> choice THEN 'Tenor tidak konsisten: pilihan=' || choice || ' bulan, rentang=' || d || ' bulan'
    WHEN ref = '' THEN 'Tenor konsisten tapi tidak ada data referensi' WHEN CAST(choice AS VARCHAR) <> split_part(ref, ' ', 1) THEN 'Tenor tidak sesuai: dokumen=' || choice || ' bulan, referensi=' || ref END AS reason FROM e
""")
def term_check(spark, sf_dir):
    k = F.col("o_orderkey")
    of = lambda n: F.element_at(F.array(F.lit(1), F.lit(3), F.lit(6)), (1 + k % n).cast("int"))
    ref = F.when(k % 7 == 0, "").otherwise(F.concat((k % 4).cast("string"), F.lit(" bulan")))
    row = reconcile.term_check(of(3), F.when(k % 4 == 0, "review").otherwise("detected"), F.when(k % 5 != 0, of(2)), F.lit("r"), ref)
    return table(spark, sf_dir, "orders").select(k.alias("doc"), row.alias("v")).select("doc", "v.status", "v.reason")


@query("""
WITH e AS (SELECT o_orderkey AS doc, CASE o_orderkey % 2 WHEN 0 THEN 'tunai' ELSE 'non_tunai' END AS choice, CASE WHEN o_orderkey % 9 = 0 THEN 'out_of_frame' ELSE 'detected' END AS st, o_orderkey % 3 = 0 AS goods, o_orderkey % 5 < 3 AS cash, CASE o_orderkey % 4 WHEN 0 THEN 'Cashback' WHEN 1 THEN 'Barang' WHEN 2 THEN 'Emas' ELSE '' END AS ref,
  CASE o_orderkey % 4 WHEN 0 THEN 'tunai' WHEN 1 THEN 'non_tunai' WHEN 2 THEN 'emas' ELSE '' END AS norm FROM orders)
SELECT doc, CASE WHEN st = 'out_of_frame' THEN 'REVIEW' WHEN choice = 'tunai' AND goods AND NOT cash THEN 'TOLAK' WHEN choice = 'tunai' AND NOT cash THEN 'REVIEW' WHEN choice <> 'tunai' AND cash AND NOT goods THEN 'TOLAK' WHEN choice <> 'tunai' AND NOT goods THEN 'REVIEW' WHEN norm = '' THEN 'REVIEW' WHEN norm <> choice THEN 'TOLAK' ELSE 'OK' END AS status FROM e
""")
def reward_check(spark, sf_dir):
    k = F.col("o_orderkey")
    ref = F.when(k % 4 == 0, "Cashback").when(k % 4 == 1, "Barang").when(k % 4 == 2, "Emas").otherwise("")
    row = reconcile.reward_check(F.when(k % 2 == 0, "tunai").otherwise("non_tunai"), F.when(k % 9 == 0, "out_of_frame").otherwise("detected"), k % 3 == 0, k % 5 < 3, ref)
    return table(spark, sf_dir, "orders").select(k.alias("doc"), row["status"].alias("status"))


@query()
def name_similarity(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit("name").alias("kind"), F.col("c_name").alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.reverse("c_name")).otherwise(F.concat(F.col("c_name"), F.lit(" jr"))).alias("b"))
    return reconcile.match(c, "a", "b", "kind").select("c_custkey", "similarity", "is_match")


# ---- fallback readings


@query("""
WITH r AS (SELECT o_orderkey AS doc, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'not_detected' WHEN 1 THEN 'review' WHEN 2 THEN 'review' WHEN 3 THEN 'blank' ELSE 'read' END AS status, o_orderkey % 5 <> 1 AS valid, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0 END AS conf, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE 'affine' END AS method FROM orders),
a AS (SELECT *, CASE WHEN status = 'not_detected' THEN 'not_detected' WHEN status = 'review' AND NOT valid THEN 'invalid' WHEN status = 'review' AND coalesce(conf, 0) < 0.45 THEN 'low_confidence' WHEN status = 'review' THEN 'uncertain' WHEN status = 'read' AND method = 'none' THEN 'geometry_uncertain' END AS reason,
  k % 2 = 0 AS p, k % 7 < 3 AS q, k % 11 < 4 AS s FROM r),
b AS (SELECT *, coalesce(reason IS NOT NULL AND p, false) AS page FROM a), c AS (SELECT *, coalesce(reason IS NOT NULL AND NOT page AND status <> 'read' AND q, false) AS roi FROM b),
d AS (SELECT *, coalesce(reason IS NOT NULL AND (NOT (page OR roi) OR method = 'none'), false) AS asked FROM c)
SELECT doc, reason, CASE WHEN asked AND s THEN 'roi_second_pass_vlm' WHEN roi THEN 'roi_template' WHEN page THEN 'vlm_fullpage' ELSE 'ocr_primary' END AS source,
  CASE WHEN asked AND s THEN '3333' WHEN roi THEN '2222' WHEN page THEN '1111' ELSE '0000' END AS final_value FROM d
""")
def fallback_arbitration(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("doc"), F.lit("numeric").alias("kind"), F.lit("0000").alias("value"),
        F.when(k % 5 == 0, "not_detected").when(k % 5 < 3, "review").when(k % 5 == 3, "blank").otherwise("read").alias("status"), (k % 5 != 1).alias("valid"), F.when(k % 3 != 0, (k % 100) / 100.0).alias("confidence"),
        F.when(k % 4 == 0, "none").otherwise("affine").alias("section_method"), F.when(k % 2 == 0, "1111").otherwise("1").alias("page_value"), F.lit("readable").alias("page_status"),
        F.when(k % 7 < 3, "2222").alias("roi_value"), F.lit("3333").alias("second_value"), F.when(k % 11 < 4, "readable").otherwise("uncertain").alias("second_status"),
    )
    return resolve.arbitrate(rows).select("doc", "reason", "source", "final_value")


@query("""
WITH e AS (SELECT o_orderkey AS doc, CAST(o_custkey AS VARCHAR) AS v, CASE WHEN o_orderkey % 3 = 0 THEN 'review' ELSE 'read' END AS st, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey AS VARCHAR) ELSE '1' || CAST(o_custkey AS VARCHAR) END AS ref, CASE WHEN o_orderkey % 5 = 0 THEN 'uncertain' ELSE 'readable' END AS rs, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '9' END AS rv FROM orders)
SELECT doc, CASE WHEN st = 'read' AND ref <> '' AND ref <> v AND rs = 'readable' THEN CASE WHEN rv = v THEN 'confirmed' ELSE 'recognition_conflict' END END AS verdict FROM e
""")
def reference_check(spark, sf_dir):
    k, v = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ref = F.when(k % 4 == 0, "").when(k % 4 == 1, v).otherwise(F.concat(F.lit("1"), v))
    verdict = resolve.reference_verdict(F.lit("numeric"), v, F.when(k % 3 == 0, "review").otherwise("read"), ref, F.when(k % 2 == 0, v).otherwise("9"), F.when(k % 5 == 0, "uncertain").otherwise("readable"))
    return table(spark, sf_dir, "orders").select(k.alias("doc"), verdict.alias("verdict"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE event_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '1' WHEN 2 THEN '6' END WHEN 1 THEN CASE event_id % 2 WHEN 0 THEN 'non_tunai' ELSE 'tunai' END ELSE CASE event_id % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'present' WHEN 2 THEN 'absent' END END AS value FROM events
""")
def independent_reads(spark, sf_dir):
    k = F.col("event_id")
    term = resolve.apply_choice_read(F.lit("tenor_penempatan"), F.when(k % 4 == 0, "sekitar 3 bulan").when(k % 4 == 2, "6Bulan").otherwise("x"), F.lit("readable"), F.when(k % 4 == 1, "1/1/2025"), F.when(k % 4 == 1, "3/2/2025"))
    reward = resolve.apply_choice_read(F.lit("bentuk_reward"), F.when(k % 2 == 0, "NON tunai").otherwise("Tunai"), F.lit("readable"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    sig = resolve.apply_signature_read(F.when(k % 4 == 0, "Tidak ada").when(k % 4 == 1, "Ada tanda").when(k % 4 == 2, "kosong").otherwise("?"), F.lit("readable"))
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 3 == 0, term).when(k % 3 == 1, reward).otherwise(sig).alias("value"))


# ---- measures


def _evaluated(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n, v: F.when(k % n != 0, v)
    cols = {
        "segment": F.col("o_orderpriority"), "load_success": k % 20 != 0, "pipeline_success": k % 10 != 0, "alignment_status": some(15, F.when(k % 4 == 0, "failed").otherwise("ok")), "alignment_method": F.when(k % 6 == 0, "homography").otherwise("affine"),
        "failure_stage": F.when(k % 10 == 0, F.when(k % 20 == 0, "INPUT").otherwise("ALIGNMENT")), "region_status": F.when(k % 7 == 0, "error").otherwise("ok"), "all_5_fields_match": some(3, k % 5 == 0), "all_7_checks_match": some(4, k % 9 == 0),
        "tenor_choice": some(5, F.lit(1)), "tenor_derived": some(6, F.lit(1)), "tenor_consistent": k % 8 != 0, "reward_choice": some(7, F.lit("tunai")), "goods_filled": k % 2 == 0, "cash_filled": k % 3 == 0, "reward_consistent": k % 11 != 0,
        "truth": some(12, F.when(k % 5 < 3, "OK").otherwise("TOLAK")), "decision": F.when(k % 4 == 0, "REVIEW").when(k % 7 < 4, "OK").otherwise("TOLAK"), "seconds": F.col("o_custkey") % 50 * 1.0,
    }
    cols |= {f"{f}_comparison": F.when(k % (i + 5) == 0, "N/A").when(k % (i + 2) == 0, "MATCH").otherwise("MISMATCH") for i, f in enumerate(metrics.COMPARED_FIELDS)}
    return table(spark, sf_dir, "orders").select(k.alias("doc"), *[c.alias(n) for n, c in cols.items()])


_RATE = "round({0} / nullif({1}, 0), 4)"
_EVALUATED = "SELECT o_orderpriority AS segment, o_orderkey AS k, o_custkey % 50 * 1.0 AS seconds, CASE WHEN o_orderkey % 12 <> 0 THEN CASE WHEN o_orderkey % 5 < 3 THEN 'OK' ELSE 'TOLAK' END END AS truth, CASE WHEN o_orderkey % 4 = 0 THEN 'REVIEW' WHEN o_orderkey % 7 < 4 THEN 'OK' ELSE 'TOLAK' END AS decision FROM orders"


@query(f"""
WITH e AS ({_EVALUATED})
SELECT segment, count(*) AS documents_total, count_if(k % 10 <> 0) AS documents_processed, {_RATE.format('count_if(k % 20 <> 0)', 'count(*)')} AS load_success_rate,
  {_RATE.format('count_if(k % 15 <> 0 AND k % 4 <> 0)', 'count_if(k % 15 <> 0)')} AS alignment_success_rate, count_if(k % 10 = 0 AND k % 20 <> 0) AS alignment_failed_count, count_if(k % 6 = 0) AS alignment_homography_escalation_count,
  {_RATE.format('count_if(k % 7 <> 0)', 'count_if(k % 20 <> 0)')} AS semantic_region_success_rate, {_RATE.format('count_if(k % 10 <> 0)', 'count(*)')} AS pipeline_success_rate,
  {_RATE.format('count_if(k % 3 <> 0 AND k % 5 = 0)', 'count_if(k % 3 <> 0)')} AS all_5_fields_exact_accuracy, {_RATE.format('count_if(k % 4 <> 0 AND k % 9 = 0)', 'count_if(k % 4 <> 0)')} AS all_7_checks_exact_accuracy,
  count_if(k % 5 <> 0 AND k % 6 <> 0) AS tenor_both_evidence_read_count, {_RATE.format('count_if(k % 8 <> 0)', 'count_if(k % 10 <> 0)')} AS tenor_internal_consistency_rate,
  count_if(k % 7 <> 0 AND (k % 2 = 0 OR k % 3 = 0)) AS reward_both_evidence_read_count, {_RATE.format('count_if(k % 11 <> 0)', 'count_if(k % 10 <> 0)')} AS reward_internal_consistency_rate,
  count(truth) AS decision_ground_truth_available, {_RATE.format('count_if(decision = truth)', 'count(truth)')} AS decision_accuracy,
  {_RATE.format("count_if(truth = 'TOLAK' AND decision = 'OK')", "count_if(truth = 'TOLAK')")} AS false_accept_rate, {_RATE.format("count_if(truth = 'OK' AND decision = 'TOLAK')", "count_if(truth = 'OK')")} AS false_reject_rate,
  {_RATE.format("count_if(decision = 'REVIEW')", 'count_if(k % 10 <> 0)')} AS review_rate, round(avg(seconds), 2) AS average_processing_time_sec, count_if(k % 20 = 0) AS failed_INPUT, count_if(k % 10 = 0 AND k % 20 <> 0) AS failed_ALIGNMENT,
  {', '.join(f'CAST(0 AS BIGINT) AS failed_{s}' for s in C.FAILURE_STAGES[2:])},
  {', '.join(f'''count_if(k % {i + 5} <> 0) AS {f}_measurable, count_if(k % {i + 5} <> 0 AND k % {i + 2} = 0) AS {f}_match, {_RATE.format(f'count_if(k % {i + 5} <> 0 AND k % {i + 2} = 0)', f'count_if(k % {i + 5} <> 0)')} AS {f}_accuracy''' for i, f in enumerate(metrics.COMPARED_FIELDS))}
FROM e GROUP BY segment
""")
def evaluation_summary(spark, sf_dir):
    return metrics.evaluation_summary(_evaluated(spark, sf_dir), ["segment"])


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(s), '^ok') THEN 'OK' WHEN regexp_matches(lower(s), '^tolak') THEN 'TOLAK' END AS truth FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'OK lanjut' ELSE CASE WHEN doc_id % 2 = 0 THEN 'Tolak - x' ELSE '?' END END AS s FROM labels)
""")
def ground_truth(spark, sf_dir):
    s = F.when(F.col("quality") == 1, " OK lanjut").when(F.col("doc_id") % 2 == 0, "Tolak - x").otherwise("?")
    return table(spark, sf_dir, "labels").select("doc_id", X.ground_truth_decision(s).alias("truth"))


@query("""
WITH e AS (SELECT o_orderkey AS doc, unnest(['nama_nasabah', 'nomor_rekening', 'nominal_penempatan', 'tenor_penempatan', 'bentuk_reward']) AS field, o_orderpriority AS p, o_orderkey % 4 AS v FROM orders),
t AS (SELECT doc, field, CASE v WHEN 0 THEN '' WHEN 1 THEN CASE field WHEN 'bentuk_reward' THEN 'non_tunai' ELSE p || ' 12' END WHEN 2 THEN CASE field WHEN 'bentuk_reward' THEN 'Emas' ELSE p || '  012' END ELSE 'zz 9' END AS a, CASE field WHEN 'bentuk_reward' THEN 'Cashback' ELSE lower(p) || ' 12' END AS b FROM e),
n AS (SELECT *, CASE field WHEN 'nama_nasabah' THEN nullif(upper(trim(regexp_replace(a, '\\s+', ' ', 'g'))), '') WHEN 'nomor_rekening' THEN nullif(regexp_replace(a, '[^0-9]', '', 'g'), '') WHEN 'nominal_penempatan' THEN CAST(TRY_CAST(nullif(regexp_replace(a, '[^0-9]', '', 'g'), '') AS DECIMAL(38,0)) AS VARCHAR) WHEN 'tenor_penempatan' THEN CAST(TRY_CAST(nullif(regexp_extract(a, '([0-9]+)', 1), '') AS DECIMAL(38,0)) AS VARCHAR) ELSE CASE WHEN trim(a) = '' THEN NULL WHEN regexp_matches(lower(a), 'cash|tunai') THEN 'tunai' ELSE 'non_tunai' END END AS x,
  CASE field WHEN 'nama_nasabah' THEN upper(b) WHEN 'nomor_rekening' THEN regexp_replace(b, '[^0-9]', '', 'g') WHEN 'nominal_penempatan' THEN CAST(CAST(regexp_replace(b, '[^0-9]', '', 'g') AS DECIMAL(38,0)) AS VARCHAR) WHEN 'tenor_penempatan' THEN CAST(CAST(regexp_extract(b, '([0-9]+)', 1) AS DECIMAL(38,0)) AS VARCHAR) ELSE 'tunai' END AS y FROM t)
SELECT doc, field, CASE WHEN x IS NULL OR y IS NULL THEN 'N/A' WHEN x = y THEN 'MATCH' ELSE 'MISMATCH' END AS comparison FROM n
""")
def compare_fields(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(k.alias("doc"), p.alias("p"), (k % 4).alias("v"), F.explode(F.array(*[F.lit(f) for f in metrics.COMPARED_FIELDS])).alias("field"))
    reward = F.col("field") == "bentuk_reward"
    a = F.when(F.col("v") == 0, "").when(F.col("v") == 1, F.when(reward, "non_tunai").otherwise(F.concat("p", F.lit(" 12")))).when(F.col("v") == 2, F.when(reward, "Emas").otherwise(F.concat("p", F.lit("  012")))).otherwise("zz 9")
    return rows.select("doc", "field", X.compare_field(F.col("field"), a, F.when(reward, "Cashback").otherwise(F.concat(F.lower("p"), F.lit(" 12")))).alias("comparison"))


@query("""
WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey % 100) / 100.0 AS ratio, (l_suppkey % 24 - 12) / 1.0 AS rot, 0.8 + (l_partkey % 45) / 100.0 AS sx, (l_suppkey % 12 - 6) / 1.0 AS shear, l_linenumber % 2 = 0 AS h, (l_partkey % 20) / 20.0 AS cov, (l_suppkey % 10) / 10.0 AS sig FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(ratio < 0.35 AS INTEGER) + CAST(abs(rot) > 8 AS INTEGER) + 2 * CAST(NOT sx BETWEEN 0.85 AND 1.15 AS INTEGER) + CAST(h AND abs(shear) > 3 AS INTEGER) + CAST(cov < 0.85 AS INTEGER) + CAST(sig < 0.85 AS INTEGER) AS n_reasons,
  CASE WHEN ratio < 0.35 OR abs(rot) > 8 OR NOT sx BETWEEN 0.85 AND 1.15 OR h AND abs(shear) > 3 OR cov < 0.85 THEN 'FAIL' ELSE 'PASS' END AS status FROM g
""")
def gate_rules(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    sx = F.lit(0.8) + p % 45 / 100.0
    sx = F.round(sx, 4)
    reasons = metrics.gate_reasons(p % 100 / 100.0, (s % 24 - 12) / 1.0, sx, sx, (s % 12 - 6) / 1.0, F.when(F.col("l_linenumber") % 2 == 0, "homography").otherwise("affine"), {"identity_area": p % 20 / 20.0, "signature_area": s % 10 / 10.0})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.size(reasons).alias("n_reasons"), metrics.gate_status(reasons).alias("status"))


_ROI = """SELECT o_orderkey AS doc, ['nama_nasabah', 'nomor_rekening', 'nominal_penempatan', 'tenor_penempatan', 'bentuk_reward'][1 + o_custkey % 5] AS field, CASE WHEN o_orderkey % 13 = 0 THEN 'out_of_frame' WHEN o_orderkey % 11 = 0 THEN 'not_detected' ELSE 'read' END AS st,
  CASE o_orderkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN 'nasabah x' WHEN 2 THEN o_orderpriority WHEN 3 THEN o_orderpriority || o_orderpriority ELSE '' END AS raw, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ' ' || o_orderpriority END AS truth FROM orders"""
_ROI_CLASS = "CASE WHEN st = 'out_of_frame' THEN 'CUT_OFF' WHEN truth <> '' AND st = 'not_detected' THEN 'WRONG_LOCATION' WHEN raw = 'nasabah x' THEN 'LABEL_BLEED' WHEN truth <> '' AND raw <> '' AND length(raw) / length(trim(truth)) < 0.6 THEN 'TOO_NARROW' WHEN truth <> '' AND raw <> '' AND length(raw) / length(trim(truth)) > 1.6 THEN 'TOO_WIDE' ELSE 'PASS' END"


def _rois(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    field = F.element_at(F.array(*[F.lit(f) for f in metrics.COMPARED_FIELDS]), (1 + F.col("o_custkey") % 5).cast("int"))
    raw = F.when(k % 5 == 0, "ab").when(k % 5 == 1, "nasabah x").when(k % 5 == 2, p).when(k % 5 == 3, F.concat(p, p)).otherwise("")
    status = F.when(k % 13 == 0, "out_of_frame").when(k % 11 == 0, "not_detected").otherwise("read")
    truth = F.when(k % 6 == 0, "").otherwise(F.concat(F.lit(" "), p))
    return table(spark, sf_dir, "orders").select(k.alias("doc"), field.alias("field"), metrics.text_roi(status, raw, truth, F.lit(False)).alias("roi"))


@query(f"SELECT doc, field, {_ROI_CLASS} AS roi FROM ({_ROI})")
def roi_class(spark, sf_dir):
    return _rois(spark, sf_dir)


@query(f"WITH r AS (SELECT field, {_ROI_CLASS} AS roi FROM ({_ROI})) SELECT roi, {', '.join(f'''count_if(field = '{f}') AS {f}''' for f in metrics.COMPARED_FIELDS)} FROM r GROUP BY roi")
def roi_matrix(spark, sf_dir):
    return metrics.roi_matrix(_rois(spark, sf_dir))


@query(f"""
WITH r AS (SELECT doc, {_ROI_CLASS} AS roi, CASE WHEN doc % 8 = 0 THEN 'FAIL' ELSE 'PASS' END AS gate, doc % 3 <> 0 AS ok FROM ({_ROI})), s AS (SELECT *, CASE WHEN gate <> 'PASS' THEN 'PREPROCESSING' WHEN roi <> 'PASS' THEN 'ROI' WHEN NOT ok THEN 'OCR' ELSE 'PASS' END AS stage FROM r)
SELECT count(*) AS total_input, count_if(gate = 'PASS') AS preprocessing_pass, count_if(gate = 'FAIL') AS preprocessing_fail, round(100 * count_if(gate = 'FAIL') / count(*), 2) AS preprocessing_error_pct,
  count_if(gate = 'PASS' AND roi = 'PASS') AS roi_pass, count_if(gate = 'PASS' AND roi <> 'PASS') AS roi_fail, round(100 * count_if(gate = 'PASS' AND roi <> 'PASS') / count_if(gate = 'PASS'), 2) AS roi_error_pct,
  count_if(stage = 'PASS') AS ocr_pass, count_if(stage = 'OCR') AS ocr_fail, round(100 * count_if(stage = 'OCR') / count_if(gate = 'PASS' AND roi = 'PASS'), 2) AS ocr_error_pct FROM s
""")
def funnel(spark, sf_dir):
    rows = _rois(spark, sf_dir).withColumns({"gate": F.when(F.col("doc") % 8 == 0, "FAIL").otherwise("PASS"), "ok": F.col("doc") % 3 != 0})
    return metrics.funnel(rows.withColumn("stage", metrics.bottleneck(F.col("gate"), F.col("roi"), F.col("ok"))))


@query(f"""
WITH r AS (SELECT doc, field, {_ROI_CLASS} AS roi, CASE WHEN doc % 8 = 0 THEN 'FAIL' ELSE 'PASS' END AS gate, CASE doc % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'MISMATCH' ELSE 'MATCH' END AS cmp FROM ({_ROI}))
SELECT field, round(count_if(gate = 'PASS' AND roi = 'PASS') / count_if(gate = 'PASS'), 4) AS field_capture_rate, count_if(gate = 'PASS' AND roi = 'PASS') AS roi_pass_count, round(count_if(roi = 'PASS' AND cmp = 'MATCH') / nullif(count_if(roi = 'PASS' AND cmp <> 'N/A'), 0), 4) AS pure_ocr_accuracy, count_if(roi = 'PASS' AND cmp <> 'N/A') AS pure_ocr_measurable FROM r GROUP BY field
""")
def capture_and_accuracy(spark, sf_dir):
    d = F.col("doc") % 4
    rows = _rois(spark, sf_dir).withColumns({"gate": F.when(F.col("doc") % 8 == 0, "FAIL").otherwise("PASS"), "comparison": F.when(d == 0, "N/A").when(d == 1, "MISMATCH").otherwise("MATCH")})
    return metrics.capture_and_accuracy(rows)


@query("""
SELECT c_custkey, round(CASE WHEN r = '' THEN NULL WHEN h = '' THEN 1.0 ELSE levenshtein(h, r) / length(r) END, 6) AS cer FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment || c_name END AS h, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS r FROM customer)
""")
def character_error_rate(spark, sf_dir):
    h, r = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat("c_mktsegment", "c_name")), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(X.character_error_rate(h, r), 6).alias("cer"))


@query("""
WITH y AS (SELECT 'y' || year(l_shipdate) AS run, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY 1),
m AS (SELECT run, 'counts.rows' AS metric, CAST(n AS DOUBLE) AS x, CAST(n AS VARCHAR) AS value, 0 AS position FROM y UNION ALL SELECT run, 'counts.quantity', CAST(q AS DOUBLE), CAST(q AS VARCHAR), 1 FROM y UNION ALL SELECT run, 'flag', NULL, f, 2 FROM y),
b AS (SELECT metric, x AS base FROM m WHERE run = (SELECT min(run) FROM y))
SELECT m.metric, run, value, CASE WHEN x IS NULL THEN '' WHEN abs(x - base) < 1e-9 THEN '=' ELSE printf('%+.4f', x - base) END AS delta, position FROM m JOIN b ON m.metric = b.metric
""")
def compare_runs(spark, sf_dir):
    y = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("y"), F.year("l_shipdate").cast("string")).alias("run")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.min("l_returnflag").alias("flag"))
    nested = y.select("run", F.struct(F.col("n").alias("rows"), F.col("q").alias("quantity")).alias("counts"), "flag")
    long = metrics.metrics_of(nested, "run")
    first = y.agg(F.min("run")).first()[0]
    return metrics.compare_runs(long, first)


@query("""
SELECT 'signature_a' AS signature, count_if(event_id % 3 = 0) AS present, count_if(event_id % 3 = 1) AS absent, count_if(event_id % 3 = 2) AS uncertain FROM events UNION ALL SELECT 'signature_b', count_if(event_id % 5 < 2), count_if(event_id % 5 = 2), count_if(event_id % 5 = 3) FROM events
""")
def signature_distribution(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.when(k % 3 == 0, "present").when(k % 3 == 1, "absent").otherwise("uncertain").alias("signature_a"), F.when(k % 5 < 2, "present").when(k % 5 == 2, "absent").when(k % 5 == 3, "uncertain").alias("signature_b"))
    return metrics.signature_distribution(rows, ["signature_a", "signature_b"])


# ---- layout and association


@query("WITH b(name, x1, y1, x2, y2, field) AS (VALUES " + ", ".join([f"('{n}', {v[1][0]}, {v[1][1]}, {v[1][2]}, {v[1][3]}, true)" for n, v in C.FIELDS.items()] + [f"('{n}', {', '.join(map(str, v[2]))}, false)" for n, v in C.OPTIONS.items()] + [f"('{n}', {', '.join(map(str, v[1]))}, false)" for n, v in C.SIGNATURES.items()]) + """)
SELECT f.name AS field, CAST(coalesce(min(o.y1) FILTER (o.y1 >= f.y2), 1.0) AS DOUBLE) AS next_top, CAST(coalesce(max(o.y2) FILTER (o.field AND o.y2 <= f.y1), 0.0) AS DOUBLE) AS prev_bottom
FROM b f LEFT JOIN b o ON o.name <> f.name AND least(f.x2, o.x2) - greatest(f.x1, o.x1) > 0 WHERE f.field GROUP BY f.name""")  # fmt: skip
def neighbour_limits(spark, sf_dir):
    return layout.neighbour_limits(spark)


@query("""
SELECT l_orderkey, round(greatest(0, min(x1) - 0.01), 6) AS x1, round(greatest(0, min(y1) - 0.01), 6) AS y1, round(least(1, max(x2) + 0.01), 6) AS x2, round(least(1, max(y2) + 0.01), 6) AS y2
FROM (SELECT l_orderkey, (l_partkey % 80) / 100.0 AS x1, (l_suppkey % 70) / 100.0 AS y1, (l_partkey % 80) / 100.0 + 0.15 AS x2, (l_suppkey % 70) / 100.0 + 0.2 AS y2 FROM lineitem) GROUP BY l_orderkey
""")
def region_envelope(spark, sf_dir):
    x, y = F.col("l_partkey") % 80 / 100.0, F.col("l_suppkey") % 70 / 100.0
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", x.alias("x1"), y.alias("y1"), (x + 0.15).alias("x2"), (y + 0.2).alias("y2"))
    return layout.region_envelopes(boxes, ["l_orderkey"]).select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


_CROPS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 20 + l_partkey % 60 AS h FROM lineitem"


def _crops(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (20 + F.col("l_partkey") % 60).alias("h"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


@query(f"""
WITH c AS ({_CROPS}) SELECT *, CAST(y0 + h AS BIGINT) AS y1 FROM (SELECT *, CAST(coalesce(sum(h + 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y0 FROM c)
""")
def canvas_layout(spark, sf_dir):
    return associate.canvas_layout(_crops(spark, sf_dir), ["l_orderkey"], _ORDER)


@query(f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM ({_CROPS})),
r AS (SELECT l_orderkey, n, l_linenumber, l_partkey, l_suppkey, h, 1 AS chunk, CAST(h + 10 AS BIGINT) AS used FROM c WHERE n = 1
 UNION ALL SELECT c.l_orderkey, c.n, c.l_linenumber, c.l_partkey, c.l_suppkey, c.h, CASE WHEN used + c.h + 10 > 150 THEN chunk + 1 ELSE chunk END, CASE WHEN used + c.h + 10 > 150 THEN c.h + 10 ELSE used + c.h + 10 END FROM r JOIN c ON c.l_orderkey = r.l_orderkey AND c.n = r.n + 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, h, chunk FROM r
""")
def canvas_chunks(spark, sf_dir):
    return associate.canvas_chunks(_crops(spark, sf_dir), "l_orderkey", _ORDER, 150)


@query(f"""
WITH c AS ({_CROPS}), l AS (SELECT *, y0 + h AS y1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM (SELECT *, coalesce(sum(h + 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0 FROM c)),
t AS (SELECT o_orderkey AS l_orderkey, o_orderkey * 3 + i AS token, (o_custkey * (i + 3)) % 300 AS ty1, (o_custkey * (i + 3)) % 300 + 12 AS ty2 FROM orders, range(3) r(i)),
j AS (SELECT t.*, ord, y0, row_number() OVER (PARTITION BY t.l_orderkey, token ORDER BY ord) AS n FROM t JOIN l ON t.l_orderkey = l.l_orderkey AND (ty1 + ty2) / 2 BETWEEN y0 - 2 AND y1 + 2)
SELECT l_orderkey, token, ord, CAST(ty1 - y0 AS BIGINT) AS ty1, CAST(ty2 - y0 AS BIGINT) AS ty2 FROM j WHERE n = 1
""")
def token_layout_join(spark, sf_dir):
    canvas = associate.canvas_layout(_crops(spark, sf_dir), ["l_orderkey"], _ORDER).withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    top = F.col("o_custkey") * (F.col("i") + 3) % 300
    tokens = o.select("l_orderkey", (F.col("l_orderkey") * 3 + F.col("i")).alias("token"), top.alias("ty1"), (top + 12).alias("ty2"))
    return associate.tokens_to_crops(tokens, canvas.select("l_orderkey", "ord", "y0", "y1"), ["l_orderkey"]).select("l_orderkey", "token", "ord", "ty1", "ty2")


@query("""
WITH w(region, field, label, wx1, wy1, wx2, wy2, ry1, ry2) AS (VALUES ('r0', 'nama_nasabah', 'nama nasabah', 10, 10, 60, 60, 0, 100), ('r0', 'nomor_rekening', 'nomor rekening', 40, 30, 90, 95, 0, 100), ('r1', 'rentang_tenor', 'tenor penempatan', 0, 0, 100, 50, 0, 100)),
t AS (SELECT l_orderkey AS doc_id, 'r' || l_orderkey % 2 AS region, CASE l_linenumber % 4 WHEN 0 THEN 'Nama Nasabah: Z' || l_partkey WHEN 1 THEN 'asa' ELSE 'T' || l_partkey || 'q' || l_suppkey END AS text, (l_partkey % 90) / 100.0 AS confidence, l_partkey % 90 AS x1, l_suppkey % 90 AS y1, l_partkey % 90 + 10 AS x2, l_suppkey % 90 + 8 AS y2 FROM lineitem),
j AS (SELECT t.*, field, label, ry1, ry2, regexp_replace(lower(text), '[^a-z]', '', 'g') AS a, replace(label, ' ', '') AS b, (x1 + x2) / 2 BETWEEN wx1 AND wx2 AND (y1 + y2) / 2 BETWEEN wy1 AND wy2 AS inside FROM t JOIN w USING (region)),
p AS (SELECT *, CASE WHEN a <> '' AND (contains(b, a) OR contains(a, substr(b, 1, length(b) - 2))) THEN CASE WHEN label = 'nama nasabah' THEN nullif(trim(regexp_extract(text, '(?is)nama\\s*nasabah[ :.–—-]*(.*)$', 1)), '') END WHEN inside THEN text END AS picked FROM j)
SELECT doc_id, field, string_agg(picked, ' ' ORDER BY round_even((y1 - ry1) / (ry2 - ry1) * 40, 0), x1, picked) AS text, min(confidence) AS confidence, count(*) AS n_tokens FROM p WHERE picked IS NOT NULL GROUP BY doc_id, field
""")
def token_field_join(spark, sf_dir):
    windows = spark.createDataFrame([("r0", "nama_nasabah", "nama nasabah", 10, 10, 60, 60, 0, 100), ("r0", "nomor_rekening", "nomor rekening", 40, 30, 90, 95, 0, 100), ("r1", "rentang_tenor", "tenor penempatan", 0, 0, 100, 50, 0, 100)], "region string, field string, label string, wx1 int, wy1 int, wx2 int, wy2 int, ry1 int, ry2 int")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") % 4
    text = F.when(n == 0, F.concat(F.lit("Nama Nasabah: Z"), p.cast("string"))).when(n == 1, "asa").otherwise(F.concat(F.lit("T"), p.cast("string"), F.lit("q"), s.cast("string")))
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("r"), (F.col("l_orderkey") % 2).cast("string")).alias("region"), text.alias("text"), (p % 90 / 100.0).alias("confidence"), (p % 90).alias("x1"), (s % 90).alias("y1"), (p % 90 + 10).alias("x2"), (s % 90 + 8).alias("y2"))
    return associate.tokens_to_fields(tokens, windows)


@query("""
WITH e AS (SELECT DISTINCT user_id, event_id // 50 AS "at" FROM events), m AS (SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at") <= 3 THEN 0 ELSE 1 END AS new FROM e), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY "at") AS band FROM m)
SELECT user_id, min("at") AS start, max("at") + 1 AS "end", count(*) AS n FROM b GROUP BY user_id, band
""")
def ink_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 50).alias("at"))
    return associate.ink_bands(rows, ["user_id"], "at")


@query("""
WITH p AS (SELECT user_id, value AS dx, (event_id % 101) / 1.0 AS dy FROM events), m AS (SELECT user_id, median(dx) AS mx, median(dy) AS my, count(*) AS n FROM p GROUP BY user_id)
SELECT p.user_id, round(mx, 4) AS mx, round(my, 4) AS my, n, count_if(sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) <= 40) AS n_near, round(avg(dy) FILTER (sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) <= 40), 4) AS dy FROM p JOIN m ON p.user_id = m.user_id GROUP BY p.user_id, mx, my, n
""")
def section_offsets(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("dx"), (F.col("event_id") % 101 / 1.0).alias("dy"))
    return associate.robust_offsets(points, ["user_id"], 40.0).select("user_id", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"), "n", "n_near", F.round("dy", 4).alias("dy"))


@query("SELECT s_nationkey, max_by(s_name, row(s_suppkey % 3, s_acctbal, s_suppkey)) AS s_name, count(*) AS n FROM supplier GROUP BY s_nationkey")
def best_alignment(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("rank", F.col("s_suppkey") % 3)
    return associate.best_candidate(s, ["s_nationkey"], ["rank", "s_acctbal", "s_suppkey"], "s_name")


@query("""
WITH v AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT l.vec_id AS l_id, r.vec_id AS r_id, round(1 - list_inner_product(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS distance FROM v l JOIN v r ON l.label = r.label AND l.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY distance, r_id) AS n FROM p), t AS (SELECT l_id, min_by(r_id, row(distance, r_id)) AS r_id, min(distance) AS d1, max(distance) AS d2, count(*) AS n FROM k WHERE n <= 2 GROUP BY l_id)
SELECT l_id, r_id, d1, d2, n FROM t WHERE n = 2 AND d1 < 0.78 * d2
""")
def ratio_test(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("key"), F.col("embedding").cast("array<double>").alias("e"))
    left, right = v.select("key", F.col("vec_id").alias("l_id"), F.col("e").alias("l_e")), v.select("key", F.col("vec_id").alias("r_id"), F.col("e").alias("r_e"))
    return associate.ratio_matches(left, right, 0.78)


# ---- boxes on a page


def _pages(spark, sf_dir):
    """Part rows as pages: sizes of 1 to 4,000 pixels, a template box, a shift and a map."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    box = lambda a, b: F.struct((k % a / (2.0 * a)).alias("x1"), (k % b / (2.0 * b)).alias("y1"), (k % a / (2.0 * a) + 0.25).alias("x2"), (k % b / (2.0 * b) + 0.125).alias("y2"))
    return p.select("p_partkey", (k * 37 % 4000 + 1).cast("int").alias("w"), (k * 53 % 3000 + 1).cast("int").alias("h"), box(8, 16).alias("value"), box(16, 4).alias("anchor"), (k % 41 - 20).cast("double").alias("dx"), (k % 23 - 11).cast("double").alias("dy"), (k % 3 == 0).alias("matched"))


_PAGES = """p AS (SELECT p_partkey, p_partkey * 37 % 4000 + 1 AS w, p_partkey * 53 % 3000 + 1 AS h, p_partkey % 8 / 16.0::DOUBLE AS vx, p_partkey % 16 / 32.0::DOUBLE AS vy, p_partkey % 16 / 32.0::DOUBLE AS ax, p_partkey % 4 / 8.0::DOUBLE AS ay, p_partkey % 41 - 20 AS dx, p_partkey % 23 - 11 AS dy, p_partkey % 3 = 0 AS matched FROM part)"""


def _clipped(x1: str, y1: str, x2: str, y2: str, name: str) -> str:
    """SQL columns of a box cut to the page."""
    left, top = f"greatest(0, least(w - 1, round_even({x1}, 0)))", f"greatest(0, least(h - 1, round_even({y1}, 0)))"
    return f"CAST({left} AS INT) AS {name}_x1, CAST({top} AS INT) AS {name}_y1, CAST(greatest({left} + 1, least(w, round_even({x2}, 0))) AS INT) AS {name}_x2, CAST(greatest({top} + 1, least(h, round_even({y2}, 0))) AS INT) AS {name}_y2"


def _flat(*boxes: str) -> list[Column]:
    return [F.col(f"{b}.{c}").alias(f"{b}_{c}") for b in boxes for c in ("x1", "y1", "x2", "y2")]


@query(f"""
WITH {_PAGES} SELECT p_partkey, round(least(1.0, 1800 / greatest(w, h)::DOUBLE), 9) AS scale, CAST(greatest(1, round_even(w * least(1000.0::DOUBLE / w, 1400.0::DOUBLE / h), 0)) AS INT) AS width, CAST(greatest(1, round_even(h * least(1000.0::DOUBLE / w, 1400.0::DOUBLE / h), 0)) AS INT) AS height,
CAST(floor((1000 - greatest(1, round_even(w * least(1000.0::DOUBLE / w, 1400.0::DOUBLE / h), 0))) / 2) AS INT) AS x, CAST(floor((1400 - greatest(1, round_even(h * least(1000.0::DOUBLE / w, 1400.0::DOUBLE / h), 0))) / 2) AS INT) AS y FROM p
""")
def page_fit(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("f", regions.letterbox(F.col("w"), F.col("h"), F.lit(1000), F.lit(1400)))
    return p.select("p_partkey", F.round(regions.match_scale(F.col("w"), F.col("h")), 9).alias("scale"), "f.*")


@query(f"""
WITH {_PAGES}, t AS (SELECT *, {_clipped("vx * w", "vy * h", "(vx + 0.25) * w", "(vy + 0.125) * h", "t")}, {_clipped("ax * w", "ay * h", "(ax + 0.25) * w", "(ay + 0.125) * h", "a")} FROM p),
m AS (SELECT *, p_partkey % 5 < 2 AS mapped, p_partkey % 2 = 0 AS clamped FROM t),
r AS (SELECT *, CASE WHEN mapped THEN t_x1 * 1.5 + 4 WHEN matched THEN t_x1 + dx ELSE t_x1 END AS bx1, CASE WHEN mapped THEN t_y1 * 1.5 - 6 WHEN matched THEN t_y1 + dy ELSE t_y1 END AS by1, CASE WHEN mapped THEN t_x2 * 1.5 + 4 WHEN matched THEN t_x2 + dx ELSE t_x2 END AS bx2, CASE WHEN mapped THEN t_y2 * 1.5 - 6 WHEN matched THEN t_y2 + dy ELSE t_y2 END AS by2 FROM m),
c AS (SELECT *, {_clipped("bx1", "by1", "bx2", "by2", "c")} FROM r),
k AS (SELECT *, greatest(c_y1, CAST(round_even(0.25 * h, 0) AS INT)) AS top, least(c_y2, CAST(round_even(0.75 * h, 0) AS INT)) AS bottom FROM c),
b AS (SELECT *, c_x1 AS box_x1, c_x2 AS box_x2, CASE WHEN clamped AND bottom > top THEN top ELSE c_y1 END AS box_y1, CASE WHEN clamped AND bottom > top THEN bottom ELSE c_y2 END AS box_y2 FROM k)
SELECT p_partkey, CASE WHEN mapped THEN 'section_section_affine' WHEN matched THEN 'anchor' ELSE 'fallback' END AS source, box_x1, box_y1, box_x2, box_y2, {_clipped("a_x1 + box_x1 - t_x1", "a_y1 + box_y1 - t_y1", "a_x2 + box_x1 - t_x1", "a_y2 + box_y1 - t_y1", "anchor_box")} FROM b
""")
def field_boxes(spark, sf_dir):
    k = F.col("p_partkey")
    number = lambda v: F.lit(float(v))
    m = F.struct(number(1.5).alias("a"), number(0).alias("b"), number(4).alias("tx"), number(0).alias("c"), number(1.5).alias("d"), number(-6).alias("ty"))
    rows = _pages(spark, sf_dir).select("*", F.when(k % 5 < 2, m).alias("transform"), F.lit("section_affine").alias("method"), F.when(k % 2 == 0, C.CLAMPED_REGION).otherwise("placement_area").alias("region"), number(0.75).alias("next_top"), number(0.25).alias("prev_bottom"))
    return regions.field_boxes(rows, F.col("w"), F.col("h")).select("p_partkey", "source", *_flat("box", "anchor_box"))


@query(f"""
WITH {_PAGES} SELECT p_partkey, round(greatest(0.125, vx - 0.75 * 0.025), 9) AS x1, round(greatest(0.0625, vy - 0.5 * 0.02), 9) AS y1, round(least(0.875, vx + 0.25 + 0.75 * 0.025), 9) AS x2, round(least(0.5625, vy + 0.125 + 0.5 * 0.02), 9) AS y2 FROM p
""")
def search_windows(spark, sf_dir):
    region = F.struct(*[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (0.125, 0.0625, 0.875, 0.5625), strict=True)])
    p = _pages(spark, sf_dir).withColumn("s", regions.search_window(F.col("value"), region))
    return p.select("p_partkey", *[F.round(f"s.{c}", 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""
WITH e AS (SELECT user_id, event_id % 1000 / 2.0 AS x, event_id * 7 % 800 / 2.0 AS y, value, event_id % 4 > 0 AS inlier FROM events), b AS (SELECT * FROM e WHERE y >= 40)
SELECT user_id, round(CASE WHEN count_if(inlier) >= 2 THEN (max(x) FILTER (inlier) - min(x) FILTER (inlier)) * (max(y) FILTER (inlier) - min(y) FILTER (inlier)) / 200000.0 ELSE 0 END, 6) AS coverage,
round(CASE WHEN count_if(inlier) >= 2 THEN avg(sqrt(0.0625 + value * value)) FILTER (inlier) END, 6) AS error, count_if(inlier) AS inliers FROM b GROUP BY user_id
""")
def match_geometry(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", (k % 1000 / 2.0).alias("x"), (k * 7 % 800 / 2.0).alias("y"), "value", (k % 4 > 0).alias("inlier"))
    body = regions.body_points(e, F.lit(400)).select("*", (F.col("x") + 0.25).alias("px"), (F.col("y") + F.col("value")).alias("py"))
    return regions.match_geometry(body, ["user_id"], F.lit(500), F.lit(400)).select("user_id", F.round("coverage", 6).alias("coverage"), F.round("error", 6).alias("error"), "inliers")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'CUT_OFF' ELSE 'PASS' END AS roi, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, CASE WHEN event_id % 5 < 3 THEN props END) AS value FROM events
""")
def result_values(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    result = F.create_map(F.lit("text"), F.when(k % 5 < 3, F.col("props")).otherwise(""), F.lit("ocr_result"), F.when(k % 3 == 0, F.col("event_type")).when(k % 3 == 1, ""), F.lit("other"), F.lit("x"))
    return e.select("event_id", regions.signature_roi(F.when(F.col("event_type") == "error", "out_of_frame").otherwise("present")).alias("roi"), metrics.extracted_value(result).alias("value"))


@query("""
WITH r AS (SELECT o_custkey, count(*) AS n, CAST(NULL AS VARCHAR) AS stage FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey UNION ALL SELECT o_custkey, NULL, 'late' FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey)
SELECT c_custkey, n, stage, r.o_custkey IS NOT NULL AS evaluated FROM customer LEFT JOIN r ON c_custkey = o_custkey
""")
def evaluated_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    done = orders.where("o_orderstatus = 'O'").groupBy("c_custkey").agg(F.count("*").alias("n"))
    failed = orders.where("o_orderstatus <> 'O'").groupBy("c_custkey").agg(F.lit("late").alias("stage"))
    return metrics.with_blank_rows(table(spark, sf_dir, "customer").select("c_custkey"), metrics.all_columns(done, failed), "c_custkey")


# ---- service state


@query("""
SELECT user_id, count(*) AS total, count_if(event_type = 'view') AS pending, count_if(event_type = 'click') AS queued, CAST(0 AS BIGINT) AS processing, count_if(event_type = 'purchase') AS done, count_if(event_type = 'signup') AS no_document, count_if(event_type = 'error') AS error FROM events GROUP BY user_id
""")
def batch_status(spark, sf_dir):
    t = F.col("event_type")
    status = F.when(t == "view", "pending").when(t == "click", "queued").when(t == "purchase", "done").when(t == "signup", "no_document").otherwise(t)
    return records.batch_status(table(spark, sf_dir, "events").select("user_id", status.alias("status")), "user_id")


@query("""
SELECT user_id, max_by(event_type, row(ts, event_id)) FILTER (event_type <> 'view') AS event_type, max_by(event_id, row(ts, event_id)) FILTER (event_id % 3 = 0) AS event_id FROM (SELECT user_id, event_type, event_id, ts FROM events) GROUP BY user_id
""")
def latest_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("event_id"))
    return records.latest_progress(e, "user_id", ["ts", "seq"], ["event_type", "event_id"])


@query("""
SELECT page_id, path FROM (SELECT page_id, 'F' || CAST(page_id % 50 AS VARCHAR) AS file_id FROM pages) LEFT JOIN (SELECT 'F' || CAST(page_id % 40 AS VARCHAR) AS file_id, min(url) AS path FROM pages GROUP BY 1) USING (file_id)
""")
def fetch_documents(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.concat(F.lit("https://x/d/F"), (F.col("page_id") % 50).cast("string"), F.lit("/view")).alias(C.LINK_COLUMN))
    docs = p.select(F.concat(F.lit("F"), (F.col("page_id") % 40).cast("string")).alias("file_id"), F.col("url").alias("path"))
    return records.with_documents(links, docs).select("page_id", "path")


@query("""
SELECT 's1' AS session, c_custkey, c_custkey % 2 = 0 AS ready, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS result, CASE WHEN c_custkey % 2 <> 0 THEN 'pending' END AS status, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 <> 0 THEN 'e' END AS error FROM customer WHERE c_custkey = 9
""")
def session_result(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = records.new_session(c, "s1", "c_custkey").join(c.select("c_custkey", "c_name"), "c_custkey")
    k = F.col("c_custkey")
    rows = rows.select("session", "c_custkey", "status", F.when(k % 2 == 0, F.col("c_name")).alias("result"), F.when(k % 3 == 0, "e").alias("error"))
    return records.record_result(rows, "s1", 9, "c_custkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as forms: account and term checks, decided by the checks of each one's region mode."""
    return decision_rollup(spark, sf_dir)
