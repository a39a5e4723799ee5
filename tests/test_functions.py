"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from sheetwright.functions import dates, text as X
from sheetwright.functions.python import repair_object, similarity
from sheetwright.operators import resolve
from sheetwright.sources.files import sheet_export_url

L = F.lit
S = lambda v: F.lit(v).cast("string")

CASES = [
    (lambda: X.clean_value(L(" N/A ")), None), (lambda: X.clean_value(L("--")), None), (lambda: X.clean_value(L(" x ")), "x"), (lambda: X.clean_value(S(None)), None), (lambda: X.clean_value(L(" nan\t")), None),
    (lambda: X.to_int(L("1.9"), L(7).cast("long")), 1), (lambda: X.to_int(L("x"), L(7).cast("long")), 7),
    (lambda: X.drive_file_id(L("https://x/d/AB_1/view")), "AB_1"), (lambda: X.drive_file_id(L("?id=Z9")), "Z9"), (lambda: X.drive_file_id(L("abc")), None),
    (lambda: X.normalize_numeric(L("OoIlSB")), "001158"), (lambda: X.normalize_numeric(L("12-3 4")), "1234"), (lambda: X.normalize_numeric(L("xyz")), None),
    (lambda: X.normalize_currency(L("Rp. 5.900.000 (lima)")).cast("string"), "5900000"), (lambda: X.normalize_currency(L("1.000,00")).cast("string"), "100000"), (lambda: X.normalize_currency(L("9" * 50)), None),
    (lambda: X.validate_value(L("123"), L("numeric")), False), (lambda: X.validate_value(L("1234"), L("numeric")), True), (lambda: X.validate_value(L("1" * 31), L("numeric")), False), (lambda: X.validate_value(S(None), L("text")), False),
    (lambda: X.field_status(L(""), L(False), S(None).cast("double"), L("optional_text")), "blank"), (lambda: X.field_status(L(""), L(False), L(0.9), L("text")), "not_detected"), (lambda: X.field_status(L("a"), L(True), L(0.59), L("text")), "review"),
    (lambda: X.field_status(L("a"), L(True), L(0.60), L("text")), "read"), (lambda: X.field_status(L("a"), L(True), S(None).cast("double"), L("text")), "read"),
    (lambda: X.strip_label_bleed(L("asabah : Abc")), "Abc"), (lambda: X.strip_label_bleed(L("asabah Abc")), "Abc"), (lambda: X.strip_label_bleed(L("sabah Abc")), "Abc"), (lambda: X.strip_label_bleed(L("bah Abc")), "bah Abc"),
    (lambda: X.normalize_for_compare(L("Non Tunai"), L("choice")), "nontunai"), (lambda: X.normalize_for_compare(L("Cash Back"), L("choice")), "tunai"), (lambda: X.normalize_for_compare(L("Emas"), L("choice")), "emas"), (lambda: X.normalize_for_compare(L("000"), L("currency")), "0"), (lambda: X.normalize_for_compare(L("007"), L("numeric")), "007"),
    (lambda: X.region_mode(L(" URBAN ")), "urban"), (lambda: X.region_mode(S(None)), "rural"), (lambda: X.region_mode(L("suburban")), "rural"),
    (lambda: X.compare_field(L("bentuk_reward"), L("non_tunai"), L("Cashback")), "MATCH"), (lambda: X.compare_field(L("bentuk_reward"), L("Emas"), L("Cashback")), "MISMATCH"), (lambda: X.compare_field(L("nomor_rekening"), L(""), L("1")), "N/A"),
    (lambda: F.round(X.character_error_rate(L("kitten"), L("sitting")), 6), round(3 / 7, 6)), (lambda: X.character_error_rate(L(""), L("abc")), 1.0), (lambda: X.character_error_rate(L("x"), L("")), None),
    (lambda: X.format_delta(L(1.0), L(1.0)), "="), (lambda: X.format_delta(L(1.0), L(1.5)), "+0.5000"), (lambda: X.format_delta(S(None).cast("double"), L(1.0)), ""),
    (lambda: X.fuzzy_contains(L("asa"), L("nama nasabah")), True), (lambda: X.fuzzy_contains(L("Nama Nasab"), L("nama nasabah")), True), (lambda: X.fuzzy_contains(L("Budi"), L("nama nasabah")), False), (lambda: X.fuzzy_contains(L("12"), L("nama nasabah")), False),
    (lambda: X.label_remainder(L("NAMA  nasabah :– Budi A"), "nama nasabah"), "Budi A"), (lambda: X.label_remainder(L("nama nasabah:"), "nama nasabah"), None),
    (lambda: X.json_object(L('```json\n{"a": 1}\n```')), '{"a":1}'), (lambda: X.json_object(L('so: {"a": [1, 2,],} ok')), '{"a":[1,2]}'), (lambda: X.json_object(L("[1]")), None), (lambda: X.json_object(L("none")), None),
    (lambda: X.read_status(L("x"), L("odd")), "readable"), (lambda: X.read_status(S(None), L("odd")), "not_visible"), (lambda: X.tenor_from_text(L("3 BULAN")), 3),
    (lambda: X.sanitize_error(L("no such file: /srv/a b.pdf"), L("E")), "Berkas dokumen tidak ditemukan di server. [E]"), (lambda: X.sanitize_error(S(None), L("E")), "Gagal memproses dokumen [E]"),
    (lambda: dates.term_of_range(L("1 Januari 2025 - 1 April 2025"))["value"], 3), (lambda: dates.term_of_range(L("1/2/2025 - 31/02/2025 s.d 1.5.2025"))["value"], 3), (lambda: F.size(dates.dates_in(L("1/2/25 x 3-4-2025"))), 2), (lambda: dates.term_of_range(S(None))["reason"], "rentang_tenor_kosong"),
    (lambda: resolve.signature_state(L(0), L(0.0), L(0.0), L(0.0)), "absent"), (lambda: resolve.signature_state(L(3), L(0.02), L(0.3), L(0.0)), "present"), (lambda: resolve.signature_state(L(1), L(0.02), L(0.1), L(0.1)), "uncertain"), (lambda: resolve.signature_state(L(2), L(0.008), L(0.5), L(0.5)), "uncertain"),
    (lambda: resolve.reread_reason(L("review"), L(False), L(0.9), L("affine")), "invalid"), (lambda: resolve.reread_reason(L("review"), L(True), L(0.30), L("affine")), "low_confidence"), (lambda: resolve.reread_reason(L("review"), L(True), L(0.50), L("affine")), "uncertain"), (lambda: resolve.reread_reason(L("read"), L(True), L(0.9), L("none")), "geometry_uncertain"), (lambda: resolve.reread_reason(L("blank"), L(True), L(0.9), L("none")), None),
    (lambda: resolve.page_note(L("conflict")), "OCR primary evidence conflicting → Full-Page VLM fallback used"), (lambda: resolve.page_note(L("other")), "OCR primary uncertain → Full-Page VLM fallback used"),
]


def test_golden_values(spark):
    row = spark.range(1).select(*[make().alias(f"c{i}") for i, (make, _) in enumerate(CASES)]).first()
    wrong = [(i, got, want) for i, (got, (_, want)) in enumerate(zip(row, CASES, strict=True)) if got != want]
    assert not wrong


@pytest.mark.parametrize(("months", "term"), list(enumerate([None, 1, 1, 3, 3, 6, 6, 6, None])))
def test_term_ladder(spark, months, term):
    assert spark.range(1).select(dates.nearest_term(F.lit(months))).first()[0] == term


def test_similarity_depends_on_order():
    assert (similarity("tide", "diet"), similarity("diet", "tide"), similarity("", "x")) == (25.0, 50.0, 0.0)


@pytest.mark.parametrize(("text", "want"), [('{"a": 1, "b": "un', '{"a":1}'), ('{"a": "un', '{"a":"un"}'), ('{"a": 1,', '{"a":1}'), ("none", None), ("{", '{}'), (None, None)])
def test_json_repair(text, want):
    assert repair_object(text) == want


def test_sheet_url():
    assert sheet_export_url("https://docs.google.com/spreadsheets/d/A-b_1/edit#gid=42").endswith("/A-b_1/export?format=csv&gid=42")
    assert sheet_export_url("ID").endswith("/ID/export?format=csv&gid=0")
