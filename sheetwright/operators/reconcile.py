"""Comparison with records, checks, decisions, notes and export text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright import constants as C
from sheetwright.functions import text as X
from sheetwright.functions.python import name_similarity


def _kind_of(field: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in C.DATA_TYPES.items() for x in pair])
    return F.coalesce(kinds[field], F.lit("text"))


def match(rows: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """``rows`` with is_match and similarity: names by similarity of a to b, other types by equal normal forms.

    An empty normal form never matches.  The Python function gets nulls for
    rows that are no names, so the rows are neither split nor joined again.
    """
    forms = rows.withColumns({"_a": X.normalize_for_compare(F.col(a), F.col(kind)), "_b": X.normalize_for_compare(F.col(b), F.col(kind))})
    full = (F.col("_a") != "") & (F.col("_b") != "")
    named = F.coalesce((F.col(kind) == "name") & full, F.lit(False))
    found = forms.withColumn("_s", name_similarity(F.when(named, F.col("_a")), F.when(named, F.col("_b"))))
    same = F.when(named, F.col("_s") >= C.NAME_SIMILARITY).otherwise(full & (F.col("_a") == F.col("_b")))
    return found.withColumns({"similarity": F.when(named, F.col("_s")), "is_match": same}).drop("_a", "_b", "_s")


def entries_of(records: DataFrame, key: str = "Record") -> DataFrame:
    """key, field, entry: the compared columns of records as rows."""
    pairs = [F.struct(F.lit(field).alias("field"), F.col(f"`{column}`").alias("entry")) for column, field in C.COMPARED.items() if column in records.columns]
    return records.select(key, F.explode(F.array(*pairs)).alias("e")).select(key, "e.*")


def _similarity_text() -> Column:
    return F.when(F.col("similarity").isNotNull(), F.format_string(" (similarity %.0f%%)", "similarity")).otherwise("")


def display_status(status: Column, matched: Column) -> Column:
    return F.when(matched, "sesuai").when(matched == F.lit(False), "tidak_sesuai").otherwise(F.coalesce(X.or_null(status), F.lit("-")))


def attach_entries(fields: DataFrame, records: DataFrame, key: str = "Record") -> DataFrame:
    """Each field row with its record's entry, match, display status and, on a mismatch, the reason for it."""
    joined = fields.join(entries_of(records, key), [key, "field"], "left").withColumn("kind", _kind_of(F.col("field")))
    both = (F.coalesce(F.col("entry"), F.lit("")) != "") & (F.coalesce(F.col("ocr_result"), F.lit("")) != "")
    rows = match(joined, "entry", "ocr_result", "kind").withColumn("is_match", F.when(both, F.col("is_match")))
    detail = F.concat(F.lit("data spreadsheet='"), F.col("entry"), F.lit("' vs dokumen='"), F.col("ocr_result"), F.lit("'"), _similarity_text())
    reason = F.when(F.col("is_match") == F.lit(False), F.concat_ws("; ", X.or_null(F.col("reason")), detail)).otherwise(F.col("reason"))
    return rows.withColumns({"display_status": display_status(F.col("status"), F.col("is_match")), "reason": reason})


def final_status(rows: DataFrame, key: str) -> DataFrame:
    """One status a document: ERROR, MISMATCH, INCOMPLETE, UNCERTAIN or PASSED, the first that applies."""
    compared = F.col("field").isin(*C.DATA_TYPES)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    status = (
        F.when(some(F.col("status") == "error"), "ERROR")
        .when(some(compared & (F.col("is_match") == F.lit(False))), "MISMATCH")
        .when(some(compared & F.col("status").isin(*C.INCOMPLETE)), "INCOMPLETE")
        .when(some(F.col("status").isin(*C.UNCERTAIN)), "UNCERTAIN")
        .otherwise("PASSED")
    )
    return rows.groupBy(key).agg(status.alias("final_status"))


def diagnostic_notes(rows: DataFrame, key: str) -> DataFrame:
    """Up to three badges a document, in a fixed order."""
    review = F.col("status") == "review"
    valid = F.coalesce(F.col("valid"), F.lit(False))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy(key).agg(
        F.array_compact(
            F.array(
                F.when(some((F.col("status") == "not_detected") | (review & ~valid)), "ROI Bermasalah"),
                F.when(some(review & valid), "OCR Kurang Yakin"),
                F.when(some(F.col("source").isin(*C.FALLBACK_SOURCES)), "Fallback OCR Digunakan"),
            )
        ).alias("notes")
    )


def _verdict(status: str, reason: Column | str | None = None) -> Column:
    text = F.lit(reason) if reason is None or isinstance(reason, str) else reason
    return F.struct(F.lit(status).alias("status"), text.cast("string").alias("reason"))


def simple_check(rows: DataFrame) -> DataFrame:
    """``verdict`` of value against reference (columns value, reference, kind, label, doc_status)."""
    matched = match(rows, "value", "reference", "kind")
    label = F.col("label")
    doc, ref = X.normalize_for_compare(F.col("value"), F.col("kind")), X.normalize_for_compare(F.col("reference"), F.col("kind"))
    say = lambda *parts: F.concat(label, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    differs = say(" tidak sesuai: dokumen=", F.col("value"), ", referensi=", F.col("reference"), _similarity_text())
    verdict = (
        F.when(F.col("doc_status") == "recognition_conflict", _verdict("REVIEW", say(": hasil OCR dan VLM tidak sepakat, perlu verifikasi manual")))
        .when(F.col("doc_status") == "out_of_frame", _verdict("REVIEW", say(" berada di luar area foto (dokumen kemungkinan terpotong)")))
        .when(doc == "", _verdict("REVIEW", say(" tidak terbaca dari dokumen")))
        .when(ref == "", _verdict("REVIEW", say(" tidak ada data referensi")))
        .when(~F.col("is_match"), _verdict("TOLAK", differs))
        .otherwise(_verdict("OK"))
    )
    return matched.withColumn("verdict", verdict)


def term_check(choice: Column, choice_status: Column, derived: Column, derive_reason: Column, reference: Column) -> Column:
    """Two pieces of evidence must agree, and then agree with the record."""
    ref = X.normalize_for_compare(reference, F.lit("tenor"))
    months = choice.cast("string")
    return (
        F.when(choice_status == "out_of_frame", _verdict("REVIEW", "Area pilihan tenor berada di luar cakupan foto"))
        .when(~F.coalesce(choice_status == "detected", F.lit(False)) | choice.isNull(), _verdict("REVIEW", "Pilihan tenor (1/3/6) tidak terbaca dgn yakin"))
        .when(derived.isNull(), _verdict("REVIEW", F.concat(F.lit("Rentang tanggal tenor tidak terbaca/ambigu ("), derive_reason, F.lit(")"))))
        .when(derived != choice, _verdict("TOLAK", F.concat(F.lit("Tenor tidak konsisten: pilihan="), months, F.lit(" bulan, rentang="), derived.cast("string"), F.lit(" bulan"))))
        .when(ref == "", _verdict("REVIEW", "Tenor konsisten tapi tidak ada data referensi"))
        .when(months != ref, _verdict("TOLAK", F.concat(F.lit("Tenor tidak sesuai: dokumen="), months, F.lit(" bulan, referensi="), reference)))
        .otherwise(_verdict("OK"))
    )


def reward_check(choice: Column, choice_status: Column, goods: Column, cash: Column, reference: Column) -> Column:
    """The marked kind of reward must have its own detail filled in, and then agree with the record."""
    ref = X.normalize_for_compare(reference, F.lit("choice"))
    ref = F.when(ref == "nontunai", "non_tunai").otherwise(ref)
    money = choice == "tunai"
    return (
        F.when(choice_status == "out_of_frame", _verdict("REVIEW", "Area pilihan bentuk reward berada di luar cakupan foto"))
        .when(~F.coalesce(choice_status == "detected", F.lit(False)) | choice.isNull(), _verdict("REVIEW", "Pilihan bentuk reward (tunai/non-tunai) tidak terbaca dgn yakin"))
        .when(money & goods & ~cash, _verdict("TOLAK", "Bentuk reward tidak konsisten: pilihan=tunai tapi detail non-tunai terisi"))
        .when(money & ~cash, _verdict("REVIEW", "Pilihan=tunai tapi nilai reward tunai tidak terbaca"))
        .when(~money & cash & ~goods, _verdict("TOLAK", "Bentuk reward tidak konsisten: pilihan=non-tunai tapi nilai tunai terisi"))
        .when(~money & ~goods, _verdict("REVIEW", "Pilihan=non-tunai tapi detail barang tidak terbaca"))
        .when(ref == "", _verdict("REVIEW", "Bentuk reward konsisten tapi tidak ada data referensi"))
        .when(choice != ref, _verdict("TOLAK", F.concat(F.lit("Bentuk reward tidak sesuai: dokumen="), choice, F.lit(", referensi="), reference)))
        .otherwise(_verdict("OK"))
    )


def signature_check(name: str, state: Column) -> Column:
    """A missing state counts as absent."""
    label = "Nasabah" if name == "signature_nasabah" else "Unit Kerja/Atasan"
    state = F.coalesce(state, F.lit("absent"))
    return (
        F.when(state == "present", _verdict("OK"))
        .when(state == "out_of_frame", _verdict("REVIEW", f"Area tanda tangan {label} berada di luar cakupan foto"))
        .when(state == "absent", _verdict("TOLAK", f"Tanda tangan {label} tidak ditemukan"))
        .otherwise(_verdict("REVIEW", f"Tanda tangan {label} perlu verifikasi manual"))
    )


def decide(checks: DataFrame, decisive: DataFrame, key: str) -> DataFrame:
    """decision and reasons from (key, mode, check, status, reason) over the checks that decide in the mode.

    Any rejection rejects with all its reasons, else any review reviews; a
    status without a reason does not count.  One join and one grouping serve
    both modes.
    """
    rows = checks.join(F.broadcast(decisive), ["mode", "check"])  # ten rows
    given = lambda s: F.array_sort(F.collect_list(F.when((F.col("status") == s) & (F.coalesce(F.col("reason"), F.lit("")) != ""), F.struct("ord", "reason"))))
    grouped = rows.groupBy(key, "mode").agg(given("TOLAK").alias("_no"), given("REVIEW").alias("_maybe"))
    decision = F.when(F.size("_no") > 0, "TOLAK").when(F.size("_maybe") > 0, "REVIEW").otherwise("OK")
    chosen = F.when(F.size("_no") > 0, F.col("_no")).otherwise(F.col("_maybe"))
    return grouped.select(key, "mode", decision.alias("decision"), F.transform(chosen, lambda x: x["reason"]).alias("reasons"))


def rural_notes(checks: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Notes with a badge for each rejected check that does not decide in rural mode."""
    badges = F.array_compact(F.array(*[F.when(F.coalesce(F.bool_or((F.col("mode") == "rural") & (F.col("check") == c) & (F.col("status") == "TOLAK")), F.lit(False)), badge) for c, badge in C.RURAL_NOTES.items()]))
    return notes.join(checks.groupBy(key).agg(badges.alias("_badges")), key, "left").select(key, F.array_union("notes", F.coalesce("_badges", F.array().cast("array<string>"))).alias("notes"))


def export_text(decision: Column, reasons: Column) -> Column:
    """The exported status; a review reads as a rejection."""
    listed = F.coalesce(X.or_null(F.array_join(F.filter(reasons, lambda r: r != ""), "; ")), F.lit("Perlu verifikasi manual"))
    return F.when(F.coalesce(decision, F.lit("")) == "", "Belum Diproses").when(F.upper(decision) == "OK", "OK Lanjut Proses").otherwise(F.concat(F.lit("Tolak – "), listed))
