"""Resolvers: marks, signatures, term, reward, and the order in which readings replace each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright import constants as C
from sheetwright.functions import dates, text as X


def text_field(raw: Column, confidence: Column, kind: Column, detected: Column) -> Column:
    """struct(value, raw, confidence, status, valid) of a recognised field text, already free of terms."""
    bare = X.strip_label_bleed(raw)
    value = X.normalize_value(bare, kind)
    valid = X.validate_value(value, kind)
    status = F.when(~detected, F.when(kind == "optional_text", "blank").otherwise("not_detected")).otherwise(X.field_status(bare, valid, confidence, kind))
    here = lambda c: F.when(detected, c)
    return F.struct(here(value).alias("value"), here(X.or_null(bare)).alias("raw"), here(confidence).alias("confidence"), status.alias("status"), here(valid).alias("valid"))


def choices(marks: DataFrame, by: list[str]) -> DataFrame:
    """value, status, reason of each group of options (option, ord, label, score, out_of_frame).

    Three options and more: one marked, or all but one, decides if the gap is
    wide enough.  Two: never decided by marks alone.  One out of frame takes
    the whole group out.
    """
    ranked = F.array_sort(F.collect_list(F.struct(F.col("score"), F.col("ord"), F.col("label"))))
    row = marks.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= C.MARK_CHANGE).alias("marked"), F.bool_or("out_of_frame").alias("out"), ranked.alias("r"))
    marked_first = marks.where(F.col("score") >= C.MARK_CHANGE).groupBy(*by).agg(F.min_by("option", "ord").alias("first_marked"))
    row = row.join(marked_first, by, "left")
    top, second, low, next_low = (F.try_element_at("r", F.lit(i)) for i in (-1, -2, 1, 2))
    lone, clean = top["score"] - second["score"] >= C.MARK_GAP, next_low["score"] - low["score"] >= C.MARK_GAP
    n, marked = F.col("n"), F.col("marked")
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    two = F.when(marked == 0, say("blank", "belum_diisi")).when(marked == 2, say("review", "kedua_opsi_bertanda_kemungkinan_coretan_ganda")).otherwise(say("review", F.concat(F.lit("satu_dari_dua_opsi_bertanda_ambigu_konvensi:"), F.col("first_marked"))))
    many = (
        F.when(n < 2, say("blank", "insufficient_options"))
        .when((marked == 1) & lone, say("detected", "single_mark"))
        .when(marked == 1, say("review", "single_mark_low_gap"))
        .when((marked == n - 1) & clean, say("detected", "cross_out"))
        .when(marked == 0, say("blank", "belum_diisi"))
        .otherwise(say("review", "ambiguous_mark"))
    )
    verdict = F.when(F.col("out"), say("out_of_frame", "out_of_frame")).when(n == 2, two).otherwise(many)
    margin = F.when(n >= 2, F.round(top["score"] - second["score"], 4))
    out = row.withColumn("v", verdict).withColumn("margin", margin)
    value = F.when(F.col("v.reason") == "single_mark", top["label"]).when(F.col("v.reason") == "cross_out", low["label"])
    return out.select(*by, value.alias("value"), F.col("v.status").alias("status"), F.col("v.reason").alias("reason"), "margin")


def signature_state(components: Column, area: Column, spread_x: Column, spread_y: Column) -> Column:
    """absent, present or uncertain, by the ink's area and extent."""
    spread = F.greatest(spread_x, spread_y)
    return F.when((components == 0) | (area < C.INK_ABSENT), "absent").when((area >= C.INK_PRESENT) & (spread >= C.INK_SPREAD), "present").otherwise("uncertain")


def term_source(choice: Column, choice_status: Column, choice_reason: Column, range_raw: Column) -> Column:
    """struct(value, source, status, reason): the marked term, or the one that the written dates give."""
    derived = dates.term_of_range(range_raw)
    marked = (choice_status == "detected") & choice.isNotNull()
    clash = F.concat(F.lit("choice="), choice.cast("string"), F.lit(" vs rentang_tenor="), derived["value"].cast("string"), F.lit(" ("), derived["reason"], F.lit(")"))
    row = lambda value, source, status, reason: F.struct(value.alias("value"), F.lit(source).alias("source"), status.alias("status"), reason.alias("reason"))
    none = F.when((choice_status == "blank") & (F.coalesce(range_raw, F.lit("")) == ""), "blank").otherwise("review")
    return (
        F.when(marked & derived["value"].isNotNull() & (derived["value"] != choice), row(choice, "choice", F.lit("conflict"), clash))
        .when(marked, row(choice, "choice", F.lit("detected"), choice_reason))
        .when(derived["value"].isNotNull(), row(derived["value"], "rentang_tenor", F.lit("detected"), derived["reason"]))
        .otherwise(row(F.lit(None).cast("int"), "none", none, F.coalesce(X.or_null(choice_reason), derived["reason"])))
    )


def reward_source(choice: Column, choice_status: Column, choice_reason: Column, goods: Column, cash: Column) -> Column:
    """struct(value, source, status, reason): the marked kind of reward, or the one whose detail is filled in."""
    marked = (choice_status == "detected") & choice.isNotNull()
    row = lambda value, source, status, reason: F.struct(value.cast("string").alias("value"), F.lit(source).alias("source"), status.alias("status"), reason.alias("reason"))
    say = F.lit
    return (
        F.when(marked & (choice == "tunai") & goods & ~cash, row(choice, "choice", say("conflict"), say("choice=tunai tapi reward_non_tunai terisi & reward_tunai kosong")))
        .when(marked & (choice == "non_tunai") & cash & ~goods, row(choice, "choice", say("conflict"), say("choice=non_tunai tapi reward_tunai terisi & reward_non_tunai kosong")))
        .when(marked, row(choice, "choice", say("detected"), choice_reason))
        .when(goods & cash, row(say(None), "evidence", say("uncertain"), say("reward_non_tunai & reward_tunai sama-sama terisi, evidence bertentangan")))
        .when(goods, row(say("non_tunai"), "evidence_reward_non_tunai", say("detected"), say("choice ambigu, reward_non_tunai terisi (barang/deskripsi spesifik)")))
        .when(cash, row(say("tunai"), "evidence_reward_tunai", say("detected"), say("choice ambigu, reward_tunai terisi (nominal currency)")))
        .otherwise(row(say(None), "none", F.coalesce(X.or_null(choice_status), say("blank")), choice_reason))
    )


def reread_reason(status: Column, valid: Column, confidence: Column, section_method: Column) -> Column:
    """Why a text field is to be read anew; null if it is not."""
    return (
        F.when(status == "not_detected", "not_detected")
        .when((status == "review") & (valid == F.lit(False)), "invalid")
        .when((status == "review") & (F.coalesce(confidence, F.lit(0.0)) < C.LOW_CONFIDENCE), "low_confidence")
        .when(status == "review", "uncertain")
        .when((status == "read") & (section_method == "none"), "geometry_uncertain")
    )


def choice_reread_reason(status: Column) -> Column:
    return F.when(status.isin("review", "conflict"), status)


def signature_reread_reason(status: Column) -> Column:
    return F.when(status == "uncertain", "uncertain")


def page_note(reason: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in C.REASON_TEXT.items() for x in pair])
    return F.concat(F.coalesce(texts[reason], F.lit(C.REASON_TEXT["uncertain"])), F.lit(C.NOTE_PAGE))


def arbitrate(rows: DataFrame) -> DataFrame:
    """The final reading of each text field.

    rows: status, valid, confidence, value, section_method and, from the
    recognisers, page_value, page_status, roi_value, second_value,
    second_status and kind.  In turn: the page reader's value if it is read
    well; else the template crop's, unless the value counts as read by then;
    else the second reader's, which may also replace a read value whose
    section has no geometry.  A reader is asked only while a reason remains.
    """
    kind = F.col("kind")

    def read_well(value: Column) -> Column:
        bare = X.strip_label_bleed(value)
        norm = X.normalize_value(bare, kind)
        return F.coalesce((bare != "") & X.validate_value(norm, kind), F.lit(False))

    norm = lambda value: X.normalize_value(X.strip_label_bleed(value), kind)
    out = rows.withColumn("reason", reread_reason(F.col("status"), F.col("valid"), F.col("confidence"), F.col("section_method")))
    page = F.col("reason").isNotNull() & (F.col("page_status") == "readable") & read_well(F.col("page_value"))
    still = F.col("reason").isNotNull() & (~F.coalesce(page, F.lit(False)) | (F.col("section_method") == "none"))
    roi = still & ~F.coalesce(page, F.lit(False)) & (F.col("status") != "read") & read_well(F.col("roi_value"))
    settled = F.coalesce(page | roi, F.lit(False))
    second = F.col("reason").isNotNull() & (~settled | (F.col("section_method") == "none")) & (F.col("second_status") == "readable") & read_well(F.col("second_value"))
    source = F.when(second, "roi_second_pass_vlm").when(roi, "roi_template").when(page, "vlm_fullpage").otherwise("ocr_primary")
    value = F.when(second, norm(F.col("second_value"))).when(roi, norm(F.col("roi_value"))).when(page, norm(F.col("page_value"))).otherwise(F.col("value"))
    asked = F.col("reason").isNotNull() & (~settled | (F.col("section_method") == "none"))
    notes = F.when(second, C.NOTE_SECOND).when(asked, F.concat(F.lit(C.NOTE_SECOND), F.lit(" (masih perlu review manual)"))).when(roi, C.NOTE_TEMPLATE).when(page, page_note(F.col("reason"))).otherwise(C.NOTE_PRIMARY)
    return out.withColumns({"source": source, "final_value": value, "final_status": F.when(source == "ocr_primary", F.col("status")).otherwise("read"), "notes": notes})


def apply_choice_read(group: Column, value: Column, status: Column, start: Column, end: Column) -> Column:
    """What an independent read makes of a choice: the term named or else dated, or the kind of reward; null if nothing."""
    named = F.when(status == "readable", X.tenor_from_text(value))
    dated = F.when((F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != ""), dates.term_of_range(F.concat_ws(" - ", start, end))["value"])
    reward = F.when((status == "readable") & F.lower(value).contains("non"), "non_tunai").when((status == "readable") & F.lower(value).contains("tunai"), "tunai")
    return F.when(group == "tenor_penempatan", F.coalesce(named, dated).cast("string")).otherwise(reward)


def apply_signature_read(value: Column, status: Column) -> Column:
    """present, absent or null; words for absence are looked for first."""
    text = F.lower(value)
    return F.when((status != "readable") | (F.coalesce(value, F.lit("")) == ""), None).when(text.rlike("kosong|absent|tidak ada"), "absent").when(text.rlike("ada|present|tanda"), "present")


def reference_verdict(kind: Column, value: Column, status: Column, reference: Column, read_value: Column, read_status: Column) -> Column:
    """What an independent read says of a value that differs from the record: null (not asked or unreadable), confirmed or recognition_conflict.

    The comparison is exact, for names too.
    """
    doc, ref, again = (X.normalize_for_compare(c, kind) for c in (value, reference, read_value))
    target = (status == "read") & (doc != "") & (ref != "") & (doc != ref)
    usable = (read_status == "readable") & (F.coalesce(read_value, F.lit("")) != "")
    return F.when(target & usable & (again == doc), "confirmed").when(target & usable, "recognition_conflict")
