"""Golden-set accuracy, gates and funnel, error rates, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheetwright import constants as C
from sheetwright.functions import text as X

COMPARED_FIELDS = tuple(C.DATA_TYPES)


def rate(part: Column, whole: Column, digits: int = 4, scale: int = 1) -> Column:
    """part / whole, rounded; null if there is nothing to divide by."""
    return F.round(F.try_divide(part * scale, whole), digits)


def evaluation_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row of measures over evaluation rows; all in one pass.

    Missing outcomes are null.  A field's accuracy leaves out rows without a
    truth; the all-fields measures count them as failures, as they come in.
    """
    n = F.count("*")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    col = F.col
    loaded, done = count(col("load_success")), count(col("pipeline_success"))
    attempted = count(col("alignment_status").isNotNull())
    outs = [
        n.alias("documents_total"),
        done.alias("documents_processed"),
        rate(loaded, n).alias("load_success_rate"),
        rate(count(col("alignment_status").isin("ok", "warning")), attempted).alias("alignment_success_rate"),
        count(col("failure_stage") == "ALIGNMENT").alias("alignment_failed_count"),
        count(col("alignment_method") == "homography").alias("alignment_homography_escalation_count"),
        rate(count(col("region_status") == "ok"), loaded).alias("semantic_region_success_rate"),
        rate(done, n).alias("pipeline_success_rate"),
        rate(count(col("all_5_fields_match")), F.count("all_5_fields_match")).alias("all_5_fields_exact_accuracy"),
        rate(count(col("all_7_checks_match")), F.count("all_7_checks_match")).alias("all_7_checks_exact_accuracy"),
        count(col("tenor_choice").isNotNull() & col("tenor_derived").isNotNull()).alias("tenor_both_evidence_read_count"),
        rate(count(col("tenor_consistent")), done).alias("tenor_internal_consistency_rate"),
        count(col("reward_choice").isNotNull() & (col("goods_filled") | col("cash_filled"))).alias("reward_both_evidence_read_count"),
        rate(count(col("reward_consistent")), done).alias("reward_internal_consistency_rate"),
        F.count("truth").alias("decision_ground_truth_available"),
        rate(count(col("decision") == col("truth")), F.count("truth")).alias("decision_accuracy"),
        rate(count((col("truth") == "TOLAK") & (col("decision") == "OK")), count(col("truth") == "TOLAK")).alias("false_accept_rate"),
        rate(count((col("truth") == "OK") & (col("decision") == "TOLAK")), count(col("truth") == "OK")).alias("false_reject_rate"),
        rate(count(col("decision") == "REVIEW"), done).alias("review_rate"),
        F.round(F.avg("seconds"), 2).alias("average_processing_time_sec"),
        *[count(col("failure_stage") == s).alias(f"failed_{s}") for s in C.FAILURE_STAGES],
    ]
    for f in COMPARED_FIELDS:
        hit, seen = count(col(f"{f}_comparison") == "MATCH"), count(col(f"{f}_comparison").isin("MATCH", "MISMATCH"))
        outs += [seen.alias(f"{f}_measurable"), hit.alias(f"{f}_match"), rate(hit, seen).alias(f"{f}_accuracy")]
    return rows.groupBy(*(by or [])).agg(*outs)


def signature_distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signature"), F.col(c).alias("state")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("signature").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("present", "absent", "uncertain")])


def gate_reasons(ratio: Column, rotation: Column, scale_x: Column, scale_y: Column, shear: Column, method: Column, coverage: dict[str, Column]) -> Column:
    """Rules that a page breaks, in order; the signature area's is for information."""
    low, high = C.SCALE_RANGE
    outside = lambda s: ~s.between(low, high)
    say = F.format_string
    rules = [
        F.when(ratio < C.PAPER_MIN, say(f"excessive_background: paper_area_ratio=%.2f (<{C.PAPER_MIN})", ratio)),
        F.when(F.abs(rotation) > C.ROTATION_MAX, say(f"orientation_out_of_tolerance: rotation=%.2fdeg (max {C.ROTATION_MAX})", rotation)),
        F.when(outside(scale_x), say(f"scale_x_out_of_tolerance: %.3f (range {low}-{high})", scale_x)),
        F.when(outside(scale_y), say(f"scale_y_out_of_tolerance: %.3f (range {low}-{high})", scale_y)),
        F.when((method == "homography") & (F.abs(shear) > C.SHEAR_MAX), say(f"alignment_added_shear: shear=%.2fdeg (method=homography, max {C.SHEAR_MAX})", shear)),
    ]
    for region, share in coverage.items():
        text = f"form_cropped: {region} coverage=%.2f (<{C.COVERAGE_MIN})" if region != "signature_area" else "signature_area_cropped_informational: coverage=%.2f"
        rules.append(F.when(share < C.COVERAGE_MIN, say(text, share)))
    return F.array_compact(F.array(*rules))


def gate_status(reasons: Column) -> Column:
    return F.when(F.exists(reasons, lambda r: ~r.contains("_informational")), "FAIL").otherwise("PASS")


def text_roi(status: Column, raw: Column, truth: Column, optional: Column) -> Column:
    """How a text field's box did, the surest finding first."""
    text, gold = F.coalesce(raw, F.lit("")), X.strip(F.coalesce(truth, F.lit("")))
    share = F.length(text) / F.greatest(F.lit(1), F.length(gold))
    both = (gold != "") & (text != "")
    return (
        F.when(status == "out_of_frame", "CUT_OFF")
        .when((gold != "") & ~optional & status.isin("not_detected", "blank"), "WRONG_LOCATION")
        .when(X.looks_like_label_bleed(text), "LABEL_BLEED")
        .when(both & (share < C.ROI_NARROW), "TOO_NARROW")
        .when(both & (share > C.ROI_WIDE), "TOO_WIDE")
        .otherwise("PASS")
    )


def choice_roi(options: DataFrame, by: list[str]) -> DataFrame:
    status = F.when(F.bool_or(F.col("status") == "out_of_frame"), "CUT_OFF").when(F.bool_or(F.col("roi_source") == "fallback"), "WRONG_LOCATION").otherwise("PASS")
    return options.groupBy(*by).agg(status.alias("roi_status"))


def bottleneck(gate: Column, roi: Column, ocr: Column) -> Column:
    """The first gate that fails."""
    return F.when(gate != "PASS", "PREPROCESSING").when(roi != "PASS", "ROI").when(ocr == F.lit(False), "OCR").otherwise("PASS")


def funnel(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and percentages of documents through the gates (gate, roi, stage)."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n, gate, roi = F.count("*"), F.col("gate") == "PASS", F.col("roi") == "PASS"
    passed, placed, read = count(gate), count(gate & roi), count(gate & roi & (F.col("stage") == "PASS"))
    failed = count(F.col("gate") == "FAIL")
    return rows.groupBy(*(by or [])).agg(
        n.alias("total_input"), passed.alias("preprocessing_pass"), failed.alias("preprocessing_fail"), rate(failed, n, 2, 100).alias("preprocessing_error_pct"),
        placed.alias("roi_pass"), (passed - placed).alias("roi_fail"), rate(passed - placed, passed, 2, 100).alias("roi_error_pct"),
        read.alias("ocr_pass"), (placed - read).alias("ocr_fail"), rate(placed - read, placed, 2, 100).alias("ocr_error_pct"),
    )


def capture_and_accuracy(rows: DataFrame) -> DataFrame:
    """By field: share of boxes that did well, and accuracy among those alone (field, gate, roi, comparison)."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    gate, roi = F.col("gate") == "PASS", F.col("roi") == "PASS"
    placed, seen, hit = count(gate & roi), count(roi & F.col("comparison").isin("MATCH", "MISMATCH")), count(roi & (F.col("comparison") == "MATCH"))
    return rows.groupBy("field").agg(rate(placed, count(gate)).alias("field_capture_rate"), placed.alias("roi_pass_count"), rate(hit, seen).alias("pure_ocr_accuracy"), seen.alias("pure_ocr_measurable"))


def roi_matrix(rows: DataFrame, fields: tuple[str, ...] = COMPARED_FIELDS) -> DataFrame:
    """Counts of each status (rows) for each field (columns)."""
    return rows.groupBy("roi").pivot("field", list(fields)).count().na.fill(0)


def flatten(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """(dotted name, column as a string) of each leaf of a struct; lists are joined."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        column = F.col(".".join(f"`{p}`" for p in path.split(".")))
        if isinstance(f.dataType, T.StructType):
            out += flatten(f.dataType, path)
        elif isinstance(f.dataType, T.ArrayType):
            out.append((path, F.array_join(column.cast("array<string>"), ", ")))
        else:
            out.append((path, column.cast("string")))
    return out


def metrics_of(summary: DataFrame, *keys: str) -> DataFrame:
    """metric, ord, value: a summary's nested columns as rows, nulls kept; ``keys`` stay beside them."""
    leaves = [(n, c) for n, c in flatten(summary.schema) if n not in keys]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(i).alias("ord"), c.alias("value")) for i, (n, c) in enumerate(leaves)])
    return summary.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.*")


def run_label(label: Column, module: Column, path: Column) -> Column:
    """A run's name: its label, with the module unless it is the usual one, else its file's stem."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(.)\.[^.]*$", "$1")
    named = F.coalesce(label, F.lit("")) != ""
    other = (F.coalesce(module, F.lit("")) != "") & (module != "pipeline")
    return F.when(named & other, F.concat(label, F.lit(" ("), module, F.lit(")"))).when(named, label).otherwise(stem)


def summary_kind(columns: list[str]) -> str:
    return "stage_evaluation" if "funnel" in columns else "evaluation" if "decision_accuracy" in columns else "unknown"


def compare_runs(metrics: DataFrame, baseline: str) -> DataFrame:
    """metric, run, value, delta against the baseline run, from (run, metric, ord, value).

    Rows, not columns, for each run: no list of runs is needed beforehand, and
    the baseline is taken by a window over a metric's few runs.
    """
    number = F.col("value").try_cast("double")
    once = metrics.where(~F.col("metric").isin("run_label", "pipeline_module", "vlm_fallback_enabled")).groupBy("metric", "run").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    w = Window.partitionBy("metric")
    base = F.max(F.when(F.col("run") == baseline, number)).over(w)
    first = F.min("ord").over(w)
    return once.withColumns({"_base": base, "_number": number, "position": first}).select("metric", "run", "value", X.format_delta(F.col("_base"), F.col("_number")).alias("delta"), "position")


def extracted_value(result: Column) -> Column:
    """The value of a field's result (a map of strings): the first of VALUE_KEYS that is not empty."""
    return F.coalesce(*[F.when(result[k] != "", result[k]) for k in C.VALUE_KEYS])


def with_blank_rows(records: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """A row for every record: its results, or nulls where its run gave none (a sink writes them as N/A)."""
    joined = records.join(results.withColumn("evaluated", F.lit(True)), key, "left")
    return joined.withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))


def all_columns(*frames: DataFrame) -> DataFrame:
    """The rows of all frames with the union of their columns, in the order in which they first come."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
