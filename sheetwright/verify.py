"""The whole flow: fields and records in, decisions out, all documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright import constants as C
from sheetwright.functions import dates, text as X
from sheetwright.operators import layout, reconcile


def field_rows(tokens: DataFrame, key: str = "Record") -> DataFrame:
    """Typed field rows from recognised texts (key, field, text, confidence, out_of_frame); every field of a document has a row."""
    from sheetwright.operators.resolve import text_field

    kinds = F.create_map(*[F.lit(x) for n, v in C.FIELDS.items() for x in (n, v[2])])
    docs = tokens.select(key).distinct().select(key, F.explode(F.array(*[F.lit(n) for n in C.FIELDS])).alias("field"))
    rows = docs.join(tokens, [key, "field"], "left").withColumn("kind", kinds[F.col("field")])
    terms = X.strip_terms(F.col("text"), ("rp",))
    cleaned = F.when(F.col("kind") == "currency", terms).otherwise(F.coalesce("text", F.lit("")))
    out = rows.withColumn("r", text_field(cleaned, F.col("confidence"), F.col("kind"), F.col("text").isNotNull()))
    gone = F.coalesce("out_of_frame", F.lit(False))
    here = lambda c: F.when(~gone, F.col(c))
    return out.select(key, "field", "kind", here("r.value").alias("value"), here("r.raw").alias("raw"), here("r.confidence").alias("confidence"), F.when(gone, "out_of_frame").otherwise(F.col("r.status")).alias("status"), here("r.valid").alias("valid"), F.coalesce("source", F.lit("ocr_primary")).alias("source") if "source" in tokens.columns else F.lit("ocr_primary").alias("source"))


def all_checks(fields: DataFrame, groups: DataFrame, signatures: DataFrame, records: DataFrame, key: str = "Record", collapse_evidence: bool = True) -> DataFrame:
    """key, mode, check, status, reason: the seven checks of every record.

    ``groups`` has (key, grp, value, status) of the marked choices and
    ``signatures`` (key, name, status).  With ``collapse_evidence`` a term that
    only the dates give stands for the mark too, as the service does; without
    it the mark itself must be read, as its rules are written.
    """
    by = {f: F.max(F.when(F.col("field") == f, F.struct("value", "raw", "status"))).alias(f) for f in C.FIELDS}
    wide = fields.groupBy(key).agg(*by.values())
    marks = groups.groupBy(key).agg(*[F.max(F.when(F.col("grp") == g, F.struct("value", "status"))).alias(f"g_{g}") for g in ("tenor_penempatan", "bentuk_reward")])
    inks = signatures.groupBy(key).agg(*[F.max(F.when(F.col("name") == s, F.col("status"))).alias(f"s_{s}") for s in C.SIGNATURES])
    mode = X.region_mode(F.col(f"`{C.REGION_COLUMN}`") if C.REGION_COLUMN in records.columns else F.lit(None).cast("string")).alias("mode")
    entry = {f: (F.col(f"`{c}`") if c in records.columns else F.lit(None).cast("string")).alias(f"e_{f}") for c, f in C.COMPARED.items()}
    docs = records.select(key, mode, *entry.values()).join(wide, key, "left").join(marks, key, "left").join(inks, key, "left")

    simple = F.array(*[F.struct(F.lit(f).alias("check"), F.col(f"{f}.value").alias("value"), F.col(f"e_{f}").alias("reference"), F.lit(C.DATA_TYPES[f]).alias("kind"), F.lit(C.LABELS[f]).alias("label"), F.col(f"{f}.status").alias("doc_status")) for f in C.LABELS])
    first = reconcile.simple_check(docs.select(key, "mode", F.explode(simple).alias("c")).select(key, "mode", "c.*")).select(key, "mode", "check", "verdict.*")

    derived = dates.term_of_range(F.col("rentang_tenor.raw"))
    term = F.col("g_tenor_penempatan.value").try_cast("int")
    state = F.col("g_tenor_penempatan.status")
    marked = (state == "detected") & term.isNotNull()
    if collapse_evidence:
        clash = marked & derived["value"].isNotNull() & (derived["value"] != term)
        only_dates = ~F.coalesce(marked, F.lit(False)) & derived["value"].isNotNull()
        term, state = F.when(only_dates, derived["value"]).otherwise(term), F.when(only_dates, "detected").when(clash, "conflict").otherwise(state)
    goods, cash = (F.coalesce(F.col(f"{f}.value"), F.lit("")) != "" for f in ("reward_non_tunai", "reward_tunai"))
    kind, kind_state = F.col("g_bentuk_reward.value"), F.col("g_bentuk_reward.status")
    if collapse_evidence:
        decided = (kind_state == "detected") & kind.isNotNull()
        clash = decided & (((kind == "tunai") & goods & ~cash) | ((kind == "non_tunai") & cash & ~goods))
        lone = ~F.coalesce(decided, F.lit(False)) & (goods != cash)
        kind_state = F.when(clash, "conflict").when(lone, "detected").when(~F.coalesce(decided, F.lit(False)) & goods & cash, "uncertain").otherwise(kind_state)
        kind = F.when(lone, F.when(goods, "non_tunai").otherwise("tunai")).otherwise(kind)
    others = {
        "tenor_penempatan": reconcile.term_check(term, state, derived["value"], derived["reason"], F.col("e_tenor_penempatan")),
        "bentuk_reward": reconcile.reward_check(kind, kind_state, goods, cash, F.col("e_bentuk_reward")),
        **{s: reconcile.signature_check(s, F.col(f"s_{s}")) for s in C.SIGNATURES},
    }
    rest = docs.select(key, "mode", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("v")) for n, v in others.items()])).alias("c")).select(key, "mode", "c.check", "c.v.*")
    return first.unionByName(rest)


def verify(spark: SparkSession, fields: DataFrame, groups: DataFrame, signatures: DataFrame, records: DataFrame, key: str = "Record", collapse_evidence: bool = True) -> DataFrame:
    """key, mode, decision, reasons, notes, final_status and export text of every record.

    A record without a document has no field rows: it is reviewed or rejected
    for what is missing, and ``export`` says it was not processed.
    """
    checks = all_checks(fields, groups, signatures, records, key, collapse_evidence)
    decided = reconcile.decide(checks, layout.checks(spark), key)
    rows = fields.withColumn("reason", F.lit(None).cast("string")).withColumnRenamed("value", "ocr_result")
    attached = reconcile.attach_entries(rows.drop("kind"), records, key)
    notes = reconcile.rural_notes(checks, reconcile.diagnostic_notes(attached, key), key)
    out = decided.join(reconcile.final_status(attached, key), key, "left").join(notes, key, "left")
    seen = F.col("final_status").isNotNull()
    return out.select(key, "mode", "decision", "reasons", "notes", "final_status", reconcile.export_text(F.when(seen, F.col("decision")), F.col("reasons")).alias("export"))
