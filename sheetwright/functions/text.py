"""Text cleaning, normalisation by type, validation and status rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwright import constants as C

#: Widest decimal; longer digit strings become null.
BIG = "decimal(38,0)"


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_value(cell: Column) -> Column:
    """A cell without outer space; null if it stands for a missing one."""
    text = strip(cell)
    return F.when(~F.lower(text).isin(*C.MISSING), text)


def to_int(text: Column, fallback: Column) -> Column:
    """The integer part of a number in text, or the fallback."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), fallback)


def drive_file_id(url: Column) -> Column:
    """The file id of a share link: a path part first, else a query field."""
    part = lambda pattern: or_null(F.regexp_extract(url, pattern, 1))
    return F.coalesce(part("/d/([a-zA-Z0-9_-]+)"), part("[?&]id=([a-zA-Z0-9_-]+)"))


def strip_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """Without the given words, whatever their case."""
    out = F.coalesce(text, F.lit(""))
    for term in terms:
        out = F.regexp_replace(out, "(?i)" + "".join(c if c.isalnum() else "\\" + c for c in term), " ")
    return collapse(out)


def _is_label_end(word: Column) -> Column:
    ends = F.array(*[F.lit(x) for x in C.LABEL_ENDS])
    return (F.length(word) >= 5) & F.exists(ends, lambda label: label.endswith(word))


def _first_word(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(text, " ", 1), "^[.,]+|[.,]+$", ""))


def strip_label_bleed(text: Column) -> Column:
    """Without a printed label's remains: what follows the last colon, or all but a first word that ends a known label."""
    plain = strip(text)
    rest = F.when(F.instr(plain, " ") > 0, F.regexp_replace(plain, "^[^ ]* ", "")).otherwise("")
    return F.when(F.contains(text, F.lit(":")), strip(F.substring_index(text, ":", -1))).when(_is_label_end(_first_word(plain)), strip(rest)).otherwise(plain)


def looks_like_label_bleed(text: Column) -> Column:
    """Whether a label's remains are left."""
    return F.coalesce(F.contains(text, F.lit(":")) | _is_label_end(_first_word(strip(text))), F.lit(False))


def normalize_text(text: Column) -> Column:
    return or_null(collapse(text))


def normalize_numeric(text: Column) -> Column:
    """Digits, with letters that are misread digits put right."""
    return or_null(F.regexp_replace(F.translate(text, "OoIlSB", "001158"), r"(?U)\D", ""))


def normalize_currency(text: Column) -> Column:
    """The amount before any bracket, as a whole number; separators are dropped with the decimals kept as digits."""
    amount = F.substring_index(F.regexp_replace(text, r"(?i)rp\.?", ""), "(", 1)
    return normalize_numeric(amount).try_cast(BIG)


def normalize_value(text: Column, kind: Column) -> Column:
    """The normal form, as a string, by field type."""
    return F.when(kind == "numeric", normalize_numeric(text)).when(kind == "currency", normalize_currency(text).cast("string")).otherwise(normalize_text(text))


def validate_value(value: Column, kind: Column) -> Column:
    """Whether a normal form is one of its type; null is not."""
    amount = value.try_cast(BIG)
    ok = F.when(kind == "numeric", value.rlike(r"^\d{4,30}$")).when(kind == "currency", (amount > 0) & (amount < F.lit(10**18).cast(BIG))).otherwise(F.length(value) >= 2)
    return F.coalesce(ok, F.lit(False))


def field_status(raw: Column, valid: Column, confidence: Column, kind: Column) -> Column:
    """blank or not_detected without text, review if invalid or unsure, else read."""
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.when(kind == "optional_text", "blank").otherwise("not_detected"))
        .when(~valid, "review")
        .when(confidence < C.REVIEW_CONFIDENCE, "review")
        .otherwise("read")
    )


def normalize_for_compare(value: Column, kind: Column) -> Column:
    """The form in which a document's and a record's value are compared; empty for missing."""
    text = F.coalesce(strip(value), F.lit(""))
    digits = F.regexp_replace(text, r"(?U)\D", "")
    money = F.regexp_replace(F.substring_index(F.regexp_replace(text, r"(?i)rp\.?", ""), "(", 1), r"(?U)\D", "")
    money = F.when(money.rlike("^0+$"), "0").otherwise(F.regexp_replace(money, "^0+", ""))
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    choice = F.when(letters.isin("nontunai", "barang", "nonkas", "noncash"), "nontunai").when(letters.isin("tunai", "cash", "cashback", "kas"), "tunai").otherwise(letters)
    name = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.when(kind.isin("numeric", "tenor"), digits).when(kind == "currency", money).when(kind == "choice", choice).otherwise(name)


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def fuzzy_contains(token: Column, label: Column) -> Column:
    """Whether a token is part of a label, or holds the label's start (all but two letters, four at least)."""
    t, n = letters_only(token), letters_only(label)
    start = F.substring(n, F.lit(1), F.greatest(F.lit(4), F.length(n) - 2))
    return F.coalesce((t != "") & (n != "") & (F.contains(n, t) | F.contains(t, start)), F.lit(False))


def label_remainder(token: Column, label: str) -> Column:
    """What follows a label in a token; null if nothing does or the label is not there."""
    pattern = r"(?is)" + r"\s*".join(label.split()) + "[ :.–—-]*(.*)$"
    return or_null(strip(F.regexp_extract(token, pattern, 1)))


def sanitize_error(message: Column, code: Column) -> Column:
    """A message without paths: the first hint that fits, or the text cut to 140 characters."""
    path = r"""[A-Za-z]:[\\/][^\s"']*|(?<![\w.])/[^\s"']*|\\\\[^\s"']*"""
    text = F.regexp_replace(F.coalesce(message, F.lit("")), path, "<berkas>")
    tail = F.concat(F.lit(" ["), code, F.lit("]"))
    out = None
    for pattern, hint in C.ERROR_HINTS:
        out = (F if out is None else out).when(text.rlike(pattern), F.concat(F.lit(hint), tail))
    short = collapse(text)
    short = F.when(F.length(short) > 140, F.concat(F.substring(short, 1, 140), F.lit("…"))).otherwise(short)
    return out.otherwise(F.concat(F.lit("Gagal memproses dokumen"), tail, F.when(short != "", F.concat(F.lit(": "), short)).otherwise("")))


def failure_stage(message: Column) -> Column:
    """The stage that an error text points to; OCR by default."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: text.rlike("|".join(words))
    return F.when(has("ocr"), "OCR").when(has("choice", "pilihan"), "VISUAL_CHOICE").when(has("signature", "tanda tangan"), "SIGNATURE").when(has("normal"), "NORMALIZATION").when(has("anchor", "roi", "localiz"), "LOCALIZATION").otherwise("OCR")


def ground_truth_decision(status: Column) -> Column:
    text = F.lower(strip(status))
    return F.when(text.startswith("ok"), "OK").when(text.startswith("tolak"), "TOLAK")


def region_mode(value: Column) -> Column:
    return F.when(F.lower(strip(value)) == "urban", "urban").otherwise("rural")


def compare_field(field: Column, extracted: Column, truth: Column) -> Column:
    """MATCH, MISMATCH or N/A under the evaluation's own normal forms."""

    def form(value: Column) -> Column:
        text = F.coalesce(value, F.lit(""))
        digits = or_null(F.regexp_replace(text, "[^0-9]", ""))
        # Rewards fall in two buckets by a substring, so non_tunai counts as tunai here.
        reward = F.when(strip(text) == "", None).when(F.lower(text).rlike("cash|tunai"), "tunai").otherwise("non_tunai")
        return (
            F.when(field == "nama_nasabah", or_null(F.upper(collapse(text))))
            .when(field == "nomor_rekening", digits)
            .when(field == "nominal_penempatan", digits.try_cast(BIG).cast("string"))
            .when(field == "tenor_penempatan", or_null(F.regexp_extract(text, r"(\d+)", 1)).try_cast(BIG).cast("string"))
            .when(field == "bentuk_reward", reward)
            .otherwise(or_null(text))
        )

    a, b = form(extracted), form(truth)
    return F.when(a.isNull() | b.isNull(), "N/A").when(a == b, "MATCH").otherwise("MISMATCH")


def character_error_rate(hypothesis: Column, reference: Column) -> Column:
    h, r = F.coalesce(hypothesis, F.lit("")), F.coalesce(reference, F.lit(""))
    return F.when(r == "", None).when(h == "", 1.0).otherwise(F.levenshtein(h, r) / F.length(r))


def format_value(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.4f", value)).otherwise("")


def format_delta(base: Column, other: Column) -> Column:
    """Signed difference with four decimals, = for none, empty unless both are numbers."""
    d = other - base
    return F.when(d.isNull(), "").when(F.abs(d) < 1e-9, "=").otherwise(F.format_string("%+.4f", d))


def json_object(text: Column) -> Column:
    """The JSON object in a reply, as a string: without a code fence, else from the first to the last brace, else without trailing commas; null if none parses."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    loose = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    parsed = lambda t: F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.to_json(F.try_parse_json(t)))
    return F.coalesce(parsed(bare), parsed(inner), parsed(loose))


def read_status(value: Column, status: Column) -> Column:
    """The status of an independent read: as given if known, else by whether there is a value."""
    return F.when(status.isin(*C.READ_STATUSES), status).when(F.coalesce(value, F.lit("")) != "", "readable").otherwise("not_visible")


def tenor_from_text(text: Column) -> Column:
    return or_null(F.regexp_extract(F.lower(text), r"([136])\s*bulan", 1)).try_cast("int")
