"""Vocabularies, thresholds and the layout of the form.

They must be as they are for right results.
"""

from __future__ import annotations

# Tokens that stand for a missing cell.
MISSING = ("", "none", "nan", "null", "n/a", "na", "-", "--")
# Names of an index column, in order of preference.
INDEX_COLUMNS = ("no", "no.", "nomor", "no urut", "index", "id", "record")
# The record's columns.
DECISION_COLUMN = "Status Verifikasi Form Pendaftaran Nasabah"
REGION_COLUMN = "Urban"
LINK_COLUMN = "Surat Pernyataan"
COMPARED = {
    "Nomor Rekening": "nomor_rekening",
    "Nama Nasabah": "nama_nasabah",
    "Nominal Penempatan": "nominal_penempatan",
    "Tenor Hold": "tenor_penempatan",
    "Pilihan Hadiah": "bentuk_reward",
}
RECORD_COLUMNS = ("Regional Office", "Nama Branch Office", *COMPARED, LINK_COLUMN, DECISION_COLUMN, REGION_COLUMN)
DATA_TYPES = {"nama_nasabah": "name", "nomor_rekening": "numeric", "nominal_penempatan": "currency", "tenor_penempatan": "tenor", "bentuk_reward": "choice"}
LABELS = {"nama_nasabah": "Nama Nasabah", "nomor_rekening": "Nomor Rekening", "nominal_penempatan": "Nominal Penempatan"}
# The order of the result table.
FIELD_ORDER = (
    "nama_nasabah", "nomor_rekening", "unit_kerja_pengelola_rekening", "nominal_penempatan", "tenor_penempatan", "rentang_tenor",
    "bentuk_reward", "reward_non_tunai", "reward_tunai", "signature_nasabah", "signature_atasan",
)
# Checks that decide, by region mode.
DECISIVE = {
    "urban": ("nama_nasabah", "nomor_rekening", "nominal_penempatan", "tenor_penempatan", "bentuk_reward"),
    "rural": ("nama_nasabah", "nomor_rekening", "nominal_penempatan", "signature_nasabah", "signature_atasan"),
}
RURAL_NOTES = {"tenor_penempatan": "Tenor Tidak Sesuai", "bentuk_reward": "Reward Tidak Sesuai"}
CHECK_ORDER = ("nama_nasabah", "nomor_rekening", "nominal_penempatan", "tenor_penempatan", "bentuk_reward", "signature_nasabah", "signature_atasan")
FALLBACK_SOURCES = ("vlm_fullpage", "roi_template", "roi_second_pass_vlm", "vlm_reference_check")
INCOMPLETE = ("blank", "not_detected", "out_of_frame")
UNCERTAIN = ("review", "conflict", "uncertain", "recognition_conflict")
READ_STATUSES = ("readable", "uncertain", "not_visible")
FAILURE_STAGES = ("INPUT", "ALIGNMENT", "LOCALIZATION", "OCR", "VISUAL_CHOICE", "NORMALIZATION", "INTERNAL_VALIDATION", "SIGNATURE", "COMPARISON", "DECISION")
ROI_STATUSES = ("PASS", "TOO_NARROW", "TOO_WIDE", "WRONG_LOCATION", "CUT_OFF", "LABEL_BLEED")
# Ends of printed labels.
LABEL_ENDS = ("nasabah", "rekening", "penempatan", "reward", "surat")
# Month names.
MONTHS = ("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember")
# Thresholds.
NAME_SIMILARITY = 80.0
REVIEW_CONFIDENCE, LOW_CONFIDENCE = 0.60, 0.45
MARK_CHANGE, MARK_GAP = 0.010, 0.004
INK_ABSENT, INK_PRESENT, INK_SPREAD, INK_PIXELS = 0.004, 0.012, 0.15, 12
TENORS, TENOR_TOLERANCE = (1, 3, 6), 1
COVERAGE_MIN, SHEAR_MAX, PAPER_MIN = 0.85, 3.0, 0.35
ROTATION_MAX, SCALE_RANGE = 8.0, (0.85, 1.15)
ROI_NARROW, ROI_WIDE = 0.6, 1.6
BATCH_GAP, BAND_GAP = 10, 3
# Why a value was read anew.
REASON_TEXT = {
    "not_detected": "OCR primary failed",
    "invalid": "OCR primary invalid",
    "low_confidence": "OCR primary low-confidence",
    "uncertain": "OCR primary uncertain",
    "review": "OCR primary uncertain",
    "geometry_uncertain": "OCR primary geometry-uncertain",
    "conflict": "OCR primary evidence conflicting",
}
NOTE_PRIMARY = "OCR primary used (confident, no fallback needed)"
NOTE_PAGE = " → Full-Page VLM fallback used"
NOTE_TEMPLATE = "Full-Page VLM uncertain → ROI template fallback used"
NOTE_SECOND = "ROI template → second-pass VLM used"
# Error patterns and what a user is told, first match.
ERROR_HINTS = (
    ("(?i)pdf tidak memiliki halaman", "Dokumen PDF kosong (tidak memiliki halaman)."),
    ("(?i)gagal membaca file|imread|cannot identify image", "Berkas dokumen tidak dapat dibaca (format tidak didukung/file rusak)."),
    ("(?i)memoryerror|out of memory", "Server kehabisan memori saat memproses dokumen."),
    ("(?i)permission|access is denied|errno 13", "Server tidak memiliki izin mengakses berkas."),
    ("(?i)no such file|errno 2|filenotfound", "Berkas dokumen tidak ditemukan di server."),
    ("(?i)timeout|timed out", "Proses memakan waktu terlalu lama (timeout)."),
    ("(?i)connection|network|resolve|urlopen|http error|ssl", "Gagal mengunduh dokumen (masalah koneksi/link)."),
    ("(?i)homography|findhomography", "Gagal menyelaraskan dokumen dengan template (kualitas scan/foto kurang baik)."),
    ("(?i)paddle|ocr", "Mesin OCR gagal membaca dokumen."),
)
# The form's boxes as fractions of the page (x1, y1, x2, y2): label anchor, value, type, region, printed label.
FIELDS = {
    "nama_nasabah": ((0.1208, 0.1369, 0.2102, 0.1464), (0.3691, 0.1354, 0.9396, 0.1478), "text", "identity_area", "nama nasabah"),
    "nomor_rekening": ((0.1208, 0.1484, 0.2188, 0.1579), (0.3691, 0.1478, 0.9396, 0.1585), "numeric", "identity_area", "nomor rekening"),
    "unit_kerja_pengelola_rekening": ((0.1208, 0.1598, 0.2982, 0.1693), (0.3691, 0.1585, 0.9396, 0.1704), "text", "identity_area", "unit kerja"),
    "nominal_penempatan": ((0.1208, 0.2457, 0.2465, 0.2552), (0.3691, 0.2441, 0.8893, 0.2568), "currency", "placement_area", "nominal penempatan"),
    "rentang_tenor": ((0.1208, 0.2571, 0.2315, 0.2666), (0.3520, 0.2673, 0.7718, 0.2798), "text", "placement_area", "tenor penempatan"),
    "reward_non_tunai": ((0.3708, 0.2915, 0.6142, 0.3010), (0.6184, 0.2900, 0.9200, 0.3025), "optional_text", "placement_area", "non tunai"),
    "reward_tunai": ((0.1208, 0.3145, 0.2998, 0.3240), (0.3691, 0.3130, 0.7718, 0.3246), "currency", "placement_area", "bentuk reward"),
    "tempat_tanggal_surat": ((0.1208, 0.7437, 0.2459, 0.7532), (0.1510, 0.7756, 0.5201, 0.7900), "text", None, None),
}
OPTIONS = {
    "tenor_opsi_1": ("tenor_penempatan", "1", (0.3650, 0.2540, 0.3840, 0.2700)),
    "tenor_opsi_3": ("tenor_penempatan", "3", (0.3860, 0.2540, 0.4060, 0.2700)),
    "tenor_opsi_6": ("tenor_penempatan", "6", (0.4060, 0.2540, 0.4270, 0.2700)),
    "pilihan_reward_tunai": ("bentuk_reward", "tunai", (0.3650, 0.2770, 0.4070, 0.2925)),
    "pilihan_reward_non_tunai": ("bentuk_reward", "non_tunai", (0.4070, 0.2770, 0.4790, 0.2925)),
}
SIGNATURES = {
    "signature_nasabah": ((0.2260, 0.7886, 0.4234, 0.7981), (0.1678, 0.7981, 0.4530, 0.8622)),
    "signature_atasan": ((0.6720, 0.7886, 0.7449, 0.7981), (0.5872, 0.7981, 0.8305, 0.8622)),
}

# The longer side of pages that are matched, the head's share of a page, and how far a field's search window
# reaches beyond its box, as shares of the region's width and height.
MATCH_SIDE, HEAD_SHARE = 1800, 0.10
SEARCH_X, SEARCH_Y = 0.025, 0.02
CLAMPED_REGION = "identity_area"
#: The members of a result that may hold a field's value, the first that is not empty counts.
VALUE_KEYS = ("ocr_result", "normalized_value", "value", "text", "label", "final_value")
# The limit and the tiles of the local contrast.
CONTRAST_CLIP, CONTRAST_TILES = 1.3, 8
