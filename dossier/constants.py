"""Word lists, code tables, formats and limits that results depend on."""

from __future__ import annotations

# Document types and their abbreviations; the last one is the fallback.
DOC_TYPES = [
    ("nghi_quyet", "NQ"),
    ("quyet_dinh", "QĐ"),
    ("chi_thi", "CT"),
    ("quy_che", "QC"),
    ("quy_dinh", "QYĐ"),
    ("thong_cao", "TC"),
    ("thong_bao", "TB"),
    ("huong_dan", "HD"),
    ("chuong_trinh", "CTr"),
    ("ke_hoach", "KH"),
    ("phuong_an", "PA"),
    ("de_an", "ĐA"),
    ("du_an", "DA"),
    ("bao_cao", "BC"),
    ("bien_ban", "BB"),
    ("to_trinh", "TTr"),
    ("hop_dong", "HĐ"),
    ("cong_van", "CV"),
    ("cong_dien", "CĐ"),
    ("ban_ghi_nho", "BGN"),
    ("ban_thoa_thuan", "BTT"),
    ("giay_uy_quyen", "GUQ"),
    ("giay_moi", "GM"),
    ("giay_gioi_thieu", "GGT"),
    ("giay_nghi_phep", "GNP"),
    ("phieu_gui", "PG"),
    ("phieu_chuyen", "PC"),
    ("phieu_bao", "PB"),
    ("thu_cong", "TC2"),
    ("khac", ""),
]
FALLBACK_TYPE = "khac"

# Subject fields and roles.
FIELD_VALUES = ("khoa_hoc", "cong_nghe", "dmst", "cds", "tdđlcl", "bcvt")
ROLE_VALUES = ("giao_nhiem_vu", "thuc_hien_nhiem_vu")
FALLBACK_ROLE = "khac"

# Directions.
OUTGOING = "out"
INCOMING = "in"

# Name fragments that exclude a PDF, and the one that marks the signed copy.
OUTGOING_EXCLUDED = ("can_cu", "cancu", "thamkhao")
INCOMING_EXCLUDED = ("phieu_gui", "phieu_chuyen", "ticket", "luanchuyen")
SIGNED_MARK = "signed"

# File kinds by extension.
PDF_EXTENSIONS = ("pdf",)
SHEET_EXTENSIONS = ("xls", "xlsx", "csv")
WORD_EXTENSIONS = ("doc", "docx")

# Chunking.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\nĐiều ", "\nKhoản ", "\n\n", "\n", ". ", " ")

# Text selection and excerpts.
MIN_NATIVE_TEXT = 50
HEAD_CHARS = 3000
TAIL_CHARS = 1500
PROBE_CHARS = 600
PASSAGE_CHARS = 500
CITATION_CHARS = 160

# Retrieval.
SEARCH_POOL, SEARCH_TOP = 24, 8
NARROW_POOL, NARROW_TOP = 60, 40
CHECK_POOL, CHECK_TOP = 20, 6
NARROW_ABOVE = 15
FUZZY_THRESHOLD, FUZZY_TOP = 0.4, 3
LISTING_SIZE = 100
TAG_LIST_SIZE = 10
READ_LIMIT = 500
TOPIC_LIMIT = 8
RRF_CONSTANT = 60
BM25_K1, BM25_B = 1.2, 0.75

# Output texts and formats.
PASSAGE_FORMAT = "\n[Đoạn %d | %s - %s] %s\n"
DRAFT_PASSAGE_FORMAT = "[%s] %s"
NOT_FOUND_TEXT = "Không tìm thấy thông tin trong kho dữ liệu."
MISSING_MARK = "?"
SHEET_HEADER_FORMAT = "--- Sheet: %s ---"

# Citation patterns. The first code pattern lets a code run past a second slash;
# the narrow one stops there.
CITATION_SPAN = "Căn cứ[^;\\n]*"
CITATION_CODE = "số\\s*([0-9]+[/-][0-9A-ZĐa-zđ./\\-]+)"
CITATION_CODE_NARROW = "số\\s*([0-9]+[/-][0-9A-ZĐa-zđ.\\-]+)"
TYPE_IN_NUMBER = "[/\\-]([A-ZĐa-zđ]+)"

# Layout rules.
LAYOUT_FONTS = ("Times New Roman",)
LAYOUT_SIZES = (13, 14)
LAYOUT_MARGINS_CM = (
    ("top", 2.0, 2.5),
    ("bottom", 2.0, 2.5),
    ("left", 3.0, 3.5),
    ("right", 1.5, 2.0),
)
LAYOUT_SPACING_MAX = 1.5
MARGIN_TOLERANCE_CM = 0.05
SPACING_TOLERANCE = 0.01
ISSUE_EXAMPLES = 5

# Code fences around a reply, and the widest JSON text inside prose.
REPLY_FENCE = "(?m)^```(json)?|```$"
REPLY_WIDEST = "(?s)\\{.*\\}|\\[.*\\]"
