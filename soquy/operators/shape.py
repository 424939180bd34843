"""Fixed values the reports share: category codes, class keys and labels."""

# Service category code -> report column.
CATEGORY_COLUMNS = {
    "DT001": "tien_kham",
    "DT002": "tien_giuong",
    "DT003": "tien_cls",
    "DT004": "tien_pttt",
    "DT005": "tien_thuoc",
    "DT006": "tien_vattu",
    "DT007": "tien_thuoc_pm",
    "DT008": "tien_vattu_pm",
    "DT009": "tien_khac",
}

# Class column -> code -> label.
CLASS_LABELS = {
    "kcb_class": {1: "Ngoại trú", 2: "Nội trú"},
    "price_type": {1: "Thông thường", 2: "Theo yêu cầu"},
    "object_type": {1: "BHYT", 2: "Dịch vụ"},
}

# Texts for missing names and for the total row.
UNKNOWN_DEPARTMENT = "Không xác định"
NO_CONTRACT = "NULL"
TOTAL_LABEL = "Tổng cộng"
NULL_INVOICE = "None"

CATEGORIES = list(CATEGORY_COLUMNS.values())
CLASS_KEYS = list(CLASS_LABELS)
