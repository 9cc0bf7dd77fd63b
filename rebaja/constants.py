"""Fixed values.

Everything here must equal the published values for results to agree, so it is
stated plainly and in natural order.
"""

# Operational discount ladder used by the pricing passes.
PRICE_LADDER = [0.0, 0.15, 0.20, 0.30, 0.40]

# Finer ladder used by the margin targets, and the default
# velocity multiplier of each of its steps.
MARGIN_LADDER = [0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40]
DEFAULT_LIFT = [1.0, 1.3, 1.5, 1.8, 2.2, 2.6, 3.0, 3.5, 4.0]

# Velocity multiplier of a markdown to a price-ladder step when
# no usable elasticity exists.
STEP_LIFT = {0.15: 1.8, 0.20: 2.2, 0.30: 3.0, 0.40: 4.0}

# Price anchors.
PRICE_ANCHORS = [
    990, 1990, 2990, 3990, 4990, 5990, 6990, 7990, 8990, 9990,
    12990, 14990, 16990, 19990,
    24990, 29990, 34990, 39990, 44990, 49990,
    54990, 59990, 69990, 79990, 89990, 99990,
    109990, 119990, 129990, 139990, 149990, 169990, 199990,
    249990, 299990, 399990, 499990, 599990, 799990, 999990,
]
ANCHOR_STEP_ABOVE = 10000

# Tax, margin floor (percent), smallest price move worth making.
VAT = 1.19
MIN_MARGIN_PCT = 15
MIN_PRICE_MOVE = 2000
MANDATORY_REVIEW_VARIANCE = 0.50

# Columns and categories of the source data.
PICKUP_DELIVERY = "Retiro en Tienda"
CREDIT_NOTE = "NOTA DE CREDITO"
MARKDOWN_LISTS = ["liquidacion", "outlet"]
FOOTWEAR = "Footwear"
SERVICE_SKUS = ["000000001000000031", "AJUSTE", "HANDBAG01"]
NON_RETAIL_STORES = ["DX01", "B611", "B997", "514", "170", "508", "D005", "AB10", "2019", "B609", "BEC2"]
CORE_SIZES = ["7", "7,5", "8", "8,5", "9", "9,5", "10", "10,5"]

# Lifecycle stages in code order.
LIFECYCLE_STAGES = ["launch", "growth", "peak", "steady", "decline", "clearance"]

# Months of the spring-summer season.
SPRING_SUMMER_MONTHS = [9, 10, 11, 12, 1, 2]

# Decision statuses.
IMPLEMENTED_STATUSES = ["approved", "bm_approved", "manual", "bm_manual", "planner_approved"]
BM_STATUSES = ["bm_approved", "bm_rejected", "bm_manual", "approved", "rejected", "manual"]
EXPORT_STATUSES = ["approved", "manual", "planner_approved"]

# Sort rank of an urgency label.
URGENCY_RANK = {"INCREASE": -1, "HIGH": 0, "MEDIUM": 1, "LOW": 2}

# Probability cuts of the recommendation list.
RECOMMEND_CUTS = {"low": 0.30, "medium": 0.50, "high": 0.75}

# Vendor of a SKU prefix (longest prefix wins), and overrides per banner.
VENDOR_PREFIXES = {
    "CAH": "Carhartt", "CAB": "Bamers",
    "NI": "Nike", "NP": "Nike", "AD": "Adidas", "PM": "Puma", "JR": "Jordan",
    "NB": "New Balance", "VN": "Vans", "CV": "Converse", "NE": "New Era",
    "SK": "Skechers", "CR": "Crocs", "BM": "Bamers", "HK": "Hoka", "OK": "Oakley",
    "UA": "Under Armour", "RB": "Reebok", "AL": "Alpinestars", "LT": "Lacoste",
    "SH": "Shaka", "UM": "Umbro", "QS": "Quiksilver", "MN": "Merrell",
    "ML": "Maui and Sons", "SC": "Saucony", "BL": "Belsport", "KP": "Kappa",
}
VENDOR_OVERRIDES = {"BELSPORT": {"LT": "Lotto", "AL": "Alphabet"}}

# Product-name clean-up patterns.
NAME_SIZE_SUFFIX = r"\s*N[°º]?\s*[\d,\.]+\s*$"
NAME_LETTER_SUFFIX = r"\s*T/[A-Z]+\s*$"
MATCH_SIZE_SUFFIXES = [r"\s+n[°º]\s*[\d,\.]+\s*$", r"\s*t/[a-z0-9]+\s*$", r"\s*talla\s*[\d\.]+\s*$"]
MATCH_NOISE_WORDS = r"\b(hombre|mujer|unisex|adulto|infantil|nino|nina)\b"
MODEL_WORDS = ["GTX", "MID", "ATR", "LOW", "RUN", "HAT", "LS", "PACK", "SOCK", "CREW", "TANK", "TEE"]
LETTER_SIZES = ["S", "M", "L", "XL", "XXL", "U", "W", "T", "OSFA"]
HOUSE_PREFIXES = ["HOKA ONE ONE ", "HOKA "]

# Model input columns that must not be used as features.
CATEGORICAL_COLUMNS = ["primera_jerarquia", "segunda_jerarquia", "genero", "grupo_etario"]
NON_FEATURES = [
    "brand", "sku", "centro", "week", "codigo_padre", "first_sale_date",
    "will_discount_4w", "future_max_disc_4w", "future_velocity_2w", "velocity_lift",
    "color1", "tercera_jerarquia",
    "should_reprice", "optimal_disc_margin", "optimal_profit",
    "click_collect_units", "instore_units", "instore_velocity_4w", "click_collect_ratio",
]
HOLDOUT_WEEKS = 4
