"""Column expressions: tags, dates, rounding, names, formatting.

Every function takes and returns Columns; nothing here triggers a job.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rebaja import constants as C


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters must not be pushed through.

    A filter on a plain derived column is moved below it with the expression
    substituted, once per use; over several pricing steps the copies multiply.
    One-element generators stop that: each row computes each column once.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


# ---------------------------------------------------------------- numbers

def half_even(c: str | Column, digits: int = 0) -> Column:
    """Round half to even on the scaled binary value."""
    scale = float(10 ** digits)
    return F.rint(col(c) * scale) / scale


def ratio(num: str | Column, den: str | Column, otherwise=None) -> Column:
    """num / den where den > 0, else ``otherwise`` (NULL if not given)."""
    n, d = col(num), col(den)
    out = F.when(d > 0, n / d)
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def clip(c: str | Column, low=None, high=None) -> Column:
    """Bound a value and keep NULL as NULL (greatest/least would skip it)."""
    x = col(c)
    out = x
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def safe_double(c: str | Column) -> Column:
    """Text or number to double; blanks, words and NaN become NULL."""
    d = col(c).cast("string").try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def true(c: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(c, F.lit(False))


# ------------------------------------------------------------------ dates

def week_start(c: str | Column) -> Column:
    """Monday of the week as a date."""
    return F.trunc(col(c).cast("date"), "week")


def whole_days(later: str | Column, earlier: str | Column) -> Column:
    """Days between two timestamps, rounded down."""
    seconds = col(later).cast("timestamp").cast("long") - col(earlier).cast("timestamp").cast("long")
    return F.floor(seconds / 86400)


def cyclical(c: str | Column, period: int, fn) -> Column:
    return fn(F.lit(2.0) * F.pi() * col(c) / F.lit(period))


# ------------------------------------------------------- transaction tags

def is_click_collect() -> Column:
    return true(F.col("tipo_entrega") == C.PICKUP_DELIVERY)


def has_coupon() -> Column:
    return true(F.col("codigo_descuento") != "")


def is_credit_note() -> Column:
    return true(F.upper("tipo_documento").contains(C.CREDIT_NOTE))


def is_extreme_discount() -> Column:
    return true(ratio("descuento", "precio_lista") > 0.50)


def is_markdown_list() -> Column:
    return true(F.col("list_category").isin(C.MARKDOWN_LISTS))


def is_clean_retail() -> Column:
    """Sale lines that carry the regular store price."""
    return ~(is_click_collect() | has_coupon() | is_credit_note() | is_extreme_discount() | is_markdown_list())


# ------------------------------------------------------------ stores, SKUs

def is_ecomm(store: str | Column) -> Column:
    return F.upper(F.trim(col(store))).startswith("AB")


def channel_of(store: str | Column) -> Column:
    return F.when(is_ecomm(store), "ecomm").otherwise("bm")


def is_pricing_store(store: str | Column) -> Column:
    """Not a logistics, digital or internal store."""
    keep = F.lit(True)
    for prefix in C.NON_RETAIL_STORES:
        keep = keep & ~col(store).startswith(prefix)
    return keep


def store_code(store_id: str | Column) -> Column:
    return F.substring_index(col(store_id), "-", 1)


def store_name(sucursal: str | Column) -> Column:
    """Text after the first dash, or all of it."""
    s = col(sucursal)
    return F.when(s.contains("-"), F.trim(F.regexp_replace(s, r"^[^-]*-", ""))).otherwise(s)


def folio_number(folio: str | Column) -> Column:
    """Trailing number of a register-prefixed folio."""
    f = col(folio)
    return F.coalesce(F.nullif(F.split_part(f, F.lit("-"), F.lit(2)), F.lit("")), f)


def vendor_brand(sku: str | Column, banner: str | Column | None = None) -> Column:
    """Vendor of a SKU by its longest known prefix; 'Other' if unknown."""
    code = F.upper(F.trim(col(sku)))
    entries = []
    for prefix, vendor in C.VENDOR_PREFIXES.items():
        entries += [F.lit(prefix), F.lit(vendor)]
    names = F.create_map(*entries)
    found = F.coalesce(names[F.substring(code, 1, 3)], names[F.substring(code, 1, 2)], F.lit("Other"))
    if banner is None:
        return found
    by_prefix = F.substring(code, 1, 2)
    long_hit = names[F.substring(code, 1, 3)].isNotNull()
    for name, changes in C.VENDOR_OVERRIDES.items():
        for prefix, vendor in changes.items():
            here = (F.upper(col(banner)) == name) & (by_prefix == prefix) & ~long_hit
            found = F.when(here, vendor).otherwise(found)
    return found


def classify_price_list(desc: str | Column) -> Column:
    text = F.lower(col(desc))
    return (
        F.when(col(desc).isNull() | (F.trim(col(desc)) == ""), "unknown")
        .when(text.contains("liquid") | text.rlike(r"\bliq[\s.]"), "liquidacion")
        .when(text.contains("outlet"), "outlet")
        .when(text.contains("evento"), "eventos")
        .when(text.contains("virtual") | text.contains("marketplace") | text.contains("wholesale"), "online")
        .otherwise("retail")
    )


def size_number(talla: str | Column) -> Column:
    return F.regexp_replace(col(talla), ",", ".").try_cast("double")


# ------------------------------------------------------------------- text

def clean_product_name(name: str | Column) -> Column:
    """Product name without its trailing size."""
    out = F.regexp_replace(col(name), C.NAME_SIZE_SUFFIX, "")
    return F.trim(F.regexp_replace(out, C.NAME_LETTER_SUFFIX, ""))


def parse_pct(text: str | Column) -> Column:
    """'30%' to 0.30; 'Full price', blanks and bad text to 0."""
    s = F.trim(col(text))
    number = F.regexp_replace(s, "%$", "").try_cast("double")
    return F.coalesce(F.when(s.endswith("%"), number / 100.0).otherwise(number), F.lit(0.0))


def format_pct(step: str | Column, zero: str = "Full price") -> Column:
    """0.30 to '30%'; 0 to ``zero``."""
    s = col(step)
    return F.when(s <= 0, F.lit(zero)).otherwise(F.concat(F.rint(s * 100).cast("int").cast("string"), F.lit("%")))


def pct_text(value: str | Column) -> Column:
    """0.347 to '35%'."""
    return F.concat(F.rint(col(value) * 100).cast("int").cast("string"), F.lit("%"))


def format_clp(value: str | Column) -> Column:
    """36990 to '$36.990', negative amounts with a leading minus."""
    v = F.rint(col(value)).cast("long")
    text = F.translate(F.format_number(F.abs(v), 0), ",", ".")
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.when(v < 0, F.lit("-$")).otherwise(F.lit("$")), text))


def join_reasons(parts: Sequence[Column], sep: str = "; ") -> Column:
    """Join the non-NULL parts in order."""
    return F.concat_ws(sep, *parts)


def strip_accents(text: str | Column) -> Column:
    return F.translate(col(text), "ÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇáàäâãéèëêíìïîóòöôõúùüûñç",
                       "AAAAAEEEEIIIIOOOOOUUUUNCaaaaaeeeeiiiiooooouuuunc")


def normalise_name(name: str | Column) -> Column:
    """Lower-case ASCII name without size suffix and audience words."""
    out = F.trim(F.lower(strip_accents(name)))
    for pattern in C.MATCH_SIZE_SUFFIXES:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, C.MATCH_NOISE_WORDS, "")
    return F.coalesce(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def strip_brand(name: Column, brand: str | Column) -> Column:
    """Drop a leading normalised brand from a normalised name."""
    return strip_head(name, normalise_name(brand))


def strip_head(name: Column, head: Column) -> Column:
    """Drop the leading words ``head`` from a name; both normalised."""
    spaced = F.concat(head, F.lit(" "))
    return F.when((head != "") & name.startswith(spaced), F.trim(F.substr(name, F.length(spaced)))).otherwise(name)


def model_name(raw: str | Column) -> Column:
    """Search name of a product: gender, house brand, colour and size removed."""
    out = F.regexp_replace(F.trim(col(raw)), r"^[MWU]\s+", "")
    for prefix in C.HOUSE_PREFIXES:
        out = F.regexp_replace(out, "(?i)^" + prefix, "")
    out = F.regexp_replace(out, r"\s+N[°º]\s*\S+.*$", "")
    out = F.regexp_replace(out, r"\s*/\s*[A-Z].*$", "")
    size = "(?:" + "|".join(C.LETTER_SIZES) + r"|\d+[,./]?\d*)"
    out = F.regexp_replace(out, rf"(?:(?:^|\s+){size})+\s*$", "")
    keep = "|".join(C.MODEL_WORDS)
    out = F.regexp_replace(out, rf"(?:(?:^|\s+)(?!(?:{keep})(?:\s|$))[A-Z]{{3,6}})+\s*$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
