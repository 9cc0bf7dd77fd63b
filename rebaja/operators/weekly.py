"""Child-SKU features per store and week.

One exchange on (brand, sku, centro) carries every running window: a series has
one row per observed week, so no group grows with the transaction count.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja.functions import columns as X
from rebaja.operators import lookups

SERIES = ["brand", "sku", "centro"]
WEEKLY = [*SERIES, "week"]
#: Slices of folios by hash, over which the distinct folios of one (sku, centro, week) are spread.
FOLIO_SLICES = 8


def _series(keys: Sequence[str] = SERIES):
    return Window.partitionBy(*keys).orderBy("week")


def _rows(back: int, keys: Sequence[str] = SERIES):
    return _series(keys).rowsBetween(-(back - 1), 0)


def _so_far(keys: Sequence[str] = SERIES):
    return _series(keys).rowsBetween(Window.unboundedPreceding, 0)


# ------------------------------------------------------------- weekly sales

def exclude_service_skus(txn: DataFrame) -> DataFrame:
    from rebaja.constants import SERVICE_SKUS
    return txn.where(~F.col("sku").isin(SERVICE_SKUS))


def folio_counts(txn: DataFrame) -> DataFrame:
    """(brand, sku, centro, week, n_folios): distinct folios of sales, null keys included.

    Counted apart from the sums of sales, so lines cross the exchange as key and
    folio only. Equal folios of a key meet in one slice, so its slices add up.
    """
    sold = txn.where("cantidad > 0 and folio is not null").select(
        *SERIES, X.week_start("fecha").alias("week"), "folio", F.pmod(F.xxhash64("folio"), F.lit(FOLIO_SLICES)).cast("byte").alias("_slice"))
    sliced = sold.repartition(*WEEKLY, "_slice").groupBy(*WEEKLY, "_slice").agg(F.countDistinct("folio").alias("_n"))
    return sliced.groupBy(*WEEKLY).agg(F.sum("_n").alias("n_folios"))


def with_folio_counts(weekly: DataFrame, counts: DataFrame) -> DataFrame:
    """``weekly`` (one row per key) with ``txn_count`` out of ``folio_counts``; keys without a folio count 0."""
    found = counts.select(*[F.col(k).alias(f"_{k}") for k in WEEKLY], "n_folios")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in WEEKLY])
    return weekly.join(found, same, "left").withColumn("txn_count", F.coalesce("n_folios", F.lit(0))).drop("n_folios", *[f"_{k}" for k in WEEKLY])


def line_totals(txn: DataFrame) -> DataFrame:
    """One row per (brand, sku, centro, week): the sums of sales, clean and all, and of returns.

    Weekly sales, price panel and parent sales are read from it, so all share
    one pass over the lines and one exchange of partial sums. A ratio of a sum
    and its count is the mean; keys without a sale have null ``units_sold``.
    """
    sale, clean = F.col("cantidad") > 0, X.is_clean_retail()
    kinds = {"clean": sale & clean, "all": sale}

    def each(fn, name: str, value: str | Column) -> list[Column]:
        value = F.col(value) if isinstance(value, str) else value
        return [fn(F.when(test, value)).alias(f"{name}_{kind}") for kind, test in kinds.items()]

    return txn.where("cantidad <> 0").withColumn("week", X.week_start("fecha")).groupBy(*WEEKLY).agg(
        F.sum(F.when(sale, F.col("cantidad"))).alias("units_sold"),
        F.count_if(sale & X.is_click_collect()).alias("click_collect_units"),
        *each(F.sum, "discount", "descuento"),
        *each(F.sum, "list", "precio_lista"), *each(F.count, "n_list", "precio_lista"),
        *each(F.sum, "final", "precio_final"), *each(F.count, "n_final", "precio_final"),
        *each(F.min, "min_list", "precio_lista"), *each(F.max, "max_list", "precio_lista"),
        F.sum(F.when(kinds["clean"], F.col("precio_final") / F.col("cantidad"))).alias("per_unit_clean"),
        F.sum(F.when(~sale, F.col("cantidad"))).alias("returned"),
        F.min(F.when(sale, F.col("fecha"))).alias("first_fecha"))


def weekly_sales(txn: DataFrame, exclude: bool = True, first: bool = False, folios: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Units, revenue, returns and price aggregates per (brand, sku, centro, week).

    Volume comes from all sales; prices from clean retail lines, column by
    column falling back to all sales. Prices are read as unit prices and the
    discount rate as a ratio of line sums, with no quantity. ``exclude=False``
    takes prices from all sales; ``first`` adds the time of the first sale.
    Sales and returns share one aggregation of partial sums; distinct folios are
    counted beside it (``totals``, ``folios``: ``line_totals`` and ``folio_counts`` of the same lines, if at hand).
    """
    def priced(value) -> Column:
        return F.coalesce(value("clean"), value("all")) if exclude else value("all")

    def total(name: str) -> Column:
        return priced(lambda kind: F.col(f"{name}_{kind}"))

    def mean(name: str) -> Column:
        return priced(lambda kind: F.try_divide(f"{name}_{kind}", f"n_{name}_{kind}"))

    out = (line_totals(txn) if totals is None else totals).where("units_sold is not null").select(
        *WEEKLY, "units_sold", F.col("final_all").alias("gross_revenue"), "click_collect_units",
        total("discount").alias("total_discount"), total("list").alias("total_list_value"),
        mean("list").alias("avg_precio_lista"), mean("final").alias("avg_precio_final"),
        total("min_list").alias("min_precio_lista"), total("max_list").alias("max_precio_lista"),
        F.coalesce(F.abs("returned"), F.lit(0)).alias("units_returned"),
        *(["first_fecha"] if first else []),
    )
    rest = [c for c in out.columns if c not in (*WEEKLY, "units_sold", "gross_revenue")]
    out = with_folio_counts(out, folio_counts(txn) if folios is None else folios).select(*WEEKLY, "units_sold", "gross_revenue", "txn_count", *rest)
    return out.withColumns({
        "instore_units": X.clip(F.col("units_sold") - F.col("click_collect_units"), low=0),
        "click_collect_ratio": X.ratio("click_collect_units", "units_sold", 0.0),
        "net_units": F.col("units_sold") - F.col("units_returned"),
        "discount_rate": X.ratio("total_discount", "total_list_value", 0.0),
    })


def dense_weeks(weekly: DataFrame, measures: Sequence[str] = ("units_sold", "instore_units"),
                keys: Sequence[str] = SERIES) -> DataFrame:
    """Every week between the first and last observed one; new weeks carry zeros.

    Each row is exploded up to the next observed week, so no spine is joined.
    """
    following = F.lead("week").over(_series(keys))
    last = F.coalesce(F.date_sub(following, 7), F.col("week"))
    steps = F.sequence(F.col("week"), last, F.expr("INTERVAL 7 DAYS"))
    spread = weekly.withColumn("_weeks", steps).select("*", F.explode("_weeks").alias("_w"))
    real = F.col("_w") == F.col("week")
    keep = []
    for c in weekly.columns:
        if c == "week":
            keep.append(F.col("_w").alias("week"))
        elif c in keys:
            keep.append(F.col(c))
        elif c in measures:
            keep.append(F.when(real, F.col(c)).otherwise(0).alias(c))
        else:
            keep.append(F.when(real, F.col(c)).alias(c))
    return spread.select(*keep)


def apply_official_prices(weekly: DataFrame, official: DataFrame, skus: DataFrame | None = None) -> DataFrame:
    """Replace the observed list price with the official one where it exists.

    ``skus`` lists the codes to look up (default: those of ``weekly``).
    """
    valid = official.where("list_price > 0")
    found = lookups.prefix_lookup(weekly if skus is None else skus, valid, "sku", "sku", "list_price", exact_first_per_brand=True)
    return weekly.join(found, ["brand", "sku"], "left").withColumn(
        "avg_precio_lista", F.coalesce("list_price", "avg_precio_lista")).drop("list_price")


# ------------------------------------------------------------------ windows

def velocity_features(weekly: DataFrame, dense: bool = False) -> DataFrame:
    """Trailing mean units over observed rows (calendar weeks if ``dense``)."""
    df = dense_weeks(weekly) if dense else weekly
    out = df.withColumns({
        **{f"velocity_{k}w": F.avg("units_sold").over(_rows(k)) for k in (1, 2, 4, 8)},
        "cumulative_units": F.sum("units_sold").over(_so_far()),
        "instore_velocity_4w": F.avg("instore_units").over(_rows(4)),
    })
    return out.withColumn("velocity_trend", X.ratio("velocity_2w", "velocity_4w", 1.0))


def first_sales(txn: DataFrame) -> DataFrame:
    return txn.where("cantidad > 0").groupBy("brand", "sku").agg(F.min("fecha").alias("first_sale_date"))


def product_age(weekly: DataFrame, txn: DataFrame) -> DataFrame:
    """Weeks since the SKU first sold anywhere, never negative."""
    days = X.whole_days("week", "first_sale_date") / 7
    return weekly.join(first_sales(txn), ["brand", "sku"], "left").withColumn("product_age_weeks", X.clip(days, low=0.0))


def price_features(weekly: DataFrame) -> DataFrame:
    """List-price changes and discount history of a series."""
    price, w = F.col("avg_precio_lista"), _series()
    flagged = weekly.withColumns({
        "_prev": F.lag("avg_precio_lista").over(w),
        "has_discount": (F.col("discount_rate") > 0.01).cast("int"),
    })
    out = flagged.withColumns({
        "price_changed": X.true(price != F.col("_prev")).cast("int"),
        "price_change_pct": X.ratio(price - F.col("_prev"), F.col("_prev"), 0.0),
        "cumulative_disc_weeks": F.sum("has_discount").over(_so_far()),
        "_nth": F.row_number().over(w),
        "max_discount_rate": F.max("discount_rate").over(_so_far()),
    })
    # nth row of the latest discount week so far; before any, count from the first row
    latest = F.max(F.when(F.col("has_discount") == 1, F.col("_nth"))).over(_so_far())
    return out.withColumns({
        "weeks_since_discount": F.col("_nth") - F.coalesce(latest, F.lit(1)),
        "disc_exposure_rate": F.col("cumulative_disc_weeks") / F.col("_nth"),
    }).drop("_prev", "_nth")


def target_variables(weekly: DataFrame, strict_future: bool = False) -> DataFrame:
    """Training labels.

    The compatible form takes the next row and the three before it, that is rows
    t-2..t+1. ``strict_future`` looks at rows t+1..t+4 only.
    """
    w = _series()
    frame = w.rowsBetween(1, 4) if strict_future else w.rowsBetween(-3, 0)
    df = weekly.withColumns({
        "_flag": F.col("has_discount") if strict_future else F.lead("has_discount").over(w),
        "_rate": F.col("discount_rate") if strict_future else F.lead("discount_rate").over(w),
        "future_velocity_2w": F.lead("velocity_2w", 2).over(w),
    })
    return df.withColumns({
        "will_discount_4w": F.coalesce(F.max("_flag").over(frame), F.lit(0)).cast("int"),
        "future_max_disc_4w": F.coalesce(F.max("_rate").over(frame), F.lit(0.0)),
        "velocity_lift": X.ratio("future_velocity_2w", "velocity_2w"),
    }).drop("_flag", "_rate")


def filter_active_rows(weekly: DataFrame) -> DataFrame:
    """Rows between the first and the last week with a sale."""
    sold = F.when(F.col("units_sold") > 0, F.col("week"))
    over = Window.partitionBy(*SERIES)
    return (
        weekly.withColumns({"_first": F.min(sold).over(over), "_last": F.max(sold).over(over)})
        .where("week between _first and _last").drop("_first", "_last")
    )


# ------------------------------------------------------------------- joins

def size_curve_completeness(weekly: DataFrame, products: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Share of the parent's catalogue sizes that sold in the store-week.

    ``base`` holds the same rows before later columns were added; give it where
    ``weekly`` is expensive, so that its lineage is not planned twice.
    """
    parents = lookups.sku_parent(products)
    sized = products.groupBy("brand", F.col("material").alias("sku")).agg(F.min("talla").alias("_talla"))
    total = (products.where("codigo_padre is not null").groupBy("brand", "codigo_padre")
             .agg(F.countDistinct("talla").alias("_total")))
    df = weekly.join(parents, ["brand", "sku"], "left")
    sold = (weekly if base is None else base).where("units_sold > 0").select(*WEEKLY)
    selling = (
        sold.join(parents, ["brand", "sku"]).join(sized, ["brand", "sku"], "left")
        .groupBy("brand", "codigo_padre", "centro", "week").agg(F.countDistinct("_talla").alias("_selling"))
        .join(total, ["brand", "codigo_padre"], "left")
        .select("brand", "codigo_padre", "centro", "week",
                X.clip(F.col("_selling") / F.col("_total"), high=1.0).alias("size_curve_completeness"))
    )
    return df.join(selling, ["brand", "codigo_padre", "centro", "week"], "left").fillna(
        0.0, ["size_curve_completeness"])


def seasonality_features(weekly: DataFrame) -> DataFrame:
    return weekly.withColumns({
        "month": F.month("week"), "week_of_year": F.weekofyear("week"), "quarter": F.quarter("week"),
    }).withColumns({
        "month_sin": X.cyclical("month", 12, F.sin), "month_cos": X.cyclical("month", 12, F.cos),
        "week_sin": X.cyclical("week_of_year", 52, F.sin), "week_cos": X.cyclical("week_of_year", 52, F.cos),
    })


def stock_weekly(stock: DataFrame) -> DataFrame:
    """End-of-week snapshot and days out of stock per (brand, sku, centro, week)."""
    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("fecha")))

    return (
        stock.withColumns({"centro": X.store_code("store_id"), "week": X.week_start("fecha")})
        .groupBy(*WEEKLY)
        .agg(last("stock_on_hand_units").alias("stock_on_hand"),
             last("stock_in_transit_units").alias("stock_in_transit"),
             last("total_stock_position_units").alias("stock_total"),
             F.count_if(F.col("stock_on_hand_units") == 0).alias("stock_out_days"))
    )


def cover_columns(units: str = "units_sold") -> dict[str, Column]:
    """Weeks of cover (at most 52) and stock-to-sales ratio (at most 99)."""
    hand = F.col("stock_on_hand")

    def per(denominator: str, idle: float) -> Column:
        value = F.when(F.col(denominator) > 0, hand / F.col(denominator)).otherwise(
            F.when(hand > 0, idle).otherwise(0.0))
        return X.clip(value, high=idle)

    return {"weeks_of_cover": per("velocity_4w", 52.0), "stock_to_sales_ratio": per(units, 99.0)}


def stock_features(weekly: DataFrame, stock: DataFrame) -> DataFrame:
    return weekly.join(stock_weekly(stock), WEEKLY, "left").withColumns(cover_columns())


def latest_week(df: DataFrame) -> DataFrame:
    """Last week of each brand: as many rows as brands."""
    return df.groupBy("brand").agg(F.max("week").alias("_latest"))


def backorder_features(weekly: DataFrame, backorder: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Open purchase orders, on the brand's latest week only."""
    signal = backorder.groupBy("brand", "sku", "centro").agg(
        F.sum("open_qty").alias("open_po_units"), F.min("earliest_delivery").alias("_due"),
        F.sum("n_open_pos").alias("n_open_pos"))
    now = F.col("week") >= F.col("_latest")
    return (
        weekly.join(signal, SERIES, "left").join(F.broadcast(latest_week(weekly if base is None else base)), "brand", "left")
        .withColumns({
            "open_po_units": F.coalesce(F.when(now, F.col("open_po_units")), F.lit(0.0)).cast("double"),
            "n_open_pos": F.coalesce(F.when(now, F.col("n_open_pos")), F.lit(0)).cast("long"),
            "days_to_delivery": F.coalesce(F.when(now, F.datediff("_due", "week")), F.lit(9999)).cast("long"),
        }).drop("_due", "_latest")
    )


def replenishment_features(weekly: DataFrame, replenishment: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Transfers in transit and received, on the brand's latest week only."""
    signal = replenishment.groupBy("brand", "sku", "centro").agg(
        F.sum("units_in_transit").alias("units_in_transit"),
        F.sum("units_received_window").alias("units_received_window"),
        F.avg("avg_transit_days").alias("avg_transit_days"), F.sum("n_transfers").alias("n_transfers"))
    now = F.col("week") >= F.col("_latest")
    return (
        weekly.join(signal, SERIES, "left").join(F.broadcast(latest_week(weekly if base is None else base)), "brand", "left")
        .withColumns({
            "units_in_transit": F.coalesce(F.when(now, F.col("units_in_transit")), F.lit(0.0)).cast("double"),
            "units_received_window": F.coalesce(F.when(now, F.col("units_received_window")), F.lit(0.0)).cast("double"),
            "avg_transit_days": F.when(now, F.col("avg_transit_days")).cast("double"),
            "n_transfers": F.coalesce(F.when(now, F.col("n_transfers")), F.lit(0)).cast("long"),
        }).drop("_latest")
    )


def size_shares(txn: DataFrame, products: DataFrame) -> DataFrame:
    """All-time share and rank of each child SKU within its parent."""
    sold = txn.where("cantidad > 0").groupBy("brand", "sku").agg(F.sum("cantidad").alias("sku_total_units"))
    family = Window.partitionBy("brand", "codigo_padre")
    total = F.sum("sku_total_units").over(family)
    return (
        sold.join(lookups.sku_parent(products), ["brand", "sku"])
        .withColumns({
            "size_sales_share": F.col("sku_total_units") / F.greatest(total, F.lit(1)),
            "size_rank": F.rank().over(family.orderBy(F.desc("sku_total_units"))),
        })
    )


def size_sales_share(weekly: DataFrame, txn: DataFrame, products: DataFrame) -> DataFrame:
    shares = size_shares(txn, products).select("brand", "sku", "size_sales_share", "size_rank")
    return weekly.join(shares, ["brand", "sku"], "left").fillna({"size_sales_share": 0.0, "size_rank": 99})


def traffic_weekly(traffic: DataFrame) -> DataFrame:
    return (
        traffic.where("tienda_id is not null")
        .groupBy(F.col("tienda_id").cast("string").alias("centro"), X.week_start("fecha").alias("week"))
        .agg(F.sum("entradas").alias("weekly_entries"), F.sum("salidas").alias("weekly_exits"),
             F.avg("tiempo_permanencia_prom").alias("avg_dwell_time"))
    )


def foot_traffic_features(weekly: DataFrame, traffic: DataFrame) -> DataFrame:
    visits = traffic_weekly(traffic).select("centro", "week", "weekly_entries", "avg_dwell_time")
    return weekly.join(visits, ["centro", "week"], "left").withColumn(
        "conversion_rate", X.ratio("units_sold", "weekly_entries"))


ATTRIBUTES = ["primera_jerarquia", "segunda_jerarquia", "tercera_jerarquia", "genero", "grupo_etario", "color1"]


def product_attributes(weekly: DataFrame, products: DataFrame) -> DataFrame:
    return weekly.join(lookups.product_attributes(products, ATTRIBUTES), ["brand", "sku"], "left")


def markdown_contribution(weekly: DataFrame, contribution: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Supplier contribution per SKU, a flag, and the parent total over all rows.

    Every row of a SKU counts in the total, so weeks and stores multiply it: it
    is built from row counts per SKU, not by a window over a whole parent.
    """
    paid = contribution.groupBy("brand", "sku").agg(
        F.sum(F.coalesce("contribucion_valor", F.lit(0.0))).alias("mkdown_contrib_2024_clp"))
    df = weekly.join(paid, ["brand", "sku"], "left").fillna(0.0, ["mkdown_contrib_2024_clp"])
    rows = (weekly if base is None else base).groupBy("brand", "sku", "codigo_padre").agg(F.count(F.lit(1)).alias("_n"))
    total = (
        rows.where("codigo_padre is not null").join(paid, ["brand", "sku"], "left")
        .groupBy("brand", "codigo_padre")
        .agg(F.sum(F.coalesce(F.col("_n") * F.col("mkdown_contrib_2024_clp"), F.lit(0.0)))
             .alias("mkdown_contrib_2024_parent_total"))
    )
    return df.withColumn("mkdown_contrib_2024_present", (F.col("mkdown_contrib_2024_clp") > 0).cast("int")).join(
        total, ["brand", "codigo_padre"], "left")


def weekly_weather(daily: DataFrame) -> DataFrame:
    """Weather per region and week, with the deviation from a 4-week mean.

    The mean runs over the region's weeks, once per region, and does not depend
    on how many SKUs a store carries.
    """
    weekly = daily.groupBy("region", X.week_start("date").alias("week")).agg(
        (F.avg(F.col("temp_max") + F.col("temp_min")) / 2).alias("avg_temp"), F.max("temp_max").alias("max_temp"),
        F.min("temp_min").alias("min_temp"), F.sum("precipitation").alias("total_rain"),
        F.count_if(F.col("precipitation") > 1.0).alias("rain_days"))
    mean = F.avg("avg_temp").over(Window.partitionBy("region").orderBy("week").rowsBetween(-3, 0))
    return weekly.withColumns({
        "temp_deviation": F.col("avg_temp") - mean, "is_rainy_week": (F.col("total_rain") > 20).cast("int")})


def weather_features(weekly: DataFrame, stores: DataFrame, daily: DataFrame) -> DataFrame:
    regions = stores.groupBy("centro").agg(F.min("region").alias("region"))
    by_store = weekly_weather(daily).join(regions, "region").drop("region")
    return weekly.join(by_store, ["centro", "week"], "left").fillna(0, ["is_rainy_week"])
