"""Roll-up of child rows to parent, store and week."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja.functions import columns as X
from rebaja.operators import lookups, weekly

KEYS = ["brand", "codigo_padre", "centro", "week"]

SUMS = ["units_sold", "net_units", "gross_revenue", "velocity_1w", "velocity_2w", "velocity_4w", "velocity_8w",
        "cumulative_units", "units_returned", "click_collect_units", "instore_units", "instore_velocity_4w",
        "total_list_value", "total_discount", "txn_count", "mkdown_contrib_2024_clp"]
SUMS_OR_NULL = ["stock_on_hand", "stock_in_transit", "stock_total"]
MEDIANS = ["avg_precio_lista", "avg_precio_final", "discount_rate", "optimal_disc_margin"]
MAXIMA = ["max_precio_lista", "has_discount", "max_discount_rate", "cumulative_disc_weeks", "product_age_weeks",
          "price_changed", "will_discount_4w", "future_max_disc_4w", "should_reprice", "stock_out_days"]
MINIMA = ["min_precio_lista", "weeks_since_discount", "first_sale_date"]
MEANS = ["disc_exposure_rate", "price_change_pct"]
# equal on all children of a parent-store-week, so any aggregate that skips NULL will do
SHARED = ["weekly_entries", "avg_dwell_time", "price_elasticity", "lifecycle_stage_code", "lifecycle_position",
          "attrition_rate", "core_completeness", "fragmentation_index", "is_fall_winter", "month", "week_of_year",
          "quarter", "month_sin", "month_cos", "week_sin", "week_cos", "avg_temp", "max_temp", "min_temp",
          "total_rain", "rain_days", "temp_deviation", "is_rainy_week", "comp_min_price", "comp_avg_price",
          "comp_max_price", "comp_count", "comp_any_discount", "comp_max_discount", "comp_in_stock_count",
          "mkdown_contrib_2024_parent_total"]
# differ between children: the value of the lowest child SKU that has one
FIRST = ["comp_price_index", "comp_price_gap_pct", "comp_undercut", "comp_discount_pressure", "cat_x_lifecycle",
         "cat_x_season", "cat_x_velocity", "cat_x_age", "mkdown_contrib_2024_present"]
SIGNAL_SUMS = ["open_po_units", "n_open_pos", "units_in_transit", "units_received_window", "n_transfers"]
CATALOGUE = ["primera_jerarquia", "segunda_jerarquia", "genero", "grupo_etario"]


def _first(c: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("sku")))


def weighted_size_features(stock: DataFrame, txn: DataFrame, products: DataFrame) -> DataFrame:
    """Volume-weighted availability of a parent's sizes at the end of the week."""
    shares = weekly.size_shares(txn, products).select("brand", "sku", "size_sales_share", "size_rank")
    held = (
        weekly.stock_weekly(stock).join(lookups.sku_parent(products), ["brand", "sku"])
        .join(shares, ["brand", "sku"], "left")
        .select(*KEYS, F.coalesce("size_sales_share", F.lit(0.0)).alias("_share"), "size_rank",
                (F.coalesce("stock_on_hand", F.lit(0)) > 0).cast("int").alias("_has"))
    )
    share, has = F.col("_share"), F.col("_has")
    return held.groupBy(*KEYS).agg(
        X.clip(F.sum(share * has) / F.greatest(F.sum(share), F.lit(0.001)), high=1.0).alias("weighted_size_avail"),
        F.sum(share * (1 - has)).alias("revenue_at_risk_pct"),
        F.avg(F.when(F.col("size_rank") <= 3, has)).alias("top3_sizes_in_stock"))


def aggregate_to_parent(child: DataFrame, products: DataFrame, weighted: DataFrame | None = None,
                        signals: bool = False) -> DataFrame:
    """One row per parent, store and week.

    A single aggregation over the children (bounded by the sizes of a parent),
    then ratios recomputed from its sums. Columns the child table lacks are left
    out. ``signals`` adds the sums of orders and transfers.
    """
    have = set(child.columns)

    def of(names):
        return [n for n in names if n in have]

    sold = F.col("units_sold") > 0
    aggs = [
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in of(SUMS)],
        *[F.sum(c).alias(c) for c in of(SUMS_OR_NULL)],
        *[F.median(c).alias(c) for c in of(MEDIANS)],
        *[F.max(c).alias(c) for c in of(MAXIMA + SHARED)],
        *[F.min(c).alias(c) for c in of(MINIMA)],
        *[F.avg(c).alias(c) for c in of(MEANS)],
        *[_first(c).alias(c) for c in of(FIRST)],
        F.coalesce(F.sum("future_velocity_2w"), F.lit(0.0)).alias("future_velocity_2w"),
        F.count_if(sold).alias("_active"), F.count(F.lit(1)).alias("_sizes"),  # a child has one row per key
    ]
    if "optimal_profit" in have:
        aggs.append(F.coalesce(F.sum("optimal_profit"), F.lit(0.0)).alias("optimal_profit"))
    if "stock_on_hand" in have:
        aggs += [F.count_if(F.col("stock_on_hand") > 0).alias("_held"), F.count("stock_on_hand").alias("_counted")]
    if signals:
        aggs += [F.sum(c).alias(c) for c in of(SIGNAL_SUMS)]
        if "days_to_delivery" in have:
            aggs.append(F.min("days_to_delivery").alias("days_to_delivery"))
    out = child.where("codigo_padre is not null").groupBy(*KEYS).agg(*aggs)

    if "stock_on_hand" in have:
        out = out.withColumns({
            "pct_sizes_in_stock": F.when(F.col("_counted") > 0, F.col("_held") / F.col("_counted")),
            **weekly.cover_columns()}).drop("_held", "_counted")
    if weighted is not None:
        out = out.join(weighted, KEYS, "left")
    catalogue = lookups.parent_catalogue(products, CATALOGUE)
    return (
        out.join(catalogue, ["brand", "codigo_padre"], "left")
        .withColumns({
            "velocity_trend": X.ratio("velocity_2w", "velocity_4w", 1.0),
            "conversion_rate": X.ratio("units_sold", "weekly_entries"),
            "velocity_lift": X.ratio("future_velocity_2w", "velocity_2w"),
            "size_curve_completeness": F.coalesce(X.clip(
                F.col("_active") / F.coalesce("total_sizes_catalog", "_sizes"), high=1.0), F.lit(0.0)),
            "click_collect_ratio": X.ratio("click_collect_units", "units_sold", 0.0),
        }).drop("_active", "_sizes", "total_sizes_catalog")
    )


def child_scores_to_parent(scored: DataFrame) -> DataFrame:
    """Scored child rows of one week as parent-store rows, for child-grain pricing."""
    return (
        scored.where("codigo_padre is not null").groupBy("brand", "codigo_padre", "centro", "week")
        .agg(*[F.sum(c).alias(c) for c in ("velocity_4w", "velocity_2w", "velocity_8w", "units_sold", "cumulative_units")],
             *[F.median(c).alias(c) for c in ("avg_precio_lista", "avg_precio_final", "discount_rate", "lifecycle_stage_code")],
             F.max("max_discount_rate").alias("max_discount_rate"), F.max("product_age_weeks").alias("product_age_weeks"),
             F.avg("markdown_probability").alias("markdown_probability"), F.avg("raw_depth").alias("raw_depth"),
             F.count_if(F.col("units_sold") > 0).alias("sizes_selling"), _first("attrition_rate").alias("attrition_rate"))
        .withColumn("velocity_trend", X.ratio("velocity_4w", "velocity_8w", 1.0))
    )


def brand_weeks(parent: DataFrame, min_rows: int = 10) -> DataFrame:
    """Week to price per brand: the latest with enough rows, else the latest."""
    counts = parent.groupBy("brand", "week").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("brand").agg(
        F.coalesce(F.max(F.when(F.col("n") >= min_rows, F.col("week"))), F.max("week")).alias("week"))


def ranked_weeks(df: DataFrame) -> DataFrame:
    """Distinct weeks per brand with their rank from the newest (1) and oldest."""
    w = Window.partitionBy("brand")
    return df.select("brand", "week").distinct().withColumns({
        "newest": F.row_number().over(w.orderBy(F.desc("week"))), "oldest": F.row_number().over(w.orderBy("week"))})
