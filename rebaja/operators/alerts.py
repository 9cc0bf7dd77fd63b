"""Price consistency alerts across the stores of a parent."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rebaja.functions import columns as X
from rebaja.operators import lookups, weekly

PARENT = ["brand", "codigo_padre"]


def cross_store_alerts(parent: DataFrame, price_spread: float = 0.10, discount_spread: float = 0.10,
                       ecomm_gap: float = 0.15, cover_excess: float = 12.0) -> DataFrame:
    """Stores of parents whose prices, discounts or stock disagree in the latest week.

    One conditional aggregation per parent (bounded by its stores), joined back
    to the rows of the alerted parents.
    """
    c = F.col
    now = (
        parent.join(F.broadcast(weekly.latest_week(parent)), "brand").where("week = _latest")
        .select(*PARENT, "centro", "week", X.channel_of("centro").alias("channel"), "avg_precio_final", "discount_rate",
                "stock_on_hand", "weeks_of_cover", "velocity_4w")
    )
    price, disc, bm = c("avg_precio_final"), c("discount_rate"), c("channel") == "bm"
    speed = F.greatest("velocity_4w", F.lit(0.0))
    discounted = X.true(disc > 0.05)
    stats = now.groupBy(*PARENT).agg(
        F.countDistinct("centro").alias("n_stores"), F.median(price).alias("median_price"),
        (F.max(price) - F.min(price)).alias("_range"), (F.max(disc) - F.min(disc)).alias("discount_spread"),
        (F.max(F.when(bm, price)) - F.min(F.when(bm, price))).alias("_bm_range"), F.median(F.when(bm, price)).alias("_bm_median"),
        F.countDistinct(F.when(bm, c("centro"))).alias("_bm_stores"), F.median(F.when(~bm, price)).alias("_web"),
        (F.bool_or(discounted) & F.bool_or(~discounted)).alias("has_markdown_split"),
        X.true(F.bool_or(c("stock_on_hand") == 0) & F.bool_or(c("stock_on_hand").isNotNull() & (c("weeks_of_cover") > cover_excess)))
        .alias("has_stock_imbalance"),
        F.sum(speed * price).alias("_vp"), F.sum(speed).alias("_v"),
    ).where("n_stores >= 2")
    stats = stats.withColumns({
        "price_spread": X.ratio("_range", "median_price", 0.0),
        "bm_price_spread": F.coalesce(X.ratio("_bm_range", "_bm_median", 0.0), F.lit(0.0)),
        "ecomm_gap": F.coalesce(X.ratio(c("_bm_median") - c("_web"), "_bm_median", 0.0), F.lit(0.0)),
        "sync_price": F.coalesce(X.ratio("_vp", "_v"), c("median_price")),
    })
    wide, apart = c("bm_price_spread") > price_spread, X.true(c("discount_spread") > discount_spread)
    gap = F.abs("ecomm_gap") > ecomm_gap
    alerted = stats.where((wide & (c("_bm_stores") >= 2)) | apart | c("has_markdown_split") | c("has_stock_imbalance") | gap)
    tests = [(wide, "price_inconsistency_bm;"), (apart, "discount_spread;"), (c("has_markdown_split"), "markdown_split;"),
             (c("has_stock_imbalance"), "stock_imbalance;"), (gap, "ecomm_gap;")]
    reasons = F.concat(*[F.when(t, F.lit(name)).otherwise(F.lit("")) for t, name in tests])
    return now.join(alerted, PARENT).withColumn("alert_reasons", reasons).select(
        *PARENT, "centro", "week", "channel", "avg_precio_final", "discount_rate", "n_stores", "median_price", "price_spread",
        "discount_spread", "bm_price_spread", "ecomm_gap", "sync_price", "alert_reasons", "stock_on_hand", "weeks_of_cover",
        "velocity_4w")


def alert_reason_counts(alerts: DataFrame) -> DataFrame:
    return (
        alerts.select("brand", F.explode(F.split("alert_reasons", ";")).alias("reason")).where("reason <> ''")
        .groupBy("brand", "reason").agg(F.count(F.lit(1)).alias("n"))
    )


def cross_store_view(alerts: DataFrame, actions: DataFrame, stores: DataFrame, min_spread: float = 0.0,
                     limit: int | None = 50) -> DataFrame:
    """The ``limit`` alerted parents of each brand with the widest price spread (None: all), their stores nested after the cut."""
    names = actions.groupBy("brand", F.col("parent_sku").alias("codigo_padre")).agg(F.min("product").alias("product"))
    shops = stores.groupBy("centro").agg(F.min(X.store_name("sucursal")).alias("store_name"))
    shop = F.struct(
        F.col("centro").alias("store"), F.coalesce("store_name", "centro").alias("store_name"), "channel",
        F.col("avg_precio_final").cast("long").alias("price"), X.half_even("discount_rate", 3).alias("discount_rate"),
        F.col("stock_on_hand").cast("long").alias("stock_on_hand"), X.half_even("velocity_4w", 1).alias("velocity_4w"))
    parents = alerts.where(F.col("price_spread") >= min_spread).groupBy(*PARENT).agg(
        F.max("n_stores").alias("n_stores"), F.max("price_spread").alias("_spread"), X.half_even(F.max("discount_spread"), 3).alias("discount_spread"),
        F.max("sync_price").cast("long").alias("sync_price"), F.max("alert_reasons").alias("alert_reasons"))
    top = lookups.top_per(parents, "brand", [F.desc("_spread"), "codigo_padre"], limit).withColumn("price_spread", X.half_even("_spread", 3)).drop("_spread")
    nested = alerts.join(top.select(*PARENT), PARENT, "left_semi").join(shops, "centro", "left").groupBy(*PARENT).agg(F.array_sort(F.collect_list(shop)).alias("stores"))
    return top.join(nested, PARENT).join(names, PARENT, "left").withColumnRenamed("codigo_padre", "parent_sku")
