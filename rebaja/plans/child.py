"""Assembly of the child feature table."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rebaja.operators import margin, weekly as W
from rebaja.session import materialise


@dataclass(frozen=True)
class ChildInputs:
    """Input entities; absent optional ones are None."""

    transactions: DataFrame
    products: DataFrame
    stores: DataFrame
    traffic: DataFrame
    stock: DataFrame | None = None
    costs: DataFrame | None = None
    elasticity: DataFrame | None = None
    official_prices: DataFrame | None = None
    backorder: DataFrame | None = None
    replenishment: DataFrame | None = None
    weather: DataFrame | None = None
    contribution: DataFrame | None = None
    folios: DataFrame | None = None
    totals: DataFrame | None = None


def build_child_features(x: ChildInputs, dense: bool = False, strict_future: bool = False) -> DataFrame:
    """Weekly sales with every feature group, targets last.

    The aggregated sales are written once: later steps look at them again
    (first sales, shares of sizes, sizes selling, latest week, row counts) and
    would otherwise each read the transactions again.
    """
    weekly = materialise(W.weekly_sales(x.transactions, first=True, folios=x.folios, totals=x.totals), "weekly_sales")
    sold = weekly.select("brand", "sku", F.col("units_sold").alias("cantidad"), F.col("first_fecha").alias("fecha"))
    base = weekly.drop("first_fecha")
    skus = base.select("brand", "sku").distinct()
    df = base
    if x.official_prices is not None:
        df = W.apply_official_prices(df, x.official_prices, skus)
    df = W.velocity_features(df, dense)
    df = W.price_features(df)
    df = W.target_variables(df, strict_future)
    df = W.filter_active_rows(df)
    df = W.product_age(df, sold)
    if x.stock is not None:
        df = W.size_sales_share(df, sold, x.products)
    df = W.product_attributes(df, x.products)
    df = W.size_curve_completeness(df, x.products, base)
    df = W.seasonality_features(df)
    if x.stock is not None:
        df = W.stock_features(df, x.stock)
    if x.backorder is not None:
        df = W.backorder_features(df, x.backorder, base)
    if x.replenishment is not None:
        df = W.replenishment_features(df, x.replenishment, base)
    if x.weather is not None:
        df = W.weather_features(df, x.stores, x.weather)
    df = W.foot_traffic_features(df, x.traffic)
    if x.contribution is not None:
        parents = x.products.selectExpr("brand", "material AS sku", "codigo_padre").distinct()
        df = W.markdown_contribution(df, x.contribution, base.join(parents, ["brand", "sku"], "left"))
    if x.costs is not None and x.elasticity is not None:
        df = materialise(df, "child_before_margin")
        df = margin.margin_targets(df, x.costs, x.elasticity, margin.empirical_lift(df),
                                   df.selectExpr("brand", "coalesce(codigo_padre, sku) AS _code").distinct())
    return df
