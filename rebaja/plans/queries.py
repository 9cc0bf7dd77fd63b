"""Registry of queries: a DataFrame builder and, where SQL can say it, the SQL.

Builders get a ``WeeklyRun`` over the tables of one directory. Columns are
brought to fixed types on both sides. Doubles are rounded to six places after a
shift of 1e-9, since the engines break exact halves differently.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X, pricing as P
from rebaja.operators import alerts as AL, backtest as B, channel as CH, competitors as K, decisions as D, elasticity as E
from rebaja.operators import enhance as H, lifecycle as L, lookups as Q, margin as M, models as ML, names as N, outcomes as O
from rebaja.operators import parent as R, pricing as A, reports as RP, signals as S, sizes as Z, weekly as W
from rebaja.oracle import actions as _actions  # noqa: F401  (adds its steps)
from rebaja.oracle import steps as SQL
from rebaja.plans.result_types import RESULT_TYPES
from rebaja.plans.weekly_run import WeeklyRun
from rebaja.session import shared_dir
from rebaja.sources.retail import RetailTables
from rebaja.sources.steps import StepStore
from rebaja.streaming import weekly as SW

BUILDERS: dict[str, Callable[[WeeklyRun], DataFrame]] = {}
TEXTS: dict[str, str] = {}
_RUNS: dict[tuple[str, str], WeeklyRun] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        BUILDERS[name] = fn
        if sql is not None:
            TEXTS[name] = sql
        return fn
    return register


def run_of(spark: SparkSession, path: str) -> WeeklyRun:
    """One run per session and directory: its steps are tables shared by the queries."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _RUNS:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _RUNS[key] = WeeklyRun(RetailTables(spark, path))
    return _RUNS[key]


def _types(name: str) -> dict[str, str]:
    return dict(item.split(":") for item in RESULT_TYPES.get(name, "").split())


def typed(df: DataFrame, name: str) -> DataFrame:
    kinds = _types(name)
    if not kinds:
        return df

    def cast(c: str, kind: str) -> Column:
        if kind == "double":
            return (F.round(F.col(c).cast("double") + F.lit(1e-9), 6) + F.lit(0.0)).alias(c)
        return F.col(c).cast(kind).alias(c)

    return df.select(*[cast(c, k) for c, k in kinds.items()])


def typed_sql(name: str) -> str:
    text, kinds = TEXTS[name], _types(name)
    if kinds:
        def cast(c: str, kind: str) -> str:
            if kind == "double":
                return f"round(CAST({c} AS DOUBLE) + 1e-9, 6) + 0.0::DOUBLE AS {c}"
            return f"CAST({c} AS {'VARCHAR' if kind == 'string' else kind.upper()}) AS {c}"
        text = f"SELECT {', '.join(cast(c, k) for c, k in kinds.items())} FROM ({text})"
    return SQL.assemble(text)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name):
        return lambda spark, path: typed(BUILDERS[name](run_of(spark, path)), name)
    return {name: bind(name) for name in BUILDERS}


def all_sql() -> dict[str, str]:
    return {name: typed_sql(name) for name in TEXTS}


S4, P4 = SQL.S4, SQL.P4

# ------------------------------------------------------- sources and filters

_LINE = ["brand", "folio", "tipo_documento", "tipo_entrega", "codigo_descuento", "list_category", "fecha", "centro", "sku",
         "cantidad", "precio_lista", "descuento", "precio_final"]


@query("read_transactions", f"SELECT {', '.join(_LINE)} FROM fx_line")
def _(r):
    return r.t.transactions.select(*_LINE)


@query("column_pruned_read", "SELECT sku, centro, fecha, cantidad, precio_final FROM fx_line")
def _(r):
    return r.t.transactions.select("sku", "centro", "fecha", "cantidad", "precio_final")


@query("latest_snapshot", "SELECT p.* FROM parent_sales p JOIN (SELECT brand, max(week) AS week FROM parent_sales GROUP BY brand) USING (brand, week)")
def _(r):
    return RP.latest_snapshot(L.parent_weekly_sales(r.t.transactions, r.t.products))


@query("union_brands", "SELECT brand, codigo_padre, centro, week, alert_reasons FROM alerts")
def _(r):
    alerts = AL.cross_store_alerts(r.parent).select("brand", "codigo_padre", "centro", "week", "alert_reasons")
    parts = {b: alerts.where(F.col("brand") == b).drop("brand") for b in ("NORTE", "CENTRO", "SUR")}
    return RP.union_brands(parts)


@query("null_normalise", f"SELECT {S4}, discount_rate, velocity_lift, coalesce(color1, '') AS color1, coalesce(genero, '') AS genero FROM child")
def _(r):
    return RP.null_normalise(r.features.select(*W.WEEKLY, "discount_rate", "velocity_lift", "color1", "genero"))


_AUDIT_SQL = "SELECT brand, 'formula' AS user_email, status AS action, key, ts AS timestamp FROM decided"


def _audit(r):
    return D.decide_by_formula(r.history).select(
        "brand", F.lit("formula").alias("user_email"), F.col("status").alias("action"), "key", F.col("ts").alias("timestamp"))


@query("load_audit", f"SELECT * FROM ({_AUDIT_SQL}) WHERE brand = 'SUR' ORDER BY timestamp DESC, key, action LIMIT 100")
def _(r):
    return D.load_audit(_audit(r), "SUR", 100)


@query("load_feedback", """
SELECT brand, week, key, status IN ('approved', 'manual') AS implemented, ts
FROM decided JOIN (SELECT brand, max(week) AS week FROM decided GROUP BY brand) USING (brand, week)""")
def _(r):
    log = D.decide_by_formula(r.history).withColumn("implemented", F.col("status").isin("approved", "manual"))
    earlier = log.withColumns({"ts": F.col("ts") - F.expr("INTERVAL 1 DAY"), "implemented": ~F.col("implemented")})
    return D.load_feedback(log.unionByName(earlier))


@query("transaction_tags", f"""
SELECT brand, folio, sku, centro, fecha, coalesce(tipo_entrega = 'Retiro en Tienda', false) AS click_collect, codigo_descuento IS NOT NULL AS coupon,
       tipo_documento LIKE '%NOTA DE CREDITO%' AS credit_note, precio_lista > 0 AND descuento / precio_lista > 0.5::DOUBLE AS extreme,
       list_category IN ('liquidacion', 'outlet') AS markdown_list, {SQL.CLEAN} AS clean,
       CASE WHEN cantidad > 0 THEN 'sale' ELSE 'return' END AS kind FROM fx_line""")
def _(r):
    return r.t.transactions.select(
        "brand", "folio", "sku", "centro", "fecha", X.is_click_collect().alias("click_collect"), X.has_coupon().alias("coupon"),
        X.is_credit_note().alias("credit_note"), X.is_extreme_discount().alias("extreme"), X.is_markdown_list().alias("markdown_list"),
        X.is_clean_retail().alias("clean"), F.when(F.col("cantidad") > 0, "sale").otherwise("return").alias("kind"))


@query("exclude_service_skus", """
SELECT l.brand, l.sku, count(*) AS n FROM fx_line l JOIN fx_products p ON l.brand = p.brand AND l.sku = p.material
WHERE l.sku NOT IN ('000000001000000031', 'AJUSTE', 'HANDBAG01') GROUP BY l.brand, l.sku""")
def _(r):
    skus = r.t.products.select("brand", F.col("material").alias("sku"))
    return S.brand_rows(W.exclude_service_skus(r.t.transactions), skus).groupBy("brand", "sku").agg(F.count(F.lit(1)).alias("n"))


@query("pick_target_week", "SELECT * FROM target_week")
def _(r):
    return R.brand_weeks(r.parent)


@query("filter_stores", "SELECT brand, codigo_padre, centro, week, velocity_4w FROM parent WHERE centro <> '2003'")
def _(r):
    active = r.t.stores.where("centro <> '2003'").select("centro")
    brands = r.parent.select("brand").distinct()
    listed = active.withColumn("brand", F.explode(F.array(*[F.lit(b) for b in ("NORTE", "CENTRO", "SUR")]))).join(brands, "brand", "left_semi")
    return A.filter_stores(r.parent, listed).select("brand", "codigo_padre", "centro", "week", "velocity_4w")


@query("filter_actions", """
SELECT brand, week, parent_sku, store, urgency, status FROM act_status
WHERE vendor_brand = 'Nike' AND lower(category) LIKE '%footwear%' AND urgency = 'HIGH' AND action_type <> 'increase' AND status = 'approved'
  AND lower(product) LIKE '%small%'""")
def _(r):
    rows = A.filter_actions(r.history, vendor="nike", category="footwear", urgency="HIGH", search="small", status="approved", decisions=D.decide_by_formula(r.history))
    return rows.select("brand", "week", "parent_sku", "store", "urgency", F.lit("approved").alias("status"))


# ------------------------------------------------------------ child features

@query("weekly_sales", "SELECT * FROM weekly")
def _(r):
    return W.weekly_sales(r.t.transactions)


@query("weekly_sales_all_prices", f"""
SELECT {S4}, CAST(sum(cantidad) AS BIGINT) AS units_sold, avg(precio_final) AS avg_precio_final, avg(precio_lista) AS avg_precio_lista FROM sales GROUP BY {S4}""")
def _(r):
    return W.weekly_sales(r.t.transactions, exclude=False).select(*W.WEEKLY, "units_sold", "avg_precio_final", "avg_precio_lista")


@query("apply_official_prices", f"SELECT {S4}, avg_precio_lista FROM priced")
def _(r):
    weekly = W.weekly_sales(r.t.transactions)
    sold = r.t.transactions.where("cantidad > 0").select("brand", "sku").distinct()
    return W.apply_official_prices(weekly, r.t.official_prices, sold).select(*W.WEEKLY, "avg_precio_lista")


_VEL = ["velocity_1w", "velocity_2w", "velocity_4w", "velocity_8w", "velocity_trend", "cumulative_units", "instore_velocity_4w"]


@query("velocity_features", f"SELECT {S4}, {', '.join(_VEL)} FROM velocity")
def _(r):
    return W.velocity_features(W.weekly_sales(r.t.transactions)).select(*W.WEEKLY, *_VEL)


@query("velocity_dense", f"""
SELECT brand, centro, week, count(*) AS n_series, CAST(sum(units_sold) AS BIGINT) AS units_sold, sum(velocity_4w) AS velocity_4w, sum(velocity_8w) AS velocity_8w FROM (
SELECT *, avg(units_sold) OVER (PARTITION BY {SQL.S3} ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS velocity_4w,
       avg(units_sold) OVER (PARTITION BY {SQL.S3} ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS velocity_8w
FROM (SELECT {S4}, coalesce(units_sold, 0) AS units_sold
      FROM (SELECT {SQL.S3}, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM weekly GROUP BY {SQL.S3})
      LEFT JOIN weekly USING ({S4}))) GROUP BY brand, centro, week""")
def _(r):
    dense = W.velocity_features(W.weekly_sales(r.t.transactions), dense=True)
    return dense.groupBy("brand", "centro", "week").agg(
        F.count(F.lit(1)).alias("n_series"), *[F.sum(c).alias(c) for c in ("units_sold", "velocity_4w", "velocity_8w")])


@query("product_age", f"""
SELECT {S4}, first_sale_date, greatest(floor(date_diff('second', first_sale_date, CAST(week AS TIMESTAMP)) / 86400.0::DOUBLE) / 7, 0) AS product_age_weeks
FROM weekly JOIN age USING (brand, sku)""")
def _(r):
    return W.product_age(W.weekly_sales(r.t.transactions), r.t.transactions).select(*W.WEEKLY, "first_sale_date", "product_age_weeks")


_PRICE = ["price_changed", "price_change_pct", "has_discount", "weeks_since_discount", "cumulative_disc_weeks", "disc_exposure_rate", "max_discount_rate"]


@query("price_features", f"SELECT {S4}, {', '.join(_PRICE)} FROM child")
def _(r):
    weekly = W.weekly_sales(r.t.transactions)
    sold = r.t.transactions.where("cantidad > 0").select("brand", "sku").distinct()
    return W.price_features(W.apply_official_prices(weekly, r.t.official_prices, sold)).select(*W.WEEKLY, *_PRICE)


@query("size_curve_completeness", f"SELECT {S4}, codigo_padre, size_curve_completeness FROM child")
def _(r):
    return W.size_curve_completeness(W.weekly_sales(r.t.transactions), r.t.products).select(*W.WEEKLY, "codigo_padre", "size_curve_completeness")


_SEASON = ["month", "week_of_year", "quarter", "month_sin", "month_cos", "week_sin", "week_cos"]


@query("seasonality_features", f"SELECT DISTINCT week, {', '.join(_SEASON)} FROM child")
def _(r):
    return W.seasonality_features(r.t.lines.where("cantidad > 0").select("week").distinct()).select("week", *_SEASON)


_STOCK = ["stock_on_hand", "stock_in_transit", "stock_total", "stock_out_days", "weeks_of_cover", "stock_to_sales_ratio"]


@query("stock_features", f"SELECT {S4}, {', '.join(_STOCK)} FROM child")
def _(r):
    return W.stock_features(W.velocity_features(W.weekly_sales(r.t.transactions)), r.t.stock).select(*W.WEEKLY, *_STOCK)


@query("backorder_signal", "SELECT * FROM bo_signal")
def _(r):
    return S.backorder_signal(r.t.po_lines, r.t.receipts)


@query("backorder_features", f"SELECT {S4}, open_po_units, n_open_pos, days_to_delivery FROM child")
def _(r):
    signal = S.backorder_signal(r.t.po_lines, r.t.receipts)
    return W.backorder_features(W.weekly_sales(r.t.transactions), signal).select(*W.WEEKLY, "open_po_units", "n_open_pos", "days_to_delivery")


@query("replenishment_signal", "SELECT * FROM rp_signal")
def _(r):
    return S.replenishment_signal(r.t.transfers)


_REPL = ["units_in_transit", "units_received_window", "avg_transit_days", "n_transfers"]


@query("replenishment_features", f"SELECT {S4}, {', '.join(_REPL)} FROM child")
def _(r):
    signal = S.replenishment_signal(r.t.transfers)
    return W.replenishment_features(W.weekly_sales(r.t.transactions), signal).select(*W.WEEKLY, *_REPL)


@query("size_sales_share", "SELECT brand, sku, codigo_padre, sku_total_units, size_sales_share, size_rank FROM shares")
def _(r):
    return W.size_shares(r.t.transactions, r.t.products)


@query("traffic_weekly", "SELECT * FROM traffic_week")
def _(r):
    return W.traffic_weekly(r.t.traffic)


@query("foot_traffic_features", f"SELECT {S4}, weekly_entries, avg_dwell_time, conversion_rate FROM child")
def _(r):
    return W.foot_traffic_features(W.weekly_sales(r.t.transactions), r.t.traffic).select(*W.WEEKLY, "weekly_entries", "avg_dwell_time", "conversion_rate")


@query("product_attributes", f"SELECT {S4}, {', '.join(W.ATTRIBUTES)} FROM child")
def _(r):
    return W.product_attributes(W.weekly_sales(r.t.transactions), r.t.products).select(*W.WEEKLY, *W.ATTRIBUTES)


_MK = ["mkdown_contrib_2024_clp", "mkdown_contrib_2024_present", "mkdown_contrib_2024_parent_total"]


@query("markdown_contribution", f"SELECT {S4}, {', '.join(_MK)} FROM child")
def _(r):
    weekly = W.weekly_sales(r.t.transactions).join(Q.sku_parent(r.t.products), ["brand", "sku"], "left")
    return W.markdown_contribution(weekly, r.t.markdown_contribution).select(*W.WEEKLY, *_MK)


@query("weekly_weather", "SELECT * FROM weather_week")
def _(r):
    return W.weekly_weather(r.t.weather)


@query("store_weather", """
SELECT DISTINCT centro, week, avg_temp, max_temp, min_temp, total_rain, rain_days, temp_deviation, is_rainy_week FROM child""")
def _(r):
    weeks = r.t.lines.where("cantidad > 0").select("centro", "week").distinct()
    return W.weather_features(weeks, r.t.stores, r.t.weather)


_TARGET = ["will_discount_4w", "future_max_disc_4w", "future_velocity_2w", "velocity_lift"]


@query("target_variables", f"SELECT {S4}, {', '.join(_TARGET)} FROM child")
def _(r):
    df = W.price_features(W.velocity_features(W.weekly_sales(r.t.transactions)))
    return W.target_variables(df).select(*W.WEEKLY, *_TARGET)


@query("target_variables_strict", f"""
SELECT {S4}, CAST(coalesce(max(has_discount) OVER w, 0) AS INT) AS will_discount_4w, coalesce(max(discount_rate) OVER w, 0) AS future_max_disc_4w
FROM pricef WINDOW w AS (PARTITION BY {SQL.S3} ORDER BY week ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def _(r):
    df = W.price_features(W.velocity_features(W.weekly_sales(r.t.transactions)))
    return W.target_variables(df, strict_future=True).select(*W.WEEKLY, "will_discount_4w", "future_max_disc_4w")


@query("filter_active_rows", f"SELECT {S4} FROM child")
def _(r):
    return W.filter_active_rows(W.weekly_sales(r.t.transactions)).select(*W.WEEKLY)


@query("empirical_lift", "SELECT brand, step, lift FROM lift")
def _(r):
    return M.empirical_lift(r.features)


@query("empirical_lift_healthy", """
SELECT brand, s AS step, greatest(1.0::DOUBLE, max(l) OVER (PARTITION BY brand ORDER BY s ROWS UNBOUNDED PRECEDING)) AS lift
FROM (SELECT b.brand, d.s, CASE WHEN t.total >= 150 AND z.base > 0 AND m.n >= 50 AND m.med > 0 THEN round_even(m.med / z.base, 2) ELSE d.l END AS l
      FROM (SELECT DISTINCT brand FROM enh WHERE lifecycle_stage_code <= 3) b CROSS JOIN defaults9 d
      LEFT JOIN (SELECT brand, bucket, count(*) AS n, median(velocity_4w) AS med FROM (SELECT brand, velocity_4w,
                 (SELECT arg_min(s, (abs(s - discount_rate), s)) FROM steps9) AS bucket FROM enh WHERE lifecycle_stage_code <= 3) GROUP BY ALL) m ON m.brand = b.brand AND m.bucket = d.s
      LEFT JOIN (SELECT brand, count(*) AS total FROM enh WHERE lifecycle_stage_code <= 3 GROUP BY brand) t ON t.brand = b.brand
      LEFT JOIN (SELECT brand, CASE WHEN count(*) >= 50 THEN median(velocity_4w) END AS base FROM enh WHERE lifecycle_stage_code <= 3
                 AND (SELECT arg_min(s, (abs(s - discount_rate), s)) FROM steps9) = 0 GROUP BY brand) z ON z.brand = b.brand)""")
def _(r):
    return M.empirical_lift(r.enhanced.where("lifecycle_stage_code <= 3"))


@query("margin_targets", f"SELECT {S4}, optimal_disc_margin, should_reprice, optimal_profit FROM child")
def _(r):
    base = r.features.drop("optimal_disc_margin", "should_reprice", "optimal_profit")
    return M.margin_targets(base, r.t.costs, r.elasticity, M.empirical_lift(base)).select(
        *W.WEEKLY, "optimal_disc_margin", "should_reprice", "optimal_profit")


@query("child_features", "SELECT * FROM child")
def _(r):
    return r.child_features()


# ---------------------------------------------------------------- elasticity

@query("elasticity_panel", f"""
SELECT {S4}, codigo_padre, primera_jerarquia, segunda_jerarquia, units, txn_count, avg_price, avg_list_price, precio_normal, month, week_num, ln_units, ln_price,
       discount_depth, is_normal_price, CAST(discount_depth >= 0.07::DOUBLE AND discount_depth < 0.175::DOUBLE AS INT) AS md_tier_15,
       CAST(discount_depth >= 0.175::DOUBLE AND discount_depth < 0.25::DOUBLE AS INT) AS md_tier_20,
       CAST(discount_depth >= 0.25::DOUBLE AND discount_depth < 0.35::DOUBLE AS INT) AS md_tier_30, CAST(discount_depth >= 0.35::DOUBLE AS INT) AS md_tier_40 FROM panel""")
def _(r):
    return r.panel


@query("price_variation_gate", """
SELECT brand, codigo_padre, count(*) AS n, stddev_samp(avg_price) / avg(avg_price) AS price_cv FROM panel GROUP BY brand, codigo_padre
HAVING count(*) >= 10 AND stddev_samp(avg_price) / avg(avg_price) >= 0.05::DOUBLE""")
def _(r):
    return E.price_variation_gate(r.panel)


@query("elasticity_fast", "SELECT * FROM elasticity")
def _(r):
    return E.elasticity_fast(r.panel)


_VARIED = "count(*) >= 10 AND stddev_samp(avg_price) / avg(avg_price) >= 0.05::DOUBLE"


@query("elasticity_by_parent", f"SELECT *, h1 AS primera_jerarquia, h2 AS segunda_jerarquia FROM ({SQL.regression(['brand', 'codigo_padre'], _VARIED)})")
def _(r):
    return E.elasticity_by_parent(r.panel)


@query("elasticity_by_parent_tiers", f"SELECT *, h1 AS primera_jerarquia, h2 AS segunda_jerarquia FROM ({SQL.regression(['brand', 'codigo_padre'], _VARIED, tiers=True)})")
def _(r):
    return E.elasticity_by_parent(r.panel, tiers=True)


@query("elasticity_by_category", SQL.regression(["brand", "primera_jerarquia", "segunda_jerarquia"], "count(*) >= 30"))
def _(r):
    return E.elasticity_by_category(r.panel)


@query("attach_elasticity", f"""
SELECT {S4}, coalesce(r.elasticity, ce.elasticity) AS price_elasticity,
       CASE WHEN coalesce(r.elasticity, ce.elasticity) < -0.5::DOUBLE THEN 1 / (1 + abs(coalesce(r.elasticity, ce.elasticity))) END AS optimal_discount_rev
FROM child LEFT JOIN reliable r USING (brand, codigo_padre) LEFT JOIN cat_elasticity ce USING (brand, primera_jerarquia, segunda_jerarquia)""")
def _(r):
    return E.attach_elasticity(r.features, r.elasticity, r.category_elasticity).select(*W.WEEKLY, "price_elasticity", "optimal_discount_rev")


@query("elasticity_summary", f"""
SELECT brand, CASE WHEN grouping(sub) = 0 THEN 'subcategory' WHEN grouping(ven) = 0 THEN 'vendor' ELSE 'brand' END AS level, coalesce(sub, ven, 'all') AS name,
       count(*) AS sku_count, round(median(elasticity), 3) AS median_elasticity, count(*) FILTER (elasticity < -1) AS elastic_count,
       count(*) FILTER (elasticity > -0.5::DOUBLE) AS inelastic_count, count(*) FILTER (confidence = 'high') AS high_confidence
FROM (SELECT brand, segunda_jerarquia AS sub, {SQL.vendor('codigo_padre')} AS ven, elasticity, confidence FROM elasticity)
GROUP BY GROUPING SETS ((brand), (brand, sub), (brand, ven)) HAVING count(*) >= 3 OR (grouping(sub) = 1 AND grouping(ven) = 1)""")
def _(r):
    return E.elasticity_summary(r.elasticity)


@query("elasticity_bands", """
SELECT brand, band, count(*) AS n, count(*) / any_value(total) AS share FROM (
SELECT brand, CASE WHEN elasticity >= -10 AND elasticity < -3 THEN 'very_elastic' WHEN elasticity >= -3 AND elasticity < -2 THEN 'elastic'
       WHEN elasticity >= -2 AND elasticity < -1.5::DOUBLE THEN 'moderately_elastic' WHEN elasticity >= -1.5::DOUBLE AND elasticity < -1 THEN 'unit_elastic'
       WHEN elasticity >= -1 AND elasticity < -0.5::DOUBLE THEN 'inelastic' WHEN elasticity >= -0.5::DOUBLE AND elasticity < 0 THEN 'very_inelastic'
       WHEN elasticity >= 0 AND elasticity < 10 THEN 'positive' END AS band, count(*) OVER (PARTITION BY brand) AS total FROM elasticity)
WHERE band IS NOT NULL GROUP BY brand, band""")
def _(r):
    return E.elasticity_bands(r.elasticity)


# ------------------------------------------------------- lifecycle and sizes

@query("parent_weekly_sales", "SELECT * FROM parent_sales")
def _(r):
    return L.parent_weekly_sales(r.t.transactions, r.t.products)


@query("densify_weeks", "SELECT * FROM dense_sales")
def _(r):
    return L.densify_weeks(L.parent_weekly_sales(r.t.transactions, r.t.products))


@query("lifecycle_stage", "SELECT * FROM life")
def _(r):
    return L.lifecycle_stage(L.parent_weekly_sales(r.t.transactions, r.t.products))


@query("derive_season", "SELECT * FROM seasons")
def _(r):
    return r.seasons()


@query("stage_summary", """
SELECT brand, lifecycle_stage, count(*) AS n, avg(units) AS avg_units, avg(avg_discount_rate) AS avg_discount,
       count(*) / (SELECT count(*) FROM life t WHERE t.brand = l.brand) AS share FROM life l GROUP BY brand, lifecycle_stage""")
def _(r):
    return L.stage_summary(r.lifecycle)


@query("size_availability_stock", "SELECT * FROM size_stock")
def _(r):
    return Z.size_availability_stock(r.t.stock, r.t.products)


@query("size_availability_sales", "SELECT * FROM size_sales")
def _(r):
    return Z.size_availability_sales(r.t.transactions, r.t.products)


_ALERT_TEST = "attrition_rate > 0.3::DOUBLE OR core_sizes_lost >= 2 OR (core_completeness < 0.5::DOUBLE AND core_sizes_total > 0)"
_ALERT_SQL = f"""
SELECT s.*, CASE WHEN attrition_rate > 0.3::DOUBLE THEN 'high_attrition;' ELSE '' END || CASE WHEN core_sizes_lost >= 2 THEN 'core_sizes_lost;' ELSE '' END
       || CASE WHEN core_completeness < 0.5::DOUBLE AND core_sizes_total > 0 THEN 'low_core_completeness;' ELSE '' END AS alert_reasons
FROM size_stock s JOIN (SELECT brand, max(week) AS week FROM size_stock GROUP BY brand) USING (brand, week) WHERE {_ALERT_TEST}"""


@query("size_alerts", _ALERT_SQL)
def _(r):
    return Z.size_alerts(r.sizes)


@query("size_alert_view", f"""
SELECT brand, codigo_padre AS parent_sku, centro AS store, active_sizes_4w AS active_sizes, total_sizes_ever AS total_sizes,
       round_even(attrition_rate, 3) AS attrition_rate, round_even(core_completeness, 3) AS core_completeness, alert_reasons
FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY attrition_rate DESC, codigo_padre, centro) AS k FROM ({_ALERT_SQL}) WHERE attrition_rate >= 0.3::DOUBLE) WHERE k <= 30""")
def _(r):
    return Z.size_alert_view(Z.size_alerts(r.sizes))


_REL_SQL = f"""
SELECT *, avg(ahead) OVER (PARTITION BY {SQL.P3} ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS future_disc_4w
FROM (SELECT s.*, avg_discount_rate, lifecycle_stage, lead(avg_discount_rate) OVER (PARTITION BY {SQL.P3} ORDER BY week) AS ahead
      FROM size_stock s JOIN (SELECT {P4}, avg_discount_rate, lifecycle_stage FROM life) USING ({P4}))"""


@query("size_markdown_relation", f"SELECT {P4}, attrition_rate, avg_discount_rate, lifecycle_stage, future_disc_4w FROM ({_REL_SQL})")
def _(r):
    return Z.size_markdown_relation(r.sizes, r.lifecycle).select(
        *R.KEYS, "attrition_rate", "avg_discount_rate", "lifecycle_stage", "future_disc_4w")


@query("size_markdown_buckets", f"""
SELECT brand, kind, bucket, count(*) AS n, avg(future_disc_4w) AS avg_future_disc FROM (
SELECT brand, future_disc_4w, 'attrition' AS kind, CASE WHEN attrition_rate > 0 AND attrition_rate <= 0.1::DOUBLE THEN '0-10%' WHEN attrition_rate > 0.1::DOUBLE AND attrition_rate <= 0.2::DOUBLE THEN '10-20%'
       WHEN attrition_rate > 0.2::DOUBLE AND attrition_rate <= 0.3::DOUBLE THEN '20-30%' WHEN attrition_rate > 0.3::DOUBLE AND attrition_rate <= 0.5::DOUBLE THEN '30-50%'
       WHEN attrition_rate > 0.5::DOUBLE AND attrition_rate <= 1 THEN '50%+' END AS bucket FROM ({_REL_SQL})
UNION ALL SELECT brand, future_disc_4w, 'core', CASE WHEN core_completeness > 0 AND core_completeness <= 0.25::DOUBLE THEN '<25%' WHEN core_completeness > 0.25::DOUBLE AND core_completeness <= 0.5::DOUBLE THEN '25-50%'
       WHEN core_completeness > 0.5::DOUBLE AND core_completeness <= 0.75::DOUBLE THEN '50-75%' WHEN core_completeness > 0.75::DOUBLE THEN '75-100%' END FROM ({_REL_SQL}))
WHERE bucket IS NOT NULL GROUP BY ALL""")
def _(r):
    return Z.size_markdown_buckets(Z.size_markdown_relation(r.sizes, r.lifecycle))


@query("size_health_histogram", """
SELECT brand, band, count(*) AS n, count(*) / any_value(total) AS share FROM (
SELECT brand, CASE WHEN size_completeness < 0.25::DOUBLE THEN 'critical' WHEN size_completeness < 0.5::DOUBLE THEN 'poor' WHEN size_completeness < 0.75::DOUBLE THEN 'fair'
       WHEN size_completeness < 1 THEN 'good' ELSE 'full' END AS band, count(*) OVER (PARTITION BY brand) AS total FROM size_stock) GROUP BY brand, band""")
def _(r):
    return Z.size_health_histogram(r.sizes)


# ------------------------------------------------------ assembly and roll-up

_COMP = ["comp_min_price", "comp_avg_price", "comp_max_price", "comp_count", "comp_any_discount", "comp_max_discount", "comp_in_stock_count",
         "comp_price_index", "comp_price_gap_pct", "comp_undercut", "comp_discount_pressure"]


@query("competitor_features", f"SELECT {S4}, {', '.join(_COMP)} FROM enh")
def _(r):
    return H.competitor_features(r.features, r.t.competitor_prices).select(*W.WEEKLY, *_COMP)


_CATX = ["cat_x_lifecycle", "cat_x_season", "cat_x_velocity", "cat_x_age"]


@query("category_interactions", f"SELECT {S4}, {', '.join(_CATX)} FROM enhanced")
def _(r):
    return H.category_interactions(r.enhanced.drop(*_CATX)).select(*W.WEEKLY, *_CATX)


@query("velocity_terciles", "SELECT brand, quantile_cont(velocity_4w, 0.33::DOUBLE) AS q33, quantile_cont(velocity_4w, 0.66::DOUBLE) AS q66 FROM child GROUP BY brand")
def _(r):
    return H.velocity_terciles(r.features).selectExpr("brand", "_q33 AS q33", "_q66 AS q66")


@query("enhanced_features", "SELECT * FROM enhanced")
def _(r):
    return r.enhanced_features()


@query("weighted_size_features", "SELECT * FROM weighted")
def _(r):
    return R.weighted_size_features(r.t.stock, r.t.transactions, r.t.products)


@query("parent_features", "SELECT * FROM parent")
def _(r):
    return r.parent_features()


@query("parent_signals", f"""
SELECT {P4}, sum(open_po_units) AS open_po_units, sum(n_open_pos) AS n_open_pos, sum(units_in_transit) AS units_in_transit,
       sum(units_received_window) AS units_received_window, sum(n_transfers) AS n_transfers, min(days_to_delivery) AS days_to_delivery FROM enhanced GROUP BY {P4}""")
def _(r):
    return R.aggregate_to_parent(r.enhanced, r.t.products, signals=True).select(*R.KEYS, *R.SIGNAL_SUMS, "days_to_delivery")


# -------------------------------------------------------------------- signals

@query("active_rebates", """
SELECT b.brand, parent_sku, w.week, max(aporte_unitario) AS rebate FROM fx_rebates b
JOIN (SELECT DISTINCT brand, week FROM weekly) w ON w.brand = b.brand AND w.week BETWEEN fecha_inicio AND fecha_termino GROUP BY ALL""")
def _(r):
    return S.active_rebates(r.t.rebates, r.t.lines.where("cantidad > 0").select("brand", "week").distinct())


_VALIDITY = """
SELECT brand, codigo_padre AS sku, list_price AS precio_normal, DATE '1997-01-01' + INTERVAL (30 * size_ix) DAY AS fecha_inicio_validez,
       CASE WHEN size_ix < 6 THEN DATE '1998-06-01' + INTERVAL (40 * size_ix) DAY END AS fecha_fin_validez FROM fx_part"""


@query("valid_prices", f"""
SELECT brand, sku, max(precio_normal) AS list_price FROM ({_VALIDITY}) WHERE precio_normal > 0 AND fecha_inicio_validez <= DATE '1998-09-01'
  AND (fecha_fin_validez IS NULL OR fecha_fin_validez > DATE '1998-09-01') GROUP BY brand, sku""")
def _(r):
    ix = F.col("size_ix")
    prices = r.t.parts.select(
        "brand", F.col("codigo_padre").alias("sku"), F.col("list_price").alias("precio_normal"),
        F.date_add(F.to_date(F.lit("1997-01-01")), (ix * 30).cast("int")).alias("fecha_inicio_validez"),
        F.when(ix < 6, F.date_add(F.to_date(F.lit("1998-06-01")), (ix * 40).cast("int"))).alias("fecha_fin_validez"))
    return S.valid_prices(prices, F.to_date(F.lit("1998-09-01")))


@query("prefix_cost_lookup", """
SELECT s.brand, s.sku, arg_max(c.cost, length(c.sku)) AS cost FROM (SELECT DISTINCT brand, sku FROM fx_line) s
JOIN (SELECT brand, sku, cost FROM fx_costs UNION ALL SELECT brand, split_part(sku, '-', 1), max(cost) / 2 FROM fx_costs GROUP BY ALL) c
  ON c.brand = s.brand AND starts_with(s.sku, c.sku) GROUP BY s.brand, s.sku""")
def _(r):
    short = r.t.costs.groupBy("brand", F.substring_index("sku", "-", 1).alias("sku")).agg((F.max("cost") / 2).alias("cost"))
    return Q.prefix_lookup(r.t.lines, r.t.costs.unionByName(short), "sku", "sku", "cost")


@query("combine_costs", """
SELECT brand, sku, cost FROM fx_costs UNION ALL
SELECT brand, sku, CASE WHEN list_price / 1000 < 500 THEN list_price / 1000 * 1000 ELSE list_price / 1000 END AS cost
FROM (SELECT brand, codigo_padre AS sku, min(list_price) AS list_price FROM fx_part GROUP BY ALL) p
WHERE NOT EXISTS (SELECT 1 FROM fx_costs c WHERE c.brand = p.brand AND c.sku = p.sku)""")
def _(r):
    legacy = r.t.parts.groupBy("brand", F.col("codigo_padre").alias("sku")).agg((F.min("list_price") / 1000).alias("cost"))
    return S.combine_costs(r.t.costs, S.fallback_costs(legacy))


@query("latest_costs", """
SELECT brand, codigo_padre AS sku, CAST(round(avg(costo)) AS BIGINT) AS cost, count(DISTINCT sku) AS n_children_with_cost, any_value(n_total) AS n_children_total
FROM (SELECT l.brand, l.sku, l.centro, arg_max(precio_final, (fecha, precio_final)) AS costo FROM fx_line l
      WHERE precio_final > 0 AND fecha >= TIMESTAMP '2001-05-01' GROUP BY ALL)
JOIN parents USING (brand, sku) JOIN (SELECT brand, codigo_padre, count(*) AS n_total FROM parents GROUP BY ALL) USING (brand, codigo_padre) GROUP BY brand, codigo_padre""")
def _(r):
    costs = r.t.lines.select("brand", "sku", "centro", "fecha", F.col("precio_final").alias("costo"))
    return S.latest_costs(costs, Q.sku_parent(r.t.products), F.to_date(F.lit("2001-07-30")), 90)


_LISTS = ["Tienda", "Liquidación Verano", "Outlet Centro", "Tienda Eventos", "Tienda Virtual", "Promo Liq. final", "  "]


def _list_frames(r):
    # one line of a document carries its price list; the list follows the order number
    docs = r.t.lines.select(
        "brand", F.concat(F.lit("039-"), "folio").alias("folio_sii"), F.col("l_orderkey").alias("doc_facturacion"),
        F.col("centro").alias("tienda_codigo_sap"))
    invoices = r.t.lines.select(F.col("l_orderkey").alias("doc_facturacion"), (F.col("l_orderkey") % 7).alias("lista_precio_id")).distinct()
    lists = r.t.table("orders").select((F.col("o_orderkey") % 7).alias("lista_precio_id")).distinct().withColumn(
        "descripcion", F.element_at(F.array(*[F.lit(x) for x in _LISTS]), (F.col("lista_precio_id") + 1).cast("int")))
    return docs, invoices, lists


_LIST_SQL = """
SELECT DISTINCT brand, folio, centro, CASE l_orderkey % 7 WHEN 0 THEN 'Tienda' WHEN 1 THEN 'Liquidación Verano' WHEN 2 THEN 'Outlet Centro' WHEN 3 THEN 'Tienda Eventos'
       WHEN 4 THEN 'Tienda Virtual' WHEN 5 THEN 'Promo Liq. final' ELSE '  ' END AS list_name,
       CASE l_orderkey % 7 WHEN 0 THEN 'retail' WHEN 1 THEN 'liquidacion' WHEN 2 THEN 'outlet' WHEN 3 THEN 'eventos' WHEN 4 THEN 'online' WHEN 5 THEN 'liquidacion'
       ELSE 'unknown' END AS list_category FROM fx_line"""


@query("price_list_names", _LIST_SQL)
def _(r):
    return S.price_list_names(*_list_frames(r))


@query("enrich_price_list", f"""
SELECT l.brand, l.folio, l.centro, l.sku, l.fecha, l.cantidad, n.list_name, n.list_category FROM fx_line l JOIN ({_LIST_SQL}) n USING (brand, folio, centro)""")
def _(r):
    return S.enrich_price_list(r.t.transactions, S.price_list_names(*_list_frames(r))).select(
        "brand", "folio", "centro", "sku", "fecha", "cantidad", "list_name", "list_category")


@query("transfer_star", "SELECT brand, sku, codigo_padre, centro, fecha_creacion, fecha_recepcion, unidades FROM fx_transfers")
def _(r):
    t = r.t.transfers
    org = t.select(F.col("brand").alias("venta_organizacion_id")).distinct().withColumn("organizacion_ventas_nombre", F.col("venta_organizacion_id"))
    centres = t.select(F.concat_ws("/", "brand", "centro").alias("centro_id"), F.col("centro").alias("tienda_codigo_sap"),
                       F.col("brand").alias("venta_organizacion_id")).distinct()
    products = t.select(F.col("sku").alias("producto_id"), F.col("sku").alias("sku_sap"), F.col("codigo_padre").alias("sku_padre_sap")).distinct()
    key = F.concat_ws("/", F.col("fecha_creacion").cast("string"), F.coalesce(F.col("fecha_recepcion").cast("string"), F.lit("")))
    headers = t.select(key.alias("traspaso_cabecera_id"), "fecha_creacion", "fecha_recepcion").distinct()
    details = t.select(key.alias("traspaso_cabecera_id"), F.col("sku").alias("producto_id"),
                       F.concat_ws("/", "brand", "centro").alias("centro_destino_id"), "unidades")
    return S.transfer_star(details, headers, products, centres, org)


# -------------------------------------------------------- functions on tables

@query("vendor_brand", f"SELECT brand, material, {SQL.vendor('material')} AS vendor_brand FROM fx_products")
def _(r):
    return r.t.products.select("brand", "material", X.vendor_brand("material", "brand").alias("vendor_brand"))


@query("product_names", """
SELECT brand, material, trim(regexp_replace(material_descripcion, '\\s*N[°º]?\\s*[\\d,\\.]+\\s*$', '')) AS clean_name,
       segunda_jerarquia || ' ' || regexp_extract(codigo_padre, '(\\d+)-', 1) AS model, lower(trim(regexp_replace(material_descripcion, '\\s+N[°º]\\s*[\\d,\\.]+\\s*$', ''))) AS normal_name
FROM fx_products""")
def _(r):
    d = "material_descripcion"
    return r.t.products.select("brand", "material", X.clean_product_name(d).alias("clean_name"), X.model_name(d).alias("model"),
                               X.normalise_name(d).alias("normal_name"))


@query("store_names", "SELECT centro, trim(substr(sucursal, strpos(sucursal, '-') + 1)) AS store_name, CASE WHEN centro LIKE 'AB%' THEN 'ecomm' ELSE 'bm' END AS channel FROM fx_stores")
def _(r):
    return r.t.stores.select("centro", X.store_name("sucursal").alias("store_name"), X.channel_of("centro").alias("channel"))


@query("size_numbers", "SELECT brand, material, TRY_CAST(replace(talla, ',', '.') AS DOUBLE) AS size_number FROM fx_products")
def _(r):
    return r.t.products.select("brand", "material", X.size_number("talla").alias("size_number"))


@query("format_values", f"""
SELECT brand, folio, sku, fecha, precio_final, '$' || replace(format('{{:,}}', CAST(round_even(precio_final, 0) AS BIGINT)), ',', '.') AS clp,
       {SQL.pct('descuento / precio_lista')} AS pct_text, CAST(replace({SQL.pct('descuento / precio_lista')}, '%', '') AS DOUBLE) / 100 AS pct_value
FROM fx_line""")
def _(r):
    share = F.col("descuento") / F.col("precio_lista")
    return r.t.lines.select("brand", "folio", "sku", "fecha", "precio_final", X.format_clp("precio_final").alias("clp"), X.pct_text(share).alias("pct_text"),
                            X.parse_pct(X.pct_text(share)).alias("pct_value"))


@query("snap_prices", f"""
SELECT brand, folio, sku, fecha, precio_final, {SQL.snap_nearest('precio_final')} AS nearest, {SQL.snap_up('precio_final')} AS up, {SQL.snap_down('precio_final')} AS down,
       {SQL.snap_nearest('big')} AS nearest_big, {SQL.snap_up('big')} AS up_big, {SQL.snap_down('big')} AS down_big, {SQL.snap_disc('d')} AS step
FROM (SELECT *, precio_final * 17 AS big, descuento / precio_lista AS d FROM fx_line)""")
def _(r):
    big, d = F.col("precio_final") * 17, F.col("descuento") / F.col("precio_lista")
    return r.t.lines.select(
        "brand", "folio", "sku", "fecha", "precio_final", P.snap_price("precio_final").alias("nearest"), P.snap_price("precio_final", "up").alias("up"),
        P.snap_price("precio_final", "down").alias("down"), P.snap_price(big).alias("nearest_big"), P.snap_price(big, "up").alias("up_big"),
        P.snap_price(big, "down").alias("down_big"), P.snap_discount(d).alias("step"))


@query("expected_velocity", f"""
SELECT {P4}, s AS new_step, {SQL.velocity_down('velocity_4w', 'd', 's', 'e')} AS down, {SQL.velocity_both('velocity_4w', 'd', 's', 'e')} AS both_ways
FROM (SELECT *, coalesce(discount_rate, 0) AS d, price_elasticity AS e FROM parent) CROSS JOIN {SQL.ladder(C.PRICE_LADDER)} l(s)""")
def _(r):
    df = r.parent.select(*R.KEYS, "velocity_4w", F.coalesce("discount_rate", F.lit(0.0)).alias("d"), F.col("price_elasticity").alias("e"),
                         F.explode(P.price_ladder()).alias("new_step"))
    return df.select(*R.KEYS, "new_step", P.expected_velocity("velocity_4w", "d", "new_step", "e").alias("down"),
                     P.expected_velocity_bidir("velocity_4w", "d", "new_step", "e").alias("both_ways"))


# -------------------------------------------------------------------- pricing

_TRIO = ["brand", "codigo_padre", "centro", "week", "raw_cost", "rebate_amount", "unit_cost"]


@query("pricing_rows", f"SELECT {P4}, e AS elasticity, d AS disc_rate, product_name, total_sizes_catalog, store_name, raw_cost, rebate_amount, unit_cost, cur AS current_step, now_p AS price_now, n_sell FROM pricing_rows")
def _(r):
    return r.rows_for(r.parent.select("brand", "week").distinct()).select(
        *R.KEYS, "elasticity", "disc_rate", "product_name", "total_sizes_catalog", "store_name", "raw_cost", "rebate_amount", "unit_cost",
        "current_step", "price_now", "n_sell")


@query("cost_trio", f"SELECT {', '.join(_TRIO)} FROM pricing_rows")
def _(r):
    return A.cost_trio(r.parent.select(*R.KEYS), r.t.costs, r.t.rebates).select(*_TRIO)


_ACTION = [c.strip() for c in """brand, week, parent_sku, store, store_name, product, category, subcategory, sizes_selling, sizes_total, product_age_weeks, stock_on_hand,
weeks_of_cover, current_list_price, current_price, current_discount, current_velocity, recommended_price, recommended_discount, expected_velocity, current_weekly_rev,
expected_weekly_rev, rev_delta, unit_cost, raw_cost, rebate_amount, margin_pct, margin_delta, urgency, reasons, model_confidence, confidence_tier, action_type, vendor_brand,
click_collect_ratio""".split(",")]


def _all_rows(r):
    return r.history_rows


@query("price_increase_pass", f"SELECT {', '.join(_ACTION)} FROM acts WHERE action_type = 'increase'")
def _(r):
    return A.price_increase_pass(_all_rows(r))


@query("markdown_pass", f"SELECT {', '.join(_ACTION)} FROM acts WHERE action_type = 'decrease'")
def _(r):
    return A.markdown_pass(_all_rows(r))


@query("urgency", f"""
SELECT {P4}, {_actions.SCORE} AS score, CASE WHEN {_actions.SCORE} >= 5 THEN 'HIGH' WHEN {_actions.SCORE} >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
       CASE WHEN {_actions.REASONS} = '' THEN 'Model predicts markdown based on overall patterns' ELSE {_actions.REASONS} END AS reasons, {_actions.TIER} AS tier FROM pricing_rows""")
def _(r):
    rows = _all_rows(r)
    tier = A.confidence_tier(F.col("markdown_probability"), F.col("velocity_4w"), F.col("product_age_weeks"), F.col("has_elast"), False)
    return rows.select(*R.KEYS, A.urgency_score().alias("score"), A.urgency_label(A.urgency_score()).alias("urgency"),
                       A.urgency_reasons().alias("reasons"), tier.alias("tier"))


@query("weekly_actions", "SELECT * FROM acts_now")
def _(r):
    return A.weekly_actions(r.rows)


@query("weekly_actions_all_weeks", "SELECT * FROM acts")
def _(r):
    return r.history


_ORDERS = {"urgency": "CASE urgency WHEN 'INCREASE' THEN -1 WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, rev_delta DESC", "revenue": "abs(rev_delta) DESC",
           "confidence": "model_confidence DESC NULLS LAST", "store": "store_name NULLS FIRST", "age": "product_age_weeks DESC NULLS LAST",
           "discount": "CASE recommended_discount WHEN 'Full price' THEN 0.0::DOUBLE ELSE CAST(replace(recommended_discount, '%', '') AS DOUBLE) / 100 END DESC"}


def _past_runs(r) -> StepStore:
    """A store as five runs, a week apart, have left it: the newest five weeks of actions of each brand."""
    if not hasattr(r, "past_runs"):
        store = StepStore(r.t.spark, f"{shared_dir(r.t.spark)}/rebaja/steps-{uuid.uuid4().hex[:8]}")
        rank = F.dense_rank().over(Window.partitionBy("brand").orderBy(F.desc("week")))
        weeks = r.history.select("brand", "week").distinct().withColumn("age", rank).where("age <= 5").drop("age")
        store.write("actions", r.history.join(F.broadcast(weeks), ["brand", "week"], "left_semi"))
        r.past_runs = store
    return r.past_runs


@query("published_latest", "SELECT a.* FROM acts a JOIN (SELECT brand, max(week) AS week FROM acts GROUP BY brand) USING (brand, week)")
def _(r):
    return _past_runs(r).latest("actions")


@query("published_changes", """
SELECT brand, parent_sku, store, c.week AS week, c.recommended_price AS recommended_price, p.recommended_price AS previous_price FROM acts c JOIN acts p USING (brand, parent_sku, store)
JOIN (SELECT brand, week, row_number() OVER (PARTITION BY brand ORDER BY week DESC) AS age FROM (SELECT DISTINCT brand, week FROM acts)) n ON n.brand = c.brand AND n.week = c.week AND n.age = 1
JOIN (SELECT brand, week, row_number() OVER (PARTITION BY brand ORDER BY week DESC) AS age FROM (SELECT DISTINCT brand, week FROM acts)) b ON b.brand = p.brand AND b.week = p.week AND b.age = 2
WHERE c.recommended_price <> p.recommended_price""")
def _(r):
    two = _past_runs(r).latest("actions", 2)
    newest = two.groupBy("brand").agg(F.max("week").alias("newest"))
    keys = ["brand", "parent_sku", "store"]
    told = two.join(F.broadcast(newest), "brand")
    before = told.where("week < newest").select(*keys, F.col("recommended_price").alias("previous_price"))
    return told.where("week = newest").join(before, keys).where("recommended_price <> previous_price").select(*keys, "week", "recommended_price", "previous_price")


@query("order_actions", f"""
SELECT brand, week, parent_sku, store, urgency, rev_delta, row_number() OVER (PARTITION BY brand ORDER BY {_ORDERS['urgency']}, parent_sku, store) AS place FROM acts_now""")
def _(r):
    return A.placed_actions(r.actions).select("brand", "week", "parent_sku", "store", "urgency", "rev_delta", "place")


@query("action_orders", " UNION ALL ".join(
    f"SELECT '{name}' AS sort, brand, parent_sku, store, row_number() OVER (PARTITION BY brand ORDER BY {by}, parent_sku, store) AS place FROM acts_now" for name, by in _ORDERS.items()))
def _(r):
    parts = [A.placed_actions(r.actions, name).select(F.lit(name).alias("sort"), "brand", "parent_sku", "store", "place") for name in _ORDERS]
    return reduce(DataFrame.unionByName, parts)


@query("page_by_place", f"""
SELECT brand, parent_sku, store, place FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY {_ORDERS['confidence']}, parent_sku, store) AS place FROM acts_now) WHERE place > 10 AND place <= 20""")
def _(r):
    return A.page_by_place(A.placed_actions(r.actions, "confidence"), 2, 10).select("brand", "parent_sku", "store", "place")


@query("page_of_actions", """
SELECT brand, parent_sku, store, current_velocity FROM acts_now ORDER BY model_confidence DESC, brand, parent_sku, store LIMIT 10 OFFSET 10""")
def _(r):
    return A.page(r.actions, 2, 10, "confidence").select("brand", "parent_sku", "store", "current_velocity")


@query("channel_actions", "SELECT * FROM channel")
def _(r):
    rows = _all_rows(r)
    return CH.channel_actions(rows, r.history, r.t.costs, r.elasticity)


@query("channel_variance", "SELECT brand, week, parent_sku, channel, variance AS variance_pct FROM ch_variance")
def _(r):
    acts = r.history.withColumn("channel", X.channel_of("store"))
    return CH.step_variance(acts, ["brand", "week", "parent_sku", "channel"]).select("brand", "week", "parent_sku", "channel", "variance_pct")


@query("top_reasons", "SELECT * FROM ch_reasons")
def _(r):
    return CH.top_reasons(r.history.withColumn("channel", X.channel_of("store")), ["brand", "week", "parent_sku", "channel"])


@query("channel_gap_stats", """
SELECT brand, week, count(*) AS n_channel_actions, count(*) FILTER (mandatory_review) AS n_mandatory_review, round_even(avg(gap_pct), 2) AS gap_pct_mean,
       round_even(median(gap_pct), 2) AS gap_pct_median, round_even(quantile_cont(gap_pct, 0.75::DOUBLE), 2) AS gap_pct_p75, round_even(quantile_cont(gap_pct, 0.95::DOUBLE), 2) AS gap_pct_p95,
       round(sum(chain_uniform_profit), 2) AS total_chain_uniform_profit, round(sum(sum_per_store_profit), 2) AS total_sum_per_store_profit,
       round_even(avg(per_store_variance_pct), 3) AS variance_pct_mean,
       round_even(avg(CAST(aggregation_method = 'velocity_weighted_fallback' AS DOUBLE)) * 100, 1) AS pct_fallback FROM channel JOIN target_week USING (brand, week) GROUP BY brand, week""")
def _(r):
    return CH.channel_gap_stats(r.channel_actions)


_MANUAL = f"""
SELECT *, {SQL.snap_nearest('mp')} AS snap FROM (SELECT a.*, recommended_price * 1.07::DOUBLE + 300 AS mp, e.elasticity AS e FROM acts a LEFT JOIN
(SELECT brand, codigo_padre AS parent_sku, elasticity FROM elasticity) e USING (brand, parent_sku)) JOIN target_week USING (brand, week)"""


@query("manual_price_impact", f"""
SELECT brand, parent_sku, store, mp AS manual_price, snap AS snapped_price, round_even(v, 1) AS velocity, CAST(trunc(v * snap) AS BIGINT) AS weekly_revenue, m AS margin_pct,
       CASE WHEN unit_cost > 0 THEN CAST(trunc((snap / 1.19::DOUBLE - unit_cost) * v - (current_price / 1.19::DOUBLE - unit_cost) * current_velocity) AS BIGINT) END AS margin_delta,
       CASE WHEN unit_cost IS NULL OR unit_cost <= 0 THEN 'no_cost_data' WHEN m < 0 THEN 'below_cost' WHEN m < 15 THEN 'below_margin_floor' WHEN m < 20 THEN 'thin_margin' END AS warning
FROM (SELECT *, {SQL.velocity_down('current_velocity', 'd0', 'd1', 'e')} AS v, CASE WHEN unit_cost > 0 THEN round_even((snap / 1.19::DOUBLE - unit_cost) / (snap / 1.19::DOUBLE) * 100, 1) END AS m
      FROM (SELECT *, 1 - current_price / current_list_price AS d0, greatest(0::DOUBLE, least(1 - snap / current_list_price, 0.5::DOUBLE)) AS d1 FROM ({_MANUAL})))""")
def _(r):
    prices = r.actions.select("brand", "parent_sku", "store", (F.col("recommended_price") * F.lit(1.07) + 300).alias("manual_price"))
    return A.manual_price_impact(r.actions, prices, r.elasticity)


_GRID = f"""
SELECT *, {SQL.velocity_both('current_velocity', 'd0', 's', 'e')} AS v, {SQL.snap_nearest('raw')} AS p FROM (
SELECT a.*, s, 1 - current_price / current_list_price AS d0, current_list_price * (1 - s) AS raw, e.elasticity AS e FROM acts a JOIN target_week USING (brand, week)
LEFT JOIN (SELECT brand, codigo_padre AS parent_sku, elasticity FROM elasticity) e USING (brand, parent_sku) CROSS JOIN {SQL.ladder(C.PRICE_LADDER)} l(s))"""


@query("promotion_grid", f"""
SELECT *, row_number() OVER (PARTITION BY brand ORDER BY margin DESC, discount) = 1 AS is_best FROM (
SELECT brand, s AS discount, count(*) AS n_items, round(sum(v * 4), 4) AS units, round(sum(v * p * 4), 2) AS revenue,
       round(sum(CASE WHEN unit_cost > 0 THEN p / 1.19::DOUBLE - unit_cost END * v * 4), 2) AS margin FROM ({_GRID}) GROUP BY brand, s)""")
def _(r):
    return A.promotion_grid(r.actions, r.elasticity)


_RECS = """
SELECT *, row_number() OVER (PARTITION BY brand, week ORDER BY prio DESC, sku, centro) AS rank FROM (
SELECT *, round(markdown_probability * greatest(coalesce(velocity_4w * avg_precio_lista, 0), 0) * CASE WHEN velocity_trend < 0.8::DOUBLE THEN 1.2::DOUBLE ELSE 1 END, 6) AS prio
FROM child_scored) WHERE markdown_probability >= 0.3::DOUBLE"""


@query("recommendations", f"""
SELECT brand, week, rank, sku, material_descripcion AS product_name, talla, centro AS store_code, codigo_padre AS parent_sku, markdown_probability,
       CASE WHEN markdown_probability > 0.75::DOUBLE THEN 'high' WHEN markdown_probability > 0.5::DOUBLE THEN 'medium' WHEN markdown_probability > 0.3::DOUBLE THEN 'low' ELSE 'skip' END AS confidence,
       raw_depth AS recommended_depth, prio AS priority_score, velocity_4w AS weekly_velocity, velocity_trend, has_discount AS currently_discounted,
       velocity_4w * avg_precio_lista AS estimated_weekly_revenue
FROM ({_RECS}) JOIN (SELECT brand, material AS sku, material_descripcion, talla FROM fx_products) USING (brand, sku) WHERE rank <= 100""")
def _(r):
    scored = A.formula_scores(r.enhanced)
    return A.recommendations(scored, r.t.products, r.enhanced.select("brand", "week").distinct())


@query("recommendations_by_parent", f"""
SELECT * FROM (SELECT brand, week, codigo_padre AS parent_sku, count(*) AS n_variants, avg(markdown_probability) AS avg_probability, avg(raw_depth) AS avg_depth, max(prio) AS max_priority,
       row_number() OVER (PARTITION BY brand, week ORDER BY max(prio) DESC, codigo_padre) AS rank FROM ({_RECS}) WHERE rank <= 100 GROUP BY brand, week, codigo_padre) WHERE rank <= 15""")
def _(r):
    recs = A.recommendations(A.formula_scores(r.enhanced), r.t.products, r.enhanced.select("brand", "week").distinct())
    return A.recommendations_by_parent(recs)


@query("child_scores_to_parent", f"""
SELECT {P4}, sum(velocity_4w) AS velocity_4w, sum(velocity_8w) AS velocity_8w, median(avg_precio_lista) AS avg_precio_lista, median(discount_rate) AS discount_rate,
       avg(markdown_probability) AS markdown_probability, count(*) FILTER (units_sold > 0) AS sizes_selling,
       CASE WHEN sum(velocity_8w) > 0 THEN sum(velocity_4w) / sum(velocity_8w) ELSE 1 END AS velocity_trend FROM child_scored GROUP BY {P4}""")
def _(r):
    return R.child_scores_to_parent(A.formula_scores(r.enhanced)).select(
        *R.KEYS, "velocity_4w", "velocity_8w", "avg_precio_lista", "discount_rate", "markdown_probability", "sizes_selling", "velocity_trend")


# ------------------------------------------------------- alerts and decisions

@query("cross_store_alerts", "SELECT * FROM alerts")
def _(r):
    return AL.cross_store_alerts(r.parent)


@query("alert_reason_counts", "SELECT brand, reason, count(*) AS n FROM (SELECT brand, unnest(string_split(alert_reasons, ';')) AS reason FROM alerts) WHERE reason <> '' GROUP BY ALL")
def _(r):
    return AL.alert_reason_counts(AL.cross_store_alerts(r.parent))


@query("cross_store_view", """
SELECT v.* EXCLUDE (k, spread), product FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY spread DESC, parent_sku) AS k FROM (SELECT brand, codigo_padre AS parent_sku, max(price_spread) AS spread, max(n_stores) AS n_stores, round_even(max(price_spread), 3) AS price_spread,
       round_even(max(discount_spread), 3) AS discount_spread, CAST(trunc(max(sync_price)) AS BIGINT) AS sync_price, max(alert_reasons) AS alert_reasons,
       string_agg(centro || ':' || CAST(CAST(trunc(avg_precio_final) AS BIGINT) AS VARCHAR), ',' ORDER BY centro) AS stores
FROM alerts GROUP BY brand, codigo_padre)) v
LEFT JOIN (SELECT brand, parent_sku, min(product) AS product FROM acts_now GROUP BY ALL) USING (brand, parent_sku) WHERE k <= 50""")
def _(r):
    view = AL.cross_store_view(AL.cross_store_alerts(r.parent), r.actions, r.t.stores)
    shops = F.array_join(F.transform("stores", lambda s: F.concat_ws(":", s["store"], s["price"].cast("string"))), ",")
    return view.withColumn("stores", shops)


@query("decisions_by_formula", "SELECT * FROM decided")
def _(r):
    return D.decide_by_formula(r.history)


def _log(r):
    """Events: every decision; an undo a day later for rejected ones; a bulk approval of everything two days later."""
    base = D.decide_by_formula(r.history).withColumn("bulk", F.lit(False))
    undo = base.where("status = 'rejected'").withColumns({"status": F.lit(""), "manual_price": F.lit(None).cast("double"),
                                                          "ts": F.col("ts") + F.expr("INTERVAL 1 DAY")})
    bulk = r.history.select("brand", "week", D.decision_key(r.history).alias("key"), F.lit("approved").alias("status"),
                            F.lit(None).cast("double").alias("manual_price"), (F.col("week").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("ts"),
                            F.lit(True).alias("bulk"))
    return base.unionByName(undo).unionByName(bulk)


@query("apply_decisions", """
SELECT brand, week, key, CASE WHEN status IS NULL OR status = 'rejected' THEN 'approved' ELSE status END AS status,
       d.manual_price, CASE WHEN status IS NULL OR status = 'rejected' THEN CAST(week AS TIMESTAMP) + INTERVAL 2 DAY ELSE d.ts END AS ts
FROM (SELECT brand, week, parent_sku || '-' || store AS key FROM acts) a LEFT JOIN decided d USING (brand, week, key)""")
def _(r):
    return D.apply_decisions(_log(r)).drop("event_user")


@query("chain_fanout", """
SELECT * FROM (SELECT brand, week, key, status, CAST(NULL AS VARCHAR) AS chain_key FROM decided UNION ALL
SELECT brand, week, parent_sku || '-' || store, 'approved', parent_sku || '-chain-bm' FROM acts a WHERE store NOT LIKE 'AB%'
  AND NOT EXISTS (SELECT 1 FROM decided d WHERE d.brand = a.brand AND d.week = a.week AND d.key = parent_sku || '-' || store))""")
def _(r):
    chain = r.history.select("brand", "week", "parent_sku").distinct().withColumns(
        {"chain_scope": F.lit("bm"), "status": F.lit("approved"), "ts": F.col("week").cast("timestamp")})
    return D.chain_fanout(chain, r.history, D.decide_by_formula(r.history)).select("brand", "week", "key", "status", "chain_key")


def _planned(r):
    """Planners approve every brand-manager approval of a store whose code is even."""
    dec = D.decide_by_formula(r.history)
    return dec.where("status = 'bm_approved'").select("brand", "week", "key", F.lit("planner_approved").alias("planner_status"))


@query("planner_transition", """
SELECT brand, week, key, CASE WHEN status = 'bm_approved' THEN 'planner_approved' ELSE status END AS status,
       CASE WHEN status = 'bm_approved' THEN status END AS bm_status, CASE WHEN status = 'bm_approved' THEN 'planner_approved' END AS planner_status FROM decided""")
def _(r):
    return D.planner_transition(D.decide_by_formula(r.history), _planned(r)).select("brand", "week", "key", "status", "bm_status", "planner_status")


@query("planner_queue", """
SELECT brand, week, parent_sku, store, key, d.status AS bm_status, d.manual_price FROM (SELECT brand, week, parent_sku, store, parent_sku || '-' || store AS key FROM acts) a
JOIN decided d USING (brand, week, key) WHERE d.status <> 'bm_approved'""")
def _(r):
    moved = D.planner_transition(D.decide_by_formula(r.history), _planned(r)).drop("bm_status")
    return D.planner_queue(r.history, moved).select("brand", "week", "parent_sku", "store", "key", "bm_status", "manual_price")


@query("planner_roster", """
SELECT a.brand, store_name AS name, count(*) AS n, CAST(sum(rev_delta) AS BIGINT) AS rev_delta FROM act_status_now a WHERE status IS NOT NULL GROUP BY ALL""")
def _(r):
    return D.planner_roster(D.planner_queue(r.actions, D.decide_by_formula(r.history)))


@query("export_rows", """
SELECT brand, week, parent_sku, store, status, CASE WHEN status = 'manual' THEN recommended_price + 1000 ELSE recommended_price END AS recommended_price, margin_pct,
       expected_velocity, CASE WHEN action_type = 'increase' THEN 'increase' ELSE 'markdown' END AS section FROM act_status WHERE status IN ('approved', 'manual')""")
def _(r):
    return D.export_rows(r.history, D.decide_by_formula(r.history)).select(
        "brand", "week", "parent_sku", "store", "status", "recommended_price", "margin_pct", "expected_velocity", "section")


_CHANNEL_STATUS = """
SELECT *, parent_sku || '-' || channel AS key, CASE CAST(regexp_extract(parent_sku, '(\\d+)-', 1) AS INTEGER) % 5 WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'manual'
       WHEN 4 THEN 'bm_approved' END AS status FROM channel JOIN target_week USING (brand, week)"""


def _channel_decisions(r):
    """Decisions per channel; planners approve what brand managers approved for the web shop."""
    decided = D.decide_by_formula(r.channel_actions)
    planned = decided.where("status = 'bm_approved' and key like '%-ecomm'").select(*D.KEYS, F.lit("planner_approved").alias("planner_status"))
    return D.planner_transition(decided, planned).drop("bm_status")


@query("channel_planner_queue", f"""
SELECT brand, week, parent_sku, channel, key, status AS bm_status, CASE WHEN status = 'manual' THEN recommended_price + 1000 END AS manual_price
FROM ({_CHANNEL_STATUS}) WHERE status IS NOT NULL AND NOT (status = 'bm_approved' AND channel = 'ecomm')""")
def _(r):
    return D.planner_queue(r.channel_actions, _channel_decisions(r)).select("brand", "week", "parent_sku", "channel", "key", "bm_status", "manual_price")


@query("channel_planner_roster", f"""
SELECT brand, CASE channel WHEN 'ecomm' THEN 'Ecomm' ELSE 'B&M' END AS name, count(*) AS n, sum(rev_delta) AS rev_delta
FROM ({_CHANNEL_STATUS}) WHERE status IS NOT NULL AND NOT (status = 'bm_approved' AND channel = 'ecomm') GROUP BY ALL""")
def _(r):
    return D.planner_roster(D.planner_queue(r.channel_actions, _channel_decisions(r)))


@query("channel_export_rows", f"""
SELECT brand, week, parent_sku, channel, CASE status WHEN 'bm_approved' THEN 'planner_approved' ELSE status END AS status,
       recommended_price + CASE WHEN status = 'manual' THEN 1000 ELSE 0 END AS recommended_price, margin_pct, expected_velocity,
       CASE WHEN action_type = 'increase' THEN 'increase' ELSE 'markdown' END AS section
FROM ({_CHANNEL_STATUS}) WHERE status IN ('approved', 'manual') OR (status = 'bm_approved' AND channel = 'ecomm')""")
def _(r):
    return D.export_rows(r.channel_actions, _channel_decisions(r)).select(
        "brand", "week", "parent_sku", "channel", "status", "recommended_price", "margin_pct", "expected_velocity", "section")


# ------------------------------------------------------------------- outcomes

@query("eval_weeks", "SELECT brand, week FROM oc_weeks")
def _(r):
    return O.eval_weeks(r.history, D.decide_by_formula(r.history))


@query("actual_metrics", "SELECT * FROM actual")
def _(r):
    weeks = O.eval_weeks(r.history, D.decide_by_formula(r.history))
    return O.actual_metrics(r.t.transactions, r.t.products, weeks)


@query("outcomes", "SELECT * FROM outcome")
def _(r):
    return O.outcomes(r.history, D.decide_by_formula(r.history), r.t.transactions, r.t.products, r.t.costs)


@query("outcomes_all_weeks")
def _(r):
    return O.outcomes(r.history, D.decide_by_formula(r.history), r.t.transactions, r.t.products, r.t.costs, lookback=10_000)


@query("outcome_summary", """
SELECT brand, CASE WHEN grouping(confidence_tier) = 0 THEN 'confidence' WHEN grouping(action_type) = 0 THEN 'action' ELSE 'brand' END AS level,
       coalesce(confidence_tier, action_type, 'all') AS name, count(*) AS n, count(DISTINCT decision_week) AS weeks_evaluated,
       round_even(median(velocity_error_pct), 1) AS median_velocity_error_pct, round_even(avg(CAST(direction_correct AS INT)) * 100, 1) AS pct_direction_correct,
       round_even(round(avg(actual_lift_vs_baseline), 6), 1) AS avg_actual_rev_lift,
       round_even(median(CASE WHEN abs(predicted_lift_vs_baseline) > 0.1::DOUBLE THEN round(greatest(-5, least(5, actual_lift_vs_baseline / predicted_lift_vs_baseline)), 6) END) * 100, 1) AS lift_capture_rate
FROM outcome WHERE data_quality = 'normal' GROUP BY GROUPING SETS ((brand), (brand, confidence_tier), (brand, action_type))""")
def _(r):
    return O.outcome_summary(r.outcomes)


@query("outcome_details", """
SELECT * FROM outcome WHERE data_quality = 'normal' QUALIFY row_number() OVER (PARTITION BY brand ORDER BY abs(velocity_error_pct) DESC NULLS LAST, parent_sku, store, decision_week) <= 200""")
def _(r):
    return O.outcome_details(r.outcomes)


@query("worst_predictions", """
SELECT brand, parent_sku, store, predicted_velocity, actual_velocity, velocity_error_pct, confidence_tier, decision_week FROM outcome
WHERE data_quality = 'normal' AND velocity_error_pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY brand ORDER BY abs(velocity_error_pct) DESC, parent_sku, store, decision_week) <= 5""")
def _(r):
    return O.worst_predictions(r.outcomes)


# -------------------------------------------------------------------- reports

@query("brand_overview", """
SELECT brand, week, count(*) AS total_actions, count(status) AS decided, count(*) FILTER (status IN ('approved', 'bm_approved', 'manual', 'bm_manual', 'planner_approved')) AS approved,
       count(*) - count(status) AS pending, count(*) FILTER (action_type = 'increase') AS increases, count(*) FILTER (action_type <> 'increase') AS decreases,
       coalesce(sum(rev_delta), 0) AS rev_delta, coalesce(sum(margin_delta), 0) AS margin_delta, count(*) FILTER (margin_pct < 20 AND margin_pct <> 0) AS thin_margin_count
FROM act_status GROUP BY brand, week""")
def _(r):
    return RP.brand_overview(r.history, D.decide_by_formula(r.history))


@query("impact_breakdown", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, dimension ORDER BY abs(rev_delta) DESC, name) AS rank FROM (
SELECT brand, dimension, name, coalesce(sum(rev_delta), 0) AS rev_delta, coalesce(sum(margin_delta), 0) AS margin_delta, count(*) AS n FROM (
SELECT brand, 'store_name' AS dimension, store_name AS name, rev_delta, margin_delta FROM acts_now UNION ALL SELECT brand, 'subcategory', subcategory, rev_delta, margin_delta FROM acts_now
UNION ALL SELECT brand, 'vendor_brand', vendor_brand, rev_delta, margin_delta FROM acts_now) GROUP BY brand, dimension, name)) WHERE rank <= 10""")
def _(r):
    return RP.impact_breakdown(r.actions)


@query("action_distributions", """
SELECT brand, dimension, value, count(*) AS n FROM (SELECT brand, 'urgency' AS dimension, urgency AS value FROM acts_now UNION ALL SELECT brand, 'action_type', action_type FROM acts_now
UNION ALL SELECT brand, 'confidence_tier', confidence_tier FROM acts_now) GROUP BY ALL""")
def _(r):
    return RP.action_distributions(r.actions)


@query("weekly_report", """
SELECT b.*, top_opportunities, coalesce(competitor_products, 0) AS competitor_products, coalesce(cross_store_alerts, 0) AS cross_store_alerts FROM (
SELECT brand, week, count(*) AS total, count(*) FILTER (urgency = 'HIGH') AS high, count(*) FILTER (urgency = 'MEDIUM') AS medium, count(*) FILTER (action_type = 'increase') AS increases,
       count(*) FILTER (action_type = 'decrease') AS decreases, coalesce(sum(rev_delta), 0) AS rev_delta, coalesce(sum(margin_delta), 0) AS margin_delta FROM acts_now GROUP BY brand, week) b
LEFT JOIN (SELECT brand, string_agg(parent_sku || ':' || rev_delta, '; ' ORDER BY k) AS top_opportunities FROM (
  SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rev_delta DESC, parent_sku, store) AS k FROM acts_now) WHERE k <= 3 GROUP BY brand) USING (brand)
LEFT JOIN (SELECT brand, count(DISTINCT codigo_padre) AS competitor_products FROM fx_competitor_prices WHERE comp_price > 0 GROUP BY brand) USING (brand)
LEFT JOIN (SELECT brand, count(DISTINCT codigo_padre) AS cross_store_alerts FROM alerts GROUP BY brand) USING (brand)""")
def _(r):
    return RP.weekly_report(r.actions, r.t.competitor_prices, AL.cross_store_alerts(r.parent))


SQL.STEPS["act_status_now"] = "SELECT s.* FROM act_status s JOIN target_week USING (brand, week)"


def _roster_sql(by: str) -> str:
    return f"""
SELECT brand, {by} AS name, count(*) AS total, count(*) FILTER (status IS NULL) AS pending, count(status) AS decided, count(*) FILTER (urgency = 'HIGH') AS high,
       count(*) FILTER (urgency = 'MEDIUM') AS medium, coalesce(sum(rev_delta), 0) AS rev_delta,
       round(avg(click_collect_ratio) FILTER (click_collect_ratio > 0), 6) AS avg_click_collect FROM act_status_now GROUP BY brand, {by}"""


@query("store_roster", _roster_sql("store_name"))
def _(r):
    return RP.roster(r.actions, D.decide_by_formula(r.history))


@query("vendor_roster", _roster_sql("vendor_brand"))
def _(r):
    return RP.roster(r.actions, D.decide_by_formula(r.history), "vendor_brand")


def _middle(c: str, test: str) -> str:
    values = f"list_sort(list({c}) FILTER ({test} AND {c} <> 0))"
    return f"coalesce({values}[len({values}) // 2 + 1], 0)"


def _grid_side(name: str, test: str) -> str:
    return f"""count(*) FILTER ({test}) AS {name}_stores, {_middle('current_price', test)} AS {name}_price, {_middle('recommended_price', test)} AS {name}_recommended,
       round(coalesce(sum(current_velocity) FILTER ({test}), 0), 6) AS {name}_velocity, coalesce(sum(rev_delta) FILTER ({test}), 0) AS {name}_rev_delta,
       count(*) FILTER ({test} AND status IS NULL) AS {name}_pending"""


@query("product_grid", f"""
SELECT brand, parent_sku, min(product) AS product, min(category) AS category, min(subcategory) AS subcategory, min(vendor_brand) AS vendor_brand, max(product_age_weeks) AS age,
       {_grid_side('bm', "store NOT LIKE 'AB%'")}, {_grid_side('ecom', "store LIKE 'AB%'")}, 2 AS category_priority
FROM (SELECT s.* FROM act_status s JOIN target_week USING (brand, week)) GROUP BY brand, parent_sku""")
def _(r):
    return RP.product_grid(r.actions, D.decide_by_formula(r.history))


@query("chain_view", """
SELECT * FROM (SELECT brand, parent_sku, round(sum(current_velocity), 6) AS total_velocity, sum(rev_delta) AS total_rev_delta, count(*) FILTER (status IS NULL) AS pending,
       count(*) FILTER (store LIKE 'AB%') AS ecomm_stores, count(*) FILTER (store NOT LIKE 'AB%') AS bm_stores, count(*) FILTER (store LIKE 'AB%' AND status IS NULL) AS ecomm_pending,
       count(*) FILTER (store NOT LIKE 'AB%' AND status IS NULL) AS bm_pending FROM act_status JOIN target_week USING (brand, week) GROUP BY brand, parent_sku)
JOIN (SELECT brand, parent_sku, arg_max(recommended_discount, (n, -step)) AS consensus_discount, max(n) AS consensus_stores FROM (
      SELECT brand, parent_sku, recommended_discount, step, count(*) AS n FROM acts_ch JOIN target_week USING (brand, week) GROUP BY ALL) GROUP BY ALL) USING (brand, parent_sku)""")
def _(r):
    return RP.chain_view(r.actions, D.decide_by_formula(r.history))


@query("decision_kpis", """
SELECT coalesce(brand, 'all') AS brand, count(*) AS total, count(status) AS reviewed, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected,
       count(*) FILTER (status IS NULL) AS undecided, coalesce(sum(rev_delta) FILTER (status = 'approved'), 0) AS approved_rev_delta,
       coalesce(sum(margin_delta) FILTER (status = 'approved'), 0) AS approved_margin_delta, CAST(round_even(count(status) / count(*) * 100, 0) AS BIGINT) AS progress_pct
FROM act_status_now GROUP BY GROUPING SETS ((brand), ())""")
def _(r):
    return RP.decision_kpis(r.actions, D.decide_by_formula(r.history))


_QUALITY = [c for c in _types("child_features") if c not in W.WEEKLY]


@query("data_quality", f"""
SELECT brand, 'transactions' AS measure, unnest(['rows', 'skus', 'stores', 'first_day', 'last_day']) AS name,
       unnest([count(*), count(DISTINCT sku), count(DISTINCT centro), date_diff('day', DATE '1970-01-01', CAST(min(fecha) AS DATE)), date_diff('day', DATE '1970-01-01', CAST(max(fecha) AS DATE))]) AS value
FROM fx_line GROUP BY brand
UNION ALL SELECT brand, 'features', unnest(['rows', 'skus', 'stores', 'first_week', 'last_week']),
       unnest([count(*), count(DISTINCT sku), count(DISTINCT centro), date_diff('day', DATE '1970-01-01', min(week)), date_diff('day', DATE '1970-01-01', max(week))]) FROM child GROUP BY brand
UNION ALL SELECT * FROM (SELECT brand, 'null_rate', unnest([{', '.join(f"'{c}'" for c in _QUALITY)}]) AS name, unnest([{', '.join(f"round(avg(CAST({c} IS NULL AS INT)), 6)" for c in _QUALITY)}]) AS value
       FROM child GROUP BY brand) WHERE value > 0.1::DOUBLE""")
def _(r):
    return RP.data_quality(r.t.transactions, r.t.products, r.features)


# ------------------------------------------------------------------ backtests

def _scored(r):
    return A.formula_scores(r.enhanced)


@query("markdown_events", f"""
SELECT {S4}, has_discount, CAST(has_discount = 1 AND coalesce(lag(has_discount) OVER (PARTITION BY {SQL.S3} ORDER BY week), 0) = 0 AS INT) AS markdown_event,
       min(week) FILTER (has_discount = 1) OVER (PARTITION BY {SQL.S3}) AS first_markdown_week FROM child""")
def _(r):
    return B.markdown_events(r.features)


@query("first_markdown_dataset", f"""
SELECT {S4}, f AS first_discount_week, CAST(coalesce(date_diff('day', week, f) / 7 > 0 AND date_diff('day', week, f) / 7 <= 4, false) AS INT) AS target_first_markdown_4w
FROM (SELECT *, min(week) FILTER (has_discount = 1) OVER (PARTITION BY {SQL.S3}) AS f FROM child) WHERE f IS NULL OR week < f""")
def _(r):
    return B.first_markdown_dataset(r.features).select(*W.WEEKLY, "first_discount_week", "target_first_markdown_4w")


@query("walk_forward_metrics", """
SELECT t.brand, t.week, t.total_skus, t.actual_positives, t.pos_avg_prob, t.neg_avg_prob, k.top_k, k.precision_at_k, k.depth_mae, k.revenue_at_risk,
       CASE WHEN t.actual_positives > 0 THEN coalesce(f.found, 0) / t.actual_positives END AS recall_at_k
FROM (SELECT brand, week, count(*) AS total_skus, count(DISTINCT sku) FILTER (will_discount_4w = 1) AS actual_positives, avg(markdown_probability) FILTER (will_discount_4w = 1) AS pos_avg_prob,
             avg(markdown_probability) FILTER (will_discount_4w = 0) AS neg_avg_prob FROM bt_rows GROUP BY brand, week) t
JOIN (SELECT brand, week, count(*) AS top_k, avg(will_discount_4w) AS precision_at_k, avg(abs(raw_depth - future_max_disc_4w)) FILTER (will_discount_4w = 1) AS depth_mae,
             sum(gross_revenue) AS revenue_at_risk FROM bt_rows WHERE k <= 50 GROUP BY brand, week) k USING (brand, week)
LEFT JOIN (SELECT brand, week, count(DISTINCT sku) AS found FROM bt_rows b WHERE k <= 50
           AND EXISTS (SELECT 1 FROM bt_rows p WHERE p.brand = b.brand AND p.week = b.week AND p.sku = b.sku AND p.will_discount_4w = 1) GROUP BY brand, week) f USING (brand, week)""")
def _(r):
    return B.walk_forward_metrics(_scored(r))


SQL.STEPS["bt_rows"] = """
SELECT *, row_number() OVER (PARTITION BY brand, week ORDER BY markdown_probability DESC, sku, centro) AS k FROM child_scored"""
SQL.STEPS["timing"] = f"""
SELECT *, round(date_diff('day', model_first_flag, actual_first_markdown) / 7, 1) AS delta_weeks FROM (
SELECT {SQL.S3}, min(week) FILTER (markdown_probability >= 0.5::DOUBLE) AS model_first_flag, min(week) FILTER (has_discount = 1) AS actual_first_markdown
FROM child_scored GROUP BY {SQL.S3}) WHERE model_first_flag IS NOT NULL AND actual_first_markdown IS NOT NULL"""
SQL.STEPS["depth"] = f"""
SELECT {S4}, primera_jerarquia, segunda_jerarquia, discount_rate, raw_depth AS model_depth, round(raw_depth - discount_rate, 9) AS depth_delta,
       markdown_probability AS model_prob, units_sold, gross_revenue,
       CASE WHEN round(raw_depth - discount_rate, 9) < -0.01::DOUBLE THEN 'shallower' WHEN round(raw_depth - discount_rate, 9) > 0.01::DOUBLE THEN 'deeper' ELSE 'similar' END AS depth_class
FROM child_scored WHERE has_discount = 1 AND discount_rate > 0.01::DOUBLE"""


@query("timing_delta", "SELECT * FROM timing")
def _(r):
    return B.timing_delta(_scored(r))


@query("timing_buckets", """
SELECT brand, bucket, count(*) AS n FROM (SELECT brand, CASE WHEN delta_weeks > -100 AND delta_weeks <= -8 THEN '8+ wks late' WHEN delta_weeks > -8 AND delta_weeks <= -4 THEN '4-8 wks late'
       WHEN delta_weeks > -4 AND delta_weeks <= -0.5::DOUBLE THEN '1-4 wks late' WHEN delta_weeks > -0.5::DOUBLE AND delta_weeks <= 0.5::DOUBLE THEN 'Same week'
       WHEN delta_weeks > 0.5::DOUBLE AND delta_weeks <= 4 THEN '1-4 wks early' WHEN delta_weeks > 4 AND delta_weeks <= 8 THEN '4-8 wks early'
       WHEN delta_weeks > 8 AND delta_weeks <= 100 THEN '8+ wks early' END AS bucket FROM timing) WHERE bucket IS NOT NULL GROUP BY ALL""")
def _(r):
    return B.timing_buckets(B.timing_delta(_scored(r)))


@query("depth_accuracy", "SELECT * FROM depth")
def _(r):
    return B.depth_accuracy(_scored(r))


@query("revenue_impact", """
SELECT * FROM (SELECT brand, round(sum(s), 2) AS depth_total_savings, round(avg(s), 2) AS depth_avg_weekly_savings, round(avg(s) * 52, 2) AS annualised_savings FROM (
  SELECT brand, week, sum(price * (discount_rate - model_depth) * units_sold) AS s FROM depth JOIN (SELECT brand, sku, avg(avg_precio_lista) AS price FROM child_scored GROUP BY ALL) USING (brand, sku)
  GROUP BY brand, week) GROUP BY brand)
FULL JOIN (SELECT brand, count(*) FILTER (delta_weeks > 0) AS flagged_early, count(*) FILTER (delta_weeks < 0) AS flagged_late, coalesce(avg(delta_weeks) FILTER (delta_weeks > 0), 0) AS avg_early_weeks,
           coalesce(avg(abs(delta_weeks)) FILTER (delta_weeks < 0), 0) AS avg_late_weeks FROM timing GROUP BY brand) USING (brand)""")
def _(r):
    s = _scored(r)
    return B.revenue_impact(s, B.depth_accuracy(s), B.timing_delta(s))


@query("depth_breakdown", """
SELECT brand, CASE WHEN grouping(centro) = 0 THEN 'store' ELSE 'category' END AS level, coalesce(centro, primera_jerarquia || '/' || segunda_jerarquia) AS name, count(*) AS n,
       avg(discount_rate) AS avg_actual_disc, avg(model_depth) AS avg_model_disc, avg(depth_delta) AS avg_depth_delta, sum(gross_revenue) AS total_revenue
FROM depth GROUP BY GROUPING SETS ((brand, primera_jerarquia, segunda_jerarquia), (brand, centro))""")
def _(r):
    return B.depth_breakdown(B.depth_accuracy(_scored(r)))


# ---------------------------------------------------------------- competitors

@query("competitor_by_parent", "SELECT * FROM comp_parent")
def _(r):
    return H.competitor_by_parent(r.t.competitor_prices)


@query("competitor_summary", """
SELECT brand, codigo_padre AS parent_sku, count(*) AS n_competitors, string_agg(competitor || ':' || CAST(CAST(comp_price AS BIGINT) AS VARCHAR), ',' ORDER BY competitor) AS competitors
FROM fx_competitor_prices WHERE comp_price > 0 GROUP BY ALL""")
def _(r):
    offers = F.array_join(F.transform("competitors", lambda o: F.concat_ws(":", o["name"], o["price"].cast("string"))), ",")
    return K.competitor_summary(r.t.competitor_prices).withColumn("competitors", offers)


@query("competitor_coverage", """
SELECT brand, coalesce(competitor, 'all') AS competitor, count(DISTINCT codigo_padre) AS parents FROM fx_competitor_prices WHERE comp_price > 0
GROUP BY GROUPING SETS ((brand), (brand, competitor))""")
def _(r):
    return K.competitor_coverage(r.t.competitor_prices)


def _position(r):
    return K.price_position(r.t.competitor_prices, r.actions)


@query("price_position", "SELECT * FROM position")
def _(r):
    return _position(r)


@query("position_summary", """
SELECT brand, count(*) AS total_products, count(*) FILTER (position = 'cheaper') AS cheaper, count(*) FILTER (position = 'parity') AS parity, count(*) FILTER (position = 'expensive') AS expensive,
       round_even(count(*) FILTER (position = 'cheaper') / count(*) * 100, 0) AS cheaper_pct, round_even(count(*) FILTER (position = 'parity') / count(*) * 100, 0) AS parity_pct,
       round_even(count(*) FILTER (position = 'expensive') / count(*) * 100, 0) AS expensive_pct, round_even(sum(our_price) / sum(comp_avg), 3) AS avg_price_index FROM position GROUP BY brand""")
def _(r):
    return K.position_summary(_position(r))


@query("competitor_breakdown", """
SELECT brand, competitor, count(*) AS products, round_even(count(*) FILTER (comp_price <= comp_min * 1.02::DOUBLE) / count(*) * 100, 0) AS cheapest_pct,
       round_even(round(avg((our_price - comp_price) / our_price * 100), 6), 1) AS avg_gap_pct
FROM fx_competitor_prices JOIN (SELECT brand, parent_sku AS codigo_padre, our_price, comp_min FROM position) USING (brand, codigo_padre) WHERE comp_price > 0 GROUP BY brand, competitor""")
def _(r):
    return K.competitor_breakdown(r.t.competitor_prices, _position(r))


@query("position_extremes", """
SELECT * FROM (SELECT *, 'overpriced' AS side FROM position QUALIFY row_number() OVER (PARTITION BY brand ORDER BY gap_pct DESC, parent_sku) <= 15)
UNION ALL SELECT * FROM (SELECT *, 'underpriced' AS side FROM position QUALIFY row_number() OVER (PARTITION BY brand ORDER BY gap_pct, parent_sku) <= 10)""")
def _(r):
    return K.position_extremes(_position(r))


@query("opportunities", """
SELECT brand, parent_sku, our_price, comp_min, velocity, round((comp_min - our_price) / 1.19::DOUBLE * velocity, 2) AS margin_impact FROM position
JOIN (SELECT brand, parent_sku, round(sum(current_velocity), 6) AS velocity FROM acts_now GROUP BY ALL) USING (brand, parent_sku) WHERE comp_min > our_price
QUALIFY row_number() OVER (PARTITION BY brand ORDER BY margin_impact DESC, parent_sku) <= 20""")
def _(r):
    return K.opportunities(_position(r), r.actions)


@query("threats", """
SELECT brand, parent_sku, our_price, comp_min, cheapest_site, gap_pct, CASE WHEN gap_pct > 20 THEN 'critical' WHEN gap_pct > 10 THEN 'high' ELSE 'medium' END AS severity, revenue_at_risk
FROM position JOIN (SELECT brand, parent_sku, sum(current_weekly_rev) AS revenue_at_risk FROM acts_now GROUP BY ALL) USING (brand, parent_sku) WHERE position = 'expensive'""")
def _(r):
    return K.threats(_position(r), r.actions)


_SNAPS = """
SELECT brand, codigo_padre, competitor, comp_list_price, DATE '1998-01-05' + INTERVAL (7 * k) DAY AS snapshot, round(comp_price * (1 + 0.04::DOUBLE * ((k * 3 + length(codigo_padre)) % 4))) AS comp_price
FROM fx_competitor_prices, (VALUES (0), (1), (2), (3), (4)) w(k)"""


@query("price_movements", f"""
SELECT brand, codigo_padre, competitor, CAST(snapshot AS DATE) AS snapshot, prev_price, comp_price, change_pct, movement FROM (
SELECT *, round((comp_price - prev_price) / prev_price, 4) AS change_pct, CASE WHEN promo AND NOT was THEN 'promo_start' WHEN NOT promo AND was THEN 'promo_end'
       WHEN round((comp_price - prev_price) / prev_price, 4) <= -0.03::DOUBLE THEN 'drop' WHEN round((comp_price - prev_price) / prev_price, 4) >= 0.03::DOUBLE THEN 'raise' END AS movement
FROM (SELECT *, lag(comp_price) OVER w AS prev_price, lag(promo) OVER w AS was FROM (SELECT *, comp_price < comp_list_price * 0.95::DOUBLE AS promo FROM ({_SNAPS}))
      WINDOW w AS (PARTITION BY brand, codigo_padre, competitor ORDER BY snapshot)) WHERE prev_price > 0) WHERE movement IS NOT NULL""")
def _(r):
    wave = (F.col("k") * 3 + F.length("codigo_padre")) % 4
    history = r.t.competitor_prices.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(5)]))).select(
        "brand", "codigo_padre", "competitor", "comp_list_price", F.date_add(F.to_date(F.lit("1998-01-05")), F.col("k") * 7).alias("snapshot"),
        F.round(F.col("comp_price") * (1 + F.lit(0.04) * wave)).alias("comp_price"))
    return K.price_movements(history)


@query("extract_offers", """
SELECT codigo_padre || '|' || competitor AS page_id, upper(split_part(codigo_padre, '-', 2)[1:1]) || lower(split_part(codigo_padre, '-', 2)[2:]) || ' ' || q || ' Mujer' AS name,
       CAST(comp_price AS BIGINT) AS comp_price, CAST(comp_price AS BIGINT) AS comp_list_price, comp_in_stock, 0.0::DOUBLE AS comp_discount
FROM fx_competitor_prices JOIN (SELECT brand, codigo_padre, min(q) AS q FROM fx_part GROUP BY ALL) USING (brand, codigo_padre)""")
def _(r):
    return K.extract_offers(r.t.competitor_pages).select("page_id", "name", "comp_price", "comp_list_price", "comp_in_stock", "comp_discount")


@query("extract_offers_raw_pages", "SELECT page_id FROM pages WHERE html LIKE '%application/ld+json%' OR html LIKE '%__NEXT_DATA__%'")
def _(r):
    return K.extract_offers(r.t.table("pages")).select("page_id")


@query("build_catalog", """
SELECT brand, codigo_padre, product_name, vendor_brand, primera_jerarquia, segunda_jerarquia, ean11 FROM (
SELECT brand, codigo_padre, arg_min(segunda_jerarquia, material) || ' ' || regexp_extract(any_value(codigo_padre), '(\\d+)-', 1) AS product_name, arg_min(grupo_articulos_descripcion, material) AS vendor_brand,
       arg_min(primera_jerarquia, material) AS primera_jerarquia, arg_min(segunda_jerarquia, material) AS segunda_jerarquia, arg_min(ean11, material) AS ean11 FROM fx_products GROUP BY ALL)""")
def _(r):
    return K.build_catalog(r.t.products)


def _offers(r):
    found = K.extract_offers(r.t.competitor_pages)
    return found.withColumnRenamed("brand", "offer_brand").join(
        r.t.competitor_pages.select("brand", "codigo_padre", "competitor", "page_id"), "page_id").select(
        "brand", "codigo_padre", "competitor", F.col("page_id").alias("offer_id"), "name", "offer_brand", F.lit(None).cast("string").alias("ean11"),
        "comp_price", "comp_list_price", "comp_in_stock")


@query("match_offers")
def _(r):
    return K.match_offers(K.build_catalog(r.t.products, cap=None), _offers(r))


@query("match_offers_subset", """
SELECT brand, codigo_padre, competitor, CAST(comp_price AS BIGINT) AS comp_price, 'high_name' AS match_method, 1.0::DOUBLE AS match_score FROM fx_competitor_prices""")
def _(r):
    matched = K.match_offers(K.build_catalog(r.t.products, cap=None), _offers(r), score=K.subset_score)
    return matched.select("brand", "codigo_padre", "competitor", "comp_price", "match_method", "match_score")


@query("match_names", rf"""
WITH mine AS (SELECT brand, codigo_padre, lower(product_name) AS a, array_to_string(list_sort(string_split(lower(product_name), ' ')), ' ') AS sa, ean11 FROM ({TEXTS["build_catalog"]})),
theirs AS (SELECT brand, competitor, codigo_padre || '|' || competitor AS offer_id, lower(split_part(codigo_padre, '-', 2)) || ' ' || regexp_extract(codigo_padre, '(\d+)-', 1) AS b,
       CASE WHEN CAST(regexp_extract(codigo_padre, '(\d+)-', 1) AS INTEGER) % 7 = 0 THEN ean11 END AS ean FROM fx_competitor_prices JOIN mine USING (brand, codigo_padre)),
met AS (SELECT *, coalesce(ean11 = ean, false) AS by_ean, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM mine JOIN theirs USING (brand)),
scored AS (SELECT *, CASE WHEN by_ean THEN 1 ELSE greatest(round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 6), round(1 - levenshtein(sa, sb) / greatest(length(sa), length(sb))::DOUBLE, 6)) END AS score FROM met)
SELECT brand, codigo_padre, competitor, offer_id, CASE WHEN by_ean THEN 'exact_ean' WHEN score >= 0.9::DOUBLE THEN 'high_name' WHEN score >= 0.85::DOUBLE THEN 'medium_name' ELSE 'low_name' END AS match_method,
       round(score, 3) AS match_score
FROM (SELECT *, row_number() OVER (PARTITION BY brand, codigo_padre, competitor ORDER BY NOT by_ean, round(score, 3) DESC, offer_id) AS k FROM scored WHERE score >= 0.75::DOUBLE) WHERE k = 1""")
def _(r):
    """Pages carry no EAN; offers of every seventh model get that of the parent they were found for."""
    catalog = K.build_catalog(r.t.products, cap=None)
    known = catalog.where(F.regexp_extract("codigo_padre", r"(\d+)-", 1).cast("int") % 7 == 0).select("brand", "codigo_padre", "ean11")
    return N.match_names(catalog, _offers(r).drop("ean11").join(known, ["brand", "codigo_padre"], "left"))


# ------------------------------------------------------------------ streaming

def _streamed(name: str, source: DataFrame, time: str, fn, keys: list[str]) -> DataFrame:
    """The table delivered in order of time and streamed with the stream's own lateness."""
    return SW.replay(source, time, fn, keys, f"{shared_dir(source.sparkSession)}/rebaja/stream-{name}-{uuid.uuid4().hex[:8]}")


@query("stream_weekly_sales", f"SELECT {S4}, units_sold, gross_revenue, click_collect_units FROM weekly")
def _(r):
    lines = r.t.transactions.select("brand", "sku", "centro", "fecha", "cantidad", "precio_final", "tipo_entrega")
    return _streamed("sales", lines, "fecha", SW.stream_weekly_sales, ["brand", "sku", "centro", "week"])


@query("stream_weekly_folios", f"SELECT {S4}, txn_count FROM weekly")
def _(r):
    lines = r.t.transactions.select("brand", "sku", "centro", "fecha", "cantidad", "folio")
    return _streamed("folios", lines, "fecha", SW.stream_weekly_folios, ["brand", "sku", "centro", "week"])


@query("stream_traffic_weekly", "SELECT * FROM traffic_week")
def _(r):
    return _streamed("traffic", r.t.traffic, "fecha", SW.stream_traffic_weekly, ["centro", "week"])


@query("stream_audit_counts", f"""
SELECT brand, action, CAST(date_trunc('week', timestamp) AS DATE) AS week, count(*) AS n FROM (SELECT DISTINCT * FROM ({_AUDIT_SQL})) GROUP BY ALL""")
def _(r):
    log = _audit(r)
    return _streamed("audit", log.unionByName(log), "timestamp", SW.stream_audit_counts, ["brand", "action", "week"])


# --------------------------------------------------------------------- models

@query("time_series_folds", """
SELECT brand, fold, week, CASE WHEN pos <= (fold + 1) * size THEN 'train' ELSE 'validate' END AS role FROM (
SELECT w.*, f.fold, n // 5 AS size FROM (SELECT brand, week, row_number() OVER (PARTITION BY brand ORDER BY week) AS pos, count(*) OVER (PARTITION BY brand) AS n
FROM (SELECT DISTINCT brand, week FROM parent)) w CROSS JOIN (VALUES (0), (1), (2), (3)) f(fold)) WHERE pos <= (fold + 2) * size""")
def _(r):
    return ML.time_series_folds(r.parent)


@query("holdout_split", f"""
SELECT {P4}, dense_rank() OVER (PARTITION BY brand ORDER BY week DESC) <= 4 AS is_holdout FROM parent""")
def _(r):
    return ML.holdout_split(r.parent).select(*R.KEYS, "is_holdout")


@query("classification_metrics", """
SELECT brand, count(*) AS n, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM (
SELECT *, count(*) FILTER (y AND p) OVER b AS tp, count(*) FILTER (NOT y AND p) OVER b AS fp, count(*) FILTER (y AND NOT p) OVER b AS fn FROM (
SELECT brand, will_discount_4w = 1 AS y, markdown_probability >= 0.5::DOUBLE AS p FROM scored) WINDOW b AS (PARTITION BY brand)) GROUP BY brand, tp, fp, fn""")
def _(r):
    return ML.classification_metrics(A.formula_scores(r.parent), "will_discount_4w", by=["brand"])


@query("regression_metrics", """
SELECT brand, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
FROM (SELECT brand, future_max_disc_4w AS y, raw_depth AS p FROM scored) GROUP BY brand""")
def _(r):
    return ML.regression_metrics(A.formula_scores(r.parent), "future_max_disc_4w", by=["brand"])


@query("store_profiles", """
SELECT centro, avg(velocity_4w) AS avg_velocity, stddev_samp(velocity_4w) AS std_velocity, avg(discount_rate) AS avg_discount, avg(avg_precio_final) AS avg_price,
       count(DISTINCT codigo_padre) AS n_skus, avg(has_discount) AS pct_discounted, avg(stock_on_hand) AS avg_stock, avg(weeks_of_cover) AS avg_woc FROM parent GROUP BY centro""")
def _(r):
    return ML.store_profiles(r.parent)


@query("ranking_metrics", """
SELECT brand, sum(pos + neg) AS n, sum(pos) AS positives, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc, sum(pos * tp / (tp + fp)) / sum(pos) AS avg_precision FROM (
SELECT *, sum(pos) OVER b AS tp, sum(neg) OVER b AS fp FROM (
SELECT brand, markdown_probability AS p, CAST(count(*) FILTER (will_discount_4w = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (will_discount_4w <> 1) AS DOUBLE) AS neg
FROM scored WHERE will_discount_4w IS NOT NULL GROUP BY ALL) WINDOW b AS (PARTITION BY brand ORDER BY p DESC)) GROUP BY brand""")
def _(r):
    return ML.ranking_metrics(A.formula_scores(r.parent), "will_discount_4w", by=["brand"])


@query("store_clusters")
def _(r):
    return ML.store_clusters(ML.store_profiles(r.parent))


@query("model_scores")
def _(r):
    return r.holdout_scores.select(*R.KEYS, "class_label", "depth_label", "markdown_probability", "raw_depth")


@query("model_metrics")
def _(r):
    return ML.model_metrics(r.holdout_scores, ["brand"])


@query("model_folds")
def _(r):
    return ML.cross_validate(r.parent)


@query("model_comparison")
def _(r):
    return ML.compare_models(r.parent)


@query("feature_importance")
def _(r):
    return ML.feature_importance(r.models, r.t.spark)


@query("permutation_importance")
def _(r):
    return ML.permutation_importance(r.split.where("is_holdout").drop("is_holdout"), r.models)
