"""Steps as SQL, written separately from the DataFrame code to check it."""
from __future__ import annotations

import re

from rebaja import constants as C
from rebaja.oracle.entities import ENTITIES

MEASURES = C.MARGIN_LADDER


def snap_nearest(p: str) -> str:
    """CASE over the midpoints between anchors; the lower anchor wins a tie."""
    a = C.PRICE_ANCHORS
    arms = " ".join(f"WHEN {p} <= {(lo + hi) / 2!r}::DOUBLE THEN {lo}" for lo, hi in zip(a, a[1:]))
    return (f"CAST(CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0 THEN 0 "
            f"WHEN {p} > {a[-1]} THEN round_even({p} / 10000.0::DOUBLE, 0) * 10000 - 10 {arms} ELSE {a[-1]} END AS BIGINT)")


def snap_up(p: str) -> str:
    a = C.PRICE_ANCHORS
    arms = " ".join(f"WHEN {p} <= {x} THEN {x}" for x in a)
    return (f"CAST(CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0 THEN 0 "
            f"WHEN {p} > {a[-1]} THEN (floor({p} / 10000.0::DOUBLE) + 1) * 10000 - 10 {arms} END AS BIGINT)")


def snap_down(p: str) -> str:
    a = C.PRICE_ANCHORS
    arms = " ".join(f"WHEN {p} >= {x} THEN {x}" for x in reversed(a))
    return (f"CAST(CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0 THEN 0 "
            f"WHEN {p} > {a[-1]} THEN floor({p} / 10000.0::DOUBLE) * 10000 - 10 {arms} ELSE {a[0]} END AS BIGINT)")


def snap_disc(d: str) -> str:
    return (f"CASE WHEN {d} < 0.07::DOUBLE THEN 0.0::DOUBLE WHEN abs(0.15::DOUBLE - {d}) <= abs(0.2::DOUBLE - {d}) THEN 0.15::DOUBLE "
            f"WHEN abs(0.2::DOUBLE - {d}) <= abs(0.3::DOUBLE - {d}) THEN 0.2::DOUBLE "
            f"WHEN abs(0.3::DOUBLE - {d}) <= abs(0.4::DOUBLE - {d}) THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END")


def _lift(step: str, otherwise: str) -> str:
    arms = " ".join(f"WHEN {s!r}::DOUBLE THEN {v!r}::DOUBLE" for s, v in C.STEP_LIFT.items())
    return f"CASE {step} {arms} ELSE {otherwise} END"


def velocity_down(v: str, cur: str, new: str, e: str) -> str:
    ch = f"(({new} - {cur}) / greatest(1 - {cur}, 0.01::DOUBLE))"
    return (f"CASE WHEN {v} <= 0 THEN 0.5::DOUBLE WHEN {new} <= {cur} THEN {v} "
            f"WHEN {e} < -0.3::DOUBLE THEN greatest({v} * (1 - {ch} * {e}), 0.5::DOUBLE) "
            f"ELSE greatest({v} * {_lift(new, f'1 + {ch} * 5')}, 0.5::DOUBLE) END")


def velocity_both(v: str, cur: str, new: str, e: str) -> str:
    ch = f"(({cur} - {new}) / greatest(1 - {cur}, 0.01::DOUBLE))"
    return (f"CASE WHEN {v} <= 0 THEN 0.5::DOUBLE WHEN {new} = {cur} THEN {v} "
            f"WHEN {e} < -0.3::DOUBLE THEN greatest({v} * (1 + {e} * {ch}), 0.3::DOUBLE) "
            f"WHEN {new} > {cur} THEN greatest({v} * {_lift(new, f'1 + abs({ch}) * 5')}, 0.5::DOUBLE) "
            f"ELSE greatest({v} * (1 - least(0.25::DOUBLE * (({cur} - {new}) / 0.15::DOUBLE), 0.6::DOUBLE)), 0.3::DOUBLE) END")


def vendor(sku: str) -> str:
    arms = " ".join(f"WHEN starts_with({sku}, '{p}') THEN '{v}'" for p, v in
                    sorted(C.VENDOR_PREFIXES.items(), key=lambda kv: -len(kv[0])))
    return f"CASE {arms} ELSE 'Other' END"


def pct(x: str) -> str:
    return f"(CAST(CAST(round_even({x} * 100, 0) AS INT) AS VARCHAR) || '%')"


def fixed(x: str, d: int) -> str:
    return f"printf('%.{d}f', round_even({x}, {d}))"


def ladder(values) -> str:
    return "(VALUES " + ", ".join(f"({v!r}::DOUBLE)" for v in values) + ")"


CLEAN = ("NOT (coalesce(tipo_entrega = 'Retiro en Tienda', false) OR coalesce(codigo_descuento <> '', false) "
         "OR coalesce(upper(tipo_documento) LIKE '%NOTA DE CREDITO%', false) "
         "OR coalesce(precio_lista > 0 AND descuento / precio_lista > 0.5::DOUBLE, false) "
         "OR coalesce(list_category IN ('liquidacion', 'outlet'), false))")
CORE = "talla IN (" + ", ".join(f"'{s}'" for s in C.CORE_SIZES) + ")"
S3, S4 = "brand, sku, centro", "brand, sku, centro, week"
P3, P4 = "brand, codigo_padre, centro", "brand, codigo_padre, centro, week"

STEPS = dict(ENTITIES)
STEPS.update({
    "sales": f"SELECT *, {CLEAN} AS clean FROM fx_line WHERE cantidad > 0",
    "parents": "SELECT brand, material AS sku, min(codigo_padre) AS codigo_padre, min(talla) AS talla FROM fx_products GROUP BY ALL",
    "weekly": f"""
SELECT s.*, greatest(units_sold - click_collect_units, 0) AS instore_units,
       CASE WHEN units_sold > 0 THEN click_collect_units / units_sold ELSE 0 END AS click_collect_ratio,
       coalesce(units_returned, 0) AS units_returned, units_sold - coalesce(units_returned, 0) AS net_units,
       CASE WHEN total_list_value > 0 THEN total_discount / total_list_value ELSE 0.0::DOUBLE END AS discount_rate
FROM (SELECT {S4}, CAST(sum(cantidad) AS BIGINT) AS units_sold, sum(precio_final) AS gross_revenue,
             count(DISTINCT folio) AS txn_count, count(*) FILTER (tipo_entrega = 'Retiro en Tienda') AS click_collect_units,
             coalesce(sum(descuento) FILTER (clean), sum(descuento)) AS total_discount,
             coalesce(sum(precio_lista) FILTER (clean), sum(precio_lista)) AS total_list_value,
             coalesce(avg(precio_lista) FILTER (clean), avg(precio_lista)) AS avg_precio_lista,
             coalesce(avg(precio_final) FILTER (clean), avg(precio_final)) AS avg_precio_final,
             coalesce(min(precio_lista) FILTER (clean), min(precio_lista)) AS min_precio_lista,
             coalesce(max(precio_lista) FILTER (clean), max(precio_lista)) AS max_precio_lista
      FROM sales GROUP BY {S4}) s
LEFT JOIN (SELECT {S4}, CAST(abs(sum(cantidad)) AS BIGINT) AS units_returned FROM fx_line WHERE cantidad < 0 GROUP BY {S4}) r
  USING ({S4})""",
    "official": """
SELECT s.brand, s.sku, CASE WHEN any_value(n.n) > 0 THEN max(o.list_price) FILTER (o.sku = s.sku)
                            ELSE arg_max(o.list_price, length(o.sku)) END AS official_price
FROM (SELECT DISTINCT brand, sku FROM weekly) s
JOIN fx_official_prices o ON s.brand = o.brand AND starts_with(s.sku, o.sku)
JOIN (SELECT w.brand, count(o.sku) AS n FROM (SELECT DISTINCT brand, sku FROM weekly) w
      LEFT JOIN fx_official_prices o ON w.brand = o.brand AND w.sku = o.sku GROUP BY w.brand) n ON n.brand = s.brand
GROUP BY s.brand, s.sku""",
    "priced": """
SELECT w.* REPLACE (coalesce(official_price, avg_precio_lista) AS avg_precio_lista)
FROM weekly w LEFT JOIN official USING (brand, sku)""",
    "velocity": f"""
SELECT *, CASE WHEN velocity_4w > 0 THEN velocity_2w / velocity_4w ELSE 1.0::DOUBLE END AS velocity_trend FROM (
SELECT *, avg(units_sold) OVER (w ROWS BETWEEN 0 PRECEDING AND CURRENT ROW) AS velocity_1w,
       avg(units_sold) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS velocity_2w,
       avg(units_sold) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS velocity_4w,
       avg(units_sold) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS velocity_8w,
       avg(instore_units) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS instore_velocity_4w,
       CAST(sum(units_sold) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_units
FROM priced WINDOW w AS (PARTITION BY {S3} ORDER BY week))""",
    "pricef": f"""
SELECT * EXCLUDE (prev, island, cnt),
       CASE WHEN has_discount = 1 THEN 0
            ELSE row_number() OVER (PARTITION BY {S3}, island ORDER BY week) - 1 END AS weeks_since_discount,
       island AS cumulative_disc_weeks, island / cnt AS disc_exposure_rate
FROM (SELECT *, CAST(coalesce(avg_precio_lista <> prev, false) AS INT) AS price_changed,
             CASE WHEN prev > 0 THEN (avg_precio_lista - prev) / prev ELSE 0.0::DOUBLE END AS price_change_pct,
             CAST(sum(has_discount) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island,
             row_number() OVER w AS cnt, max(discount_rate) OVER (w ROWS UNBOUNDED PRECEDING) AS max_discount_rate
      FROM (SELECT *, lag(avg_precio_lista) OVER (PARTITION BY {S3} ORDER BY week) AS prev,
                   CAST(discount_rate > 0.01::DOUBLE AS INT) AS has_discount FROM velocity)
      WINDOW w AS (PARTITION BY {S3} ORDER BY week))""",
    "targets": f"""
SELECT * EXCLUDE (nf, nr), CAST(coalesce(max(nf) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS INT) AS will_discount_4w,
       coalesce(max(nr) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0.0::DOUBLE) AS future_max_disc_4w,
       CASE WHEN velocity_2w > 0 THEN future_velocity_2w / velocity_2w END AS velocity_lift
FROM (SELECT *, lead(has_discount) OVER w AS nf, lead(discount_rate) OVER w AS nr, lead(velocity_2w, 2) OVER w AS future_velocity_2w
      FROM pricef WINDOW w AS (PARTITION BY {S3} ORDER BY week))
WINDOW w AS (PARTITION BY {S3} ORDER BY week)""",
    "age": "SELECT brand, sku, min(fecha) AS first_sale_date FROM sales GROUP BY brand, sku",
    "shares": """
SELECT brand, sku, codigo_padre, sku_total_units, sku_total_units / greatest(sum(sku_total_units) OVER (PARTITION BY brand, codigo_padre), 1) AS size_sales_share,
       CAST(rank() OVER (PARTITION BY brand, codigo_padre ORDER BY sku_total_units DESC) AS INT) AS size_rank
FROM (SELECT brand, sku, CAST(sum(cantidad) AS BIGINT) AS sku_total_units FROM sales GROUP BY brand, sku) JOIN parents USING (brand, sku)""",
    "selling": f"""
SELECT {P4}, least(n / t, 1.0::DOUBLE) AS size_curve_completeness
FROM (SELECT {P4}, count(DISTINCT talla) AS n FROM weekly JOIN parents USING (brand, sku) WHERE units_sold > 0 GROUP BY {P4})
JOIN (SELECT brand, codigo_padre, count(DISTINCT talla) AS t FROM fx_products GROUP BY brand, codigo_padre) USING (brand, codigo_padre)""",
    "stock_week": f"""
SELECT {S4}, arg_max(stock_on_hand_units, fecha) AS stock_on_hand, arg_max(stock_in_transit_units, fecha) AS stock_in_transit,
       arg_max(total_stock_position_units, fecha) AS stock_total, count(*) FILTER (stock_on_hand_units = 0) AS stock_out_days
FROM (SELECT *, split_part(store_id, '-', 1) AS centro, CAST(date_trunc('week', fecha) AS DATE) AS week FROM fx_stock) GROUP BY {S4}""",
    "bo_signal": """
SELECT brand, codigo_padre AS cod_padre, sku, centro, CAST(sum(cantidad - coalesce(received, 0)) AS DOUBLE) AS open_qty,
       min(fecha_entrega) AS earliest_delivery, count(*) AS n_open_pos
FROM fx_po LEFT JOIN (SELECT brand, oc_numero, sku, sum(cantidad_recibida) AS received FROM fx_receipts GROUP BY ALL) USING (brand, oc_numero, sku)
GROUP BY brand, codigo_padre, sku, centro HAVING sum(cantidad - coalesce(received, 0)) > 0""",
    "rp_signal": """
SELECT brand, codigo_padre AS cod_padre, sku, centro,
       CAST(sum(CASE WHEN fecha_recepcion IS NULL THEN unidades ELSE 0 END) AS DOUBLE) AS units_in_transit,
       CAST(sum(CASE WHEN fecha_recepcion IS NOT NULL THEN unidades ELSE 0 END) AS DOUBLE) AS units_received_window,
       avg(date_diff('day', fecha_creacion, fecha_recepcion)) AS avg_transit_days, count(*) AS n_transfers
FROM fx_transfers GROUP BY brand, codigo_padre, sku, centro
HAVING sum(CASE WHEN fecha_recepcion IS NULL THEN unidades ELSE 0 END) > 0 OR sum(CASE WHEN fecha_recepcion IS NOT NULL THEN unidades ELSE 0 END) > 0""",
    "newest": "SELECT brand, max(week) AS latest FROM weekly GROUP BY brand",
    "weather_week": """
SELECT *, avg_temp - avg(avg_temp) OVER (PARTITION BY region ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS temp_deviation,
       CAST(total_rain > 20 AS INT) AS is_rainy_week
FROM (SELECT region, CAST(date_trunc('week', date) AS DATE) AS week, avg(temp_max + temp_min) / 2 AS avg_temp, max(temp_max) AS max_temp,
             min(temp_min) AS min_temp, sum(precipitation) AS total_rain, count(*) FILTER (precipitation > 1) AS rain_days
      FROM fx_weather GROUP BY ALL)""",
    "traffic_week": """
SELECT tienda_id AS centro, CAST(date_trunc('week', fecha) AS DATE) AS week, CAST(sum(entradas) AS BIGINT) AS weekly_entries,
       CAST(sum(salidas) AS BIGINT) AS weekly_exits, avg(tiempo_permanencia_prom) AS avg_dwell_time FROM fx_traffic GROUP BY ALL""",
    "contrib": "SELECT brand, sku, sum(contribucion_valor) AS v FROM fx_contribution GROUP BY brand, sku",
    "panel": f"""
SELECT *, month(week) AS month, date_diff('day', origin, week) / 7 AS week_num, ln(units) AS ln_units, ln(avg_price) AS ln_price,
       CASE WHEN avg_list_price > 0 THEN 1 - avg_price / avg_list_price ELSE 0.0::DOUBLE END AS discount_depth,
       CASE WHEN precio_normal > 0 THEN avg_price >= precio_normal * 0.95::DOUBLE ELSE true END AS is_normal_price
FROM (SELECT {S4}, CAST(sum(cantidad) AS BIGINT) AS units, count(DISTINCT folio) AS txn_count,
             avg(precio_final / cantidad) FILTER (clean) AS avg_price, avg(precio_lista) FILTER (clean) AS avg_list_price
      FROM sales GROUP BY {S4})
JOIN (SELECT brand, min(week) AS origin FROM sales GROUP BY brand) USING (brand)
JOIN (SELECT brand, material AS sku, codigo_padre, primera_jerarquia, segunda_jerarquia FROM fx_products) USING (brand, sku)
LEFT JOIN (SELECT brand, sku AS codigo_padre, precio_normal FROM fx_reference_prices) USING (brand, codigo_padre)
WHERE avg_price > 0 AND units > 0""",
    "elasticity": """
SELECT *, CASE WHEN r2 > 0.3::DOUBLE AND n_observations > 30 AND price_cv > 0.1::DOUBLE THEN 'high'
               WHEN r2 > 0.15::DOUBLE AND n_observations > 15 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT brand, codigo_padre, count(*) AS n_observations, stddev_samp(avg_price) / avg(avg_price) AS price_cv, avg(avg_price) AS avg_price,
             avg(units) AS avg_units_week, min(primera_jerarquia) AS primera_jerarquia, min(segunda_jerarquia) AS segunda_jerarquia,
             round(sum(dx * dy) / sum(dx * dx), 6) AS elasticity,
             round(1 - (sum(dy * dy) - sum(dx * dy) * sum(dx * dy) / sum(dx * dx)) / greatest(var_pop(ln_units) * count(*), 1e-10), 6) AS r2
      FROM (SELECT *, ln_price - avg(ln_price) OVER s AS dx, ln_units - avg(ln_units) OVER s AS dy
            FROM panel WINDOW s AS (PARTITION BY brand, codigo_padre, centro))
      GROUP BY brand, codigo_padre
      HAVING count(*) >= 10 AND stddev_samp(avg_price) / avg(avg_price) >= 0.05::DOUBLE AND sum(dx * dx) > 1e-9)""",
    "cat_elasticity": """
SELECT brand, primera_jerarquia, segunda_jerarquia, avg(elasticity) AS elasticity FROM elasticity GROUP BY ALL""",
    "reliable": "SELECT brand, codigo_padre, elasticity FROM elasticity WHERE confidence IN ('high', 'medium')",
    "features": f"""
SELECT t.*, first_sale_date, greatest(floor(date_diff('second', first_sale_date, CAST(t.week AS TIMESTAMP)) / 86400.0::DOUBLE) / 7, 0) AS product_age_weeks,
       codigo_padre, coalesce(size_sales_share, 0) AS size_sales_share, coalesce(size_rank, 99) AS size_rank,
       primera_jerarquia, segunda_jerarquia, tercera_jerarquia, genero, grupo_etario, color1,
       coalesce(size_curve_completeness, 0) AS size_curve_completeness,
       month(t.week) AS month, week(t.week) AS week_of_year, quarter(t.week) AS quarter,
       sin(2 * pi() * month(t.week) / 12) AS month_sin, cos(2 * pi() * month(t.week) / 12) AS month_cos,
       sin(2 * pi() * week(t.week) / 52) AS week_sin, cos(2 * pi() * week(t.week) / 52) AS week_cos,
       stock_on_hand, stock_in_transit, stock_total, stock_out_days,
       least(CASE WHEN velocity_4w > 0 THEN CASE WHEN stock_on_hand IS NOT NULL THEN stock_on_hand / velocity_4w END WHEN stock_on_hand > 0 THEN 52.0 ELSE 0.0 END, CASE WHEN stock_on_hand IS NOT NULL OR velocity_4w <= 0 THEN 52.0 END) AS weeks_of_cover,
       least(CASE WHEN units_sold > 0 THEN CASE WHEN stock_on_hand IS NOT NULL THEN stock_on_hand / units_sold END WHEN stock_on_hand > 0 THEN 99.0 ELSE 0.0 END, CASE WHEN stock_on_hand IS NOT NULL OR units_sold <= 0 THEN 99.0 END) AS stock_to_sales_ratio,
       CASE WHEN t.week >= latest THEN coalesce(open_qty, 0) ELSE 0 END AS open_po_units,
       CASE WHEN t.week >= latest THEN coalesce(n_open_pos, 0) ELSE 0 END AS n_open_pos,
       coalesce(CASE WHEN t.week >= latest THEN date_diff('day', t.week, earliest_delivery) END, 9999) AS days_to_delivery,
       CASE WHEN t.week >= latest THEN coalesce(units_in_transit, 0) ELSE 0 END AS units_in_transit,
       CASE WHEN t.week >= latest THEN coalesce(units_received_window, 0) ELSE 0 END AS units_received_window,
       CASE WHEN t.week >= latest THEN avg_transit_days END AS avg_transit_days,
       CASE WHEN t.week >= latest THEN coalesce(n_transfers, 0) ELSE 0 END AS n_transfers,
       avg_temp, max_temp, min_temp, total_rain, rain_days, temp_deviation, coalesce(is_rainy_week, 0) AS is_rainy_week,
       weekly_entries, avg_dwell_time, CASE WHEN weekly_entries > 0 THEN units_sold / weekly_entries END AS conversion_rate,
       coalesce(v, 0) AS mkdown_contrib_2024_clp, CAST(coalesce(v, 0) > 0 AS INT) AS mkdown_contrib_2024_present,
       sum(coalesce(v, 0)) OVER (PARTITION BY t.brand, codigo_padre) AS mkdown_contrib_2024_parent_total
FROM targets t
LEFT JOIN age USING (brand, sku)
LEFT JOIN (SELECT brand, sku, size_sales_share, size_rank FROM shares) USING (brand, sku)
LEFT JOIN (SELECT brand, material AS sku, codigo_padre, primera_jerarquia, segunda_jerarquia, tercera_jerarquia, genero, grupo_etario, color1
           FROM fx_products) USING (brand, sku)
LEFT JOIN selling USING (brand, codigo_padre, centro, week)
LEFT JOIN stock_week USING (brand, sku, centro, week)
LEFT JOIN newest USING (brand)
LEFT JOIN (SELECT brand, sku, centro, open_qty, earliest_delivery, n_open_pos FROM bo_signal) USING (brand, sku, centro)
LEFT JOIN (SELECT brand, sku, centro, units_in_transit, units_received_window, avg_transit_days, n_transfers FROM rp_signal) USING (brand, sku, centro)
LEFT JOIN (SELECT centro, w.* EXCLUDE (region) FROM weather_week w JOIN fx_stores USING (region)) USING (centro, week)
LEFT JOIN (SELECT centro, week, weekly_entries, avg_dwell_time FROM traffic_week) USING (centro, week)
LEFT JOIN contrib USING (brand, sku)""",
    "steps9": f"SELECT col0 AS s, row_number() OVER (ORDER BY col0) AS i FROM {ladder(C.MARGIN_LADDER)}",
    "defaults9": "SELECT s, l FROM (VALUES " + ", ".join(f"({s!r}::DOUBLE, {x!r}::DOUBLE)" for s, x in zip(C.MARGIN_LADDER, C.DEFAULT_LIFT)) + ") d(s, l)",
    "lift": """
SELECT brand, s AS step, greatest(1.0::DOUBLE, max(l) OVER (PARTITION BY brand ORDER BY s ROWS UNBOUNDED PRECEDING)) AS lift
FROM (SELECT b.brand, d.s, CASE WHEN total >= 150 AND base > 0 AND m.n >= 50 AND m.med > 0 THEN round_even(m.med / base, 2) ELSE d.l END AS l
      FROM (SELECT DISTINCT brand FROM features) b CROSS JOIN defaults9 d
      LEFT JOIN (SELECT brand, bucket, count(*) AS n, median(velocity_4w) AS med
                 FROM (SELECT brand, velocity_4w, (SELECT arg_min(s, (abs(s - discount_rate), s)) FROM steps9) AS bucket FROM features) GROUP BY ALL) m
        ON m.brand = b.brand AND m.bucket = d.s
      LEFT JOIN (SELECT brand, count(*) AS total FROM features GROUP BY brand) t ON t.brand = b.brand
      LEFT JOIN (SELECT brand, CASE WHEN count(*) >= 50 THEN median(velocity_4w) END AS base
                 FROM features WHERE (SELECT arg_min(s, (abs(s - discount_rate), s)) FROM steps9) = 0 GROUP BY brand) z ON z.brand = b.brand)""",
    "costs_by_parent": """
SELECT p.brand, p.codigo_padre, arg_max(c.cost, length(c.sku)) AS cost
FROM (SELECT DISTINCT brand, codigo_padre FROM fx_products) p JOIN fx_costs c ON p.brand = c.brand AND starts_with(p.codigo_padre, c.sku)
WHERE c.cost > 0 GROUP BY ALL""",
    "margin_rows": f"""
SELECT {S4}, avg_precio_lista AS price, velocity_4w AS vel, coalesce(discount_rate, 0) AS d, cost, elasticity AS e,
       CASE WHEN discount_rate < 0.025::DOUBLE THEN 0.0::DOUBLE ELSE (SELECT arg_min(s, (abs(s - discount_rate), s)) FROM steps9) END AS cur
FROM features LEFT JOIN costs_by_parent USING (brand, codigo_padre) LEFT JOIN reliable USING (brand, codigo_padre)
WHERE cost > 0 AND avg_precio_lista > 0 AND velocity_4w > 0""",
    "margin": f"""
SELECT {S4}, s AS optimal_disc_margin, CAST(s <> cur AS DOUBLE) AS should_reprice, p AS optimal_profit FROM (
SELECT *, row_number() OVER (PARTITION BY {S4} ORDER BY p DESC, s) AS rn FROM (
SELECT m.*, t.s, round((price * (1 - t.s) / 1.19::DOUBLE - cost) * CASE WHEN e < -0.3::DOUBLE
           THEN greatest(vel * (1 - (t.s - d) / greatest(1 - d, 0.01::DOUBLE) * e), 0.1::DOUBLE)
           ELSE greatest(vel * a.lift / greatest(b.lift, 0.1::DOUBLE), 0.1::DOUBLE) END, 6) AS p
FROM margin_rows m CROSS JOIN steps9 t
JOIN lift a ON a.brand = m.brand AND a.step = t.s JOIN lift b ON b.brand = m.brand AND b.step = m.cur
WHERE NOT (price * (1 - t.s) / 1.19::DOUBLE - cost <= 0 AND t.s > 0))) WHERE rn = 1""",
    "child": f"SELECT f.*, optimal_disc_margin, should_reprice, optimal_profit FROM features f LEFT JOIN margin USING ({S4})",
    "parent_sales": f"""
SELECT {P4}, CAST(sum(cantidad) AS BIGINT) AS units, sum(precio_final) AS revenue, count(DISTINCT sku) AS n_sizes,
       sum(descuento) / greatest(sum(precio_lista), 1) AS avg_discount_rate FROM sales GROUP BY {P4}""",
    "series_stats": f"""
SELECT {P3}, count(*) AS n_obs, min(week) AS lo, max(week) AS hi, date_diff('day', min(week), max(week)) / 7 + 1 AS span
FROM parent_sales GROUP BY {P3}""",
    "dense_sales": f"""
SELECT s.*, n_obs FROM parent_sales s JOIN series_stats USING ({P3}) WHERE NOT (n_obs / span >= 0.2::DOUBLE AND n_obs >= 8)
UNION ALL BY NAME
SELECT brand, codigo_padre, centro, week, coalesce(units, 0) AS units, coalesce(revenue, 0) AS revenue, n_sizes,
       coalesce(avg_discount_rate, 0) AS avg_discount_rate, n_obs
FROM (SELECT {P3}, n_obs, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week FROM series_stats
      WHERE n_obs / span >= 0.2::DOUBLE AND n_obs >= 8)
LEFT JOIN parent_sales USING ({P4})""",
    "life_windows": f"""
SELECT *, max(v4) OVER g AS peak, v4 / med AS ratio, v4 / greatest(v8, 0.01::DOUBLE) AS trend,
       max(CASE WHEN i = n - 1 THEN v4 END) OVER g AS now_v, max(CASE WHEN i = n - 8 THEN v4 END) OVER g AS then_v
FROM (SELECT d.*, avg(units) OVER (r ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v4, avg(units) OVER (r ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS v8,
             avg(units) OVER (r ROWS UNBOUNDED PRECEDING) AS vx, row_number() OVER r - 1 AS i, n, med
      FROM dense_sales d JOIN (SELECT {P3}, count(*) AS n, greatest(median(units), 0.1::DOUBLE) AS med FROM dense_sales GROUP BY {P3}) USING ({P3})
      WINDOW r AS (PARTITION BY {P3} ORDER BY week))
WINDOW g AS (PARTITION BY {P3})""",
    "life": f"""
SELECT {P4}, units, revenue, avg_discount_rate, n_sizes,
       CASE WHEN n_obs >= 3 THEN v4 END AS vel_4w, CASE WHEN n_obs >= 3 THEN v8 END AS vel_8w, CASE WHEN n_obs >= 3 THEN vx END AS vel_expanding,
       CASE WHEN n_obs >= 3 THEN ratio END AS vel_ratio, CASE WHEN n_obs >= 3 THEN trend END AS vel_trend,
       CASE WHEN n_obs >= 3 THEN i END AS week_idx,
       CASE WHEN n_obs < 3 OR i < 4 THEN 'launch' WHEN avg_discount_rate > 0.15::DOUBLE AND ratio < 0.7::DOUBLE THEN 'clearance'
            WHEN ratio < 0.5::DOUBLE OR (trend < 0.7::DOUBLE AND i > 8) THEN 'decline' WHEN v4 >= peak * 0.8::DOUBLE AND peak > 0 THEN 'peak'
            WHEN trend > 1.1::DOUBLE AND ratio > 0.8::DOUBLE THEN 'growth' ELSE 'steady' END AS lifecycle_stage,
       CASE WHEN n_obs >= 3 THEN i / greatest(n - 1, 1) ELSE 0.0::DOUBLE END AS lifecycle_position,
       CASE WHEN n_obs >= 3 AND n > 8 THEN CASE WHEN now_v <= 0 THEN 0.0::DOUBLE
            WHEN then_v > 0 AND now_v < then_v AND now_v > 0.5::DOUBLE THEN greatest(0.0::DOUBLE, ln(0.5::DOUBLE / now_v) / (ln(now_v / then_v) / 8)) END END AS est_weeks_remaining
FROM life_windows""",
    "seasons": """
SELECT brand, codigo_padre, w AS first_sale_week, CASE WHEN month(w) IN (9, 10, 11, 12, 1, 2) THEN 'SS' ELSE 'FW' END AS derived_season,
       year(w) - CASE WHEN month(w) IN (1, 2) THEN 1 ELSE 0 END AS derived_season_year,
       CASE WHEN month(w) IN (9, 10, 11, 12, 1, 2) THEN 'SS' ELSE 'FW' END
         || right(CAST(year(w) - CASE WHEN month(w) IN (1, 2) THEN 1 ELSE 0 END AS VARCHAR), 2) AS derived_season_full
FROM (SELECT brand, codigo_padre, min(week) AS w FROM parent_sales WHERE units > 0 GROUP BY ALL)""",
    "shoes": "SELECT brand, material AS sku, codigo_padre, talla FROM fx_products WHERE primera_jerarquia = 'Footwear'",
})


def _track(name: str, active: str, ever: str, source: str, peak: int = 12) -> None:
    STEPS[f"{name}_frag"] = f"""
SELECT {P4}, coalesce(CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / greatest(avg(gap), 0.01::DOUBLE) END, 0) AS fragmentation_index
FROM (SELECT *, num - lag(num) OVER (PARTITION BY {P4} ORDER BY num) AS gap
      FROM (SELECT *, TRY_CAST(replace(talla, ',', '.') AS DOUBLE) AS num FROM {active}) WHERE num IS NOT NULL) GROUP BY {P4}"""
    STEPS[name] = f"""
SELECT *, total_sizes_ever - active_sizes_4w AS lost_sizes, active_sizes_4w / greatest(total_sizes_ever, 1) AS size_completeness,
       core_sizes_total - core_sizes_active AS core_sizes_lost,
       CASE WHEN core_sizes_total > 0 THEN core_sizes_active / core_sizes_total ELSE 0 END AS core_completeness,
       1 - active_sizes_4w / greatest(peak_sizes, 1) AS attrition_rate, '{source}' AS source
FROM (SELECT *, max(active_sizes_4w) OVER (PARTITION BY {P3} ORDER BY week ROWS BETWEEN {peak - 1} PRECEDING AND CURRENT ROW) AS peak_sizes
      FROM (SELECT {P4}, count(DISTINCT talla) AS active_sizes_4w, count(DISTINCT talla) FILTER ({CORE}) AS core_sizes_active
            FROM {active} GROUP BY {P4})
      LEFT JOIN (SELECT {P3}, count(DISTINCT talla) AS total_sizes_ever, count(DISTINCT talla) FILTER ({CORE}) AS core_sizes_total
                 FROM {ever} GROUP BY {P3}) USING ({P3})
      LEFT JOIN {name}_frag USING ({P4}))"""


STEPS["held"] = f"""
SELECT {P4}, talla FROM (SELECT s.*, z.codigo_padre, z.talla, split_part(store_id, '-', 1) AS centro, CAST(date_trunc('week', fecha) AS DATE) AS week
                         FROM fx_stock s JOIN shoes z USING (brand, sku))
GROUP BY {P4}, talla HAVING arg_max(stock_on_hand_units, fecha) > 0"""
STEPS["sold_sizes"] = f"SELECT DISTINCT s.brand, s.codigo_padre, centro, week, talla FROM sales s JOIN shoes z ON s.brand = z.brand AND s.sku = z.sku"
STEPS["active_sizes"] = f"""
SELECT DISTINCT {P3}, talla, CAST(week + INTERVAL (7 * k) DAY AS DATE) AS week FROM sold_sizes, (VALUES (0), (1), (2), (3)) o(k)"""
_track("size_stock", "held", "held", "stock")
_track("size_sales", "active_sizes", "sold_sizes", "sales_proxy")

STEPS.update({
    "comp_parent": """
SELECT brand, codigo_padre, CAST(round_even(min(comp_price), 0) AS BIGINT) AS comp_min_price, CAST(round_even(avg(comp_price), 0) AS BIGINT) AS comp_avg_price,
       CAST(round_even(max(comp_price), 0) AS BIGINT) AS comp_max_price, count(DISTINCT competitor) AS comp_count,
       max(CAST(comp_discount > 0.05::DOUBLE AS INT)) AS comp_any_discount, max(comp_discount) AS comp_max_discount,
       count(*) FILTER (comp_in_stock) AS comp_in_stock_count
FROM fx_competitor_prices WHERE comp_price > 0 GROUP BY ALL""",
    "enh": f"""
SELECT c.*, coalesce(r.elasticity, ce.elasticity) AS price_elasticity,
       CASE lifecycle_stage WHEN 'launch' THEN 0 WHEN 'growth' THEN 1 WHEN 'peak' THEN 2 WHEN 'steady' THEN 3 WHEN 'decline' THEN 4
                            WHEN 'clearance' THEN 5 END AS lifecycle_stage_code, lifecycle_position,
       attrition_rate, core_completeness, fragmentation_index, active_sizes_4w, total_sizes_ever,
       comp_min_price, comp_avg_price, comp_max_price, coalesce(comp_count, 0) AS comp_count, coalesce(comp_any_discount, 0) AS comp_any_discount,
       coalesce(comp_max_discount, 0) AS comp_max_discount, coalesce(comp_in_stock_count, 0) AS comp_in_stock_count,
       CASE WHEN avg_precio_final > 0 AND comp_avg_price > 0 THEN avg_precio_final / comp_avg_price END AS comp_price_index,
       CASE WHEN avg_precio_final > 0 AND comp_avg_price > 0 THEN (avg_precio_final - comp_min_price) / avg_precio_final * 100 END AS comp_price_gap_pct,
       CASE WHEN avg_precio_final > 0 AND comp_avg_price > 0 THEN CAST(comp_min_price < avg_precio_final AS INT) ELSE 0 END AS comp_undercut,
       CASE WHEN comp_avg_price > 0 THEN coalesce(comp_max_discount, 0) - discount_rate ELSE 0.0::DOUBLE END AS comp_discount_pressure,
       CAST(coalesce(derived_season = 'FW', false) AS INT) AS is_fall_winter
FROM child c
LEFT JOIN reliable r USING (brand, codigo_padre)
LEFT JOIN cat_elasticity ce USING (brand, primera_jerarquia, segunda_jerarquia)
LEFT JOIN (SELECT {P4}, lifecycle_stage, lifecycle_position FROM life) USING ({P4})
LEFT JOIN (SELECT {P4}, attrition_rate, core_completeness, fragmentation_index, active_sizes_4w, total_sizes_ever FROM size_stock) USING ({P4})
LEFT JOIN comp_parent USING (brand, codigo_padre)
LEFT JOIN (SELECT brand, codigo_padre, derived_season FROM seasons) USING (brand, codigo_padre)""",
    "enh_labels": """
SELECT e.*, coalesce(primera_jerarquia, 'Unknown') || '_' || CAST(coalesce(lifecycle_stage_code, -1) AS VARCHAR) AS l1,
       coalesce(primera_jerarquia, 'Unknown') || '_' || CAST(is_fall_winter AS VARCHAR) AS l2,
       coalesce(primera_jerarquia, 'Unknown') || '_' || CASE WHEN velocity_4w <= q33 THEN 'low' WHEN velocity_4w <= q66 THEN 'med' ELSE 'high' END AS l3,
       coalesce(primera_jerarquia, 'Unknown') || '_' || CASE WHEN product_age_weeks < 8 THEN 'new' WHEN product_age_weeks <= 26 THEN 'mid' ELSE 'old' END AS l4
FROM enh e JOIN (SELECT brand, quantile_cont(velocity_4w, 0.33::DOUBLE) AS q33, quantile_cont(velocity_4w, 0.66::DOUBLE) AS q66 FROM enh GROUP BY brand) USING (brand)""",
    "enhanced": """
SELECT * EXCLUDE (l1, l2, l3, l4), dense_rank() OVER (PARTITION BY brand ORDER BY l1) - 1 AS cat_x_lifecycle,
       dense_rank() OVER (PARTITION BY brand ORDER BY l2) - 1 AS cat_x_season, dense_rank() OVER (PARTITION BY brand ORDER BY l3) - 1 AS cat_x_velocity,
       dense_rank() OVER (PARTITION BY brand ORDER BY l4) - 1 AS cat_x_age FROM enh_labels""",
    "weighted": f"""
SELECT {P4}, least(sum(share * has) / greatest(sum(share), 0.001::DOUBLE), 1.0::DOUBLE) AS weighted_size_avail,
       sum(share * (1 - has)) AS revenue_at_risk_pct, avg(has) FILTER (size_rank <= 3) AS top3_sizes_in_stock
FROM (SELECT brand, p.codigo_padre, centro, week, coalesce(size_sales_share, 0) AS share, size_rank, CAST(stock_on_hand > 0 AS INT) AS has
      FROM stock_week JOIN parents p USING (brand, sku) LEFT JOIN (SELECT brand, sku, size_sales_share, size_rank FROM shares) USING (brand, sku))
GROUP BY {P4}""",
    "parent_raw": f"""
SELECT {P4}, """ + ", ".join(
        [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("units_sold", "net_units", "cumulative_units", "units_returned", "click_collect_units",
                                                     "instore_units", "txn_count", "stock_on_hand", "stock_in_transit", "stock_total")]
        + [f"sum({c}) AS {c}" for c in ("gross_revenue", "velocity_1w", "velocity_2w", "velocity_4w", "velocity_8w", "instore_velocity_4w",
                                        "total_list_value", "total_discount", "mkdown_contrib_2024_clp")]
        + [f"median({c}) AS {c}" for c in ("avg_precio_lista", "avg_precio_final", "discount_rate", "optimal_disc_margin")]
        + [f"max({c}) AS {c}" for c in ("max_precio_lista", "has_discount", "max_discount_rate", "cumulative_disc_weeks", "product_age_weeks",
                                        "price_changed", "will_discount_4w", "future_max_disc_4w", "should_reprice", "stock_out_days")]
        + [f"min({c}) AS {c}" for c in ("min_precio_lista", "weeks_since_discount", "first_sale_date")]
        + [f"avg({c}) AS {c}" for c in ("disc_exposure_rate", "price_change_pct")]
        + [f"arg_min({c}, sku) AS {c}" for c in (
            "weekly_entries", "avg_dwell_time", "price_elasticity", "lifecycle_stage_code", "lifecycle_position", "attrition_rate",
            "core_completeness", "fragmentation_index", "is_fall_winter", "month", "week_of_year", "quarter", "month_sin", "month_cos", "week_sin",
            "week_cos", "avg_temp", "max_temp", "min_temp", "total_rain", "rain_days", "temp_deviation", "is_rainy_week", "comp_min_price",
            "comp_avg_price", "comp_max_price", "comp_count", "comp_any_discount", "comp_max_discount", "comp_in_stock_count",
            "mkdown_contrib_2024_parent_total", "comp_price_index", "comp_price_gap_pct", "comp_undercut", "comp_discount_pressure",
            "cat_x_lifecycle", "cat_x_season", "cat_x_velocity", "cat_x_age", "mkdown_contrib_2024_present")]
        + ["coalesce(sum(future_velocity_2w), 0) AS future_velocity_2w", "coalesce(sum(optimal_profit), 0) AS optimal_profit",
           "count(*) FILTER (units_sold > 0) AS n_active", "count(*) FILTER (stock_on_hand > 0) AS n_held", "count(stock_on_hand) AS n_counted"])
    + f" FROM enhanced GROUP BY {P4}",
    "catalogue": """
SELECT brand, codigo_padre, arg_min(primera_jerarquia, material) AS primera_jerarquia, arg_min(segunda_jerarquia, material) AS segunda_jerarquia,
       arg_min(genero, material) AS genero, arg_min(grupo_etario, material) AS grupo_etario,
       trim(regexp_replace(regexp_replace(arg_min(material_descripcion, material), '\\s*N[°º]?\\s*[\\d,\\.]+\\s*$', ''), '\\s*T/[A-Z]+\\s*$', '')) AS product_name,
       count(DISTINCT material) AS total_sizes_catalog FROM fx_products GROUP BY ALL""",
    "parent": f"""
SELECT p.* EXCLUDE (n_active, n_held, n_counted), weighted_size_avail, revenue_at_risk_pct, top3_sizes_in_stock,
       primera_jerarquia, segunda_jerarquia, genero, grupo_etario,
       CASE WHEN n_counted > 0 THEN n_held / n_counted END AS pct_sizes_in_stock,
       least(CASE WHEN velocity_4w > 0 THEN CASE WHEN stock_on_hand IS NOT NULL THEN stock_on_hand / velocity_4w END WHEN stock_on_hand > 0 THEN 52.0 ELSE 0.0 END, CASE WHEN stock_on_hand IS NOT NULL OR velocity_4w <= 0 THEN 52.0 END) AS weeks_of_cover,
       least(CASE WHEN units_sold > 0 THEN CASE WHEN stock_on_hand IS NOT NULL THEN stock_on_hand / units_sold END WHEN stock_on_hand > 0 THEN 99.0 ELSE 0.0 END, CASE WHEN stock_on_hand IS NOT NULL OR units_sold <= 0 THEN 99.0 END) AS stock_to_sales_ratio,
       CASE WHEN velocity_4w > 0 THEN velocity_2w / velocity_4w ELSE 1 END AS velocity_trend,
       CASE WHEN weekly_entries > 0 THEN units_sold / weekly_entries END AS conversion_rate,
       CASE WHEN velocity_2w > 0 THEN future_velocity_2w / velocity_2w END AS velocity_lift,
       least(n_active / total_sizes_catalog, 1.0::DOUBLE) AS size_curve_completeness,
       CASE WHEN units_sold > 0 THEN click_collect_units / units_sold ELSE 0 END AS click_collect_ratio
FROM parent_raw p LEFT JOIN weighted USING ({P4}) LEFT JOIN catalogue USING (brand, codigo_padre)""",
    "target_week": """
SELECT brand, coalesce(max(week) FILTER (n >= 10), max(week)) AS week FROM (SELECT brand, week, count(*) AS n FROM parent GROUP BY ALL) GROUP BY brand""",
})


def regression(keys: list[str], kept: str, tiers: bool = False) -> str:
    """Least squares of ln units on ln price with month, trend (and tier) controls and store means taken out, per ``keys``.

    The ridge and the rounds that take it back are those of the definition;
    elimination runs as a recursion over the pivots.
    """
    xs = ["ln_price"] + [f"CAST(month = {m} AS DOUBLE)" for m in range(2, 13)] + ["week_num / 100.0::DOUBLE"]
    if tiers:
        bounds = [0.07, 0.175, 0.25, 0.35, 1e9]
        xs += [f"CAST(discount_depth >= {a}::DOUBLE AND discount_depth < {b}::DOUBLE AS DOUBLE)" for a, b in zip(bounds, bounds[1:])]
    n, by = len(xs), ", ".join(keys)
    within = ", ".join(f"{x} - avg({x}) OVER s AS x{i}" for i, x in enumerate(xs))
    gram = ", ".join("[" + ", ".join(f"sum(x{min(i, j)} * x{max(i, j)})" for j in range(n)) + "]" for i in range(n))
    side = ", ".join(f"sum(x{i} * y)" for i in range(n))
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""
WITH RECURSIVE moments AS (
  SELECT {by}, count(*) AS n_observations, avg(avg_price) AS avg_price, avg(units) AS avg_units_week, stddev_samp(avg_price) / avg(avg_price) AS price_cv,
         min(primera_jerarquia) AS h1, min(segunda_jerarquia) AS h2, var_pop(ln_units) * count(*) AS sst, sum(y * y) AS yy, [{gram}] AS g, [{side}] AS h
  FROM (SELECT *, ln_units - avg(ln_units) OVER s AS y, {within} FROM panel WHERE {known} WINDOW s AS (PARTITION BY {by}, centro))
  GROUP BY {by} HAVING {kept}),
scaled AS (
  SELECT *, list_transform(g, lambda r, i: list_transform(r, lambda v, j: v * sc[i] * sc[j])) AS a, list_transform(h, lambda v, i: v * sc[i]) AS c
  FROM (SELECT *, list_transform(g, lambda r, i: CASE WHEN r[i] > 1e-9 THEN 1 / sqrt(r[i]) ELSE 0.0::DOUBLE END) AS sc FROM moments)),
pivots AS (
  SELECT {by}, 1 AS k, list_transform(a, lambda r, i: list_concat(list_transform(r, lambda v, j: v + CASE WHEN i = j THEN 1e-6::DOUBLE ELSE 0.0::DOUBLE END),
         list_transform(r, lambda v, j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS m FROM scaled
  UNION ALL
  SELECT {by}, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k])
         ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM pivots WHERE k <= {n}),
inverse AS (SELECT {by}, list_transform(m, lambda r: r[{n + 1}:{2 * n}]) AS p FROM pivots WHERE k = {n + 1}),
steps_back AS (
  SELECT {by}, 0 AS t, a, c, p, list_transform(c, lambda v: 0.0::DOUBLE) AS b FROM scaled JOIN inverse USING ({by})
  UNION ALL
  SELECT {by}, t + 1, a, c, p, list_transform(p, lambda r, i: b[i] + list_dot_product(r, gap))
  FROM (SELECT *, list_transform(c, lambda v, i: v - list_dot_product(a[i], b)) AS gap FROM steps_back WHERE t < 9))
SELECT {by}, n_observations, avg_price, avg_units_week, price_cv, elasticity, r2, h1, h2,
       CASE WHEN r2 > 0.3::DOUBLE AND n_observations > 30 AND price_cv > 0.1::DOUBLE THEN 'high'
            WHEN r2 > 0.15::DOUBLE AND n_observations > 15 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT s.*, b[1] * sc[1] AS elasticity, 1 - (yy - list_dot_product(s.c, b)) / greatest(sst, 1e-10) AS r2
      FROM scaled s JOIN (SELECT {by}, b FROM steps_back WHERE t = 9) USING ({by}))"""


def assemble(query: str) -> str:
    """The query with the steps it needs, each defined once and before its use."""
    needed, stack = set(), [query]
    while stack:
        for word in set(re.findall(r"[a-z_][a-z0-9_]*", stack.pop())):
            if word in STEPS and word not in needed:
                needed.add(word)
                stack.append(STEPS[word])
    parts = [f"{n} AS MATERIALIZED ({STEPS[n]})" for n in STEPS if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" + query) if parts else query
