"""SQL steps of pricing, channels, alerts, decisions and outcomes."""
from rebaja import constants as C
from rebaja.oracle import steps as S
from rebaja.oracle.steps import STEPS, fixed, ladder, pct, snap_disc, snap_nearest, snap_up, vendor, velocity_both, velocity_down

RULES = [  # (test, points, reason) in the order the reasons are listed
    ("cc > 0.3::DOUBLE", 0, f"'Click&collect ' || {pct('cc')} || ' of sales (in-store: ' || {fixed('coalesce(instore_velocity_4w, 0)', 1)} || ' u/sem)'"),
    ("velocity_trend < 0.5::DOUBLE", 3, "'Velocity collapsed (trend < 0.5)'"),
    ("velocity_trend >= 0.5::DOUBLE AND velocity_trend < 0.7::DOUBLE", 2, "'Velocity declining'"),
    ("lifecycle_stage_code = 5", 3, "'In clearance stage'"),
    ("lifecycle_stage_code = 4", 2, "'In decline stage'"),
    ("attrition_rate > 0.5::DOUBLE", 3, f"'Size curve critical (' || {pct('attrition_rate')} || ' attrition)'"),
    ("attrition_rate > 0.3::DOUBLE AND attrition_rate <= 0.5::DOUBLE", 1, f"'Size curve breaking (' || {pct('attrition_rate')} || ' attrition)'"),
    ("product_age_weeks > 40", 2, "'Product is ' || CAST(CAST(floor(product_age_weeks) AS INT) AS VARCHAR) || ' weeks old'"),
    ("product_age_weeks > 26 AND product_age_weeks <= 40", 1, "'Product is ' || CAST(CAST(floor(product_age_weeks) AS INT) AS VARCHAR) || ' weeks old'"),
    ("cover = 3", 3, f"'Overstocked (' || {fixed('weeks_of_cover', 0)} || ' weeks of cover)'"),
    ("cover = 2", 2, f"'High stock (' || {fixed('weeks_of_cover', 0)} || ' WoC) + slowing sales'"),
    ("cover = 1", 1, f"'Elevated stock (' || {fixed('weeks_of_cover', 0)} || ' WoC)'"),
    ("stock_on_hand > 0 AND weighted_size_avail < 0.3::DOUBLE", 3, f"'Best sellers out of stock (' || {pct('weighted_size_avail')} || ' vol-weighted avail)'"),
    ("stock_on_hand > 0 AND weighted_size_avail >= 0.3::DOUBLE AND weighted_size_avail < 0.5::DOUBLE", 2, f"'Key sizes depleting (' || {pct('weighted_size_avail')} || ' vol-weighted avail)'"),
    ("stock_on_hand > 0 AND weighted_size_avail >= 0.5::DOUBLE AND weighted_size_avail < 0.7::DOUBLE", 1, f"'Size run weakening (' || {pct('weighted_size_avail')} || ' vol-weighted avail)'"),
    ("stock_on_hand > 0 AND weighted_size_avail IS NULL AND pct_sizes_in_stock < 0.4::DOUBLE", 2, f"'Broken size run (' || {pct('pct_sizes_in_stock')} || ' sizes in stock)'"),
    ("top3_sizes_in_stock < 0.5::DOUBLE", 2, f"'Top sellers stockout (' || {pct('top3_sizes_in_stock')} || ' of top 3 in stock)'"),
    ("max_discount_rate > 0.1::DOUBLE AND discount_rate < 0.05::DOUBLE", 1, "'Discounted in other channels'"),
    ("comp_undercut > 0 AND (velocity_4w < 0.5::DOUBLE OR velocity_trend < 0.7::DOUBLE)", 2, "'Competitor cheaper ' || gap_text || ' + velocity weak'"),
    ("comp_undercut > 0 AND NOT (velocity_4w < 0.5::DOUBLE OR velocity_trend < 0.7::DOUBLE)", 0, "'Competitor cheaper ' || gap_text || ' — velocity healthy, hold price'"),
    ("markdown_probability > 0.9::DOUBLE", 1, None),
]
SCORE = " + ".join(f"CASE WHEN {t} THEN {p} ELSE 0 END" for t, p, _ in RULES if p)
REASONS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {t} THEN {r} END" for t, _, r in RULES if r) + ")"
TIER_SCORE = ("(CASE WHEN markdown_probability > 0.85::DOUBLE THEN 3 WHEN markdown_probability > 0.70::DOUBLE THEN 2 WHEN markdown_probability > 0.50::DOUBLE THEN 1 ELSE 0 END"
              " + CASE WHEN e < -0.3::DOUBLE THEN 2 ELSE 0 END + CASE WHEN velocity_4w >= 2 THEN 2 WHEN velocity_4w >= 1 THEN 1 ELSE 0 END"
              " + CASE WHEN product_age_weeks >= 8 THEN 1 ELSE 0 END)")
TIER = f"CASE WHEN {TIER_SCORE} >= 6 THEN 'HIGH' WHEN {TIER_SCORE} >= 4 THEN 'MEDIUM' ELSE 'LOW' END"
V = "1.19::DOUBLE"


def first_step(test: str) -> str:
    """First (shallowest) ladder step whose candidate price passes."""
    arms = " ".join(f"WHEN {test.format(p=f'c{i}')} THEN {i}" for i in range(5))
    return f"CASE {arms} END"


STEPS.update({
    "scored": """
SELECT *, least(0.99::DOUBLE, 0.30::DOUBLE + 0.08::DOUBLE * coalesce(lifecycle_stage_code, 3) + 0.5::DOUBLE * coalesce(discount_rate, 0)) AS markdown_probability,
       least(0.60::DOUBLE, coalesce(discount_rate, 0) + 0.10::DOUBLE) AS raw_depth FROM parent""",
    "pr0": f"""
SELECT s.*, e.elasticity AS e, coalesce(discount_rate, 0) AS d, product_name, coalesce(total_sizes_catalog, 1) AS total_sizes_catalog,
       coalesce(trim(substr(sucursal, strpos(sucursal, '-') + 1)), centro) AS store_name,
       CAST(round_even(cost, 0) AS BIGINT) AS raw_cost, CASE WHEN cost IS NULL THEN 0 ELSE CAST(round_even(coalesce(rebate, 0), 0) AS BIGINT) END AS rebate_amount,
       coalesce(click_collect_ratio, 0) AS cc,
       CASE WHEN comp_price_gap_pct IS NULL THEN '' ELSE printf('%+.0f', round_even(comp_price_gap_pct, 0)) || '%' END AS gap_text
FROM scored s LEFT JOIN reliable e USING (brand, codigo_padre)
LEFT JOIN (SELECT brand, codigo_padre, product_name, total_sizes_catalog FROM catalogue) USING (brand, codigo_padre)
LEFT JOIN fx_stores USING (centro) LEFT JOIN costs_by_parent USING (brand, codigo_padre)
LEFT JOIN (SELECT b.brand, b.parent_sku AS codigo_padre, w.week, max(aporte_unitario) AS rebate
           FROM fx_rebates b JOIN (SELECT DISTINCT brand, week FROM parent) w ON w.brand = b.brand AND w.week BETWEEN fecha_inicio AND fecha_termino
           GROUP BY ALL) USING (brand, codigo_padre, week)
WHERE NOT ({' OR '.join(f"starts_with(centro, '{x}')" for x in C.NON_RETAIL_STORES)})""",
    "pr1": f"""
SELECT *, CASE WHEN raw_cost IS NOT NULL THEN greatest(raw_cost - rebate_amount, 0) END AS unit_cost, {snap_disc('d')} AS cur,
       coalesce({snap_nearest('avg_precio_final')}, 0) AS now_p, {snap_nearest('avg_precio_lista')} AS list_anchor,
       CAST(trunc(size_curve_completeness * total_sizes_catalog) AS BIGINT) AS n_sell,
       CASE WHEN NOT stock_on_hand > 0 THEN 0 WHEN weeks_of_cover > 20 AND velocity_trend <= 1 THEN 3
            WHEN weeks_of_cover > 12 AND velocity_trend < 0.8::DOUBLE THEN 2 WHEN weeks_of_cover > 8 THEN 1 ELSE 0 END AS cover FROM pr0""",
    "pr2": f"""
SELECT *, CASE cur WHEN 0.15::DOUBLE THEN 0.0::DOUBLE WHEN 0.2::DOUBLE THEN 0.15::DOUBLE WHEN 0.3::DOUBLE THEN 0.2::DOUBLE WHEN 0.4::DOUBLE THEN 0.3::DOUBLE END AS up_step FROM pr1""",
    "pr3": "SELECT *, avg_precio_lista * (1 - up_step) AS up_raw FROM pr2",
    "pr4": f"SELECT *, {snap_up('up_raw')} AS up_snap FROM pr3",
    "pr5": """
SELECT *, coalesce(up_snap > avg_precio_lista, false) AS premium,
       CASE WHEN up_snap > avg_precio_lista AND NOT coalesce(velocity_4w >= 2, false) THEN list_anchor ELSE up_snap END AS up_price FROM pr4""",
    "pricing_rows": """
SELECT *, coalesce(d > 0.05::DOUBLE AND cur > 0 AND avg_precio_lista > 0 AND velocity_4w >= 1 AND velocity_trend >= 1
       AND NOT coalesce(lifecycle_stage_code IN (4, 5), false) AND coalesce(attrition_rate, 0) < 0.3::DOUBLE AND product_age_weeks < 35
       AND NOT coalesce(weeks_of_cover > 15, false) AND up_price > now_p + 2000, false) AS is_up FROM pr5""",
    "ups": f"""
SELECT *, up_price AS price, up_step AS step, greatest(CASE WHEN e < -0.3::DOUBLE
       THEN velocity_4w * (1 + (up_price - now_p) / greatest(now_p, 1)::DOUBLE * e) ELSE velocity_4w * 0.75::DOUBLE END, 0.3::DOUBLE) AS ev,
       'INCREASE' AS urgency, 'increase' AS action_type, CASE WHEN up_step <= 0 THEN 'Full price' ELSE {pct('up_step')} END AS rec_text,
       CASE WHEN premium OR NOT coalesce(e < -0.3::DOUBLE, false) THEN 'SPECULATIVE' ELSE {TIER} END AS tier,
       false AS below, false AS capped FROM pricing_rows WHERE is_up""",
    "dn0": f"""
SELECT *, {snap_disc('raw_depth')} AS sug,
       CASE cur WHEN 0 THEN 0.15::DOUBLE WHEN 0.15::DOUBLE THEN 0.2::DOUBLE WHEN 0.2::DOUBLE THEN 0.3::DOUBLE WHEN 0.3::DOUBLE THEN 0.4::DOUBLE END AS deeper,
       {", ".join(f"avg_precio_lista * (1 - {s!r}::DOUBLE) AS r{i}" for i, s in enumerate(C.PRICE_LADDER))}
FROM pricing_rows WHERE NOT is_up AND markdown_probability >= 0.5::DOUBLE AND avg_precio_lista > 0""",
    "dn1": f"""
SELECT *, CASE WHEN sug > cur THEN sug WHEN markdown_probability > 0.8::DOUBLE THEN deeper END AS s0,
       {", ".join(f"{snap_nearest(f'r{i}')} AS c{i}" for i in range(5))} FROM dn0""",
    "dn2": """
SELECT *, CASE s0 WHEN 0.15::DOUBLE THEN c1 WHEN 0.2::DOUBLE THEN c2 WHEN 0.3::DOUBLE THEN c3 WHEN 0.4::DOUBLE THEN c4 ELSE c0 END AS p0,
       coalesce(unit_cost > 0, false) AS costed FROM dn1 WHERE s0 IS NOT NULL""",
    "dn3": f"""
SELECT *, costed AND p0 / {V} < unit_cost AS below, {first_step('{p} / ' + V + ' >= unit_cost')} AS k1 FROM dn2 WHERE abs(p0 - now_p) >= 2000""",
    "dn4": """
SELECT *, CASE WHEN below THEN [0.0::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE][k1 + 1] ELSE s0 END AS s1,
       CASE WHEN below THEN [c0, c1, c2, c3, c4][k1 + 1] ELSE p0 END AS p1 FROM dn3 WHERE NOT below OR k1 IS NOT NULL""",
    "dn5": f"""
SELECT *, costed AND round_even((p1 / {V} - unit_cost) / (p1 / {V}) * 100, 1) < 15 AS thin,
       {first_step('({p} / ' + V + ' - unit_cost) / ({p} / ' + V + ') * 100 >= 15')} AS k2 FROM dn4 WHERE abs(p1 - now_p) >= 2000""",
    "dn6": """
SELECT *, CASE WHEN thin THEN [0.0::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE][k2 + 1] ELSE s1 END AS step,
       CASE WHEN thin THEN [c0, c1, c2, c3, c4][k2 + 1] ELSE p1 END AS price FROM dn5 WHERE NOT thin OR k2 IS NOT NULL""",
    "downs": f"""
SELECT *, {velocity_down('velocity_4w', 'd', 'step', 'e')} AS ev,
       CASE WHEN {SCORE} >= 5 THEN 'HIGH' WHEN {SCORE} >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS urgency, 'decrease' AS action_type,
       CASE WHEN step <= 0 THEN '0%' ELSE {pct('step')} END AS rec_text, {TIER} AS tier, thin AND step <> s1 AS capped
FROM dn6 WHERE (NOT thin OR step > cur) AND abs(price - now_p) >= 2000""",
})
_MP = f"CASE WHEN unit_cost > 0 THEN round_even((price / {V} - unit_cost) / (price / {V}) * 100, 1) END"
COMMON = f"""brand, week, codigo_padre, centro, store_name, product_name, primera_jerarquia, segunda_jerarquia, n_sell, total_sizes_catalog,
       product_age_weeks, stock_on_hand, weeks_of_cover, avg_precio_lista, now_p, cur, velocity_4w, price, rec_text, ev, unit_cost, raw_cost, rebate_amount,
       urgency, tier, action_type, markdown_probability, click_collect_ratio, {_MP} AS mp"""
UP_REASONS = f"""concat_ws('; ', 'Selling ' || {fixed('velocity_4w', 1)} || ' u/sem at ' || {pct('cur')} || ' off -- test higher price',
       CASE WHEN premium THEN 'PREMIUM: above list price (' || format('{{:,}}', list_anchor) || ' -> ' || format('{{:,}}', up_price) || ')' END,
       CASE WHEN NOT coalesce(e < -0.3::DOUBLE, false) THEN 'Sin elasticidad — volumen estimado' END,
       CASE WHEN velocity_trend > 1.1::DOUBLE THEN 'Sales accelerating' END,
       CASE WHEN n_sell >= total_sizes_catalog * 0.7::DOUBLE THEN 'Size curve healthy (' || n_sell || '/' || total_sizes_catalog || ')' END,
       CASE WHEN unit_cost > 0 THEN 'Margin recovery: ' || {fixed(_MP, 0)} || '% at new price' END,
       CASE WHEN {_MP} < 20 THEN 'THIN MARGIN: ' || {fixed(_MP, 0)} || '% at recommended price' END)"""
DOWN_REASONS = f"""concat_ws('; ', CASE WHEN {REASONS} = '' THEN 'Model predicts markdown based on overall patterns' ELSE {REASONS} END,
       CASE WHEN below THEN 'Discount capped to protect margin (cost=' || format('{{:,}}', unit_cost) || ')' END,
       CASE WHEN capped THEN 'Discount capped at ' || {pct('step')} || ' to protect margin (floor=15%)' END,
       CASE WHEN {_MP} < 20 THEN 'THIN MARGIN: ' || {fixed(_MP, 0)} || '% at recommended price' END)"""
STEPS.update({
    "acts0": f"SELECT {COMMON}, {UP_REASONS} AS reasons FROM ups UNION ALL BY NAME SELECT {COMMON}, {DOWN_REASONS} AS reasons FROM downs",
    "web": """
SELECT brand, week, codigo_padre, median(avg_precio_final) FILTER (centro LIKE 'AB%') AS ecomm_price, median(discount_rate) FILTER (centro LIKE 'AB%') AS ecomm_discount,
       round(sum(velocity_4w) FILTER (centro LIKE 'AB%') + coalesce(sum(click_collect_units) FILTER (centro NOT LIKE 'AB%'), 0), 6) AS ecomm_velocity
FROM pricing_rows GROUP BY ALL HAVING count(*) FILTER (centro LIKE 'AB%') > 0""",
    "acts": f"""
SELECT a.brand, a.week, a.codigo_padre AS parent_sku, centro AS store, store_name, product_name AS product, primera_jerarquia AS category,
       segunda_jerarquia AS subcategory, n_sell AS sizes_selling, total_sizes_catalog AS sizes_total, CAST(trunc(product_age_weeks) AS BIGINT) AS product_age_weeks,
       stock_on_hand, round_even(weeks_of_cover, 1) AS weeks_of_cover, CAST(trunc(avg_precio_lista) AS BIGINT) AS current_list_price, now_p AS current_price,
       CASE WHEN cur <= 0 THEN '0%' ELSE {pct('cur')} END AS current_discount, round_even(velocity_4w, 1) AS current_velocity, price AS recommended_price,
       rec_text AS recommended_discount, round_even(ev, 1) AS expected_velocity, CAST(trunc(velocity_4w * now_p) AS BIGINT) AS current_weekly_rev,
       CAST(trunc(ev * price) AS BIGINT) AS expected_weekly_rev, CAST(trunc(ev * price - velocity_4w * now_p) AS BIGINT) AS rev_delta,
       unit_cost, raw_cost, rebate_amount, mp AS margin_pct,
       CASE WHEN unit_cost > 0 THEN CAST(trunc((price / {V} - unit_cost) * ev - (now_p / {V} - unit_cost) * velocity_4w) AS BIGINT) END AS margin_delta,
       urgency, reasons, round_even(markdown_probability, 3) AS model_confidence, tier AS confidence_tier, action_type, {vendor('a.codigo_padre')} AS vendor_brand,
       round_even(click_collect_ratio, 4) AS click_collect_ratio, ecomm_price, ecomm_discount, ecomm_velocity,
       CASE WHEN ecomm_price > 0 AND now_p <> 0 THEN round_even((now_p - ecomm_price) / now_p * 100, 1) END AS ecomm_price_gap_pct
FROM acts0 a LEFT JOIN web USING (brand, week, codigo_padre)""",
    "acts_now": "SELECT a.* FROM acts a JOIN target_week USING (brand, week)",
    "acts_ch": """
SELECT *, CASE WHEN store LIKE 'AB%' THEN 'ecomm' ELSE 'bm' END AS channel,
       CASE recommended_discount WHEN 'Full price' THEN 0.0::DOUBLE ELSE CAST(replace(recommended_discount, '%', '') AS DOUBLE) / 100 END AS step FROM acts""",
    "ch_votes": "SELECT brand, week, parent_sku, channel, step, count(*) AS n FROM acts_ch GROUP BY ALL",
    "ch_signal": """
SELECT brand, week, parent_sku, channel, round(sum(step * greatest(current_velocity, 0.01::DOUBLE)) / sum(greatest(current_velocity, 0.01::DOUBLE)), 9) AS mean_step,
       max(CASE urgency WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) FILTER (urgency <> 'INCREASE') AS sev,
       max(CASE confidence_tier WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS trust, max(rebate_amount) AS rebate_amount
FROM acts_ch GROUP BY ALL""",
    "ch_variance": """
SELECT brand, week, parent_sku, channel, CASE WHEN sum(n) >= 2 THEN 1 - max(n) / sum(n)::DOUBLE ELSE 0 END AS variance FROM ch_votes GROUP BY ALL""",
    "ch_pieces": "SELECT brand, week, parent_sku, channel, trim(unnest(string_split(reasons, ';'))) AS r FROM acts_ch",
    "ch_reasons": """
SELECT brand, week, parent_sku, channel, string_agg(r, '; ' ORDER BY k) AS reasons FROM (
SELECT *, row_number() OVER (PARTITION BY brand, week, parent_sku, channel ORDER BY n DESC, r) AS k
FROM (SELECT brand, week, parent_sku, channel, r, count(*) AS n FROM ch_pieces WHERE r <> '' GROUP BY ALL)) WHERE k <= 3 GROUP BY ALL""",
    "ch_rows": "SELECT *, CASE WHEN centro LIKE 'AB%' THEN 'ecomm' ELSE 'bm' END AS channel, CASE WHEN velocity_4w > 0 THEN velocity_4w ELSE 1e-9 END AS w FROM pricing_rows",
    "ch_group": """
SELECT * FROM (SELECT brand, week, codigo_padre AS parent_sku, channel, count(DISTINCT centro) AS n_stores, round(sum(coalesce(velocity_4w, 0)), 6) AS vel,
       string_agg(DISTINCT centro, ',' ORDER BY centro) AS stores_in_channel, sum(stock_on_hand) AS stock, median(avg_precio_lista) AS lp,
       round(sum(coalesce(avg_precio_final, 0) * w) / sum(w), 6) AS price, round(sum(coalesce(discount_rate, 0) * w) / sum(w), 9) AS disc,
       any_value(e) AS e, min(product_name) AS product, min(primera_jerarquia) AS category, min(segunda_jerarquia) AS subcategory
FROM ch_rows GROUP BY ALL) LEFT JOIN (SELECT brand, codigo_padre AS parent_sku, cost FROM costs_by_parent) USING (brand, parent_sku)
WHERE vel > 0 AND lp IS NOT NULL""",
    "ch_inputs": """
SELECT brand, week, parent_sku, channel, 'channel' AS who, lp, price, disc, vel, cost, e FROM ch_group JOIN ch_signal USING (brand, week, parent_sku, channel)
UNION ALL
SELECT g.brand, g.week, g.parent_sku, g.channel, r.centro AS who, g.lp, coalesce(r.avg_precio_final, g.price), coalesce(r.discount_rate, 0), r.velocity_4w, g.cost, g.e
FROM ch_group g JOIN ch_rows r ON g.brand = r.brand AND g.week = r.week AND g.parent_sku = r.codigo_padre AND g.channel = r.channel WHERE r.velocity_4w > 0""",
    "ch_options0": f"SELECT i.*, s, lp * (1 - s) AS raw FROM ch_inputs i CROSS JOIN {ladder(C.PRICE_LADDER)} l(s)",
    "ch_options": f"SELECT *, {snap_nearest('raw')} AS p, {velocity_both('vel', 'disc', 's', 'e')} AS v, {snap_nearest('price')} AS now_p FROM ch_options0",
    "ch_best": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, week, parent_sku, channel, who ORDER BY round(profit, 6) DESC, s) AS k FROM (
SELECT *, CASE WHEN cost > 0 THEN (p / {V} - cost) * v ELSE v * p END AS profit FROM ch_options
WHERE p > 0 AND (cost IS NULL OR (p / {V} >= cost AND (p / {V} - cost) / (p / {V}) * 100 >= 15)))) WHERE k = 1""",
    "ch_sim": f"""
SELECT brand, week, parent_sku, channel, s, p, v, CASE WHEN abs(p - now_p) < 2000 AND s = {snap_disc('disc')} THEN 'hold' WHEN p > now_p THEN 'increase'
       WHEN p < now_p THEN 'decrease' ELSE 'hold' END AS act FROM ch_best WHERE who = 'channel'""",
    "ch_stores": "SELECT brand, week, parent_sku, channel, sum(profit) AS store_profit FROM ch_best WHERE who <> 'channel' GROUP BY ALL",
    "ch_all0": f"""
SELECT g.*, mean_step, sev, trust, rebate_amount, variance, reasons, coalesce(store_profit, 0) AS store_profit, x.s, x.p, x.v, x.act, {snap_disc('mean_step')} AS fs,
       {snap_disc('disc')} AS disc_step, {snap_nearest('price')} AS now_p
FROM ch_group g JOIN ch_signal USING (brand, week, parent_sku, channel) JOIN ch_variance USING (brand, week, parent_sku, channel)
LEFT JOIN ch_reasons USING (brand, week, parent_sku, channel) LEFT JOIN ch_stores USING (brand, week, parent_sku, channel)
LEFT JOIN ch_sim x USING (brand, week, parent_sku, channel)""",
    "ch_all1": "SELECT *, lp * (1 - fs) AS fraw FROM ch_all0",
    "ch_all2": f"SELECT *, {snap_nearest('fraw')} AS fp, {velocity_both('vel', 'disc', 'fs', 'e')} AS fv FROM ch_all1",
    "ch_all": f"""
SELECT *, coalesce(s, fs) AS step, coalesce(p, fp) AS np, coalesce(v, fv) AS ev, act IS NULL AS fb,
       coalesce(act, CASE WHEN fs > disc + 1e-9 THEN 'decrease' WHEN fs < disc - 1e-9 THEN 'increase' END) AS action_type FROM ch_all2
WHERE CASE WHEN act IS NULL THEN NOT (abs(fp - now_p) < 2000 AND fs = disc_step) AND (fs > disc + 1e-9 OR fs < disc - 1e-9) ELSE act <> 'hold' END""",
    "channel": f"""
SELECT brand, week, parent_sku, channel, product, category, subcategory, {vendor('parent_sku')} AS vendor_brand, n_stores, stores_in_channel,
       stock IS NOT NULL AS has_stock_data, CAST(stock AS BIGINT) AS channel_stock, CAST(trunc(lp) AS BIGINT) AS current_list_price, now_p AS current_price,
       CASE WHEN disc_step <= 0 THEN 'Full price' ELSE {pct('disc_step')} END AS current_discount, round_even(vel, 1) AS current_velocity, np AS recommended_price,
       CASE WHEN step <= 0 THEN 'Full price' ELSE {pct('step')} END AS recommended_discount, round_even(ev, 1) AS expected_velocity,
       CAST(trunc(vel * price) AS BIGINT) AS current_weekly_rev, CAST(trunc(ev * np) AS BIGINT) AS expected_weekly_rev,
       CAST(trunc(ev * np - vel * price) AS BIGINT) AS rev_delta, CAST(trunc(cost) AS BIGINT) AS unit_cost, rebate_amount,
       CASE WHEN cost > 0 THEN round_even((np / {V} - cost) / (np / {V}) * 100, 1) END AS margin_pct,
       CASE WHEN cost > 0 THEN CAST(trunc((np / {V} - cost) * ev - (price / {V} - cost) * vel) AS BIGINT) END AS margin_delta,
       CASE WHEN action_type = 'increase' THEN 'INCREASE' ELSE coalesce(['LOW', 'MEDIUM', 'HIGH'][sev + 1], 'MEDIUM') END AS urgency,
       concat_ws('; ', nullif(reasons, ''), CASE WHEN variance > 0.5::DOUBLE THEN 'Revisar por tienda: ' || {pct('variance')} || ' de las tiendas difieren del canal' END,
                 CASE WHEN fb THEN 'Stock data missing — velocity-weighted fallback' END) AS reasons,
       ['SPECULATIVE', 'LOW', 'MEDIUM', 'HIGH'][trust + 1] AS confidence_tier, action_type, round_even(variance, 3) AS per_store_variance_pct,
       variance > 0.5::DOUBLE AS mandatory_review, CASE WHEN fb THEN 'velocity_weighted_fallback' ELSE 'profit_simulation' END AS aggregation_method,
       round_even(profit, 2) AS chain_uniform_profit, round_even(store_profit, 2) AS sum_per_store_profit, round_even(store_profit - profit, 2) AS gap_abs_clp,
       round_even(CASE WHEN store_profit > 0 THEN (store_profit - profit) / store_profit * 100 ELSE 0 END, 2) AS gap_pct
FROM (SELECT *, CASE WHEN cost > 0 THEN (np / {V} - cost) * ev ELSE np * ev END AS profit FROM ch_all)""",
    "decided": """
SELECT brand, week, parent_sku || '-' || store AS key, CASE q WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'manual' ELSE 'bm_approved' END AS status,
       CASE WHEN q = 3 THEN CAST(recommended_price + 1000 AS DOUBLE) END AS manual_price, CAST(week AS TIMESTAMP) AS ts
FROM (SELECT *, CAST(regexp_extract(parent_sku, '(\\d+)-', 1) AS INT) % 5 AS q FROM acts) WHERE q > 0""",
    "act_status": "SELECT a.*, d.status FROM (SELECT *, parent_sku || '-' || store AS key FROM acts) a LEFT JOIN (SELECT brand, week, key, status FROM decided) d USING (brand, week, key)",
    "al_rows": """
SELECT p.brand, codigo_padre, centro, week, CASE WHEN centro LIKE 'AB%' THEN 'ecomm' ELSE 'bm' END AS channel, avg_precio_final, discount_rate, stock_on_hand,
       weeks_of_cover, velocity_4w FROM parent p JOIN (SELECT brand, max(week) AS week FROM parent GROUP BY brand) USING (brand, week)""",
    "al_stats": """
SELECT *, CASE WHEN median_price > 0 THEN rng / median_price ELSE 0 END AS price_spread, coalesce(CASE WHEN bm_med > 0 THEN bm_rng / bm_med END, 0) AS bm_price_spread,
       coalesce(CASE WHEN bm_med > 0 THEN (bm_med - web) / bm_med END, 0) AS ecomm_gap, CASE WHEN v > 0 THEN vp / v ELSE median_price END AS sync_price
FROM (SELECT brand, codigo_padre, count(DISTINCT centro) AS n_stores, median(avg_precio_final) AS median_price, max(avg_precio_final) - min(avg_precio_final) AS rng,
             max(discount_rate) - min(discount_rate) AS discount_spread,
             max(avg_precio_final) FILTER (channel = 'bm') - min(avg_precio_final) FILTER (channel = 'bm') AS bm_rng, median(avg_precio_final) FILTER (channel = 'bm') AS bm_med,
             count(DISTINCT centro) FILTER (channel = 'bm') AS bm_stores, median(avg_precio_final) FILTER (channel = 'ecomm') AS web,
             bool_or(discount_rate > 0.05::DOUBLE) AND bool_or(NOT discount_rate > 0.05::DOUBLE) AS split,
             coalesce(bool_or(stock_on_hand = 0), false) AND coalesce(bool_or(weeks_of_cover > 12) FILTER (stock_on_hand IS NOT NULL), false) AS imbalance,
             sum(greatest(velocity_4w, 0) * avg_precio_final) AS vp, sum(greatest(velocity_4w, 0)) AS v
      FROM al_rows GROUP BY ALL) WHERE n_stores >= 2""",
    "alerts": """
SELECT brand, codigo_padre, centro, week, channel, avg_precio_final, discount_rate, n_stores, median_price, price_spread, discount_spread, bm_price_spread, ecomm_gap,
       sync_price, CASE WHEN bm_price_spread > 0.1::DOUBLE THEN 'price_inconsistency_bm;' ELSE '' END || CASE WHEN discount_spread > 0.1::DOUBLE THEN 'discount_spread;' ELSE '' END
       || CASE WHEN split THEN 'markdown_split;' ELSE '' END || CASE WHEN imbalance THEN 'stock_imbalance;' ELSE '' END
       || CASE WHEN abs(ecomm_gap) > 0.15::DOUBLE THEN 'ecomm_gap;' ELSE '' END AS alert_reasons, stock_on_hand, weeks_of_cover, velocity_4w
FROM al_rows JOIN al_stats USING (brand, codigo_padre)
WHERE (bm_price_spread > 0.1::DOUBLE AND bm_stores >= 2) OR discount_spread > 0.1::DOUBLE OR split OR imbalance OR abs(ecomm_gap) > 0.15::DOUBLE""",
    "oc_weeks": """
SELECT brand, week FROM (SELECT brand, week, row_number() OVER (PARTITION BY brand ORDER BY week DESC) AS k, count(*) OVER (PARTITION BY brand) AS n
FROM (SELECT DISTINCT brand, week FROM acts INTERSECT SELECT DISTINCT brand, week FROM decided)) WHERE n = 1 OR k BETWEEN 2 AND 5""",
    "actual": """
SELECT w.brand, w.week, l.codigo_padre AS parent_sku, l.centro AS store, CAST(sum(cantidad) AS BIGINT) AS actual_units, sum(precio_final * cantidad) AS actual_revenue,
       count(DISTINCT date_diff('day', w.week, CAST(fecha AS DATE)) // 7) AS n_weeks_observed,
       sum(cantidad) / count(DISTINCT date_diff('day', w.week, CAST(fecha AS DATE)) // 7) AS actual_velocity,
       sum(precio_final * cantidad) / count(DISTINCT date_diff('day', w.week, CAST(fecha AS DATE)) // 7) AS actual_weekly_rev
FROM oc_weeks w JOIN fx_line l ON l.brand = w.brand AND l.fecha >= w.week + INTERVAL 7 DAY AND l.fecha < w.week + INTERVAL 35 DAY
GROUP BY ALL""",
    "oc0": """
SELECT a.brand, a.week AS decision_week, parent_sku, store, action_type, confidence_tier, status, coalesce(manual_price, recommended_price) AS price,
       current_velocity AS bv, expected_velocity AS pv, CASE WHEN actual_units >= 3 THEN actual_velocity END AS av, current_weekly_rev AS br,
       expected_weekly_rev AS prv, CASE WHEN actual_units >= 3 THEN actual_weekly_rev END AS ar, cost, actual_units, n_weeks_observed
FROM (SELECT *, parent_sku || '-' || store AS key FROM acts) a JOIN oc_weeks USING (brand, week)
JOIN (SELECT * FROM decided WHERE status IN ('approved', 'bm_approved', 'manual', 'bm_manual', 'planner_approved')) USING (brand, week, key)
JOIN actual USING (brand, week, parent_sku, store)
LEFT JOIN (SELECT brand, sku AS parent_sku, cost FROM fx_costs) USING (brand, parent_sku)""",
    "outcome": f"""
SELECT brand, decision_week, parent_sku, store, action_type, confidence_tier, status, CAST(trunc(price) AS BIGINT) AS implemented_price, bv AS baseline_velocity,
       pv AS predicted_velocity, av AS actual_velocity, round_even(CASE WHEN pv > 0 THEN av - pv END, 2) AS velocity_error,
       round_even(CASE WHEN pv > 0 THEN (av - pv) / pv * 100 END, 1) AS velocity_error_pct, CAST(br AS DOUBLE) AS baseline_weekly_rev,
       CAST(prv AS DOUBLE) AS predicted_weekly_rev, round_even(ar, 0) AS actual_weekly_rev, round_even(CASE WHEN prv > 0 THEN ar - prv END, 0) AS rev_error,
       round_even(CASE WHEN prv > 0 THEN (ar - prv) / prv * 100 END, 1) AS rev_error_pct,
       round_even(CASE WHEN bv > 0 THEN (av - bv) * 100 / bv END, 1) AS actual_lift_vs_baseline,
       round_even(CASE WHEN bv > 0 THEN (pv - bv) * 100 / bv END, 1) AS predicted_lift_vs_baseline,
       CASE WHEN bv > 0 AND av IS NOT NULL THEN ((av - bv) >= 0) = ((pv - bv) >= 0) END AS direction_correct,
       CASE WHEN cost > 0 AND price > 0 THEN round_even((price / {V} - cost) / (price / {V}) * 100, 1) END AS actual_margin_pct,
       CASE WHEN actual_units >= 3 THEN 'normal' ELSE 'sparse' END AS data_quality, n_weeks_observed, CAST(actual_units AS DOUBLE) AS actual_units
FROM oc0""",
    "position": """
SELECT brand, codigo_padre AS parent_sku, our_price, comp_min, comp_avg, round_even((our_price - comp_min) / our_price * 100, 1) AS gap_pct,
       CASE WHEN round_even((our_price - comp_min) / our_price * 100, 1) > 5 THEN 'expensive' WHEN round_even((our_price - comp_min) / our_price * 100, 1) < -5 THEN 'cheaper'
            ELSE 'parity' END AS position, cheapest_site, n_competitors
FROM (SELECT c.*, coalesce(own, lst) AS our_price
      FROM (SELECT brand, codigo_padre, CAST(min(comp_price) AS BIGINT) AS comp_min, CAST(trunc(avg(comp_price)) AS BIGINT) AS comp_avg,
                   CAST(max(comp_list_price) AS BIGINT) AS lst, arg_min(competitor, (comp_price, competitor)) AS cheapest_site, count(*) AS n_competitors
            FROM fx_competitor_prices WHERE comp_price > 0 GROUP BY ALL) c
      LEFT JOIN (SELECT brand, parent_sku AS codigo_padre, (list_sort(list(current_price)))[len(list(current_price)) // 2 + 1] AS own
                 FROM acts_now WHERE current_price > 0 GROUP BY ALL) USING (brand, codigo_padre)) WHERE our_price > 0""",
    "child_scored": """
SELECT *, least(0.99::DOUBLE, 0.30::DOUBLE + 0.08::DOUBLE * coalesce(lifecycle_stage_code, 3) + 0.5::DOUBLE * coalesce(discount_rate, 0)) AS markdown_probability,
       least(0.60::DOUBLE, coalesce(discount_rate, 0) + 0.10::DOUBLE) AS raw_depth FROM enhanced""",
})
