import datetime as dt

import pytest
from pyspark.sql import functions as F

from rebaja.functions import pricing as P
from rebaja.operators import channel as CH, decisions as D, outcomes as O, pricing as A

WEEK = dt.date(2026, 4, 20)


def best(spark, lp, price, disc, vel, cost, e, **options):
    df = spark.createDataFrame([(lp, price, disc, vel, cost, e)], "lp double, p double, d double, v double, c double, e double")
    return P.with_best_step(df, "out", "lp", "p", "d", "v", "c", "e", **options).first()["out"]


def test_hold_and_decrease(spark):
    assert best(spark, 100000.0, 100000.0, 0.0, 5.0, 40000.0, -1.5)["action"] == "hold"
    assert best(spark, 100000.0, 100000.0, 0.0, 1.0, 30000.0, -3.0)["action"] == "decrease"


def test_floors(spark):
    got = best(spark, 100000.0, 100000.0, 0.0, 5.0, 60000.0, -4.0)
    for step in got["feasible"]:
        net = float(round(100000 * (1 - step))) / 1.19
        assert (net - 60000) / net * 100 >= 14
    assert best(spark, 100000.0, 100000.0, 0.0, 5.0, 90000.0, -1.0) is None
    assert best(spark, 0.0, 100000.0, 0.0, 5.0, 1.0, -1.0) is None


def test_no_cost_maximises_revenue(spark):
    got = best(spark, 100000.0, 100000.0, 0.0, 5.0, None, -3.0)
    assert got["margin_pct"] is None and got["profit"] == pytest.approx(got["revenue"]) and got["step"] == 0.30


def test_increase_when_overdiscounted(spark):
    got = best(spark, 100000.0, 60000.0, 0.40, 5.0, 40000.0, -0.5)
    assert got["action"] == "increase" and got["price"] > 60000
    assert min(best(spark, 100000.0, 60000.0, 0.40, 5.0, 30000.0, -0.5, allow_increase=False)["feasible"]) >= 0.40


ROW = dict(brand="A", codigo_padre="NI1-X", centro="2001", week=WEEK, avg_precio_lista=100000.0, avg_precio_final=100000.0, discount_rate=0.0, velocity_4w=2.0,
           velocity_trend=1.0, lifecycle_stage_code=3, attrition_rate=0.0, product_age_weeks=10.0, stock_on_hand=5, weeks_of_cover=3.0,
           weighted_size_avail=0.9, top3_sizes_in_stock=1.0, pct_sizes_in_stock=0.9, max_discount_rate=0.0, comp_undercut=0, comp_price_gap_pct=0.0,
           click_collect_ratio=0.0, click_collect_units=0, instore_velocity_4w=2.0, size_curve_completeness=1.0, primera_jerarquia="Footwear",
           segunda_jerarquia="Run", markdown_probability=0.6, raw_depth=0.2)
KINDS = dict(week="date", lifecycle_stage_code="int", stock_on_hand="long", comp_undercut="int", click_collect_units="long",
             **{k: "string" for k in ("brand", "codigo_padre", "centro", "primera_jerarquia", "segunda_jerarquia")})


def actions(spark, *changes, cost=40000.0, elasticity=None, rebate=None):
    data = [{**ROW, **c} for c in changes]
    scored = spark.createDataFrame([[d[k] for k in ROW] for d in data], ", ".join(f"{k} {KINDS.get(k, 'double')}" for k in ROW))
    products = spark.createDataFrame([("A", "NI1-X-1", "NI1-X", "MACH 6 N° 7")], "brand string, material string, codigo_padre string, material_descripcion string")
    stores = spark.createDataFrame([("2001", "2001-Costanera"), ("AB04", "AB04-Web")], "centro string, sucursal string")
    costs = spark.createDataFrame([("A", "NI1", cost)] if cost else [], "brand string, sku string, cost double")
    fits = spark.createDataFrame([("A", "NI1-X", elasticity, "high")] if elasticity else [], "brand string, codigo_padre string, elasticity double, confidence string")
    rebates = None if rebate is None else spark.createDataFrame(
        [("A", "NI1-X", WEEK - dt.timedelta(3), WEEK + dt.timedelta(3), rebate), ("A", "NI1-X", WEEK - dt.timedelta(30), WEEK - dt.timedelta(1), 9e6)],
        "brand string, parent_sku string, fecha_inicio date, fecha_termino date, aporte_unitario double")
    rows = A.pricing_rows(scored, products, stores, costs, rebates, fits)
    return {r.store: r for r in A.weekly_actions(rows).collect()}


def test_plain_markdown(spark):
    a = actions(spark, {}, elasticity=-2.0)["2001"]
    assert (a.action_type, a.recommended_price, a.recommended_discount, a.product, a.store_name) == ("decrease", 79990, "20%", "MACH 6", "Costanera")
    assert a.expected_velocity == 2.8 and a.unit_cost == 40000 and a.vendor_brand == "Nike"
    assert a.margin_delta == int((79990 / 1.19 - 40000) * 2.8 - (99990 / 1.19 - 40000) * 2.0)


def test_rebate_lowers_unit_cost_exactly(spark):
    a = actions(spark, {}, cost=40000.4, rebate=1500.4)["2001"]
    assert (a.raw_cost, a.rebate_amount, a.unit_cost) == (40000, 1500, 38500)


def test_cost_floor_steps_back_or_drops(spark):
    assert actions(spark, {"raw_depth": 0.4}, cost=70000.0) == {}
    a = actions(spark, {"raw_depth": 0.4, "avg_precio_final": 99990.0}, cost=55000.0)
    assert a == {}  # the shallowest step above the floor is full price, no markdown left
    b = actions(spark, {"raw_depth": 0.4}, cost=None)["2001"]
    assert (b.margin_pct, b.margin_delta, b.unit_cost, b.recommended_price) == (None, None, None, 59990)


def test_low_probability_is_left_alone(spark):
    assert actions(spark, {"markdown_probability": 0.49}) == {}
    nudged = actions(spark, {"raw_depth": 0.05, "markdown_probability": 0.85})["2001"]
    assert nudged.recommended_discount == "15%"
    assert actions(spark, {"raw_depth": 0.05, "markdown_probability": 0.8}) == {}


def test_increase(spark):
    up = {"discount_rate": 0.30, "avg_precio_final": 70000.0, "velocity_trend": 1.2}
    a = actions(spark, up)["2001"]
    assert (a.action_type, a.urgency, a.confidence_tier, a.current_discount, a.recommended_discount) == ("increase", "INCREASE", "SPECULATIVE", "30%", "20%")
    assert "Sin elasticidad" in a.reasons and "Sales accelerating" in a.reasons
    for blocked in ({"velocity_trend": 0.9}, {"lifecycle_stage_code": 5}, {"attrition_rate": 0.3}, {"product_age_weeks": 35.0}, {"weeks_of_cover": 16.0}, {"velocity_4w": 0.9}):
        assert all(r.action_type != "increase" for r in actions(spark, {**up, **blocked}).values()), blocked
    assert actions(spark, {**up, "weeks_of_cover": None}, elasticity=-1.0)["2001"].confidence_tier == "HIGH"


def test_urgency_adds_up(spark):
    a = actions(spark, {"velocity_trend": 0.4, "lifecycle_stage_code": 5, "weeks_of_cover": 25.0, "attrition_rate": 0.6})["2001"]
    assert a.urgency == "HIGH"
    assert a.reasons.split("; ")[:4] == ["Velocity collapsed (trend < 0.5)", "In clearance stage", "Size curve critical (60% attrition)", "Overstocked (25 weeks of cover)"]
    calm = actions(spark, {})["2001"]
    assert calm.urgency == "LOW" and calm.reasons.startswith("Model predicts markdown")


def test_online_overlay(spark):
    got = actions(spark, {}, {"centro": "AB04", "avg_precio_final": 90000.0, "velocity_4w": 3.0})
    a = got["2001"]
    assert (a.ecomm_price, a.ecomm_velocity, a.ecomm_price_gap_pct) == (90000.0, 3.0, 10.0)


def test_channel_fallback_when_no_step_is_feasible(spark):
    store = spark.createDataFrame([("A", WEEK, "P", "2001", "20%", 2.0, "MEDIUM", "r1; r2", "LOW", 0), ("A", WEEK, "P", "2002", "30%", 2.0, "INCREASE", "r1", "HIGH", 5)],
                                  "brand string, week date, parent_sku string, store string, recommended_discount string, current_velocity double, urgency string, reasons string, confidence_tier string, rebate_amount long")
    rows = spark.createDataFrame([("A", WEEK, "P", c, 2.0, 5, 100000.0, 100000.0, 0.0, "x", "y", "z") for c in ("2001", "2002", "2003")],
                                 "brand string, week date, codigo_padre string, centro string, velocity_4w double, stock_on_hand long, avg_precio_lista double, avg_precio_final double, discount_rate double, product_name string, primera_jerarquia string, segunda_jerarquia string")
    costs = spark.createDataFrame([("A", "P", 95000.0)], "brand string, sku string, cost double")
    fits = spark.createDataFrame([], "brand string, codigo_padre string, elasticity double, confidence string")
    out = CH.channel_actions(rows, store, costs, fits).first()
    assert (out.aggregation_method, out.recommended_discount, out.n_stores, out.per_store_variance_pct) == ("velocity_weighted_fallback", "20%", 3, 0.5)
    assert out.urgency == "MEDIUM" and out.confidence_tier == "HIGH" and out.reasons.startswith("r1; r2") and not out.mandatory_review
    assert CH.channel_actions(rows, store.where("store = 'none'"), costs, fits).count() == 0


def log(spark, rows):
    return spark.createDataFrame([("A", WEEK, k, s, dt.datetime(2026, 4, 20, h), b, m) for k, s, h, b, m in rows],
                                 "brand string, week date, key string, status string, ts timestamp, bulk boolean, manual_price double")


def test_decision_log(spark):
    events = log(spark, [("a", "approved", 1, False, None), ("a", "rejected", 2, False, None), ("b", "approved", 1, True, None), ("c", "rejected", 1, False, None),
                         ("c", "approved", 2, True, None), ("d", "approved", 1, False, None), ("d", "", 2, False, None), ("e", "manual", 1, False, 44990.0),
                         ("e", "", 2, False, None), ("e", "approved", 3, True, None), ("f", "approved", 1, True, None), ("f", "rejected", 2, False, None)])
    got = {r.key: (r.status, r.manual_price) for r in D.apply_decisions(events).collect()}
    assert got == {"a": ("rejected", None), "b": ("approved", None), "c": ("rejected", None), "e": ("approved", None), "f": ("rejected", None)}


def test_planner_and_export(spark):
    acts = spark.createDataFrame([("A", WEEK, "P", s, 100, 10.0, 1.0, "decrease") for s in ("1", "2", "3")],
                                 "brand string, week date, parent_sku string, store string, recommended_price long, margin_pct double, expected_velocity double, action_type string")
    dec = log(spark, [("P-1", "approved", 1, False, None), ("P-2", "manual", 1, False, 90.0)]).drop("bulk")
    planned = spark.createDataFrame([("A", WEEK, "P-1", "planner_approved"), ("A", WEEK, "P-3", "planner_approved")], "brand string, week date, key string, planner_status string")
    moved = D.planner_transition(dec, planned)
    state = {r.key: (r.status, r.bm_status) for r in moved.collect()}
    assert state == {"P-1": ("planner_approved", "approved"), "P-2": ("manual", None)}
    assert [r.key for r in D.planner_queue(acts, moved.drop("bm_status")).collect()] == ["P-2"]
    out = {r.store: r.recommended_price for r in D.export_rows(acts, moved).collect()}
    assert out == {"1": 100, "2": 90}
    assert [r.store for r in D.export_rows(acts, moved, require_planner=True).collect()] == ["1"]


def outcome(spark, units, manual=None, weeks=4):
    first = dt.datetime(2026, 4, 27)
    txn = spark.createDataFrame([("A", "P-1", "2001", first + dt.timedelta(7 * (i % weeks)), 1, 10000.0) for i in range(units)],
                                "brand string, sku string, centro string, fecha timestamp, cantidad long, precio_final double")
    products = spark.createDataFrame([("A", "P-1", "P")], "brand string, material string, codigo_padre string")
    acts = spark.createDataFrame([("A", WEEK, "P", "2001", "decrease", "HIGH", 39990, 3.0, 2.0, 30000, 20000, 1)],
                                 "brand string, week date, parent_sku string, store string, action_type string, confidence_tier string, recommended_price long, expected_velocity double, current_velocity double, expected_weekly_rev long, current_weekly_rev long, unit_cost long")
    dec = spark.createDataFrame([("A", WEEK, "P-2001", "manual" if manual else "approved", manual)], "brand string, week date, key string, status string, manual_price double")
    costs = spark.createDataFrame([("A", "P", 20000.0)], "brand string, sku string, cost double")
    return O.outcomes(acts, dec, txn, products, costs).first()


def test_outcomes(spark):
    r = outcome(spark, 12)
    assert (r.actual_units, r.actual_velocity, r.data_quality, r.velocity_error, r.implemented_price) == (12, 3.0, "normal", 0.0, 39990)
    assert r.actual_lift_vs_baseline == 50.0 and r.direction_correct
    sparse = outcome(spark, 2)
    assert (sparse.data_quality, sparse.actual_velocity, sparse.velocity_error) == ("sparse", None, None)
    assert outcome(spark, 12, manual=44990.0).implemented_price == 44990


def test_outcome_summary_medians(spark):
    rows = [("A", WEEK, "HIGH", "decrease", -10.0, True, 10.0, 10.0, "normal"), ("A", WEEK, "LOW", "decrease", 20.0, True, 5.0, 10.0, "normal"),
            ("A", WEEK, "LOW", "decrease", None, None, None, None, "sparse")]
    df = spark.createDataFrame(rows, "brand string, decision_week date, confidence_tier string, action_type string, velocity_error_pct double, direction_correct boolean, actual_lift_vs_baseline double, predicted_lift_vs_baseline double, data_quality string")
    got = {(r.level, r.name): r for r in O.outcome_summary(df).collect()}
    total = got["brand", "all"]
    assert (total.n, total.median_velocity_error_pct, total.pct_direction_correct, total.lift_capture_rate) == (2, 5.0, 100.0, 75.0)
    assert got["confidence", "HIGH"].median_velocity_error_pct == -10.0


def test_manual_price(spark):
    acts = spark.createDataFrame([("A", "P", "1", 100000, 100000, 2.0, 40000), ("A", "P", "2", 100000, 100000, 2.0, 80000), ("A", "P", "3", 0, 0, 2.0, None)],
                                 "brand string, parent_sku string, store string, current_list_price long, current_price long, current_velocity double, unit_cost long")
    prices = acts.select("brand", "parent_sku", "store", F.lit(80000.0).alias("manual_price"))
    fits = spark.createDataFrame([("A", "P", -1.0)], "brand string, codigo_padre string, elasticity double")
    got = {r.store: r for r in A.manual_price_impact(acts, prices, fits).collect()}
    assert got["1"].snapped_price == 79990 and got["1"].warning is None and got["1"].velocity == 2.4
    assert got["2"].warning == "below_cost" and got["3"].warning == "no_list_price"
