"""Lists are whole per brand, reports are of one week, pages follow places: two brands, two weeks, more rows than any former cap."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from rebaja.operators import alerts as AL, competitors as K, decisions as D, pricing as A, reports as RP, sizes as Z

WEEKS = dt.date(2024, 1, 1), dt.date(2024, 1, 8)


@pytest.fixture(scope="module")
def actions(spark):
    rows = [(b, w, f"P{i:03}", "2001", f"Shop {i % 3}", f"Product {i} " + "x" * 60, "HIGH" if i % 2 else "LOW", "decrease", i * 10, i, i / 100, i, "20%", "Nike", "Footwear", "Running", "high", 0.2)
            for b in ("A", "B") for w in WEEKS for i in range(120)]
    return spark.createDataFrame(rows, "brand string, week date, parent_sku string, store string, store_name string, product string, urgency string, action_type string, rev_delta long, margin_delta long, "
                                 "model_confidence double, product_age_weeks long, recommended_discount string, vendor_brand string, category string, subcategory string, confidence_tier string, click_collect_ratio double")


def test_top_lists_per_brand(spark):
    runs = spark.createDataFrame([(b, f"P{i:03}", "2001", 3, 5, 0.3 + i / 1000, 0.5, "x;") for b in "AB" for i in range(80)],
                                 "brand string, codigo_padre string, centro string, active_sizes_4w int, total_sizes_ever int, attrition_rate double, core_completeness double, alert_reasons string")
    top = Z.size_alert_view(runs)
    assert {r.brand: r.n for r in top.groupBy("brand").agg(F.count("*").alias("n")).collect()} == {"A": 30, "B": 30}
    assert top.agg(F.min("parent_sku")).first()[0] == "P050" and Z.size_alert_view(runs, limit=None).count() == 160
    shops = spark.createDataFrame([(b, f"P{i:03}", c, "bm", 100.0 + i, 0.1, 4.0, 1.25, 2, i / 10, 0.2, 90.0, "x;") for b in "AB" for i in range(70) for c in ("2001", "2002")],
                                  "brand string, codigo_padre string, centro string, channel string, avg_precio_final double, discount_rate double, stock_on_hand double, velocity_4w double, n_stores int, "
                                  "price_spread double, discount_spread double, sync_price double, alert_reasons string")
    stores = spark.createDataFrame([("2001", "x-One")], "centro string, sucursal string")
    names = spark.createDataFrame([("A", "P069", "Shoe")], "brand string, parent_sku string, product string")
    view = AL.cross_store_view(shops, names, stores).collect()
    assert len(view) == 100 and all(len(r.stores) == 2 for r in view) and {r.product for r in view} == {"Shoe", None}
    assert AL.cross_store_view(shops, names, stores, limit=None).count() == 140
    log = spark.createDataFrame([("A", f"k{i}", "approved", WEEKS[0]) for i in range(150)], "brand string, key string, action string, timestamp date")
    assert D.load_audit(log, "A").count() == 100 and D.load_audit(log, "A", None).count() == 150


def test_decisions_of_another_week_do_not_count(actions):
    now = actions.where(F.col("week") == F.lit(WEEKS[1]))
    decided = actions.where("parent_sku = 'P001' OR week = DATE '2024-01-01'").select("brand", "week", F.concat_ws("-", "parent_sku", "store").alias("key"), F.lit("approved").alias("status"))
    assert A.filter_actions(actions, decided, status="approved").count() == 2 * 120 + 2
    assert A.filter_actions(now, decided, status="approved").select("parent_sku").distinct().collect()[0][0] == "P001"
    assert A.filter_actions(now, decided, status="pending").count() == 238
    kpis = {r.brand: (r.total, r.reviewed) for r in RP.decision_kpis(now, decided).collect()}
    assert kpis == {"A": (120, 1), "B": (120, 1), "all": (240, 2)}
    rost = {(r.brand, r.name): (r.total, r.decided) for r in RP.roster(now, decided).collect()}
    assert rost["A", "Shop 1"] == (40, 1) and rost["B", "Shop 0"] == (40, 0) and len(rost) == 6
    assert {r.n for r in RP.impact_breakdown(now).where("dimension = 'vendor_brand'").collect()} == {120}


@pytest.mark.parametrize("by", ["urgency", "revenue", "confidence", "store", "discount", "age"])
def test_places_are_the_sorted_list(spark, actions, by):
    now = actions.where(F.col("week") == F.lit(WEEKS[1])).repartition(5)
    placed = A.placed_actions(now, by)
    for brand in "AB":
        want = [r.parent_sku for r in A.order_actions(now.where(F.col("brand") == brand), by).collect()]
        got = sorted((r.place, r.parent_sku) for r in placed.where(F.col("brand") == brand).collect())
        assert [p for p, _ in got] == list(range(1, 121)) and [s for _, s in got] == want
    pages = [sorted(r.place for r in A.page_by_place(placed, n, 50).where("brand = 'A'").collect()) for n in (1, 2, 3, 4)]
    assert pages == [list(range(1, 51)), list(range(51, 101)), list(range(101, 121)), []]


def test_competitors_are_all_suppliers_of_a_parent(run):
    per = run.t.competitor_prices.groupBy("brand", "codigo_padre").agg(F.count("*").alias("n"), F.countDistinct("competitor").alias("d"))
    low, high, same = per.agg(F.min("n"), F.max("n"), F.sum(F.col("n") - F.col("d"))).first()
    assert low >= 1 and high > 3 and same == 0


def test_script_blocks_of_any_form(spark):
    offer = '{"@type":"Product","name":"Shoe","offers":{"price":"1990","availability":"https://schema.org/InStock"}}'
    heads = ["<script type=\"application/ld+json\">", "<script data-x='1' type='application/ld+json' defer>", "<SCRIPT async type = application/ld+json>"]
    pages = spark.createDataFrame([(str(i), f"https://shop.example/{i}", f"<html>{h}{offer}</script >") for i, h in enumerate(heads)], "page_id string, url string, html string")
    assert [r.comp_price for r in K.extract_offers(pages).collect()] == [1990] * 3
