import datetime as dt

import pytest
from pyspark.sql import functions as F

from rebaja import schemas
from rebaja.operators import elasticity as E, lifecycle as L, margin as M, signals as S, sizes as Z, weekly as W

MONDAY = dt.date(2026, 4, 20)


def lines(spark, rows):
    """Sale lines from dicts over a default line."""
    base = dict(brand="A", folio="1", tipo_documento="BOLETA", tipo_entrega=None, fecha=dt.datetime(2026, 4, 21, 10), centro="7501", sku="P-1",
                cantidad=1, precio_lista=100000.0, descuento=0.0, precio_final=100000.0, codigo_descuento=None, list_category="retail")
    data = [{**base, "folio": str(i), **r} for i, r in enumerate(rows)]
    keys = list(base)
    kinds = {f.name: f.dataType.simpleString() for f in schemas.TRANSACTIONS}
    df = spark.createDataFrame([[d[k] for k in keys] for d in data], ", ".join(f"{k} {kinds[k]}" for k in keys))
    return schemas.complete(df, schemas.TRANSACTIONS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_markdown_lines_do_not_touch_prices(spark):
    row = one(W.weekly_sales(lines(spark, [{}] * 3 + [{"precio_final": 40000.0, "descuento": 60000.0, "list_category": "liquidacion"}])))
    assert (row.units_sold, row.avg_precio_final) == (4, 100000)


def test_regular_lists_all_count(spark):
    txn = lines(spark, [dict(list_category=c, precio_final=p) for c, p in
                        (("retail", 100000.0), ("eventos", 90000.0), ("online", 95000.0), ("retail", 100000.0))])
    assert one(W.weekly_sales(txn)).avg_precio_final == 96250


def test_exclusions_combine_and_fall_back(spark):
    txn = lines(spark, [{}, {}, {"precio_final": 30000.0, "descuento": 70000.0}, {"precio_final": 40000.0, "list_category": "liquidacion"}])
    assert one(W.weekly_sales(txn)).avg_precio_final == 100000
    only = lines(spark, [{"tipo_entrega": "Retiro en Tienda", "precio_final": 80000.0}])
    row = one(W.weekly_sales(only))
    assert (row.avg_precio_final, row.click_collect_units, row.instore_units) == (80000, 1, 0)


def test_returns_and_missing_columns(spark):
    row = one(W.weekly_sales(lines(spark, [{"cantidad": 3}, {"cantidad": -2}, {"codigo_descuento": "", "cantidad": 1}])))
    assert (row.units_sold, row.units_returned, row.net_units, row.txn_count) == (4, 2, 2, 2)
    assert W.weekly_sales(lines(spark, [{"cantidad": -1}])).count() == 0


def weeks(spark, rows):
    return spark.createDataFrame(rows, "brand string, sku string, centro string, week date")


def test_backorder(spark):
    weekly = weeks(spark, [("A", "P-1", "7501", MONDAY), ("A", "P-1", "7501", MONDAY - dt.timedelta(7)), ("A", "P-2", "7501", MONDAY)])
    orders = spark.createDataFrame([("A", "P-1", "7501", 12.0, dt.date(2026, 5, 15), 1), ("A", "P-1", "7501", 3.0, dt.date(2026, 6, 1), 2)],
                                   "brand string, sku string, centro string, open_qty double, earliest_delivery date, n_open_pos int")
    got = {(r.sku, r.week): r for r in W.backorder_features(weekly, orders).collect()}
    now = got["P-1", MONDAY]
    assert (now.open_po_units, now.n_open_pos, now.days_to_delivery) == (15, 3, 25)
    old, other = got["P-1", MONDAY - dt.timedelta(7)], got["P-2", MONDAY]
    assert (old.open_po_units, old.days_to_delivery) == (0, 9999) == (other.open_po_units, other.days_to_delivery)


def test_replenishment(spark):
    weekly = weeks(spark, [("A", "P-1", "7501", MONDAY), ("A", "P-1", "7501", MONDAY - dt.timedelta(7))])
    moves = spark.createDataFrame([("A", "P-1", "7501", 10.0, 20.0, 4.0, 2), ("A", "P-1", "7501", 5.0, 15.0, 6.0, 3)],
                                  "brand string, sku string, centro string, units_in_transit double, units_received_window double, avg_transit_days double, n_transfers int")
    got = {r.week: r for r in W.replenishment_features(weekly, moves).collect()}
    now, old = got[MONDAY], got[MONDAY - dt.timedelta(7)]
    assert (now.units_in_transit, now.units_received_window, now.avg_transit_days, now.n_transfers) == (15, 35, 5, 5)
    assert (old.units_in_transit, old.n_transfers, old.avg_transit_days) == (0, 0, None)


def test_order_with_two_lists_keeps_its_lines(spark):
    txn = lines(spark, [{"folio": "9"}]).drop("list_name", "list_category")
    names = spark.createDataFrame([("A", "9", "7501", "Tienda", "retail"), ("A", "9", "7501", "Outlet", "outlet")],
                                  "brand string, folio string, centro string, list_name string, list_category string")
    assert one(S.enrich_price_list(txn, names)).list_category == "outlet"


def test_costs(spark):
    legacy = spark.createDataFrame([("A", "P", 42.0), ("A", "Q", 56000.0), ("A", "R", 0.0), ("A", "S", None), ("A", "P", 42.0)], "brand string, sku string, cost double")
    got = {r.sku: r.cost for r in S.fallback_costs(legacy).collect()}
    assert got == {"P": 42000.0, "Q": 56000.0}
    first = spark.createDataFrame([("A", "P", 1.0)], "brand string, sku string, cost double")
    both = {r.sku: r.cost for r in S.combine_costs(first, S.fallback_costs(legacy)).collect()}
    assert both == {"P": 1.0, "Q": 56000.0}


def lift_of(spark, rows):
    df = spark.createDataFrame(rows, "brand string, discount_rate double, velocity_4w double")
    return {r.step: r.lift for r in M.empirical_lift(df).collect()}


def test_lift_is_monotone_and_starts_at_one(spark):
    import random
    rnd = random.Random(7)
    rows = [("A", s, 2.0 * (1 + 3 * s) + rnd.random()) for s in (0.0, 0.1, 0.2, 0.3, 0.4) for _ in range(100)]
    lift = lift_of(spark, rows)
    values = [lift[s] for s in sorted(lift)]
    assert values[0] == 1 and values == sorted(values) and len(values) == 9
    assert lift[0.4] > 1.5


def test_lift_defaults(spark):
    from rebaja.constants import DEFAULT_LIFT, MARGIN_LADDER
    default = dict(zip(MARGIN_LADDER, DEFAULT_LIFT))
    assert lift_of(spark, [("A", 0.0, 1.0), ("A", 0.2, 2.0)]) == default
    assert lift_of(spark, [("A", 0.2, 2.0)] * 200) == default


def test_size_tracking_without_core_sizes(spark):
    products = spark.createDataFrame([("A", "P-1", "P", "XXL", "Footwear")], "brand string, material string, codigo_padre string, talla string, primera_jerarquia string")
    got = Z.size_availability_sales(lines(spark, [{}]), products).orderBy("week").collect()
    assert [r.active_sizes_4w for r in got] == [1] * 4 and got[0].core_sizes_active == 0 and got[0].core_completeness == 0
    assert got[0].fragmentation_index == 0


def test_fragmentation(value):
    assert value(Z.fragmentation(F.array(F.lit(8.0), F.lit(7.0), F.lit(10.0)))) == pytest.approx(0.5 / 1.5)
    assert value(Z.fragmentation(F.array(F.lit(8.0)))) == 0
    assert value(Z.fragmentation(F.array(F.lit(7.0), F.lit(7.5), F.lit(8.0)))) == 0


def test_elasticity_panel_ignores_markdown_prices(spark):
    products = spark.createDataFrame([("A", "P-1", "P", "7", "Footwear", "Run")], "brand string, material string, codigo_padre string, talla string, primera_jerarquia string, segunda_jerarquia string")
    txn = lines(spark, [{}, {"precio_final": 50000.0, "list_category": "outlet"}, {"cantidad": 2, "precio_final": 180000.0}])
    row = one(E.elasticity_panel(txn, products))
    assert row.units == 4 and row.avg_price == 95000


def test_folios_are_counted_beside_narrow_rows(spark):
    """Null keys and null folios count as before, and lines cross the exchange as key and folio only."""
    rows = [{"folio": "a"}, {"folio": "a"}, {"folio": "b"}, {"folio": "r", "cantidad": -1}, {"folio": None}, *[{"folio": f"x{i % 20}", "sku": None} for i in range(40)],
            {"folio": None, "sku": "P-2"}, {"folio": "a", "centro": None, "fecha": None}]
    txn = lines(spark, rows)
    got = {(r.sku, r.centro, r.week): (r.txn_count, r.units_sold) for r in W.weekly_sales(txn).collect()}
    assert got == {("P-1", "7501", MONDAY): (2, 4), (None, "7501", MONDAY): (20, 40), ("P-2", "7501", MONDAY): (0, 1), ("P-1", None, None): (1, 1)}
    for df in (W.weekly_sales(txn), E.elasticity_panel(txn, spark.createDataFrame([], schemas.PRODUCTS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        wide = [n for n in plan.splitlines() if "HashAggregate" in n and "folio" in n.split("functions=")[0] and "sum(" in n]
        assert not wide, wide


def test_stock_parent_sales_and_folios_are_written_once(run):
    assert run.t.stock.inputFiles() and run.t.stock.inputFiles()[0].count("/stock-")
    assert "/folios-" in run.folios.inputFiles()[0] and run.folios.schema == W.folio_counts(run.sales).schema
    assert run.seasons().inputFiles() == run.parent_sales.inputFiles()
    assert run.t.stock.exceptAll(run.t.stock_view()).count() == 0 == run.t.stock_view().exceptAll(run.t.stock).count()


def test_competitor_prices_are_written_once(run):
    """Pages and all that is read from them start from the written prices, not from the order lines."""
    written = run.t.competitor_prices
    assert not [f for f in written.inputFiles() if "lineitem" in f] and not [f for f in run.t.competitor_pages.inputFiles() if "lineitem" in f]
    assert written.exceptAll(run.t.competitor_price_view()).count() == 0 == run.t.competitor_price_view().exceptAll(written).count()


def test_weekly_panel_and_parent_sales_read_one_table_of_sums(run):
    """Only the sums are made from lines; what reads them gives the rows that it gives on the lines."""
    assert "/line_totals-" in run.totals.inputFiles()[0]
    sources = run.sales, run.t.products
    parents = L.parent_weekly_sales(*sources, run.totals)
    weekly = W.weekly_sales(run.sales, first=True, folios=run.folios, totals=run.totals)
    panel = E.elasticity_panel(*sources, run.t.reference_prices, run.folios, run.totals)
    for shared in (parents, weekly, panel):
        assert not [f for f in shared.inputFiles() if "/lines-" in f]
    for shared, apart in ((parents, L.parent_weekly_sales(*sources)), (weekly, W.weekly_sales(run.sales, first=True))):
        assert shared.exceptAll(apart).count() == 0 == apart.exceptAll(shared).count()


def test_parent_sales_are_sums_of_all_lines(spark):
    products = spark.createDataFrame([("A", "P-1", "P"), ("A", "P-2", "P"), ("A", "P-3", None)], "brand string, material string, codigo_padre string")
    txn = lines(spark, [{"cantidad": 2}, {"cantidad": -1}, {"sku": "P-2", "list_category": "outlet"}, {"sku": "P-3"}, {"sku": None}])
    row = one(L.parent_weekly_sales(txn, products))
    price = txn.first()
    assert (row.units, row.n_sizes, row.revenue) == (3, 2, 2 * price.precio_final) and row.avg_discount_rate == pytest.approx(price.descuento / price.precio_lista)


def test_open_orders_meet_receipts_by_key_and_place_only(spark, run):
    po = spark.createDataFrame([
        ("A", 1, "s", "P", "x", 10, "2020-01-09"), ("A", 1, "s", "P", "x", 4, "2020-01-02"), ("A", 1, "s", "P", None, 7, None), ("A", 2, "s", "P", "x", None, "2020-01-01"),
        ("A", None, "s", None, "x", 3, "2020-02-01"), ("A", 3, "s", "P", "y", 5, "2020-03-01"), ("A", 2, "t", "P", "x", None, None)],
        "brand string, oc_numero long, sku string, codigo_padre string, centro string, cantidad long, fecha_entrega string")
    got = spark.createDataFrame([("A", 1, "s", 2), ("A", 1, "s", 1), ("A", 2, "s", 50), ("A", 3, "s", 5), ("A", None, "s", 9), ("A", 1, "s", None)],
                                "brand string, oc_numero long, sku string, cantidad_recibida long")
    rows = {(r.cod_padre, r.sku, r.centro): (r.open_qty, r.earliest_delivery, r.n_open_pos) for r in S.backorder_signal(po, got).collect()}
    assert rows == {("P", "s", "x"): (8.0, "2020-01-01", 3), ("P", "s", None): (4.0, None, 1), (None, "s", "x"): (3.0, "2020-02-01", 1)}
    joined = run.t.backorder._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert not [n for n in joined.splitlines() if "Project" in n and "fecha_entrega" in n]


def test_suppliers_are_made_distinct_by_parent_only(run):
    """Lines meet their parts first: no exchange of nearly all lines to find distinct pairs of part and supplier."""
    plan = run.t.competitor_price_view()._jdf.queryExecution().optimizedPlan().toString()
    assert not [n for n in plan.splitlines() if "Aggregate" in n and "partkey" in n]
