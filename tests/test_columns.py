import pytest
from pyspark.sql import functions as F

from rebaja.functions import columns as X, pricing as P


def each(spark, fn, cases):
    """Evaluate fn(column x) for all inputs in one job."""
    rows = [(i, c[0]) for i, c in enumerate(cases)]
    kind = "double" if isinstance(cases[0][0], (int, float)) else "string"
    df = spark.createDataFrame([(i, None if v is None else (float(v) if kind == "double" else v)) for i, v in rows], f"i int, x {kind}")
    got = [r["v"] for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == [c[1] for c in cases]


def test_price_anchor_down(spark):
    each(spark, lambda x: P.snap_price(x, "down"), [
        (32000, 29990), (29990, 29990), (500, 990), (0, 0), (-5, 0), (1234567, 1229990), (999990, 999990)])


def test_price_anchor_up(spark):
    each(spark, lambda x: P.snap_price(x, "up"), [(32000, 34990), (29990, 29990), (1234567, 1239990), (0, 0)])


def test_price_anchor_nearest(spark):
    each(spark, P.snap_price, [(45000, 44990), (47490, 44990), (47491, 49990), (100, 990), (1236000, 1239990), (None, None)])


def test_anchor_order_property(spark):
    df = spark.range(1, 999_990, 997).select(F.col("id").cast("double").alias("x"))
    wrong = df.where((F.col("x") > 990) & ((P.snap_price("x", "down") > F.col("x")) | (P.snap_price("x", "up") < F.col("x"))))
    assert wrong.count() == 0


def test_discount_ladder(spark):
    each(spark, P.snap_discount, [(0.02, 0.0), (0.07, 0.15), (0.17, 0.15), (0.18, 0.20), (0.25, 0.20), (0.36, 0.40), (0.9, 0.40)])


@pytest.mark.parametrize("vel,cur,new,e,expected", [
    (2.0, 0.20, 0.30, -1.0, 2.25), (0.0, 0.0, 0.2, -1.0, 0.5), (3.0, 0.3, 0.2, -1.0, 3.0), (2.0, 0.0, 0.15, None, 3.6), (2.0, 0.0, 0.15, -0.2, 3.6)])
def test_expected_velocity(value, vel, cur, new, e, expected):
    e = F.lit(e).cast("double")
    assert value(P.expected_velocity(F.lit(vel), F.lit(cur), F.lit(new), e)) == pytest.approx(expected)


@pytest.mark.parametrize("cur,new,e,expected", [
    (0.30, 0.15, -2.0, 10 * (1 - 2.0 * 0.15 / 0.7)), (0.30, 0.15, None, 7.5), (0.40, 0.0, None, 4.0), (0.2, 0.2, None, 10.0), (0.0, 0.2, None, 22.0)])
def test_velocity_both_ways(value, cur, new, e, expected):
    e = F.lit(e).cast("double")
    assert value(P.expected_velocity_bidir(F.lit(10.0), F.lit(cur), F.lit(new), e)) == pytest.approx(expected)


def test_price_lists(spark):
    each(spark, X.classify_price_list, [
        ("Norte tiendas", "retail"), ("Liquidación Verano", "liquidacion"), ("Promo Liq. Final", "liquidacion"), ("LIQ verano", "liquidacion"),
        ("Outlet Centro", "outlet"), ("Tienda Eventos", "eventos"), ("Tienda Virtual", "online"), ("Marketplace", "online"),
        ("Cliq shop", "retail"), ("", "unknown"), ("  ", "unknown"), (None, "unknown")])


def test_vendor_prefixes(spark):
    each(spark, X.vendor_brand, [("NI123", "Nike"), ("np9", "Nike"), ("CAH1", "Carhartt"), ("CAB1", "Bamers"), ("XX1", "Other"), (" AD7", "Adidas"), ("LT1", "Lacoste")])
    each(spark, lambda x: X.vendor_brand(x, F.lit("BELSPORT")), [("LT1", "Lotto"), ("AL1", "Alphabet"), ("NI1", "Nike")])


def test_channels_and_names(spark):
    each(spark, X.channel_of, [("AB04", "ecomm"), (" ab1", "ecomm"), ("2001", "bm")])
    each(spark, X.store_name, [("B050-Bamers Curico II", "Bamers Curico II"), ("a-b-c", "b-c"), ("plain", "plain")])
    each(spark, X.folio_number, [("039-30670736", "30670736"), ("30670736", "30670736"), ("039-", "039-")])
    each(spark, X.is_pricing_store, [("2001", True), ("AB10", False), ("5140", False), ("AB04", True)])


def test_percent_and_money(spark):
    each(spark, X.parse_pct, [("30%", 0.30), ("Full price", 0.0), ("", 0.0), (None, 0.0), ("0.2", 0.2), ("x%", 0.0)])
    each(spark, X.format_pct, [(0.3, "30%"), (0.0, "Full price"), (0.15, "15%")])
    each(spark, X.format_clp, [(36990.0, "$36.990"), (-1234567.0, "-$1.234.567"), (0.0, "$0"), (None, None)])
    each(spark, X.safe_double, [("1.5", 1.5), ("", None), ("nan", None), ("abc", None), (None, None)])
    each(spark, X.size_number, [("7,5", 7.5), ("11", 11.0), ("XXL", None)])


def test_rounding_is_half_even(spark):
    each(spark, lambda x: X.half_even(x, 1), [(2.25, 2.2), (2.35, 2.4), (-0.05, -0.0), (1.0, 1.0)])


def test_product_names(spark):
    each(spark, X.clean_product_name, [("BONDI 9 N° 7,5", "BONDI 9"), ("POLERA T/XL", "POLERA"), ("MACH 6", "MACH 6")])
    each(spark, X.normalise_name, [("Clifton 9 N° 42", "clifton 9"), ("Bondí Mujer", "bondi"), ("ZAPATILLA talla 42", "zapatilla"), ("cliftoN 9", "clifton 9"), (None, "")])
    each(spark, X.model_name, [
        ("W BONDI 7 BFBG", "BONDI 7"), ("M CHALLENGER 8 MSTRD", "CHALLENGER 8"), ("SPEEDGOAT 6 TTT 11", "SPEEDGOAT 6"),
        ("U ORA RECOVERY SLIDE 3 WWH 12/14", "ORA RECOVERY SLIDE 3"), ("M MACH 5 BLACK / MULTI", "MACH 5"), ("HOKA RUN HAT OTM N° OSFA", "RUN HAT")])


def test_dates(value):
    assert str(value(X.week_start(F.lit("2026-04-26")))) == "2026-04-20"
    assert str(value(X.week_start(F.lit("2026-04-20")))) == "2026-04-20"
    assert value(X.whole_days(F.lit("2026-04-20 00:00:00"), F.lit("2026-04-18 10:00:00"))) == 1
