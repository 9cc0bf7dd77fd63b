"""Actual sales after a decision: lines are summed by week of sale before they meet the up to four decision weeks they count for."""
import datetime as dt
import re

from rebaja.operators import outcomes as O

D0, DAY = dt.date(2024, 1, 1), dt.timedelta(days=1)


def _tables(spark):
    lines = [("A", sku, "2001", n, price, dt.datetime.combine(D0 + d * DAY, dt.time(10))) for sku, n, price, d in [
        ("P1-1", 2, 10.0, 7), ("P1-1", 1, 12.0, 8), ("P1-2", 3, 10.0, 8), ("P1-1", -1, 10.0, 15), ("P1-1", 5, 10.0, 35), ("P1-1", 9, 10.0, 0),
        ("ZZ", 7, 10.0, 8), ("P2-1", None, 10.0, 9), ("P2-1", 4, None, 9)]]
    txn = spark.createDataFrame(lines, "brand string, sku string, centro string, cantidad long, precio_final double, fecha timestamp")
    products = spark.createDataFrame([("A", "P1-1", "P1"), ("A", "P1-2", "P1"), ("A", "P2-1", "P2"), ("A", "P2-1", "P3")], "brand string, material string, codigo_padre string")
    weeks = spark.createDataFrame([("A", D0), ("A", D0 + 7 * DAY)], "brand string, week date")
    return txn, products, weeks


def test_windows_of_two_decisions(spark):
    rows = O.actual_metrics(*_tables(spark)).collect()
    got = {(r.parent_sku, (r.week - D0).days): (r.actual_units, r.actual_revenue, r.n_weeks_observed) for r in rows}
    assert got == {("P1", 0): (5, 52.0, 2), ("P1", 7): (4, 40.0, 2), ("P2", 0): (4, None, 1)}


def test_lines_are_summed_before_they_are_exploded(spark):
    plan = O.actual_metrics(*_tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[.*_sold", plan[plan.index("Generate explode"):])
