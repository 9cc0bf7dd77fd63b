"""Streams over several runs: state is taken up and evicted, late rows are dropped, and the rest equals the batch result."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from rebaja import schemas
from rebaja.operators import weekly as W
from rebaja.streaming import weekly as SW

KEYS = ["brand", "sku", "centro", "week"]


def state_rows(progress):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]


def test_sales_over_deliveries_equal_batch(spark, run, tmp_path):
    lines = run.t.transactions.select("brand", "sku", "centro", "fecha", "cantidad", "precio_final", "tipo_entrega", "folio")
    batch, progress = W.weekly_sales(run.t.transactions), []
    got = SW.replay(lines, "fecha", SW.stream_weekly_sales, KEYS, str(tmp_path / "s"), 4, progress)
    want = batch.select(*KEYS, "units_sold", "gross_revenue", "click_collect_units")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0
    assert len([p for p in progress if p["numInputRows"]]) == 4
    assert max(state_rows(progress)) < got.count() and state_rows(progress)[-1] < got.count() / 10  # passed weeks are gone
    folios = SW.replay(lines, "fecha", SW.stream_weekly_folios, KEYS, str(tmp_path / "f"), 3)
    assert folios.select(*KEYS, "txn_count").exceptAll(batch.select(*KEYS, "txn_count")).count() == 0 and folios.count() == batch.count()


def line(day, folio="f", units=1, sku="S"):
    return ("A", sku, "2001", dt.datetime(2024, 1, 1) + dt.timedelta(days=day), units, 10.0, "x", folio)


def deliver(spark, rows, stream, folder, keys, progress=None):
    """Each list of rows as one delivery and run."""
    for part in rows:
        df = spark.createDataFrame(part, "brand string, sku string, centro string, fecha timestamp, cantidad long, precio_final double, tipo_entrega string, folio string").coalesce(1)
        df.write.mode("append").parquet(f"{folder}/in")
        out = SW.run_available(stream(SW.file_stream(spark, f"{folder}/in", df.schema)), f"{folder}/out", f"{folder}/cp", "update", keys, progress)
    return out


def test_late_rows_are_dropped_and_rows_in_time_are_not(spark, tmp_path):
    parts = [[line(0), line(3, "g"), line(0)], [line(20), line(8, "in time")], [line(60)], [line(1, "late", 100), line(55, "in time")], [line(61, "h")]]
    out = {r.week.isoformat(): (r.units_sold, r.gross_revenue) for r in deliver(spark, parts, SW.stream_weekly_sales, str(tmp_path / "s"), KEYS).collect()}
    assert out["2024-01-01"] == (3, 30.0)  # the 100 units came two months late
    assert out["2024-01-08"] == (1, 10.0) and out["2024-02-19"] == (1, 10.0) and out["2024-02-26"] == (2, 20.0)
    counts = {r.week.isoformat(): r.txn_count for r in deliver(spark, parts, SW.stream_weekly_folios, str(tmp_path / "f"), KEYS).collect()}
    assert counts["2024-01-01"] == 2 and counts["2024-02-26"] == 2


@pytest.mark.parametrize("late, total", [(dt.timedelta(minutes=30), 4), (dt.timedelta(hours=200), 3)])
def test_audit_events_count_once_across_runs(spark, tmp_path, late, total):
    at = dt.datetime(2026, 4, 28, 10)
    event = lambda key, ts: ("A", "u", "approved", key, "w", ts)
    parts = [[event("k1", at)], [event("k1", at), event("k2", at + dt.timedelta(minutes=5))], [event("k3", at)], [event("k4", at - late)]]
    for part in parts:
        spark.createDataFrame(part, schemas.AUDIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = SW.run_available(SW.stream_audit_counts(SW.file_stream(spark, str(tmp_path / "in"), schemas.AUDIT)), str(tmp_path / "out"), str(tmp_path / "cp"), "update", ["brand", "action", "week"])
    assert out.agg(F.sum("n")).first()[0] == total


def test_replay_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "tienda_id string, fecha timestamp, entradas long, salidas long, tiempo_permanencia_prom double")
    assert SW.replay(none, "fecha", SW.stream_traffic_weekly, ["centro", "week"], str(tmp_path), 2).count() == 0
