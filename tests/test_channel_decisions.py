"""Decisions per channel: keys, the planner's queue and verdict, export."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from rebaja.operators import decisions as D

WEEK = dt.date(2024, 4, 15)
ACTIONS = "brand string, week date, parent_sku string, channel string, recommended_price long, margin_pct double, expected_velocity double, action_type string, rev_delta long"
DECIDED = "brand string, week date, key string, status string, manual_price double, ts timestamp"


@pytest.fixture()
def actions(spark):
    rows = [("A", WEEK, "P1", "bm", 100, 40.0, 2.0, "increase", 5), ("A", WEEK, "P1", "ecomm", 90, 30.0, 1.0, "decrease", 7), ("A", WEEK, "P2", "bm", 80, 20.0, 3.0, "decrease", 9),
            ("A", WEEK, "P3", None, 70, 10.0, 1.0, "decrease", 1), ("A", WEEK, "P3", "", 70, 10.0, 1.0, "decrease", 1), ("A", WEEK, "P3", "mall", 70, 10.0, 1.0, "decrease", 1)]
    return spark.createDataFrame(rows, ACTIONS)


def decisions(spark, *rows):
    return spark.createDataFrame([("A", WEEK, k, s, m, dt.datetime(2024, 4, 16)) for k, s, m in rows], DECIDED)


def test_keys_need_a_channel(actions):
    assert [r.key for r in actions.select(D.decision_key(actions).alias("key")).collect()] == ["P1-bm", "P1-ecomm", "P2-bm", None, None, None]


def test_queue_by_channel(spark, actions):
    log = decisions(spark, ("P1-bm", "bm_approved", None), ("P1-2001", "bm_approved", None), ("P2-bm", "planner_approved", None), ("P3", "approved", None), ("P3-", "approved", None))
    queue = D.planner_queue(actions, log)
    assert [(r.key, r.bm_status) for r in queue.collect()] == [("P1-bm", "bm_approved")]
    assert [r[:] for r in D.planner_roster(queue).collect()] == [("A", "B&M", 1, 5)]


def test_planner_moves_one_channel(spark, actions):
    log = decisions(spark, ("P1-bm", "bm_approved", None), ("P1-ecomm", "bm_approved", None))
    planned = log.where("key = 'P1-bm'").select(*D.KEYS, F.lit("planner_approved").alias("planner_status"))
    got = {r.key: (r.status, r.bm_status) for r in D.planner_transition(log, planned).collect()}
    assert got == {"P1-bm": ("planner_approved", "bm_approved"), "P1-ecomm": ("bm_approved", None)}


def test_export_of_approved_channels(spark, actions):
    log = decisions(spark, ("P1-bm", "approved", None), ("P1-ecomm", "manual", 85.0), ("P2-bm", "bm_approved", None))
    got = {r.key: (r.recommended_price, r.section) for r in D.export_rows(actions, log).collect()}
    assert got == {"P1-bm": (100, "increase"), "P1-ecomm": (85, "markdown")}
    assert D.export_rows(actions, log, require_planner=True).count() == 0


def test_no_chain_decisions_by_channel(spark, actions):
    log = decisions(spark, ("P1-bm", "approved", None))
    with pytest.raises(ValueError):
        D.chain_fanout(log, actions, log)
