"""Predicted against actual effects of implemented decisions."""
from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X
from rebaja.operators import decisions as D, lookups

fixture_decisions = D.decide_by_formula


def eval_weeks(actions: DataFrame, decisions: DataFrame, lookback: int = 4) -> DataFrame:
    """Weeks with both actions and decisions: the ``lookback`` before the newest, or the only one."""
    both = actions.select("brand", "week").intersect(decisions.select("brand", "week"))
    w = Window.partitionBy("brand")
    ranked = both.withColumns({"_age": F.row_number().over(w.orderBy(F.desc("week"))), "_n": F.count(F.lit(1)).over(w)})
    return ranked.where((F.col("_n") == 1) | F.col("_age").between(2, lookback + 1)).select("brand", "week")


def actual_metrics(txn: DataFrame, products: DataFrame, weeks: DataFrame, lookforward: int = 4) -> DataFrame:
    """Net units, revenue and weeks observed in the four weeks after each decision week.

    ``precio_final`` is read as a unit price here. Lines are summed per parent,
    store and week of sale first; such a row belongs to at most ``lookforward``
    decision weeks, so the rows, not the lines, are exploded to those and
    equi-joined rather than range-joined. Days outside all windows are not read:
    the first and last of the weeks, two values, bound the scan by a pushed filter.
    """
    first, last = weeks.agg(F.min("week"), F.max("week")).first()
    if first is None:
        txn = txn.where("false")
    else:
        day = datetime.timedelta(days=7)
        txn = txn.where((F.col("fecha") >= F.lit(first + day).cast("timestamp")) & (F.col("fecha") < F.lit(last + (lookforward + 1) * day).cast("timestamp")))
    sold = (
        txn.select("brand", "sku", "centro", "cantidad", "precio_final", X.week_start("fecha").alias("_sold"))
        .join(lookups.sku_parent(products), ["brand", "sku"])
        .groupBy("brand", F.col("codigo_padre").alias("parent_sku"), F.col("centro").alias("store"), "_sold")
        .agg(F.sum("cantidad").alias("_units"), F.sum(F.col("precio_final") * F.col("cantidad")).alias("_revenue"))
    )
    back = F.explode(F.array(*[F.lit(i) for i in range(1, lookforward + 1)]))
    seen = sold.withColumn("_k", back).withColumn("week", F.date_sub("_sold", F.col("_k") * 7)).join(F.broadcast(weeks), ["brand", "week"], "left_semi")
    # a week of sale is one row here, so rows count the weeks
    agg = seen.groupBy("brand", "week", "parent_sku", "store").agg(
        F.sum("_units").alias("actual_units"), F.sum("_revenue").alias("actual_revenue"), F.count(F.lit(1)).alias("n_weeks_observed"))
    n = F.greatest("n_weeks_observed", F.lit(1))
    return agg.withColumns({"actual_velocity": F.col("actual_units") / n, "actual_weekly_rev": F.col("actual_revenue") / n})


def outcomes(actions: DataFrame, decisions: DataFrame, txn: DataFrame, products: DataFrame, costs: DataFrame,
             lookback: int = 4) -> DataFrame:
    """One row per implemented decision that sold: errors, lifts, direction and margin."""
    c = F.col
    weeks = eval_weeks(actions, decisions, lookback)
    done = decisions.where(c("status").isin(C.IMPLEMENTED_STATUSES)).select("brand", "week", "key", "status", "manual_price")
    actual = actual_metrics(txn, products, weeks)
    cost = costs.groupBy("brand", c("sku").alias("parent_sku")).agg(F.max("cost").alias("_cost"))
    df = (
        actions.join(F.broadcast(weeks), ["brand", "week"], "left_semi").drop("unit_cost")
        .withColumn("key", F.concat_ws("-", "parent_sku", "store")).join(done, D.KEYS)
        .join(actual, ["brand", "week", "parent_sku", "store"]).join(cost, ["brand", "parent_sku"], "left")
        .withColumn("_price", F.coalesce("manual_price", c("recommended_price").cast("double"))).where("_price is not null")
    )
    normal = c("actual_units") >= 3
    av, ar = F.when(normal, c("actual_velocity")), F.when(normal, c("actual_weekly_rev"))
    pv, pr = c("expected_velocity"), c("expected_weekly_rev").cast("double")
    bv = c("current_velocity")
    up, said = X.ratio((av - bv) * 100, bv), X.ratio((pv - bv) * 100, bv)
    net = c("_price") / C.VAT
    return df.select(
        "brand", c("week").alias("decision_week"), "parent_sku", "store", "action_type", "confidence_tier", "status",
        c("_price").cast("long").alias("implemented_price"), bv.alias("baseline_velocity"), pv.alias("predicted_velocity"),
        av.alias("actual_velocity"), X.half_even(F.when(pv > 0, av - pv), 2).alias("velocity_error"),
        X.half_even(F.when(pv > 0, (av - pv) / pv * 100), 1).alias("velocity_error_pct"),
        c("current_weekly_rev").cast("double").alias("baseline_weekly_rev"), pr.alias("predicted_weekly_rev"),
        X.half_even(ar).alias("actual_weekly_rev"), X.half_even(F.when(pr > 0, ar - pr)).alias("rev_error"),
        X.half_even(F.when(pr > 0, (ar - pr) / pr * 100), 1).alias("rev_error_pct"),
        X.half_even(up, 1).alias("actual_lift_vs_baseline"), X.half_even(said, 1).alias("predicted_lift_vs_baseline"),
        ((up >= 0) == (said >= 0)).alias("direction_correct"),
        F.when((c("_cost") > 0) & (c("_price") > 0), X.half_even((net - c("_cost")) / net * 100, 1)).alias("actual_margin_pct"),
        F.when(normal, "normal").otherwise("sparse").alias("data_quality"), c("n_weeks_observed"),
        c("actual_units").cast("double").alias("actual_units"))


def outcome_summary(results: DataFrame) -> DataFrame:
    """Accuracy per brand, per confidence tier and per action type in one pass.

    The inputs are rounded to one place, which bounds what the exact medians hold.
    """
    c = F.col
    said = c("predicted_lift_vs_baseline")
    capture = F.when(F.abs(said) > 0.1, F.round(X.clip(c("actual_lift_vs_baseline") / said, -5.0, 5.0), 6))
    rows = results.where("data_quality = 'normal'").withColumn("_capture", capture)
    level = F.when(F.grouping("confidence_tier") == 0, "confidence").when(F.grouping("action_type") == 0, "action").otherwise("brand")
    correct = F.avg(F.when(c("direction_correct").isNotNull(), c("direction_correct").cast("int")))
    return (
        rows.groupingSets([["brand"], ["brand", "confidence_tier"], ["brand", "action_type"]], "brand", "confidence_tier", "action_type")
        .agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.countDistinct("decision_week").alias("weeks_evaluated"),
             X.half_even(F.median("velocity_error_pct"), 1).alias("median_velocity_error_pct"),
             X.half_even(correct * 100, 1).alias("pct_direction_correct"),
             X.half_even(F.round(F.avg("actual_lift_vs_baseline"), 6), 1).alias("avg_actual_rev_lift"),
             X.half_even(F.median("_capture") * 100, 1).alias("lift_capture_rate"))
        .select("brand", "level", F.coalesce("confidence_tier", "action_type", F.lit("all")).alias("name"), "n", "weeks_evaluated",
                "median_velocity_error_pct", "pct_direction_correct", "avg_actual_rev_lift", "lift_capture_rate")
    )


def outcome_details(results: DataFrame, limit: int | None = 200) -> DataFrame:
    """Rows with enough sales: of each brand the ``limit`` with the worst velocity error."""
    worst = [F.desc_nulls_last(F.abs("velocity_error_pct")), "parent_sku", "store", "decision_week"]
    return lookups.top_per(results.where("data_quality = 'normal'"), "brand", worst, limit)


def worst_predictions(results: DataFrame, limit: int | None = 5) -> DataFrame:
    rows = outcome_details(results.where("velocity_error_pct is not null"), limit)
    return rows.select("brand", "parent_sku", "store", "predicted_velocity", "actual_velocity", "velocity_error_pct",
                       "confidence_tier", "decision_week")
