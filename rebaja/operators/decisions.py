"""Decision log: latest state, chain decisions, planner review, export."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X

KEYS = ["brand", "week", "key"]


def decision_key(df: DataFrame) -> Column:
    """Key of an action: parent and store, or parent and channel (bm, ecomm) where rows have no store.

    A row without a valid place has no key, so it meets no decision.
    """
    place = F.nullif(F.trim("store"), F.lit("")) if "store" in df.columns else F.when(F.col("channel").isin("bm", "ecomm"), F.col("channel"))
    return F.when(place.isNotNull(), F.concat_ws("-", "parent_sku", place))


def decide_by_formula(actions: DataFrame) -> DataFrame:
    """Decisions from a stated rule on the parent code, for runs and checks without people.

    The number in the parent code modulo five: 0 none, 1 approved, 2 rejected,
    3 manual (1000 above the suggestion), 4 bm_approved.
    """
    q = F.regexp_extract("parent_sku", r"(\d+)-", 1).cast("int") % 5
    status = F.when(q == 1, "approved").when(q == 2, "rejected").when(q == 3, "manual").when(q == 4, "bm_approved")
    return actions.select(
        "brand", "week", decision_key(actions).alias("key"), status.alias("status"),
        F.when(q == 3, F.col("recommended_price").cast("double") + 1000).alias("manual_price"),
        F.col("week").cast("timestamp").alias("ts")).where("status is not null")


def apply_decisions(log: DataFrame) -> DataFrame:
    """State of every key from its event log.

    Events: brand, week, key, status, ts, bulk (optional), manual_price
    (optional). A single event sets the key, an empty status clears it. A bulk
    event only counts while the key is undecided: so the state is that of the
    last single event, or, if that cleared the key or none exists, of the first
    bulk event after it.
    """
    df = log
    for name, kind in (("bulk", "boolean"), ("manual_price", "double"), ("event_user", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    record = F.struct("status", "manual_price", "event_user", "ts")
    single = ~F.coalesce("bulk", F.lit(False))
    latest = df.where(single).groupBy(*KEYS).agg(F.max_by(record, F.struct("ts", "status")).alias("_last"))
    after = (
        df.where(~single).join(latest.select(*KEYS, "_last"), KEYS, "left")
        .where(F.col("_last").isNull() | ((F.coalesce("_last.status", F.lit("")) == "") & (F.col("ts") > F.col("_last.ts"))))
        .groupBy(*KEYS).agg(F.min_by(record, F.struct("ts", "status")).alias("_bulk"))
    )
    return (
        latest.join(after, KEYS, "full")
        .select(*KEYS, F.when(F.coalesce("_last.status", F.lit("")) != "", F.col("_last")).otherwise(F.col("_bulk")).alias("_r"))
        .where(F.coalesce("_r.status", F.lit("")) != "")
        .select(*KEYS, "_r.status", "_r.manual_price", "_r.event_user", "_r.ts")
    )


def chain_fanout(chain: DataFrame, actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chain decisions spread to the stores of their scope that have none of their own.

    ``chain``: brand, week, parent_sku, chain_scope (all, bm, ecomm), status, ts.
    Returns the store decisions, the fanned ones with ``chain_key``. Actions
    must be per store: one per channel is a chain decision already.
    """
    if "store" not in actions.columns:
        raise ValueError("chain decisions need actions per store")
    scoped = (
        actions.select("brand", "week", "parent_sku", "store", X.channel_of("store").alias("_channel"))
        .join(chain, ["brand", "week", "parent_sku"])
        .where((F.col("chain_scope") == "all") | (F.col("chain_scope") == F.col("_channel")))
        .select("brand", "week", F.concat_ws("-", "parent_sku", "store").alias("key"), "status", "ts",
                F.concat_ws("-chain-", "parent_sku", "chain_scope").alias("chain_key"))
        .groupBy(*KEYS).agg(F.max(F.struct("ts", "status", "chain_key")).alias("_c")).select(*KEYS, "_c.*")
    )
    fanned = scoped.join(decisions.select(*KEYS), KEYS, "left_anti")
    return decisions.unionByName(fanned, allowMissingColumns=True)


def planner_transition(decisions: DataFrame, planned: DataFrame) -> DataFrame:
    """Planner verdicts on decided keys; the original status is kept as ``bm_status``.

    ``planned``: brand, week, key, planner_status. Undecided keys are not touched.
    """
    df = decisions.join(planned, KEYS, "left")
    moved = F.col("planner_status").isNotNull() & F.col("status").isin(C.BM_STATUSES)
    return df.withColumn("bm_status", F.when(moved, F.col("status"))).withColumns({
        "status": F.when(moved, F.col("planner_status")).otherwise(F.col("status")),
        "planner_status": F.when(moved, F.col("planner_status"))})


def planner_queue(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Actions a brand manager decided and no planner has reviewed."""
    waiting = decisions.where(F.col("status").isin(C.BM_STATUSES)).select(
        *KEYS, F.col("status").alias("bm_status"), "manual_price", F.col("ts").alias("bm_timestamp"))
    return actions.withColumn("key", decision_key(actions)).join(waiting, KEYS)


def planner_roster(queue: DataFrame) -> DataFrame:
    place = F.col("store_name") if "store_name" in queue.columns else F.when(F.col("channel") == "ecomm", "Ecomm").otherwise("B&M")
    return queue.groupBy("brand", place.alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rev_delta").alias("rev_delta"))


def export_rows(actions: DataFrame, decisions: DataFrame, require_planner: bool = False) -> DataFrame:
    """Approved actions with manual overrides applied, labelled increase or markdown."""
    statuses = ["planner_approved"] if require_planner else C.EXPORT_STATUSES
    dec = decisions.where(F.col("status").isin(statuses))
    for name in ("manual_margin_pct", "manual_velocity"):
        if name not in dec.columns:
            dec = dec.withColumn(name, F.lit(None).cast("double"))
    dec = dec.select(*KEYS, "status", "manual_price", "manual_margin_pct", "manual_velocity")
    manual = F.coalesce(F.col("manual_price") != 0, F.lit(False))
    return actions.withColumn("key", decision_key(actions)).join(dec, KEYS).withColumns({
        "recommended_price": F.when(manual, F.col("manual_price").cast("long")).otherwise(F.col("recommended_price")),
        "margin_pct": F.when(manual & F.col("manual_margin_pct").isNotNull(), F.col("manual_margin_pct")).otherwise(F.col("margin_pct")),
        "expected_velocity": F.when(manual & F.col("manual_velocity").isNotNull(), F.col("manual_velocity"))
        .otherwise(F.col("expected_velocity")),
        "section": F.when(F.col("action_type") == "increase", "increase").otherwise("markdown"),
    }).drop("manual_margin_pct", "manual_velocity")


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").partitionBy("brand").json(path)


def load_audit(audit: DataFrame, brand: str, limit: int | None = 100) -> DataFrame:
    """Newest events of a brand first; ``None``: all."""
    events = audit.where(F.col("brand") == brand).orderBy(F.desc("timestamp"), "key", "action")
    return events if limit is None else events.limit(limit)


def load_feedback(log: DataFrame, week: str | None = None) -> DataFrame:
    """Latest feedback per key of a week, or of each brand's last week."""
    if week is None:
        last = log.groupBy("brand").agg(F.max("week").alias("week"))
        log = log.join(F.broadcast(last), ["brand", "week"], "left_semi")
    else:
        log = log.where(F.col("week") == F.lit(week))
    return log.groupBy(*KEYS).agg(F.max(F.struct("ts", "implemented")).alias("_r")).select(*KEYS, "_r.implemented", "_r.ts")
