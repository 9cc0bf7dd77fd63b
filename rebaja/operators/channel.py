"""Price actions per parent and channel."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X, pricing as P
from rebaja.operators import lookups

KEYS = ["brand", "week", "codigo_padre", "channel"]


def weighted_mean(value: str, weight: Column) -> Column:
    """Mean weighted by ``weight``, each weight at least a trace."""
    w = F.when(weight > 0, weight).otherwise(1e-9)
    return F.sum(F.coalesce(value, F.lit(0.0)) * w) / F.sum(w)


def top_reasons(actions: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Most frequent reasons per group, joined; equal counts in alphabetical order."""
    pieces = actions.select(*keys, F.explode(F.split("reasons", ";")).alias("_r")).select(*keys, F.trim("_r").alias("_r"))
    counted = pieces.where("_r <> ''").groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_r"))
    kept = counted.withColumn("_k", rank).where(F.col("_k") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_r"))), lambda s: s["_r"])
    return kept.groupBy(*keys).agg(F.concat_ws("; ", listed).alias("reasons"))


def step_variance(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Share of actioned stores off the most common step (the lower one if tied)."""
    counts = actions.groupBy(*keys, X.parse_pct("recommended_discount").alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.sum("_n").alias("n_actioned"), F.max(F.struct("_n", (-F.col("_step")).alias("_s"))).alias("_mode")
    ).select(*keys, "n_actioned", F.abs("_mode._s").alias("modal_step"),
             F.when(F.col("n_actioned") >= 2, 1 - F.col("_mode._n") / F.col("n_actioned")).otherwise(0.0).alias("variance_pct"))


def _rank(column: str, names: list[str], default: int) -> Column:
    out = F.lit(default)
    for i, name in enumerate(names):
        out = F.when(F.col(column) == name, i).otherwise(out)
    return out


def _name(rank: Column, names: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for i, name in enumerate(names):
        out = F.when(rank == i, name).otherwise(out)
    return out


def channel_groups(rows: DataFrame, costs: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Parent-channel aggregates with raw cost (no rebate) and elasticity."""
    vel = F.coalesce("velocity_4w", F.lit(0.0))
    agg = rows.withColumn("channel", X.channel_of("centro")).groupBy(*KEYS).agg(
        F.countDistinct("centro").alias("n_stores"), F.round(F.sum(vel), 6).alias("velocity"),
        F.concat_ws(",", F.array_sort(F.collect_set("centro"))).alias("stores_in_channel"),
        F.sum("stock_on_hand").alias("stock"), F.median("avg_precio_lista").alias("list_price"),
        F.round(weighted_mean("avg_precio_final", vel), 6).alias("price"),
        F.round(weighted_mean("discount_rate", vel), 9).alias("disc"))
    agg = agg.where("velocity > 0 and list_price is not null")
    found = lookups.prefix_lookup(rows, costs.where("cost > 0"), "codigo_padre", "sku", "cost")
    reliable = elasticity.where("confidence in ('high', 'medium')").select("brand", "codigo_padre", F.col("elasticity").alias("e"))
    return agg.join(found, ["brand", "codigo_padre"], "left").join(reliable, ["brand", "codigo_padre"], "left")


def store_profit(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum over stores of the best profit each could reach on its own."""
    shared = groups.select(*KEYS, "list_price", "cost", "e", F.col("price").alias("_channel_price"))
    df = rows.withColumn("channel", X.channel_of("centro")).join(shared, KEYS).withColumns({
        "_v": F.coalesce("velocity_4w", F.lit(0.0)), "_p": F.coalesce("avg_precio_final", "_channel_price"),
        "_d": F.coalesce("discount_rate", F.lit(0.0))})
    priced = P.with_best_step(df.where("_v > 0"), "_best", "list_price", "_p", "_d", "_v", "cost", "e")
    return priced.groupBy(*KEYS).agg(F.coalesce(F.sum("_best.profit"), F.lit(0.0)).alias("sum_per_store_profit"))


def channel_actions(rows: DataFrame, actions: DataFrame, costs: DataFrame, elasticity: DataFrame) -> DataFrame:
    """One action per parent and channel that has an actioned store.

    The best ladder step of the whole channel, or, where no step clears the
    floors, the velocity-weighted mean of the stores' steps. Carries the gap to
    per-store optimisation (``chain_uniform_profit`` against
    ``sum_per_store_profit``). ``rows``: pricing rows of the week; ``actions``:
    store actions of the same week.
    """
    c = F.col
    acts = actions.withColumns({"channel": X.channel_of("store"), "codigo_padre": c("parent_sku")})
    severity, trust = ["LOW", "MEDIUM", "HIGH"], ["SPECULATIVE", "LOW", "MEDIUM", "HIGH"]
    weight = F.greatest(F.coalesce("current_velocity", F.lit(0.0)), F.lit(0.01))
    signal = acts.groupBy(*KEYS).agg(
        F.round(F.sum(X.parse_pct("recommended_discount") * weight) / F.sum(weight), 9).alias("_step_mean"),
        F.max(F.when(c("urgency") != "INCREASE", _rank("urgency", severity, 0))).alias("_severity"),
        F.max(_rank("confidence_tier", trust, 1)).alias("_trust"), F.max("rebate_amount").alias("rebate_amount"))
    names = rows.groupBy("brand", "codigo_padre").agg(
        F.min("product_name").alias("product"), F.min("primera_jerarquia").alias("category"),
        F.min("segunda_jerarquia").alias("subcategory"))
    groups = channel_groups(rows, costs, elasticity)
    priced = P.with_best_step(groups, "_sim", "list_price", "price", "disc", "velocity", "cost", "e")
    df = (
        priced.join(signal, KEYS).join(step_variance(acts, KEYS), KEYS).join(top_reasons(acts, KEYS), KEYS, "left")
        .join(store_profit(rows, groups), KEYS, "left").join(names, ["brand", "codigo_padre"], "left")
        .where(c("_sim").isNull() | (c("_sim.action") != "hold"))
    )
    fallback, costed = c("_sim").isNull(), X.true(c("cost") > 0)
    df = X.computed(df, _fb_step=P.snap_discount("_step_mean"), _now=P.snap_price("price"), _held=P.snap_discount("disc"))
    df = X.computed(df, _fb_price=P.snap_price(c("list_price") * (1 - c("_fb_step"))),
                    _fb_vel=P.expected_velocity_bidir("velocity", "disc", "_fb_step", "e"))
    still = (F.abs(c("_fb_price") - c("_now")) < C.MIN_PRICE_MOVE) & (c("_fb_step") == c("_held"))
    fb_action = F.when(c("_fb_step") > c("disc") + 1e-9, "decrease").when(c("_fb_step") < c("disc") - 1e-9, "increase")
    df = df.where(~fallback | (~still & fb_action.isNotNull()))
    df = df.withColumns({
        "step": F.coalesce("_sim.step", "_fb_step"), "new_price": F.coalesce("_sim.price", "_fb_price"),
        "exp_vel": F.coalesce("_sim.velocity", "_fb_vel"), "action_type": F.coalesce("_sim.action", fb_action),
        "aggregation_method": F.when(fallback, "velocity_weighted_fallback").otherwise("profit_simulation")})
    net, net_now = c("new_price") / C.VAT, c("price") / C.VAT
    profit = F.when(costed, (net - c("cost")) * c("exp_vel")).otherwise(c("new_price") * c("exp_vel"))
    rev_now, rev_exp = c("velocity") * c("price"), c("exp_vel") * c("new_price")
    gap = c("sum_per_store_profit") - c("chain_uniform_profit")
    review = c("variance_pct") > C.MANDATORY_REVIEW_VARIANCE
    return df.withColumns({
        "chain_uniform_profit": profit, "sum_per_store_profit": F.coalesce("sum_per_store_profit", F.lit(0.0)),
    }).select(
        "brand", "week", c("codigo_padre").alias("parent_sku"), "channel", F.coalesce("product", "codigo_padre").alias("product"),
        "category", "subcategory", X.vendor_brand("codigo_padre", "brand").alias("vendor_brand"), "n_stores", "stores_in_channel",
        c("stock").isNotNull().alias("has_stock_data"), c("stock").cast("long").alias("channel_stock"),
        c("list_price").cast("long").alias("current_list_price"), c("_now").alias("current_price"),
        X.format_pct("_held").alias("current_discount"), X.half_even("velocity", 1).alias("current_velocity"),
        c("new_price").alias("recommended_price"), X.format_pct("step").alias("recommended_discount"),
        X.half_even("exp_vel", 1).alias("expected_velocity"), rev_now.cast("long").alias("current_weekly_rev"),
        rev_exp.cast("long").alias("expected_weekly_rev"), (rev_exp - rev_now).cast("long").alias("rev_delta"),
        c("cost").cast("long").alias("unit_cost"), "rebate_amount",
        F.when(costed, F.when(net > 0, X.half_even((net - c("cost")) / net * 100, 1)).otherwise(0.0)).alias("margin_pct"),
        F.when(costed, ((net - c("cost")) * c("exp_vel") - (net_now - c("cost")) * c("velocity")).cast("long")).alias("margin_delta"),
        F.when(c("action_type") == "increase", "INCREASE").otherwise(
            F.coalesce(_name(c("_severity"), severity), F.lit("MEDIUM"))).alias("urgency"),
        X.join_reasons([
            F.nullif(c("reasons"), F.lit("")),
            F.when(review, F.concat(F.lit("Revisar por tienda: "), X.pct_text("variance_pct"), F.lit(" de las tiendas difieren del canal"))),
            F.when(fallback, "Stock data missing — velocity-weighted fallback")]).alias("reasons"),
        _name(c("_trust"), trust).alias("confidence_tier"), "action_type",
        X.half_even("variance_pct", 3).alias("per_store_variance_pct"), review.alias("mandatory_review"), "aggregation_method",
        X.half_even("chain_uniform_profit", 2).alias("chain_uniform_profit"),
        X.half_even("sum_per_store_profit", 2).alias("sum_per_store_profit"), X.half_even(gap, 2).alias("gap_abs_clp"),
        X.half_even(F.when(c("sum_per_store_profit") > 0, gap / c("sum_per_store_profit") * 100).otherwise(0.0), 2).alias("gap_pct"))


def channel_gap_stats(actions: DataFrame) -> DataFrame:
    """Cost of one price per channel: distribution of the gap per brand.

    The gap is rounded to two places, so the exact percentile keeps a bounded
    number of distinct values.
    """
    return actions.groupBy("brand", "week").agg(
        F.count(F.lit(1)).alias("n_channel_actions"), F.count_if("mandatory_review").alias("n_mandatory_review"),
        X.half_even(F.avg("gap_pct"), 2).alias("gap_pct_mean"), X.half_even(F.median("gap_pct"), 2).alias("gap_pct_median"),
        X.half_even(F.percentile("gap_pct", F.lit(0.75)), 2).alias("gap_pct_p75"),
        X.half_even(F.percentile("gap_pct", F.lit(0.95)), 2).alias("gap_pct_p95"),
        F.round(F.sum("chain_uniform_profit"), 2).alias("total_chain_uniform_profit"),
        F.round(F.sum("sum_per_store_profit"), 2).alias("total_sum_per_store_profit"),
        X.half_even(F.avg("per_store_variance_pct"), 3).alias("variance_pct_mean"),
        X.half_even(F.avg((F.col("aggregation_method") == "velocity_weighted_fallback").cast("double")) * 100, 1).alias("pct_fallback"))
