"""Historical accuracy of scores against what happened."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rebaja.functions import columns as X

SERIES = ["brand", "sku", "centro"]


def markdown_events(features: DataFrame) -> DataFrame:
    """First week of each discount spell, and the first discount week of the series."""
    run, whole = Window.partitionBy(*SERIES).orderBy("week"), Window.partitionBy(*SERIES)
    on = F.col("has_discount") == 1
    return features.select(*SERIES, "week", "has_discount").withColumns({
        "markdown_event": (on & (F.coalesce(F.lag("has_discount").over(run), F.lit(0)) == 0)).cast("int"),
        "first_markdown_week": F.min(F.when(on, F.col("week"))).over(whole)})


def first_markdown_dataset(features: DataFrame) -> DataFrame:
    """Rows before the first discount; 1 if that comes within four weeks."""
    first = F.min(F.when(F.col("has_discount") == 1, F.col("week"))).over(Window.partitionBy(*SERIES))
    ahead = F.datediff("first_discount_week", "week") / 7
    return (
        features.withColumn("first_discount_week", first).where("first_discount_week is null or week < first_discount_week")
        .withColumn("target_first_markdown_4w", X.true((ahead > 0) & (ahead <= 4)).cast("int"))
    )


def walk_forward_metrics(scored: DataFrame, test_start: str | None = None, top_k: int = 50) -> DataFrame:
    """Per week from ``test_start`` on (None: all): precision and recall of the top K, depth error, separation and revenue at risk.

    Ranks are taken within 32 slices of a week first and then among the at most
    32 x K survivors, so no task sorts a whole week.
    """
    c = F.col
    df = scored if test_start is None else scored.where(c("week") >= F.lit(test_start).cast("date"))
    order = [F.desc("markdown_probability"), "sku", "centro"]
    part = Window.partitionBy("brand", "week", F.pmod(F.xxhash64("sku", "centro"), F.lit(32)))
    short = df.withColumn("_rn", F.row_number().over(part.orderBy(*order))).where(c("_rn") <= top_k)
    best = short.withColumn("_rn", F.row_number().over(Window.partitionBy("brand", "week").orderBy(*order))).where(c("_rn") <= top_k)
    hit = c("will_discount_4w") == 1
    week = df.groupBy("brand", "week").agg(
        F.count(F.lit(1)).alias("total_skus"), F.countDistinct(F.when(hit, c("sku"))).alias("actual_positives"),
        F.avg(F.when(hit, c("markdown_probability"))).alias("pos_avg_prob"),
        F.avg(F.when(~hit, c("markdown_probability"))).alias("neg_avg_prob"))
    top = best.groupBy("brand", "week").agg(
        F.count(F.lit(1)).alias("top_k"), F.avg("will_discount_4w").alias("precision_at_k"),
        F.avg(F.when(hit, F.abs(c("raw_depth") - c("future_max_disc_4w")))).alias("depth_mae"),
        F.sum("gross_revenue").alias("revenue_at_risk"))
    # a recommended SKU counts as found if any of its stores was marked down that week
    positive = df.where(hit).select("brand", "week", "sku").distinct()
    found = best.select("brand", "week", "sku").distinct().join(positive, ["brand", "week", "sku"], "left_semi").groupBy(
        "brand", "week").agg(F.count(F.lit(1)).alias("_found"))
    recall = F.when(c("actual_positives") > 0, F.coalesce("_found", F.lit(0)) / c("actual_positives"))
    return (week.join(top, ["brand", "week"]).join(found, ["brand", "week"], "left")
            .withColumn("recall_at_k", recall).drop("_found"))


def timing_delta(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Weeks from the first flag to the first discount; positive is early."""
    flagged = scored.groupBy(*SERIES).agg(
        F.min(F.when(F.col("markdown_probability") >= threshold, F.col("week"))).alias("model_first_flag"),
        F.min(F.when(F.col("has_discount") == 1, F.col("week"))).alias("actual_first_markdown"))
    return flagged.where("model_first_flag is not null and actual_first_markdown is not null").withColumn(
        "delta_weeks", F.round(F.datediff("actual_first_markdown", "model_first_flag") / 7, 1))


def timing_buckets(timing: DataFrame) -> DataFrame:
    d = F.col("delta_weeks")
    bounds = [-100.0, -8.0, -4.0, -0.5, 0.5, 4.0, 8.0, 100.0]
    names = ["8+ wks late", "4-8 wks late", "1-4 wks late", "Same week", "1-4 wks early", "4-8 wks early", "8+ wks early"]
    bucket = F.lit(None).cast("string")
    for i, name in enumerate(names):
        bucket = F.when((d > bounds[i]) & (d <= bounds[i + 1]), name).otherwise(bucket)
    return timing.withColumn("bucket", bucket).where("bucket is not null").groupBy("brand", "bucket").agg(F.count(F.lit(1)).alias("n"))


def depth_accuracy(scored: DataFrame) -> DataFrame:
    """Model depth against actual depth on discounted rows."""
    delta = F.col("raw_depth") - F.col("discount_rate")
    return scored.where("has_discount = 1 and discount_rate > 0.01").select(
        *SERIES, "week", "primera_jerarquia", "segunda_jerarquia", "discount_rate", F.col("raw_depth").alias("model_depth"),
        F.round(delta, 9).alias("depth_delta"), F.col("markdown_probability").alias("model_prob"), "units_sold", "gross_revenue"
    ).withColumn("depth_class", F.when(F.col("depth_delta") < -0.01, "shallower").when(F.col("depth_delta") > 0.01, "deeper")
                 .otherwise("similar"))


def revenue_impact(scored: DataFrame, depth: DataFrame, timing: DataFrame) -> DataFrame:
    """Savings of shallower discounts, and how early or late the flags were, per brand."""
    prices = scored.where("units_sold > 0").groupBy("brand", "sku").agg(F.avg("avg_precio_lista").alias("_price"))
    saving = F.col("_price") * (F.col("discount_rate") - F.col("model_depth")) * F.col("units_sold")
    by_week = depth.join(prices, ["brand", "sku"], "left").groupBy("brand", "week").agg(F.sum(saving).alias("_s"))
    money = by_week.groupBy("brand").agg(
        F.round(F.sum("_s"), 2).alias("depth_total_savings"), F.round(F.avg("_s"), 2).alias("depth_avg_weekly_savings"),
        F.round(F.avg("_s") * 52, 2).alias("annualised_savings"))
    d = F.col("delta_weeks")
    when = timing.groupBy("brand").agg(
        F.count_if(d > 0).alias("flagged_early"), F.count_if(d < 0).alias("flagged_late"),
        F.coalesce(F.avg(F.when(d > 0, d)), F.lit(0.0)).alias("avg_early_weeks"),
        F.coalesce(F.avg(F.when(d < 0, F.abs(d))), F.lit(0.0)).alias("avg_late_weeks"))
    return money.join(when, "brand", "full")


def depth_breakdown(depth: DataFrame) -> DataFrame:
    """Actual and model depth by category and by store, in one pass."""
    level = F.when(F.grouping("centro") == 0, "store").otherwise("category")
    return (
        depth.groupingSets([["brand", "primera_jerarquia", "segunda_jerarquia"], ["brand", "centro"]],
                           "brand", "primera_jerarquia", "segunda_jerarquia", "centro")
        .agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.avg("discount_rate").alias("avg_actual_disc"),
             F.avg("model_depth").alias("avg_model_disc"), F.avg("depth_delta").alias("avg_depth_delta"),
             F.sum("gross_revenue").alias("total_revenue"))
        .select("brand", "level", F.coalesce("centro", F.concat_ws("/", "primera_jerarquia", "segunda_jerarquia")).alias("name"),
                "n", "avg_actual_disc", "avg_model_disc", "avg_depth_delta", "total_revenue")
    )
