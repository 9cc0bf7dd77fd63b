"""Parent sales, lifecycle stages and seasons."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rebaja import constants as C
from rebaja.operators import lookups, weekly as W

SERIES = ["brand", "codigo_padre", "centro"]


def parent_weekly_sales(txn: DataFrame, products: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Sales per parent, store and week; SKUs without a parent drop out (``totals``: ``weekly.line_totals`` of the same lines, if at hand)."""
    sold = (W.line_totals(txn) if totals is None else totals).where("units_sold is not null")
    return (
        sold.join(lookups.sku_parent(products), ["brand", "sku"])
        .groupBy(*SERIES, "week")
        .agg(F.sum("units_sold").alias("units"), F.sum("final_all").alias("revenue"),
             F.count(F.lit(1)).alias("n_sizes"),
             (F.sum("discount_all") / F.greatest(F.sum("list_all"), F.lit(1.0))).alias("avg_discount_rate"))
    )


def densify_weeks(weekly: DataFrame, min_density: float = 0.2, min_weeks: int = 8) -> DataFrame:
    """Fill missing weeks with zero sales in series that are dense enough.

    Each row of a qualifying series is exploded up to its next observed week, so
    sparse series are never multiplied and no calendar is joined. Adds ``n_obs``.
    """
    over = Window.partitionBy(*SERIES)
    span = F.datediff(F.max("week").over(over), F.min("week").over(over)) / 7 + 1
    df = weekly.withColumns({
        "n_obs": F.count(F.lit(1)).over(over), "_span": span, "_next": F.lead("week").over(over.orderBy("week"))})
    dense = (F.col("n_obs") / F.col("_span") >= min_density) & (F.col("n_obs") >= min_weeks)
    until = F.when(dense & F.col("_next").isNotNull(), F.date_sub("_next", 7)).otherwise(F.col("week"))
    spread = df.withColumn("_w", F.explode(F.sequence("week", until, F.expr("INTERVAL 7 DAYS"))))
    real = F.col("_w") == F.col("week")
    return spread.select(
        *SERIES, F.col("_w").alias("week"), "n_obs",
        *[F.when(real, F.col(c)).otherwise(0).cast(t).alias(c)
          for c, t in (("units", "long"), ("revenue", "double"), ("avg_discount_rate", "double"))],
        F.when(real, F.col("n_sizes")).alias("n_sizes"))


def lifecycle_stage(parent_weekly: DataFrame, min_density: float = 0.2, min_weeks: int = 8) -> DataFrame:
    """Stage, position and weeks left of every parent-store-week.

    Stages are tested in order: first four weeks, clearance, decline, peak,
    growth, else steady. Series with fewer than three weeks are all launch.
    """
    over = Window.partitionBy(*SERIES)
    run = over.orderBy("week")
    df = densify_weeks(parent_weekly, min_density, min_weeks)
    known = F.col("n_obs") >= 3

    def trailing(k: int):
        return F.avg("units").over(run.rowsBetween(-(k - 1), 0))

    df = df.withColumns({
        "vel_4w": trailing(4), "vel_8w": trailing(8),
        "vel_expanding": F.avg("units").over(run.rowsBetween(Window.unboundedPreceding, 0)),
        "week_idx": F.row_number().over(run) - 1, "_n": F.count(F.lit(1)).over(over),
        "_median": F.greatest(F.median("units").over(over), F.lit(0.1)),
    }).withColumns({
        "_peak": F.max("vel_4w").over(over),
        "vel_ratio": F.col("vel_4w") / F.col("_median"),
        "vel_trend": F.col("vel_4w") / F.greatest("vel_8w", F.lit(0.01)),
        "_now": F.max(F.when(F.col("week_idx") == F.col("_n") - 1, F.col("vel_4w"))).over(over),
        "_then": F.max(F.when(F.col("week_idx") == F.col("_n") - 8, F.col("vel_4w"))).over(over),
    })
    i, disc, ratio, trend, v4 = (F.col(c) for c in ("week_idx", "avg_discount_rate", "vel_ratio", "vel_trend", "vel_4w"))
    stage = (
        F.when(~known | (i < 4), "launch")
        .when((disc > 0.15) & (ratio < 0.7), "clearance")
        .when((ratio < 0.5) | ((trend < 0.7) & (i > 8)), "decline")
        .when((v4 >= F.col("_peak") * 0.8) & (F.col("_peak") > 0), "peak")
        .when((trend > 1.1) & (ratio > 0.8), "growth")
        .otherwise("steady")
    )
    now, then = F.col("_now"), F.col("_then")
    decay = F.log(now / then) / 8
    left = F.when(now <= 0, 0.0).when(
        (then > 0) & (now < then) & (now > 0.5), F.greatest(F.lit(0.0), F.log(F.lit(0.5) / now) / decay))
    return df.withColumns({
        "lifecycle_stage": stage,
        "lifecycle_position": F.when(known, i / F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(0.0),
        "est_weeks_remaining": F.when(known & (F.col("_n") > 8), left),
        **{c: F.when(known, F.col(c)) for c in ("vel_4w", "vel_8w", "vel_expanding", "vel_ratio", "vel_trend", "week_idx")},
    }).drop("_n", "_median", "_peak", "_now", "_then", "n_obs")


def stage_code(stage: str = "lifecycle_stage"):
    entries = []
    for code, name in enumerate(C.LIFECYCLE_STAGES):
        entries += [F.lit(name), F.lit(code)]
    return F.create_map(*entries)[F.col(stage)]


def derive_season(parent_weekly: DataFrame) -> DataFrame:
    """Season of a parent from the month of its first sale; January and February
    belong to the season that began the year before."""
    first = parent_weekly.where("units > 0").groupBy("brand", "codigo_padre").agg(F.min("week").alias("first_sale_week"))
    month = F.month("first_sale_week")
    year = F.year("first_sale_week") - F.when(month.isin(1, 2), 1).otherwise(0)
    season = F.when(month.isin(C.SPRING_SUMMER_MONTHS), "SS").otherwise("FW")
    return first.select(
        "brand", "codigo_padre", "first_sale_week", season.alias("derived_season"), year.alias("derived_season_year"),
        F.concat(season, F.substring(year.cast("string"), -2, 2)).alias("derived_season_full"))


def stage_summary(lifecycle: DataFrame) -> DataFrame:
    """Rows, share, mean units and mean discount per stage."""
    total = lifecycle.groupBy("brand").agg(F.count(F.lit(1)).alias("_total"))
    return (
        lifecycle.groupBy("brand", "lifecycle_stage")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("units").alias("avg_units"), F.avg("avg_discount_rate").alias("avg_discount"))
        .join(F.broadcast(total), "brand").withColumn("share", F.col("n") / F.col("_total")).drop("_total")
    )
