"""Competitor, season and category features added to the child table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja.functions import columns as X
from rebaja.operators import elasticity as E, lifecycle as L, lookups
from rebaja.session import materialise

PARENT_WEEK = ["brand", "codigo_padre", "centro", "week"]
SIZE_COLUMNS = ["attrition_rate", "core_completeness", "fragmentation_index", "active_sizes_4w", "total_sizes_ever"]


def competitor_by_parent(prices: DataFrame) -> DataFrame:
    """Price range, breadth and discounts of the competition per parent."""
    return (
        prices.where("comp_price > 0").groupBy("brand", "codigo_padre")
        .agg(X.half_even(F.min("comp_price")).cast("long").alias("comp_min_price"),
             X.half_even(F.avg("comp_price")).cast("long").alias("comp_avg_price"),
             X.half_even(F.max("comp_price")).cast("long").alias("comp_max_price"),
             F.countDistinct("competitor").alias("comp_count"),
             F.max((F.col("comp_discount") > 0.05).cast("int")).alias("comp_any_discount"),
             F.max("comp_discount").alias("comp_max_discount"),
             F.count_if(F.col("comp_in_stock")).alias("comp_in_stock_count"))
    )


def competitor_features(features: DataFrame, prices: DataFrame) -> DataFrame:
    """Our price against the competition's range."""
    ours, low, mean = F.col("avg_precio_final"), F.col("comp_min_price"), F.col("comp_avg_price")
    both = (ours > 0) & (mean > 0)
    return (
        features.join(competitor_by_parent(prices), ["brand", "codigo_padre"], "left")
        .fillna(0, ["comp_count", "comp_any_discount", "comp_in_stock_count"]).fillna(0.0, ["comp_max_discount"])
        .withColumns({
            "comp_price_index": F.when(both, ours / mean),
            "comp_price_gap_pct": F.when(both, (ours - low) / ours * 100),
            "comp_undercut": F.when(both, (low < ours).cast("int")).otherwise(0),
            "comp_discount_pressure": F.when(mean > 0, F.col("comp_max_discount") - F.col("discount_rate")).otherwise(0.0),
        })
    )


def velocity_terciles(features: DataFrame) -> DataFrame:
    """Exact 33 % and 66 % velocity quantiles per brand (NULL counts as zero)."""
    rows = features.select("brand", F.coalesce("velocity_4w", F.lit(0.0)).alias("_v"))
    return lookups.exact_quantiles(rows, ["brand"], "_v", {"_q33": 0.33, "_q66": 0.66}).drop("n")


def interaction_labels() -> dict[str, Column]:
    cat = F.coalesce("primera_jerarquia", F.lit("Unknown"))
    vel, age = F.coalesce("velocity_4w", F.lit(0.0)), F.coalesce("product_age_weeks", F.lit(0.0))
    speed = F.when(vel <= F.col("_q33"), "low").when(vel <= F.col("_q66"), "med").otherwise("high")
    period = F.when(age < 8, "new").when(age <= 26, "mid").otherwise("old")
    parts = {
        "cat_x_lifecycle": F.coalesce("lifecycle_stage_code", F.lit(-1)).cast("int").cast("string"),
        "cat_x_season": F.coalesce("is_fall_winter", F.lit(0)).cast("int").cast("string"),
        "cat_x_velocity": speed, "cat_x_age": period,
    }
    return {name: F.concat(cat, F.lit("_"), part) for name, part in parts.items()}


def category_interactions(features: DataFrame) -> DataFrame:
    """Category crossed with stage, season, velocity tercile and age, as codes.

    A code is the alphabetical place of the label among those of the brand. The
    labels are few (categories times six at most), so their map is broadcast.
    The terciles, one row per brand, are written once for both readers.
    """
    labels = interaction_labels()
    terciles = materialise(velocity_terciles(features), "velocity_terciles")
    df = features.join(F.broadcast(terciles), "brand", "left").withColumns(
        {f"_{n}": c for n, c in labels.items()})
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(f"_{n}").alias("label")) for n in labels]))
    seen = df.select("brand", pairs.alias("p")).select("brand", "p.*").distinct()
    coded = seen.withColumn("code", F.dense_rank().over(Window.partitionBy("brand", "kind").orderBy("label")) - 1)
    table = coded.groupBy("brand").agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat_ws("|", "kind", "label"), F.col("code")))).alias("_codes"))
    out = df.join(F.broadcast(table), "brand", "left").withColumns(
        {n: F.col("_codes")[F.concat(F.lit(f"{n}|"), F.col(f"_{n}"))] for n in labels})
    return out.drop("_codes", "_q33", "_q66", *[f"_{n}" for n in labels])


def season_flag(features: DataFrame, seasons: DataFrame) -> DataFrame:
    winter = seasons.select("brand", "codigo_padre", (F.col("derived_season") == "FW").cast("int").alias("is_fall_winter"))
    return features.join(winter, ["brand", "codigo_padre"], "left").fillna(0, ["is_fall_winter"])


def enhance_features(features: DataFrame, by_parent: DataFrame, by_category: DataFrame, stages: DataFrame,
                     tracking: DataFrame, competitors: DataFrame, seasons: DataFrame) -> DataFrame:
    """Child features with elasticity, lifecycle, sizes, competition and season.

    The joins on (brand, codigo_padre, centro, week) follow each other so that
    one exchange of the features serves both.
    """
    life = stages.select(*PARENT_WEEK, L.stage_code().alias("lifecycle_stage_code"), "lifecycle_position")
    df = features.join(life, PARENT_WEEK, "left").join(tracking.select(*PARENT_WEEK, *SIZE_COLUMNS), PARENT_WEEK, "left")
    df = E.attach_elasticity(df, by_parent, by_category).drop("optimal_discount_rev")
    return season_flag(competitor_features(df, competitors), seasons)
