"""Markdown response and margin-optimal targets of child rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X
from rebaja.operators import lookups



def _ladder() -> Column:
    return F.array(*[F.lit(s) for s in C.MARGIN_LADDER])


def nearest_index(disc: str | Column) -> Column:
    """Place of the closest margin-ladder step; ties go to the lower step."""
    d, steps, chain = X.col(disc), C.MARGIN_LADDER, F
    for i, (lo, hi) in enumerate(zip(steps, steps[1:])):
        chain = chain.when(F.abs(F.lit(lo) - d) <= F.abs(F.lit(hi) - d), i)
    return chain.otherwise(len(steps) - 1)


def step_at(index: Column) -> Column:
    return F.get(_ladder(), index)


def empirical_lift(features: DataFrame, min_obs: int = 50) -> DataFrame:
    """Velocity multiplier per brand and ladder step, never decreasing.

    Median velocity of the rows nearest to each step over that of the zero step;
    steps with too few rows take the default, and so does a brand without a
    usable zero step. One row per (brand, step). ``features`` may be limited to
    healthy lifecycle stages by the caller.
    """
    rows = features.where("discount_rate is not null and velocity_4w is not null").select(
        "brand", step_at(nearest_index("discount_rate")).alias("step"), "velocity_4w")
    medians = lookups.exact_quantiles(rows, ["brand", "step"], "velocity_4w", {"median": 0.5})
    brand = Window.partitionBy("brand")
    stats = medians.withColumns({
        "_total": F.sum("n").over(brand),
        "_base": F.max(F.when((F.col("step") == 0.0) & (F.col("n") >= min_obs), F.col("median"))).over(brand),
    })
    usable = stats.where((F.col("_total") >= 3 * min_obs) & (F.col("_base") > 0) & (F.col("n") >= min_obs)
                         & (F.col("median") > 0))
    measured = usable.select("brand", "step", X.half_even(F.col("median") / F.col("_base"), 2).alias("_lift"))
    default = F.map_from_arrays(_ladder(), F.array(*[F.lit(x) for x in C.DEFAULT_LIFT]))
    brands = features.select("brand").distinct()
    filled = (
        brands.select("brand", F.explode(_ladder()).alias("step")).join(measured, ["brand", "step"], "left")
        .withColumn("lift", F.coalesce("_lift", default[F.col("step")]))
    )
    upto = brand.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("brand", "step", F.greatest(F.lit(1.0), F.max("lift").over(upto)).alias("lift"))


def margin_targets(features: DataFrame, costs: DataFrame, elasticity: DataFrame, lift: DataFrame,
                   skus: DataFrame | None = None) -> DataFrame:
    """Ladder step with the highest weekly gross profit, per row.

    The nine profits are plain columns of the row, so rows are neither multiplied
    nor shuffled for the choice. ``elasticity``: brand, codigo_padre, elasticity,
    confidence. ``lift``: output of ``empirical_lift``, nine rows per brand.
    ``skus`` lists the codes to price (brand, ``_code``), by default those of
    ``features``.
    """
    coded = features.withColumn("_code", F.coalesce("codigo_padre", "sku"))
    found = lookups.prefix_lookup(coded if skus is None else skus, costs.where("cost > 0"), "_code", "sku", "cost")
    reliable = elasticity.where("confidence in ('high', 'medium')").select(
        "brand", F.col("codigo_padre").alias("_code"), F.col("elasticity").alias("_e"))
    table = lift.groupBy("brand").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("step", "lift"))), lambda x: x["lift"]).alias("_lifts"))
    price, cost, vel, e, d, lifts = (F.col(c) for c in ("avg_precio_lista", "cost", "velocity_4w", "_e", "_d", "_lifts"))
    df = (
        coded.join(found, ["brand", "_code"], "left").join(reliable, ["brand", "_code"], "left")
        .join(F.broadcast(table), "brand", "left").withColumn("_d", F.coalesce("discount_rate", F.lit(0.0)))
    )
    df = X.computed(df, _ix=F.when(d < 0.025, 0).otherwise(nearest_index("_d")), _valid=X.true((cost > 0) & (price > 0) & (vel > 0)))

    def profit(i: int) -> Column:
        step = C.MARGIN_LADDER[i]
        unit = price * (1 - F.lit(step)) / C.VAT - cost
        drop = (F.lit(step) - d) / F.greatest(1 - d, F.lit(0.01))
        by_elasticity = F.greatest(vel * (1 - drop * e), F.lit(0.1))
        by_lift = F.greatest(vel * F.get(lifts, F.lit(i)) / F.greatest(F.get(lifts, F.col("_ix")), F.lit(0.1)), F.lit(0.1))
        # rounded so that equal profits tie; unprofitable markdowns are out
        value = F.round(unit * F.when(e < -0.3, by_elasticity).otherwise(by_lift), 6)
        return value if step == 0 else F.when(unit > 0, value)

    names = [f"_p{i}" for i in range(len(C.MARGIN_LADDER))]
    df = X.computed(df, **{n: profit(i) for i, n in enumerate(names)}).withColumn("_best", F.greatest(*names))
    best = F
    for n, step in zip(names, C.MARGIN_LADDER):  # the shallower step wins a tie
        best = best.when(F.col(n) == F.col("_best"), step)
    df = df.withColumn("optimal_disc_margin", F.when(F.col("_valid"), best))
    return df.withColumns({
        "should_reprice": F.when(F.col("_valid"), (F.col("optimal_disc_margin") != step_at(F.col("_ix"))).cast("double")),
        "optimal_profit": F.when(F.col("_valid"), F.col("_best")),
    }).drop("_code", "_e", "_lifts", "_d", "_ix", "_valid", "_best", "cost", *names)
