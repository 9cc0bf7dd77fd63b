"""Price elasticity: log-log least squares per parent and per category."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from rebaja.functions import columns as X
from rebaja.operators import lookups, weekly as W

TIERS = ["md_tier_15", "md_tier_20", "md_tier_30", "md_tier_40"]


def normal_price_flag(panel: DataFrame, reference: DataFrame | None) -> DataFrame:
    """Price at or above 95 % of the reference price; true where unknown."""
    if reference is None:
        return panel.withColumn("is_normal_price", F.lit(True))
    known = reference.groupBy("brand", F.col("sku").alias("codigo_padre")).agg(
        F.max("precio_normal").alias("precio_normal"))
    return panel.join(known, ["brand", "codigo_padre"], "left").withColumn(
        "is_normal_price", F.when(F.col("precio_normal") > 0, F.col("avg_price") >= F.col("precio_normal") * 0.95)
        .otherwise(True))


def markdown_tiers(panel: DataFrame) -> DataFrame:
    d = F.col("discount_depth")
    bounds = [0.07, 0.175, 0.25, 0.35]
    out = {}
    for i, name in enumerate(TIERS):
        inside = d >= bounds[i]
        if i + 1 < len(bounds):
            inside = inside & (d < bounds[i + 1])
        out[name] = X.true(inside).cast("int")
    return panel.withColumns(out)


def elasticity_panel(txn: DataFrame, products: DataFrame, reference: DataFrame | None = None, folios: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Weekly units of all sales with the retail-only price per unit (``folios``, ``totals``: see ``weekly.weekly_sales``).

    ``precio_final`` is read as a line total here, so the price of a line is
    ``precio_final / cantidad``.
    """
    weekly = (W.line_totals(txn) if totals is None else totals).where("units_sold is not null").select(
        *W.WEEKLY, F.col("units_sold").alias("units"), F.try_divide("per_unit_clean", "n_final_clean").alias("avg_price"),
        F.try_divide("list_clean", "n_list_clean").alias("avg_list_price"))
    weekly = W.with_folio_counts(weekly, W.folio_counts(txn) if folios is None else folios).select(*W.WEEKLY, "units", "txn_count", "avg_price", "avg_list_price")
    attributes = lookups.product_attributes(products, ["codigo_padre", "primera_jerarquia", "segunda_jerarquia"])
    sold = txn.where("cantidad > 0").select("brand", X.week_start("fecha").alias("week")) if totals is None else totals.where("units_sold is not null")
    origin = sold.groupBy("brand").agg(F.min("week").alias("_origin"))
    panel = (
        weekly.where("units > 0 and avg_price > 0").join(attributes, ["brand", "sku"], "left")
        .join(F.broadcast(origin), "brand")
        .withColumns({
            "month": F.month("week"), "week_num": F.datediff("week", "_origin") / 7,
            "ln_units": F.log("units"), "ln_price": F.log("avg_price"),
            "discount_depth": F.when(F.col("avg_list_price") > 0, 1 - F.col("avg_price") / F.col("avg_list_price"))
            .otherwise(0.0),
        }).drop("_origin")
    )
    return markdown_tiers(normal_price_flag(panel, reference))


def confidence_tier(r2: str = "r2", n: str = "n_observations", cv: str = "price_cv") -> Column:
    r, count = F.col(r2), F.col(n)
    return (F.when((r > 0.3) & (count > 30) & (F.col(cv) > 0.1), "high")
            .when((r > 0.15) & (count > 15), "medium").otherwise("low"))


# --------------------------------------------------------------- regression

#: Added to the diagonal of the scaled normal equations, and how often its effect is taken back.
RIDGE, REFINEMENTS = 1e-6, 8


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _times(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda row: _dot(row, vector))


def _inverse(matrix: Column, size: int) -> Column:
    """Inverse of a positive definite array of rows, by elimination beside the identity."""
    def cell(rows: Column, i: Column, j: Column) -> Column:
        return F.get(F.get(rows, i), j)

    def eliminate(rows: Column, k: Column) -> Column:
        def reduced(row: Column, i: Column) -> Column:
            factor = F.when(i == k, 1 - 1 / cell(rows, k, k)).otherwise(F.get(row, k) / cell(rows, k, k))
            return _bind(factor, lambda f: F.zip_with(row, F.get(rows, k), lambda x, pivot: x - f * pivot))
        return F.transform(rows, reduced)

    places = F.sequence(F.lit(0), F.lit(size - 1))
    beside = F.transform(matrix, lambda row, i: F.concat(row, F.transform(places, lambda j: (i == j).cast("double"))))
    return F.transform(F.aggregate(places, beside, eliminate), lambda row: F.slice(row, size + 1, size))


def _least_squares(fits: DataFrame, size: int) -> DataFrame:
    """Adds ``elasticity`` and ``_ssr`` to rows with ``_moments``, the upper triangle of the sums of products by rows.

    Variables are scaled to unit sums of squares; one without variation gets
    the coefficient 0. The normal equations are solved with a small ridge whose
    effect is then taken back step by step, so dependent controls need no case
    of their own: the steps lead to the least-squares coefficients of smallest
    norm. Arrays of fixed size all through, on the JVM.
    """
    n = size - 1
    places = F.sequence(F.lit(1), F.lit(n))

    def moment(i: Column | int, j: Column | int) -> Column:
        low, high = (F.least(F.lit(i), F.lit(j)), F.greatest(F.lit(i), F.lit(j)))
        return F.get("_moments", (low * size - low * (low - 1) / 2 + high - low).cast("int"))

    def inverse_root(i: Column) -> Column:
        return F.when(moment(i, i) > 1e-9, 1 / F.sqrt(moment(i, i))).otherwise(0.0)

    df = X.computed(fits, _scale=F.transform(places, inverse_root))
    df = X.computed(
        df, _xy=F.transform(places, lambda i: moment(0, i) * F.get("_scale", i - 1)),
        _xx=F.transform(places, lambda i: F.transform(places, lambda j: moment(i, j) * F.get("_scale", i - 1) * F.get("_scale", j - 1))))
    df = X.computed(df, _inv=_inverse(F.transform("_xx", lambda row, i: F.transform(row, lambda v, j: v + F.when(i == j, RIDGE).otherwise(0.0))), n))

    def refine(beta: Column, _) -> Column:
        left = F.zip_with("_xy", _times(F.col("_xx"), beta), lambda want, have: want - have)
        return _bind(left, lambda rest: F.zip_with(beta, _times(F.col("_inv"), rest), lambda x, y: x + y))

    start = F.array_repeat(F.lit(0.0), n)
    df = X.computed(df, _beta=F.aggregate(F.sequence(F.lit(0), F.lit(REFINEMENTS)), start, refine))
    return df.withColumns({"elasticity": F.get("_beta", F.lit(0)) * F.get("_scale", F.lit(0)),
                           "_ssr": F.get("_moments", F.lit(0)) - _dot(F.col("_xy"), F.col("_beta"))}).drop("_scale", "_xy", "_xx", "_inv", "_beta")


def grouped_ols(panel: DataFrame, groups: Sequence[str], controls: Sequence[Column], min_obs: int = 0, min_cv: float | None = None) -> DataFrame:
    """ln units on ln price, the controls and one intercept per store, by group.

    Groups below ``min_obs`` rows or ``min_cv`` of price variation are dropped
    before they are solved.

    Store intercepts are absorbed instead of being fitted: within each store the
    moments are taken around the store's means, which gives the same price
    coefficient and residual. Two levels of plain sums (store, then group),
    partial sums first, so a hot group is never gathered; what is left per group
    is a matrix of fixed size, solved in built-in array functions.
    """
    names = ["_y", "_x"] + [f"_c{i}" for i in range(len(controls))]
    values = [F.col("ln_units"), F.col("ln_price") - F.lit(10.0), *controls]
    rows = panel.where("ln_price is not null and ln_units is not null").select(
        *groups, "centro", "avg_price", "units",
        *[v.cast("double").alias(n) for n, v in zip(names, values)])
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    per_store = rows.groupBy(*groups, "centro").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(f"_s{i}") for i, n in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_p{i}_{j}") for i, j in pairs],
        F.sum("avg_price").alias("_price"), F.sum(F.col("avg_price") * F.col("avg_price")).alias("_price2"),
        F.sum("units").alias("_units"))
    within = [F.sum(F.col(f"_p{i}_{j}") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("_n")) for i, j in pairs]
    n = F.sum("_n")
    fits = per_store.groupBy(*groups).agg(
        n.alias("n_observations"), (F.sum("_price") / n).alias("avg_price"), (F.sum("_units") / n).alias("avg_units_week"),
        F.sqrt(F.greatest(F.lit(0.0), (F.sum("_price2") - F.sum("_price") * F.sum("_price") / n) / F.nullif(n - 1, F.lit(0)))).alias("_std"),
        (F.sum("_p0_0") - F.sum("_s0") * F.sum("_s0") / n).alias("_sst"), F.array(*within).alias("_moments"))
    fits = fits.withColumn("price_cv", F.col("_std") / F.col("avg_price")).where(F.col("n_observations") >= min_obs)
    if min_cv is not None:
        fits = fits.where(F.col("price_cv") >= min_cv)
    return (
        _least_squares(fits, len(names))
        .withColumn("r2", 1 - F.col("_ssr") / F.greatest("_sst", F.lit(1e-10)))
        .drop("_ssr", "_moments", "_sst", "_std")
    )


def _controls(tiers: bool, binary: bool) -> list[Column]:
    out = [(F.col("month") == m).cast("double") for m in range(2, 13)] + [F.col("week_num") / F.lit(100.0)]
    if tiers:
        out += [F.col(t) for t in TIERS]
    if binary:
        out.append((~F.col("is_normal_price")).cast("double"))
    return out


def price_variation_gate(panel: DataFrame, min_cv: float = 0.05, min_obs: int = 10) -> DataFrame:
    """Parents with enough rows and price variation: (brand, codigo_padre, n, price_cv)."""
    return (
        panel.where("codigo_padre is not null").groupBy("brand", "codigo_padre")
        .agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("avg_price") / F.avg("avg_price")).alias("price_cv"))
        .where((F.col("n") >= min_obs) & (F.col("price_cv") >= min_cv))
    )


def _with_hierarchy(fits: DataFrame, panel: DataFrame) -> DataFrame:
    tree = panel.groupBy("brand", "codigo_padre").agg(
        F.min("primera_jerarquia").alias("primera_jerarquia"), F.min("segunda_jerarquia").alias("segunda_jerarquia"))
    return fits.join(tree, ["brand", "codigo_padre"])


def elasticity_by_parent(panel: DataFrame, min_cv: float = 0.05, min_obs: int = 10,
                         tiers: bool = False, binary: bool = False) -> DataFrame:
    """Elasticity per parent with month, store and trend controls."""
    fits = grouped_ols(panel.where("codigo_padre is not null"), ["brand", "codigo_padre"], _controls(tiers, binary), min_obs, min_cv)
    return _with_hierarchy(fits.withColumn("confidence", confidence_tier()), panel)


def elasticity_by_category(panel: DataFrame, min_obs: int = 30) -> DataFrame:
    """Elasticity per (category, subcategory), the fall-back of thin parents."""
    keys = ["brand", "primera_jerarquia", "segunda_jerarquia"]
    known = panel.where("primera_jerarquia is not null and segunda_jerarquia is not null")
    return grouped_ols(known, keys, _controls(False, False), min_obs).select(
        *keys, "elasticity", "r2", "n_observations", "price_cv")


def elasticity_fast(panel: DataFrame, min_cv: float = 0.05, min_obs: int = 10) -> DataFrame:
    """Within-store slope of ln units on ln price, with no other control.

    Built-in aggregates only: deviations from the store means come from sums per
    store, so no row is joined to its mean.
    """
    rows = panel.where("codigo_padre is not null")
    x, y = F.col("ln_price"), F.col("ln_units")
    store = rows.groupBy("brand", "codigo_padre", "centro").agg(
        F.count(F.lit(1)).alias("_n"), F.covar_pop(x, y).alias("_xy"), F.var_pop(x).alias("_xx"),
        F.var_pop(y).alias("_yy"))
    spread = rows.groupBy("brand", "codigo_padre").agg(
        F.count(F.lit(1)).alias("n_observations"), (F.stddev_samp("avg_price") / F.avg("avg_price")).alias("price_cv"),
        F.avg("avg_price").alias("avg_price"), F.avg("units").alias("avg_units_week"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.min("primera_jerarquia").alias("primera_jerarquia"), F.min("segunda_jerarquia").alias("segunda_jerarquia"))
    xy, xx = F.sum(F.col("_n") * F.col("_xy")), F.sum(F.col("_n") * F.col("_xx"))
    slopes = store.groupBy("brand", "codigo_padre").agg(
        xy.alias("_sxy"), xx.alias("_sxx"), F.sum(F.col("_n") * F.col("_yy")).alias("_syy")).where("_sxx > 1e-9")
    return (
        spread.where((F.col("n_observations") >= min_obs) & (F.col("price_cv") >= min_cv))
        .join(slopes, ["brand", "codigo_padre"])
        .withColumns({
            "elasticity": F.round(F.col("_sxy") / F.col("_sxx"), 6),
            "r2": F.round(1 - (F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"))
                          / F.greatest("_sst", F.lit(1e-10)), 6),
        }).withColumn("confidence", confidence_tier()).drop("_sxy", "_sxx", "_syy", "_sst")
    )


# ------------------------------------------------------------------ readers

def attach_elasticity(features: DataFrame, by_parent: DataFrame, by_category: DataFrame) -> DataFrame:
    """Reliable parent elasticity, else the category's; revenue-optimal discount."""
    own = by_parent.where("confidence in ('high', 'medium')").select(
        "brand", "codigo_padre", F.col("elasticity").alias("_own"))
    group = by_category.select("brand", "primera_jerarquia", "segunda_jerarquia", F.col("elasticity").alias("_group"))
    e = F.col("price_elasticity")
    return (
        features.join(own, ["brand", "codigo_padre"], "left")
        .join(group, ["brand", "primera_jerarquia", "segunda_jerarquia"], "left")
        .withColumn("price_elasticity", F.coalesce("_own", "_group"))
        .withColumn("optimal_discount_rev", F.when(e < -0.5, 1 / (1 + F.abs(e))))
        .drop("_own", "_group")
    )


def elasticity_summary(by_parent: DataFrame) -> DataFrame:
    """Counts and median per brand, subcategory and vendor; groups under 3 are left out.

    One pass with grouping sets: (brand), (brand, subcategory), (brand, vendor).
    """
    rows = by_parent.where("elasticity is not null").select(
        "brand", F.col("segunda_jerarquia").alias("subcategory"), X.vendor_brand("codigo_padre", "brand").alias("vendor"),
        "elasticity", "confidence")
    level = F.when(F.grouping("subcategory") == 0, "subcategory").when(F.grouping("vendor") == 0, "vendor").otherwise("brand")
    e = F.col("elasticity")
    return (
        rows.groupingSets([["brand"], ["brand", "subcategory"], ["brand", "vendor"]], "brand", "subcategory", "vendor")
        .agg(level.alias("level"), F.count(F.lit(1)).alias("sku_count"), F.median("elasticity").alias("median_elasticity"),
             F.count_if(e < -1).alias("elastic_count"), F.count_if(e > -0.5).alias("inelastic_count"),
             F.count_if(F.col("confidence") == "high").alias("high_confidence"))
        .where((F.col("level") == "brand") | (F.col("sku_count") >= 3))
        .select("brand", "level", F.coalesce("subcategory", "vendor", F.lit("all")).alias("name"), "sku_count",
                F.round("median_elasticity", 3).alias("median_elasticity"), "elastic_count", "inelastic_count",
                "high_confidence")
    )


def elasticity_bands(by_parent: DataFrame) -> DataFrame:
    """How many parents fall in each elasticity band, with shares per brand."""
    e = F.col("elasticity")
    bounds = [-10.0, -3.0, -2.0, -1.5, -1.0, -0.5, 0.0, 10.0]
    names = ["very_elastic", "elastic", "moderately_elastic", "unit_elastic", "inelastic", "very_inelastic", "positive"]
    band = F.lit(None).cast("string")
    for i, name in enumerate(names):
        band = F.when((e >= bounds[i]) & (e < bounds[i + 1]), name).otherwise(band)
    total = by_parent.groupBy("brand").agg(F.count(F.lit(1)).alias("_total"))
    counts = by_parent.withColumn("band", band).where("band is not null").groupBy("brand", "band").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total), "brand").select(
        "brand", "band", "n", (F.col("n") / F.col("_total")).alias("share"))
