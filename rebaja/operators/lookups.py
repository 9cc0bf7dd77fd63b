"""Joins and aggregates shared by several steps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from rebaja.session import materialise


def sku_parent(products: DataFrame) -> DataFrame:
    """One parent per child SKU; SKUs without a parent are left out."""
    return (
        products.where(F.col("codigo_padre").isNotNull())
        .groupBy("brand", F.col("material").alias("sku")).agg(F.min("codigo_padre").alias("codigo_padre"))
    )


def product_attributes(products: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of attributes per child SKU, in a fixed order of ties."""
    return (
        products.groupBy("brand", F.col("material").alias("sku"))
        .agg(F.min(F.struct(*columns)).alias("a")).select("brand", "sku", "a.*")
    )


def parent_catalogue(products: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First non-NULL attribute per parent by material code, and its size count."""
    def first(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("material"))).alias(c)

    return (
        products.where(F.col("codigo_padre").isNotNull()).groupBy("brand", "codigo_padre")
        .agg(*[first(c) for c in columns], F.countDistinct("material").alias("total_sizes_catalog"))
    )


def prefix_lookup(skus: DataFrame, keys: DataFrame, sku: str, key: str, value: str,
                  exact_first_per_brand: bool = False) -> DataFrame:
    """Value of the longest key that is a prefix of each SKU: (brand, sku, value).

    Runs on distinct SKUs and turns the prefix test into an equi-join: a SKU is
    exploded into its prefixes, so no nested loop over all keys is planned.
    ``exact_first_per_brand`` uses whole-code matches only, unless the brand has
    none at all.
    """
    codes = skus.select("brand", F.col(sku).alias("_sku")).where("_sku is not null").distinct()
    entries = keys.groupBy("brand", F.col(key).alias("_prefix")).agg(F.max(value).alias("_value"))
    prefixes = codes.select(
        "brand", "_sku",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("_sku")),
                              lambda n: F.substring(F.col("_sku"), F.lit(1), n))).alias("_prefix"))
    hits = (
        prefixes.join(entries, ["brand", "_prefix"]).groupBy("brand", "_sku")
        .agg(F.max_by("_value", F.length("_prefix")).alias("_longest"),
             F.max(F.when(F.col("_prefix") == F.col("_sku"), F.col("_value"))).alias("_exact"))
    )
    if exact_first_per_brand:
        any_exact = hits.groupBy("brand").agg(F.count("_exact").alias("_n"))
        hits = hits.join(any_exact, "brand").select(
            "brand", "_sku", F.when(F.col("_n") > 0, F.col("_exact")).otherwise(F.col("_longest")).alias("_longest"))
    return hits.where("_longest is not null").select("brand", F.col("_sku").alias(sku), F.col("_longest").alias(value))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    cells: int = 64) -> DataFrame:
    """Exact interpolated quantiles for few groups of unbounded size.

    ``percentile`` keeps every distinct value of a group in one task. Here equal
    values are counted first, approximate splitters cut each group into cells
    of about equal size, cell totals locate the wanted ranks, and only the cells
    that hold a rank are sorted: a group is spread over ``cells`` tasks.
    Counts, splitters and ranks are written once, as each has several readers;
    splitters and ranks, a few rows per group, are then broadcast by their size
    on disk, so counts are not shuffled by a group that holds most of them.
    Returns keys, ``n`` and one column per probability.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialise(counts, "quantile-counts")
    cuts = [i / cells for i in range(1, cells)]
    splitters = counts.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(c) for c in cuts]), F.lit(1000)).alias("_cuts"))
    celled = counts.join(materialise(splitters, "quantile-splitters"), keys).withColumn(
        "_cell", F.size(F.filter("_cuts", lambda s: s < F.col("_v")))).drop("_cuts")
    totals = celled.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cell_n"))
    over = Window.partitionBy(*keys)
    ranked = (
        totals.withColumn("_before", F.sum("_cell_n").over(over.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_before", F.coalesce("_before", F.lit(0)))
        .withColumn("n", F.sum("_cell_n").over(over))
    )
    wanted = F.array(*[F.lit(p) for p in probs.values()])
    ranks = (
        ranked.select(*keys, "_cell", "_before", "_cell_n", "n", F.explode(wanted).alias("_p"))
        .withColumn("_at", F.col("_p") * (F.col("n") - 1))
        .select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_cell_n")))
    )
    ranks = materialise(ranks, "quantile-ranks")
    in_cell = celled.join(ranks.select(*keys, "_cell").distinct(), [*keys, "_cell"], "left_semi").withColumn(
        "_upto", F.sum("_n").over(Window.partitionBy(*keys, "_cell").orderBy("_v")
                                  .rowsBetween(Window.unboundedPreceding, 0)))
    found = ranks.join(in_cell, [*keys, "_cell"]).where(
        (F.col("_rank") - F.col("_before") < F.col("_upto"))
        & (F.col("_rank") - F.col("_before") >= F.col("_upto") - F.col("_n")))
    low, high = F.min("_v"), F.max("_v")
    per_rank = found.groupBy(*keys, "n", "_p", "_at").agg(
        (low + (high - low) * (F.col("_at") - F.floor("_at"))).alias("_q"))
    return per_rank.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("_p") == p, F.col("_q"))).alias(name) for name, p in probs.items()])


def top_per(df: DataFrame, by: str, order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows of each ``by``; None: all. The rank limit is applied before the shuffle as well."""
    if n is None:
        return df
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
