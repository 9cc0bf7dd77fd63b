"""Size availability of footwear parents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X
from rebaja.operators import lookups, weekly

SERIES = ["brand", "codigo_padre", "centro"]
INFO = ["codigo_padre", "talla", "primera_jerarquia"]


def _footwear(products: DataFrame) -> DataFrame:
    return (
        products.groupBy("brand", F.col("material").alias("sku")).agg(F.min(F.struct(*INFO)).alias("_i"))
        .select("brand", "sku", "_i.*")
        .where((F.col("primera_jerarquia") == C.FOOTWEAR) & F.col("codigo_padre").isNotNull())
        .drop("primera_jerarquia")
    )


def fragmentation(sizes: Column) -> Column:
    """Population deviation over mean of the gaps between sorted sizes; 0 under two sizes.

    ``sizes`` is an array of numbers, at most as long as a parent has sizes.
    """
    ordered = F.array_sort(sizes)
    n = F.size(ordered)
    gaps = F.transform(F.slice(ordered, 2, F.greatest(n - 1, F.lit(0))),
                       lambda v, i: v - F.get(ordered, i))
    count = F.greatest(n - 1, F.lit(1))
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g) / count
    var = F.aggregate(F.transform(gaps, lambda g: (g - mean) * (g - mean)), F.lit(0.0), lambda a, g: a + g) / count
    return F.when((n >= 2) & (mean > 0), F.sqrt(var) / F.greatest(mean, F.lit(0.01))).otherwise(0.0)


def _track(active: DataFrame, ever: DataFrame, source: str, peak_rows: int) -> DataFrame:
    """Counts and depletion from one row per active (parent, store, week, size)."""
    core = F.col("talla").isin(C.CORE_SIZES)
    by_week = active.groupBy(*SERIES, "week").agg(
        F.countDistinct("talla").alias("active_sizes_4w"),
        F.count_if(core).alias("core_sizes_active"),
        F.collect_list(X.size_number("talla")).alias("_numbers"))
    by_store = ever.groupBy(*SERIES).agg(
        F.countDistinct("talla").alias("total_sizes_ever"),
        F.countDistinct(F.when(core, F.col("talla"))).alias("core_sizes_total"))
    peak = F.max("active_sizes_4w").over(Window.partitionBy(*SERIES).orderBy("week").rowsBetween(-(peak_rows - 1), 0))
    now, total = F.col("active_sizes_4w"), F.col("total_sizes_ever")
    return (
        by_week.join(by_store, SERIES, "left")
        .withColumn("peak_sizes", peak)
        .withColumns({
            "lost_sizes": total - now, "size_completeness": now / F.greatest(total, F.lit(1)),
            "core_sizes_lost": F.col("core_sizes_total") - F.col("core_sizes_active"),
            "core_completeness": X.ratio("core_sizes_active", "core_sizes_total", 0.0),
            "attrition_rate": 1 - now / F.greatest("peak_sizes", F.lit(1)),
            "fragmentation_index": fragmentation(F.col("_numbers")), "source": F.lit(source),
        }).drop("_numbers")
    )


def size_availability_sales(txn: DataFrame, products: DataFrame, only_sold_weeks: bool = False,
                            peak_rows: int = 12) -> DataFrame:
    """A size counts as available from the week of a sale through the third week after.

    ``only_sold_weeks`` keeps weeks with a sale; with ``peak_rows=13`` that is
    the older form of the table.
    """
    sold = (
        txn.where("cantidad > 0").join(_footwear(products), ["brand", "sku"])
        .select(*SERIES, "talla", X.week_start("fecha").alias("week")).distinct()
    )
    later = F.explode(F.array(*[F.lit(7 * i) for i in range(4)]))
    active = (
        sold.select(*SERIES, "talla", "week", later.alias("_days"))
        .select(*SERIES, "talla", F.date_add("week", F.col("_days")).alias("week")).distinct()
    )
    if only_sold_weeks:
        active = active.join(sold.select(*SERIES, "week").distinct(), [*SERIES, "week"], "left_semi")
    return _track(active, sold, "sales_proxy", peak_rows)


def size_availability_stock(stock: DataFrame, products: DataFrame) -> DataFrame:
    """A size counts as available when its end-of-week stock is positive."""
    last = F.max_by("stock_on_hand_units", F.when(F.col("stock_on_hand_units").isNotNull(), F.struct("fecha", "sku")))
    held = (
        stock.withColumns({"centro": X.store_code("store_id"), "week": X.week_start("fecha")})
        .join(_footwear(products), ["brand", "sku"])
        .groupBy(*SERIES, "week", "talla").agg(last.alias("_hand")).where("_hand > 0").drop("_hand")
    )
    return _track(held, held, "stock", 12)


def _alert_tests(attrition: float, core_lost: int) -> list[tuple[Column, str]]:
    return [
        (F.col("attrition_rate") > attrition, "high_attrition;"),
        (F.col("core_sizes_lost") >= core_lost, "core_sizes_lost;"),
        ((F.col("core_completeness") < 0.5) & (F.col("core_sizes_total") > 0), "low_core_completeness;"),
    ]


def size_alerts(tracking: DataFrame, attrition: float = 0.3, core_lost: int = 2) -> DataFrame:
    """Depleted size runs of the brand's latest week, with the reasons joined."""
    tests = _alert_tests(attrition, core_lost)
    now = tracking.join(F.broadcast(weekly.latest_week(tracking)), "brand").where("week = _latest").drop("_latest")
    return now.where(tests[0][0] | tests[1][0] | tests[2][0]).withColumn(
        "alert_reasons", F.concat(*[F.when(test, F.lit(name)).otherwise(F.lit("")) for test, name in tests]))


def size_alert_view(alerts: DataFrame, min_attrition: float = 0.3, brand: str | None = None, limit: int | None = 30) -> DataFrame:
    """The ``limit`` most depleted size runs of each brand; None: all."""
    df = alerts if brand is None else alerts.where(F.col("brand") == brand)
    return (
        lookups.top_per(df.where(F.col("attrition_rate") >= min_attrition), "brand", [F.desc("attrition_rate"), "codigo_padre", "centro"], limit)
        .select("brand", F.col("codigo_padre").alias("parent_sku"), F.col("centro").alias("store"),
                F.col("active_sizes_4w").alias("active_sizes"), F.col("total_sizes_ever").alias("total_sizes"),
                X.half_even("attrition_rate", 3).alias("attrition_rate"),
                X.half_even("core_completeness", 3).alias("core_completeness"), "alert_reasons")
    )


def size_markdown_relation(tracking: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Rows of both tables with the mean discount of rows t-2..t+1 of the joined series."""
    stages = lifecycle.select(*SERIES, "week", "avg_discount_rate", "lifecycle_stage")
    run = Window.partitionBy(*SERIES).orderBy("week")
    return (
        tracking.join(stages, [*SERIES, "week"])
        .withColumn("_ahead", F.lead("avg_discount_rate").over(run))
        .withColumn("future_disc_4w", F.avg("_ahead").over(run.rowsBetween(-3, 0))).drop("_ahead")
    )


def size_markdown_buckets(relation: DataFrame) -> DataFrame:
    """Mean future discount by attrition band and by core-completeness band."""
    a, k = F.col("attrition_rate"), F.col("core_completeness")
    attrition = (F.when((a > 0) & (a <= 0.1), "0-10%").when((a > 0.1) & (a <= 0.2), "10-20%")
                 .when((a > 0.2) & (a <= 0.3), "20-30%").when((a > 0.3) & (a <= 0.5), "30-50%")
                 .when((a > 0.5) & (a <= 1.0), "50%+"))
    core = (F.when((k > 0) & (k <= 0.25), "<25%").when((k > 0.25) & (k <= 0.5), "25-50%")
            .when((k > 0.5) & (k <= 0.75), "50-75%").when((k > 0.75) & (k <= 1.01), "75-100%"))
    kinds = F.explode(F.array(F.struct(F.lit("attrition").alias("kind"), attrition.alias("bucket")),
                              F.struct(F.lit("core").alias("kind"), core.alias("bucket"))))
    return (
        relation.select("brand", "future_disc_4w", kinds.alias("_b")).select("brand", "future_disc_4w", "_b.*")
        .where("bucket is not null").groupBy("brand", "kind", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("future_disc_4w").alias("avg_future_disc"))
    )


def size_health_histogram(tracking: DataFrame) -> DataFrame:
    c = F.col("size_completeness")
    band = (F.when(c < 0.25, "critical").when(c < 0.5, "poor").when(c < 0.75, "fair").when(c < 1.0, "good")
            .when(c < 1.01, "full"))
    total = tracking.groupBy("brand").agg(F.count(F.lit(1)).alias("_total"))
    return (
        tracking.withColumn("band", band).where("band is not null").groupBy("brand", "band").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(total), "brand").select("brand", "band", "n", (F.col("n") / F.col("_total")).alias("share"))
    )
