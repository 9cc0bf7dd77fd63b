"""Summaries of actions, decisions and data quality."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X
from rebaja.operators import decisions as D, weekly


def _with_status(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    dec = decisions.select(*D.KEYS, F.col("status").alias("_status"))
    return actions.withColumn("key", D.decision_key(actions)).join(dec, D.KEYS, "left")


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def brand_overview(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    decided = F.count("_status")
    up = F.count_if(F.col("action_type") == "increase")
    return _with_status(actions, decisions).groupBy("brand", "week").agg(
        n.alias("total_actions"), decided.alias("decided"),
        F.count_if(F.col("_status").isin(C.IMPLEMENTED_STATUSES)).alias("approved"), (n - decided).alias("pending"),
        up.alias("increases"), (n - up).alias("decreases"), _sum("rev_delta").alias("rev_delta"), _sum("margin_delta").alias("margin_delta"),
        F.count_if((F.col("margin_pct") < 20) & (F.col("margin_pct") != 0)).alias("thin_margin_count"))


def impact_breakdown(actions: DataFrame, top: int = 10) -> DataFrame:
    """Largest effects by store, subcategory and vendor: one pass with grouping sets."""
    dims = ["store_name", "subcategory", "vendor_brand"]
    sets = actions.select("brand", *[F.coalesce(d, F.lit("Other")).alias(d) for d in dims], "rev_delta", "margin_delta")
    grouped = sets.groupingSets([["brand", d] for d in dims], "brand", *dims).agg(
        reduce(lambda a, d: F.when(F.grouping(d) == 0, d).otherwise(a), dims, F.lit(None).cast("string")).alias("dimension"),
        _sum("rev_delta").alias("rev_delta"), _sum("margin_delta").alias("margin_delta"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("brand", "dimension").orderBy(F.desc(F.abs("rev_delta")), "name"))
    return (grouped.select("brand", "dimension", F.coalesce(*dims).alias("name"), "rev_delta", "margin_delta", "n")
            .withColumn("rank", rank).where(F.col("rank") <= top))


def action_distributions(actions: DataFrame) -> DataFrame:
    """Counts by urgency, action type and confidence tier."""
    dims = ["urgency", "action_type", "confidence_tier"]
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]))
    return (actions.select("brand", pairs.alias("p")).select("brand", "p.*").groupBy("brand", "dimension", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def weekly_report(actions: DataFrame, competitors: DataFrame, alerts: DataFrame, top: int = 3) -> DataFrame:
    """One row per brand: counts, sums, three best actions, competitor and alert counts."""
    base = actions.groupBy("brand", "week").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("urgency") == "HIGH").alias("high"),
        F.count_if(F.col("urgency") == "MEDIUM").alias("medium"), F.count_if(F.col("action_type") == "increase").alias("increases"),
        F.count_if(F.col("action_type") == "decrease").alias("decreases"), _sum("rev_delta").alias("rev_delta"),
        _sum("margin_delta").alias("margin_delta"))
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("rev_delta"), "parent_sku", "store"))
    best = actions.withColumn("_rk", rank).where(F.col("_rk") <= top).groupBy("brand").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rk", "parent_sku", "rev_delta"))),
        lambda s: F.concat_ws(":", s["parent_sku"], s["rev_delta"].cast("string"))), "; ").alias("top_opportunities"))
    comp = competitors.where("comp_price > 0").groupBy("brand").agg(F.countDistinct("codigo_padre").alias("competitor_products"))
    cross = alerts.groupBy("brand").agg(F.countDistinct("codigo_padre").alias("cross_store_alerts"))
    return base.join(best, "brand", "left").join(comp, "brand", "left").join(cross, "brand", "left").fillna(
        0, ["competitor_products", "cross_store_alerts"])


def roster(actions: DataFrame, decisions: DataFrame, by: str = "store_name") -> DataFrame:
    """Per store, vendor or subcategory: totals, pending, urgency counts and revenue."""
    ratio = F.when(F.col("click_collect_ratio") > 0, F.col("click_collect_ratio"))
    name = F.coalesce(by, F.lit("Other")) if by != "store_name" else F.coalesce("store_name", "store")
    return _with_status(actions, decisions).groupBy("brand", name.alias("name")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_status").isNull()).alias("pending"), F.count("_status").alias("decided"),
        F.count_if(F.col("urgency") == "HIGH").alias("high"), F.count_if(F.col("urgency") == "MEDIUM").alias("medium"),
        _sum("rev_delta").alias("rev_delta"), F.round(F.avg(ratio), 6).alias("avg_click_collect"))


def _upper_middle(c: Column) -> Column:
    """Element at half the count of the sorted non-zero values."""
    values = F.array_sort(F.collect_list(F.when(c != 0, c)))
    return F.coalesce(F.get(values, F.floor(F.size(values) / 2).cast("int")), F.lit(0))


def product_grid(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per parent, stores against online: middle prices, velocity, revenue, pending."""
    df = _with_status(actions, decisions).withColumn("_web", X.is_ecomm("store"))
    sides = []
    for name, test in (("bm", ~F.col("_web")), ("ecom", F.col("_web"))):
        on = lambda c, t=test: F.when(t, F.col(c))
        sides += [
            F.count_if(test).alias(f"{name}_stores"), _upper_middle(on("current_price")).alias(f"{name}_price"),
            _upper_middle(on("recommended_price")).alias(f"{name}_recommended"),
            F.round(F.coalesce(F.sum(on("current_velocity")), F.lit(0.0)), 6).alias(f"{name}_velocity"),
            F.coalesce(F.sum(on("rev_delta")), F.lit(0)).alias(f"{name}_rev_delta"),
            F.count_if(test & F.col("_status").isNull()).alias(f"{name}_pending")]
    text = F.lower(F.coalesce("subcategory", "category"))
    shoe = reduce(lambda a, w: a | text.contains(w), ["running", "zapatilla", "footwear"], text.contains("sneaker"))
    priority = F.when(shoe, 0).when(text.contains("outdoor") | text.contains("trail"), 1).otherwise(2)
    return df.groupBy("brand", "parent_sku").agg(
        F.min("product").alias("product"), F.min("category").alias("category"), F.min("subcategory").alias("subcategory"),
        F.min("vendor_brand").alias("vendor_brand"), F.max("product_age_weeks").alias("age"), *sides
    ).withColumn("category_priority", priority)


def chain_view(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per parent: consensus discount (lower step if tied) and totals by channel."""
    votes = actions.groupBy("brand", "parent_sku", "recommended_discount").agg(F.count(F.lit(1)).alias("_n"))
    agreed = votes.groupBy("brand", "parent_sku").agg(F.max_by("recommended_discount", F.struct(
        F.col("_n"), -X.parse_pct("recommended_discount"))).alias("consensus_discount"), F.max("_n").alias("consensus_stores"))
    web, open_ = X.is_ecomm("store"), F.col("_status").isNull()
    totals = _with_status(actions, decisions).groupBy("brand", "parent_sku").agg(
        F.round(F.sum("current_velocity"), 6).alias("total_velocity"), F.sum("rev_delta").alias("total_rev_delta"),
        F.count_if(open_).alias("pending"), F.count_if(web).alias("ecomm_stores"), F.count_if(~web).alias("bm_stores"),
        F.count_if(web & open_).alias("ecomm_pending"), F.count_if(~web & open_).alias("bm_pending"))
    return totals.join(agreed, ["brand", "parent_sku"])


def decision_kpis(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review progress per brand and over all (brand ``all``)."""
    s, n = F.col("_status"), F.count(F.lit(1))
    ok = F.coalesce(s == "approved", F.lit(False))
    return _with_status(actions, decisions).groupingSets([["brand"], []], "brand").agg(
        n.alias("total"), F.count(s).alias("reviewed"), F.count_if(ok).alias("approved"), F.count_if(s == "rejected").alias("rejected"),
        F.count_if(s.isNull()).alias("undecided"), F.coalesce(F.sum(F.when(ok, F.col("rev_delta"))), F.lit(0)).alias("approved_rev_delta"),
        F.coalesce(F.sum(F.when(ok, F.col("margin_delta"))), F.lit(0)).alias("approved_margin_delta"),
        F.rint(F.count(s) / n * 100).cast("long").alias("progress_pct"),
    ).withColumn("brand", F.coalesce("brand", F.lit("all")))


def data_quality(txn: DataFrame, products: DataFrame, features: DataFrame, null_limit: float = 0.1) -> DataFrame:
    """Measures as rows (brand, measure, name, value): coverage, null rates over the limit, orphan SKUs."""
    def rows(df: DataFrame, aggs: dict[str, Column], measure: str) -> DataFrame:
        wide = df.groupBy("brand").agg(*[v.cast("double").alias(k) for k, v in aggs.items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in aggs]))
        return wide.select("brand", F.lit(measure).alias("measure"), pairs.alias("p")).select("brand", "measure", "p.*")

    n = F.count(F.lit(1))
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    sales = rows(txn, {"rows": n, "skus": F.countDistinct("sku"), "stores": F.countDistinct("centro"),
                       "first_day": day(F.min("fecha")), "last_day": day(F.max("fecha"))}, "transactions")
    table = rows(features, {"rows": n, "skus": F.countDistinct("sku"), "stores": F.countDistinct("centro"),
                            "first_week": day(F.min("week")), "last_week": day(F.max("week"))}, "features")
    plain = [c for c in features.columns if c not in ("brand", "sku", "centro", "week")]
    nulls = rows(features, {c: F.round(F.avg(F.col(c).isNull().cast("int")), 6) for c in plain}, "null_rate").where(
        F.col("value") > null_limit)
    orphans = (
        txn.select("brand", "sku").distinct().join(products.select("brand", F.col("material").alias("sku")), ["brand", "sku"], "left_anti")
        .groupBy("brand").agg(n.cast("double").alias("value"))
        .select("brand", F.lit("orphans").alias("measure"), F.lit("skus").alias("name"), "value"))
    return sales.unionByName(table).unionByName(nulls).unionByName(orphans)


def union_brands(tables: dict[str, DataFrame]) -> DataFrame:
    """Per-brand tables as one, tagged; absent columns become NULL."""
    tagged = [df.withColumn("brand", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def null_normalise(df: DataFrame) -> DataFrame:
    """NaN to NULL in numbers, NULL to '' in strings."""
    out = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out[name] = X.nan_to_null(name)
        elif kind == "string":
            out[name] = F.coalesce(F.col(name), F.lit(""))
    return df.withColumns(out)


def latest_snapshot(df: DataFrame, by: str = "week") -> DataFrame:
    """Rows of each brand's newest snapshot."""
    last = df.groupBy("brand").agg(F.max(by).alias(by))
    return df.join(F.broadcast(last), ["brand", by], "left_semi")


def latest_week_of(df: DataFrame) -> DataFrame:
    return weekly.latest_week(df).withColumnRenamed("_latest", "week")
