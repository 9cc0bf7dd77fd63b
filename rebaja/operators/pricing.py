"""Weekly price actions per parent and store, on given scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X, pricing as P
from rebaja.operators import lookups, parent as R, signals
from rebaja.operators.ordering import running

KEYS = ["brand", "parent_sku", "store"]


def fixed(c: str | Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", X.half_even(c, digits))


def formula_scores(parent: DataFrame) -> DataFrame:
    """Scores from a stated formula, for runs and checks that need no model."""
    d = F.coalesce("discount_rate", F.lit(0.0))
    stage = F.coalesce("lifecycle_stage_code", F.lit(3))
    return parent.withColumns({
        "markdown_probability": F.least(F.lit(0.99), F.lit(0.30) + F.lit(0.08) * stage + F.lit(0.5) * d),
        "raw_depth": F.least(F.lit(0.60), d + F.lit(0.10)),
    })


def filter_stores(df: DataFrame, active: DataFrame | None = None, store: str = "centro") -> DataFrame:
    """Retail stores only; with ``active`` (brand, centro) also only those listed."""
    out = df.where(X.is_pricing_store(store))
    return out if active is None else out.join(active.select("brand", F.col("centro").alias(store)), ["brand", store], "left_semi")


def cost_trio(rows: DataFrame, costs: DataFrame, rebates: DataFrame | None = None) -> DataFrame:
    """Integer raw cost, active rebate and their difference, which ties exactly."""
    found = lookups.prefix_lookup(rows, costs.where("cost > 0"), "codigo_padre", "sku", "cost")
    df = rows.join(found, ["brand", "codigo_padre"], "left")
    if rebates is None:
        df = df.withColumn("rebate", F.lit(0.0))
    else:
        weeks = rows.select("brand", "week").distinct()
        active = signals.active_rebates(rebates, weeks).withColumnRenamed("parent_sku", "codigo_padre")
        df = df.join(active, ["brand", "codigo_padre", "week"], "left")
    raw = X.half_even("cost").cast("long")
    rebate = F.when(raw.isNull(), 0).otherwise(F.coalesce(X.half_even("rebate"), F.lit(0.0))).cast("long")
    return df.withColumns({"raw_cost": raw, "rebate_amount": rebate}).withColumn(
        "unit_cost", F.when(F.col("raw_cost").isNotNull(), F.greatest(F.col("raw_cost") - F.col("rebate_amount"), F.lit(0)))
    ).drop("cost", "rebate")


def pricing_rows(scored: DataFrame, products: DataFrame, stores: DataFrame, costs: DataFrame,
                 rebates: DataFrame | None, elasticity: DataFrame, weeks: DataFrame | None = None,
                 active: DataFrame | None = None) -> DataFrame:
    """Rows of the week to price with names, elasticity and costs attached.

    ``scored``: parent table with ``markdown_probability`` and ``raw_depth``;
    ``weeks``: brand, week (default: picked per brand).
    """
    target = R.brand_weeks(scored) if weeks is None else weeks
    now = filter_stores(scored.join(F.broadcast(target), ["brand", "week"], "left_semi"), active)
    names = lookups.parent_catalogue(products, ["material_descripcion"]).select(
        "brand", "codigo_padre", X.clean_product_name("material_descripcion").alias("product_name"), "total_sizes_catalog")
    reliable = elasticity.where("confidence in ('high', 'medium')").select("brand", "codigo_padre", "elasticity")
    shops = stores.groupBy("centro").agg(F.min(X.store_name("sucursal")).alias("store_name"))
    df = (
        now.join(names, ["brand", "codigo_padre"], "left").join(reliable, ["brand", "codigo_padre"], "left")
        .join(shops, "centro", "left")
    )
    ready = cost_trio(df, costs, rebates).withColumns({
        "disc_rate": F.coalesce("discount_rate", F.lit(0.0)), "total_sizes_catalog": F.coalesce("total_sizes_catalog", F.lit(1)),
        "store_name": F.coalesce("store_name", "centro"),
    })
    return X.computed(
        ready, n_sell=(F.col("size_curve_completeness") * F.col("total_sizes_catalog")).cast("long"),
        current_step=P.snap_discount("disc_rate"), has_elast=P.usable("elasticity"),
        price_now=F.when(F.col("avg_precio_final").isNull(), 0).otherwise(P.snap_price("avg_precio_final")))


# ------------------------------------------------------------------ urgency

def _urgency_rules() -> list[tuple[Column, int, Column | None]]:
    """(test, points, reason); tests of one theme exclude each other."""
    c = F.col
    cc, trend, stage = F.coalesce("click_collect_ratio", F.lit(0.0)), c("velocity_trend"), c("lifecycle_stage_code")
    att, age, woc, hand = c("attrition_rate"), c("product_age_weeks"), c("weeks_of_cover"), c("stock_on_hand")
    avail, top3, pct = c("weighted_size_avail"), c("top3_sizes_in_stock"), c("pct_sizes_in_stock")
    stocked = X.true(hand > 0)
    t = X.true
    weeks = F.concat(F.lit("Product is "), age.cast("long").cast("string"), F.lit(" weeks old"))

    def say(before: str, value: Column, after: str) -> Column:
        return F.concat(F.lit(before), value, F.lit(after))

    over, high, some = t(stocked & (woc > 20) & (trend <= 1.0)), t(stocked & (woc > 12) & (trend < 0.8)), t(stocked & (woc > 8))
    weak = t((F.coalesce("velocity_4w", F.lit(0.0)) < 0.5) | (trend < 0.7))
    undercut = t(c("comp_undercut") > 0)
    gap = F.coalesce(F.concat(F.format_string("%+.0f", X.half_even("comp_price_gap_pct")), F.lit("%")), F.lit(""))
    measured = avail.isNotNull() & stocked
    return [
        (cc > 0.3, 0, F.concat(F.lit("Click&collect "), X.pct_text(cc), F.lit(" of sales (in-store: "),
                               fixed(F.coalesce("instore_velocity_4w", F.lit(0.0)), 1), F.lit(" u/sem)"))),
        (t(trend < 0.5), 3, F.lit("Velocity collapsed (trend < 0.5)")),
        (t((trend >= 0.5) & (trend < 0.7)), 2, F.lit("Velocity declining")),
        (t(stage == 5), 3, F.lit("In clearance stage")),
        (t(stage == 4), 2, F.lit("In decline stage")),
        (t(att > 0.5), 3, say("Size curve critical (", X.pct_text(att), " attrition)")),
        (t((att > 0.3) & (att <= 0.5)), 1, say("Size curve breaking (", X.pct_text(att), " attrition)")),
        (t(age > 40), 2, weeks),
        (t((age > 26) & (age <= 40)), 1, weeks),
        (over, 3, say("Overstocked (", fixed(woc, 0), " weeks of cover)")),
        (high & ~over, 2, say("High stock (", fixed(woc, 0), " WoC) + slowing sales")),
        (some & ~over & ~high, 1, say("Elevated stock (", fixed(woc, 0), " WoC)")),
        (t(measured & (avail < 0.3)), 3, say("Best sellers out of stock (", X.pct_text(avail), " vol-weighted avail)")),
        (t(measured & (avail >= 0.3) & (avail < 0.5)), 2, say("Key sizes depleting (", X.pct_text(avail), " vol-weighted avail)")),
        (t(measured & (avail >= 0.5) & (avail < 0.7)), 1, say("Size run weakening (", X.pct_text(avail), " vol-weighted avail)")),
        (t(avail.isNull() & stocked & (pct < 0.4)), 2, say("Broken size run (", X.pct_text(pct), " sizes in stock)")),
        (t(top3 < 0.5), 2, say("Top sellers stockout (", X.pct_text(top3), " of top 3 in stock)")),
        (t((c("max_discount_rate") > 0.1) & (c("discount_rate") < 0.05)), 1, F.lit("Discounted in other channels")),
        (undercut & weak, 2, say("Competitor cheaper ", gap, " + velocity weak")),
        (undercut & ~weak, 0, say("Competitor cheaper ", gap, " — velocity healthy, hold price")),
        (t(c("markdown_probability") > 0.9), 1, None),
    ]


def urgency_score() -> Column:
    total = F.lit(0)
    for test, points, _ in _urgency_rules():
        if points:
            total = total + F.when(test, points).otherwise(0)
    return total


def urgency_label(score: Column) -> Column:
    return F.when(score >= 5, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")


def urgency_reasons() -> Column:
    said = X.join_reasons([F.when(test, reason) for test, _, reason in _urgency_rules() if reason is not None])
    return F.when(said == "", "Model predicts markdown based on overall patterns").otherwise(said)


def confidence_tier(prob: Column, velocity: Column, age: Column, has_elasticity: Column, increase: bool) -> Column:
    score = (
        F.when(prob > 0.85, 3).when(prob > 0.70, 2).when(prob > 0.50, 1).otherwise(0)
        + F.when(has_elasticity, 2).otherwise(0)
        + F.when(velocity >= 2.0, 2).when(velocity >= 1.0, 1).otherwise(0)
        + F.when(age >= 8, 1).otherwise(0))
    tier = F.when(score >= 6, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")
    return F.when(~has_elasticity, "SPECULATIVE").otherwise(tier) if increase else tier


# -------------------------------------------------------------------- passes

def _increase_columns(rows: DataFrame) -> DataFrame:
    """Shallower step and its price; ``_up`` marks rows that qualify for a raise."""
    c = F.col
    lp, vel = c("avg_precio_lista"), c("velocity_4w")
    below = F.array_max(F.filter(P.price_ladder(), lambda s: s < F.col("current_step")))
    df = X.computed(X.computed(rows, up_step=below, _list_anchor=P.snap_price(lp)),
                    _raised=P.snap_price(lp * (1 - c("up_step")), "up"))
    df = df.withColumn("is_premium", X.true(c("_raised") > lp)).withColumn(
        "up_price", F.when(c("is_premium") & ~X.true(vel >= 2.0), c("_list_anchor")).otherwise(c("_raised")))
    gate = (
        (c("disc_rate") > 0.05) & (c("current_step") > 0) & (lp > 0) & (vel >= 1.0) & (c("velocity_trend") >= 1.0)
        & ~X.true(c("lifecycle_stage_code").isin(4, 5)) & (F.coalesce("attrition_rate", F.lit(0.0)) < 0.3)
        & (c("product_age_weeks") < 35) & ~X.true(c("weeks_of_cover") > 15))
    return X.computed(df, _up=X.true(gate & (c("up_price") > c("price_now") + C.MIN_PRICE_MOVE)))


def _impact(rows: DataFrame) -> DataFrame:
    """Revenue and margin now and expected, from step, price and velocity."""
    c = F.col
    vel, now, price, exp, cost = c("velocity_4w"), c("price_now"), c("_price"), c("_exp_vel"), c("unit_cost")
    costed = X.true(cost > 0)
    net, net_now = price / C.VAT, now / C.VAT
    return X.computed(
        rows, _rev_now=vel * now, _rev_exp=exp * price,
        _margin_pct=F.when(costed, F.when(net > 0, X.half_even((net - cost) / net * 100, 1)).otherwise(0.0)),
        _margin_delta=F.when(costed, ((net - cost) * exp - (net_now - cost) * vel).cast("long")))


def _action_columns(rows: DataFrame, recommended: Column, urgency: Column, reasons: Column, tier: Column,
                    action: str) -> DataFrame:
    c = F.col
    return rows.select(
        "brand", "week", c("codigo_padre").alias("parent_sku"), c("centro").alias("store"), "store_name",
        F.coalesce("product_name", "codigo_padre").alias("product"),
        c("primera_jerarquia").alias("category"), c("segunda_jerarquia").alias("subcategory"),
        c("n_sell").alias("sizes_selling"), c("total_sizes_catalog").alias("sizes_total"),
        c("product_age_weeks").cast("long").alias("product_age_weeks"), c("stock_on_hand").cast("long").alias("stock_on_hand"),
        X.half_even("weeks_of_cover", 1).alias("weeks_of_cover"), c("avg_precio_lista").cast("long").alias("current_list_price"),
        c("price_now").alias("current_price"), X.format_pct("current_step", "0%").alias("current_discount"),
        X.half_even("velocity_4w", 1).alias("current_velocity"), c("_price").alias("recommended_price"),
        recommended.alias("recommended_discount"), X.half_even("_exp_vel", 1).alias("expected_velocity"),
        c("_rev_now").cast("long").alias("current_weekly_rev"), c("_rev_exp").cast("long").alias("expected_weekly_rev"),
        (c("_rev_exp") - c("_rev_now")).cast("long").alias("rev_delta"), "unit_cost", "raw_cost", "rebate_amount",
        c("_margin_pct").alias("margin_pct"), c("_margin_delta").alias("margin_delta"), urgency.alias("urgency"),
        reasons.alias("reasons"), X.half_even("markdown_probability", 3).alias("model_confidence"),
        tier.alias("confidence_tier"), F.lit(action).alias("action_type"),
        X.vendor_brand("codigo_padre", "brand").alias("vendor_brand"),
        X.half_even("click_collect_ratio", 4).alias("click_collect_ratio"))


def price_increase_pass(rows: DataFrame) -> DataFrame:
    """One step up for over-discounted products that sell well."""
    c = F.col
    df = _increase_columns(rows).where("_up")
    vel, now, e = c("velocity_4w"), c("price_now"), c("elasticity")
    by_e = vel * (1 + (c("up_price") - now) / F.greatest(now, F.lit(1)) * e)
    df = _impact(X.computed(
        df, _price=c("up_price"), _exp_vel=F.greatest(F.when(c("has_elast"), by_e).otherwise(vel * 0.75), F.lit(0.3))))
    pct = fixed("_margin_pct", 0)
    reasons = X.join_reasons([
        F.concat(F.lit("Selling "), fixed(vel, 1), F.lit(" u/sem at "), X.pct_text("current_step"), F.lit(" off -- test higher price")),
        F.when(c("is_premium"), F.concat(F.lit("PREMIUM: above list price ("), F.format_number("_list_anchor", 0), F.lit(" -> "),
                                         F.format_number("up_price", 0), F.lit(")"))),
        F.when(~c("has_elast"), "Sin elasticidad — volumen estimado"),
        F.when(c("velocity_trend") > 1.1, "Sales accelerating"),
        F.when(c("n_sell") >= c("total_sizes_catalog") * 0.7, F.concat(
            F.lit("Size curve healthy ("), c("n_sell").cast("string"), F.lit("/"), c("total_sizes_catalog").cast("string"), F.lit(")"))),
        F.when(c("_margin_pct").isNotNull(), F.concat(F.lit("Margin recovery: "), pct, F.lit("% at new price"))),
        F.when(c("_margin_pct") < 20, F.concat(F.lit("THIN MARGIN: "), pct, F.lit("% at recommended price"))),
    ])
    tier = F.when(c("is_premium"), "SPECULATIVE").otherwise(confidence_tier(
        c("markdown_probability"), vel, c("product_age_weeks"), c("has_elast"), True))
    return _action_columns(df, X.format_pct("up_step"), F.lit("INCREASE"), reasons, tier, "increase")


def markdown_pass(rows: DataFrame) -> DataFrame:
    """Markdowns of likely products that got no raise, within cost and margin floors.

    Where the suggested price is below cost, and again where it misses the
    margin floor, the first (shallowest) ladder step that passes is taken.
    """
    c = F.col
    lp, now, cost = c("avg_precio_lista"), c("price_now"), c("unit_cost")
    costed = X.true(cost > 0)
    df = _increase_columns(rows).where(~c("_up") & (c("markdown_probability") >= 0.50) & (lp > 0))
    suggested = P.snap_discount("raw_depth")
    deeper = F.array_min(F.filter(P.price_ladder(), lambda s: s > F.col("current_step")))
    df = X.computed(df, step_0=F.when(suggested > c("current_step"), suggested).when(c("markdown_probability") > 0.8, deeper))
    options = F.transform(P.price_ladder(), lambda s: F.struct(
        s.alias("step"), P.snap_price(F.col("avg_precio_lista") * (1 - s)).alias("price")))
    df = X.computed(df.where("step_0 is not null"), _options=options, price_0=P.snap_price(lp * (1 - c("step_0"))))
    df = df.where(F.abs(c("price_0") - now) >= C.MIN_PRICE_MOVE)

    above_cost = F.get(F.filter("_options", lambda o: o["price"] / C.VAT >= F.col("unit_cost")), F.lit(0))
    df = df.withColumn("_below", costed & (c("price_0") / C.VAT < cost))
    df = X.computed(df, _pick=F.when(c("_below"), above_cost)).where(~c("_below") | c("_pick").isNotNull())
    df = df.withColumns({"step_1": F.coalesce("_pick.step", "step_0"), "price_1": F.coalesce("_pick.price", "price_0")}).drop("_pick")
    df = df.where(F.abs(c("price_1") - now) >= C.MIN_PRICE_MOVE)

    net, floor = c("price_1") / C.VAT, float(C.MIN_MARGIN_PCT)
    above_floor = F.get(F.filter("_options", lambda o: P.margin_pct(o["price"], "unit_cost") >= floor), F.lit(0))
    thin = costed & X.true(F.when(net > 0, X.half_even((net - cost) / net * 100, 1)).otherwise(0.0) < floor)
    df = X.computed(X.computed(df, _thin=thin), _pick=F.when(c("_thin"), above_floor))
    df = df.where(~c("_thin") | (c("_pick").isNotNull() & (c("_pick.step") > c("current_step")))).withColumns({
        "step_2": F.coalesce("_pick.step", "step_1"), "_price": F.coalesce("_pick.price", "price_1")})
    df = df.where(F.abs(c("_price") - now) >= C.MIN_PRICE_MOVE)

    df = _impact(X.computed(df, _exp_vel=P.expected_velocity("velocity_4w", "disc_rate", "step_2", "elasticity")))
    reasons = X.join_reasons([
        urgency_reasons(),
        F.when(c("_below"), F.concat(F.lit("Discount capped to protect margin (cost="), F.format_number("unit_cost", 0), F.lit(")"))),
        F.when(c("_thin") & (c("step_2") != c("step_1")), F.concat(
            F.lit("Discount capped at "), X.pct_text("step_2"), F.lit(f" to protect margin (floor={C.MIN_MARGIN_PCT}%)"))),
        F.when(c("_margin_pct") < 20, F.concat(F.lit("THIN MARGIN: "), fixed("_margin_pct", 0), F.lit("% at recommended price"))),
    ])
    tier = confidence_tier(c("markdown_probability"), c("velocity_4w"), c("product_age_weeks"), c("has_elast"), False)
    return _action_columns(df, X.format_pct("step_2", "0%"), urgency_label(urgency_score()), reasons, tier, "decrease")


def ecomm_overlay(actions: DataFrame, rows: DataFrame) -> DataFrame:
    """Online price, discount and velocity of the parent on each of its actions."""
    online = X.is_ecomm("centro")
    web = rows.groupBy("brand", "week", F.col("codigo_padre").alias("parent_sku")).agg(
        F.median(F.when(online, F.col("avg_precio_final"))).alias("ecomm_price"),
        F.median(F.when(online, F.col("discount_rate"))).alias("ecomm_discount"),
        F.sum(F.when(online, F.col("velocity_4w"))).alias("_web"),
        F.coalesce(F.sum(F.when(~online, F.col("click_collect_units"))), F.lit(0)).alias("_pickup"), F.count_if(online).alias("_n"))
    web = web.where("_n > 0").select("brand", "week", "parent_sku", "ecomm_price", "ecomm_discount",
                                     F.round(F.col("_web") + F.col("_pickup"), 6).alias("ecomm_velocity"))
    gap = (F.col("current_price") - F.col("ecomm_price")) / F.col("current_price") * 100
    return actions.join(web, ["brand", "week", "parent_sku"], "left").withColumn(
        "ecomm_price_gap_pct", F.when((F.col("ecomm_price") > 0) & (F.col("current_price") != 0), X.half_even(gap, 1)))


def weekly_actions(rows: DataFrame) -> DataFrame:
    """Raises and markdowns of the week with the online overlay."""
    return ecomm_overlay(price_increase_pass(rows).unionByName(markdown_pass(rows)), rows)


# -------------------------------------------------------------------- orders

def urgency_rank(urgency: str = "urgency") -> Column:
    out = F.lit(3)
    for name, rank in C.URGENCY_RANK.items():
        out = F.when(F.col(urgency) == name, rank).otherwise(out)
    return out


def _tie(df: DataFrame) -> list[str]:
    return [k for k in ("brand", "parent_sku", "store", "channel") if k in df.columns]


def sort_columns(df: DataFrame, by: str) -> list[str | Column]:
    """The order of a sort name; ties by key."""
    keys = {
        "urgency": lambda: [urgency_rank(), F.desc("rev_delta")],
        "revenue": lambda: [F.desc(F.abs("rev_delta"))],
        "confidence": lambda: [F.desc("model_confidence")],
        "store": lambda: [F.asc("store_name")],
        "variance": lambda: [F.desc("per_store_variance_pct")],
        "discount": lambda: [F.desc(X.parse_pct("recommended_discount"))],
        "age": lambda: [F.desc("product_age_weeks")],
    }
    return [*keys[by](), *_tie(df)]


def order_actions(actions: DataFrame, by: str = "urgency") -> DataFrame:
    """Sort variants of the action list."""
    return actions.orderBy(*sort_columns(actions, by))


def placed_actions(actions: DataFrame, by: str = "urgency") -> DataFrame:
    """All actions with their ``place`` in the sorted list of their brand: counts before each range of the order, so no task sorts a brand."""
    return running(actions.withColumn("_one", F.lit(1).cast("long")), ["brand"], sort_columns(actions, by), {"place": ("sum", "_one")}, "placed").drop("_one")


def page(actions: DataFrame, number: int, size: int = 50, by: str = "urgency") -> DataFrame:
    """One page of the sorted list: a top-k over the pages read so far, then its tail."""
    return order_actions(actions, by).offset((number - 1) * size).limit(size)


def page_by_place(placed: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of each brand's list from a written ``placed_actions``: a filter, whatever the page."""
    return placed.where((F.col("place") > (number - 1) * size) & (F.col("place") <= number * size))


def filter_actions(actions: DataFrame, decisions: DataFrame | None = None, *, store: str | None = None,
                   vendor: str | None = None, urgency: str | None = None, subcategory: str | None = None,
                   category: str | None = None, status: str | None = None, search: str | None = None,
                   skus: list[str] | None = None, channel: str | None = None) -> DataFrame:
    """Rows that match every given criterion; ``decisions``: brand, week, key, status."""
    df, c = actions, F.col
    up = c("action_type") == "increase"
    if store is not None:
        df = df.where((c("store_name") == store) | (c("store") == store))
    if vendor is not None:
        df = df.where(F.lower(F.coalesce("vendor_brand", F.lit("Other"))).contains(vendor.lower()))
    if urgency is not None:
        df = df.where(up) if urgency == "INCREASE" else df.where((c("urgency") == urgency) & ~up)
    if subcategory is not None:
        df = df.where(c("subcategory") == subcategory)
    if category is not None:
        text = category.lower()
        df = df.where(F.lower("category").contains(text) | F.lower("subcategory").contains(text))
    if skus is not None:
        df = df.where(c("parent_sku").isin(skus))
    if channel is not None:
        df = df.where(X.channel_of("store") == channel) if "channel" not in df.columns else df.where(c("channel") == channel)
    if search:
        df = df.where(F.lower("parent_sku").contains(search.lower()) | F.lower("product").contains(search.lower()))
    if status is not None and decisions is not None:
        place = "channel" if "channel" in df.columns else "store"
        known = decisions.select("brand", "week", F.col("key").alias("_key"), F.col("status").alias("_status"))
        df = (df.withColumn("_key", F.concat_ws("-", "parent_sku", place)).join(known, ["brand", "week", "_key"], "left")
              .where(F.coalesce("_status", F.lit("pending")) == status).drop("_key", "_status"))
    return df


def recommendations(scored: DataFrame, products: DataFrame, weeks: DataFrame, min_confidence: str = "low",
                    top_n: int | None = 100) -> DataFrame:
    """Child-level list of a week: probability cut, confidence band, priority, top N per brand and week (None: all)."""
    p, cuts = F.col("markdown_probability"), C.RECOMMEND_CUTS
    band = F.when(p > cuts["high"], "high").when(p > cuts["medium"], "medium").when(p > cuts["low"], "low").otherwise("skip")
    attrs = lookups.product_attributes(products, ["material_descripcion", "talla"])
    revenue = F.col("velocity_4w") * F.col("avg_precio_lista")
    df = (
        scored.join(F.broadcast(weeks.select("brand", "week")), ["brand", "week"], "left_semi")
        .where(p >= cuts[min_confidence]).withColumns({
            "confidence": band, "estimated_weekly_revenue": revenue,
            "priority_score": F.round(p * F.greatest(F.coalesce(revenue, F.lit(0.0)), F.lit(0.0))
                                      * F.when(F.col("velocity_trend") < 0.8, 1.2).otherwise(1.0), 6)})
    )
    # rank inside 16 slices first, so that no task sorts a whole brand-week
    order = [F.desc("priority_score"), "sku", "centro"]
    part = Window.partitionBy("brand", "week", F.pmod(F.xxhash64("sku", "centro"), F.lit(16)))
    short = df if top_n is None else df.withColumn("_rn", F.row_number().over(part.orderBy(*order))).where(F.col("_rn") <= top_n)
    rank = F.row_number().over(Window.partitionBy("brand", "week").orderBy(*order))
    return (
        short.withColumn("rank", rank).where(F.lit(top_n is None) | (F.col("rank") <= (top_n or 0))).join(attrs, ["brand", "sku"], "left")
        .select("brand", "week", "rank", "sku", F.col("material_descripcion").alias("product_name"), "talla",
                F.col("centro").alias("store_code"), F.col("codigo_padre").alias("parent_sku"), "markdown_probability",
                "confidence", F.col("raw_depth").alias("recommended_depth"), "priority_score",
                F.col("velocity_4w").alias("weekly_velocity"), "velocity_trend",
                F.col("has_discount").alias("currently_discounted"), "estimated_weekly_revenue")
    )


def recommendations_by_parent(recs: DataFrame, top_n: int = 15) -> DataFrame:
    view = recs.groupBy("brand", "week", "parent_sku").agg(
        F.count(F.lit(1)).alias("n_variants"), F.avg("markdown_probability").alias("avg_probability"),
        F.avg("recommended_depth").alias("avg_depth"), F.max("priority_score").alias("max_priority"))
    rank = F.row_number().over(Window.partitionBy("brand", "week").orderBy(F.desc("max_priority"), "parent_sku"))
    return view.withColumn("rank", rank).where(F.col("rank") <= top_n)


def manual_price_impact(actions: DataFrame, prices: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Impact of hand-set prices: prices (brand, parent_sku, store, manual_price)."""
    known = elasticity.select("brand", F.col("codigo_padre").alias("parent_sku"), "elasticity")
    c = F.col
    df = (actions.join(prices, KEYS).join(known, ["brand", "parent_sku"], "left")
          .withColumn("snapped_price", P.snap_price("manual_price")))
    lp, cur, snap, vel, cost = (c(x) for x in (
        "current_list_price", "current_price", "snapped_price", "current_velocity", "unit_cost"))
    ok, costed = lp > 0, X.true(cost > 0)
    df = df.withColumns({
        "_d0": F.when(ok & (cur > 0), 1 - cur / lp).otherwise(0.0),
        "_d1": F.greatest(F.lit(0.0), F.least(F.when(ok & (snap > 0), 1 - snap / lp).otherwise(0.0), F.lit(0.5)))})
    df = df.withColumn("_v", F.when(ok, P.expected_velocity("current_velocity", "_d0", "_d1", "elasticity")))
    net = snap / C.VAT
    df = df.withColumns({
        "velocity": X.half_even("_v", 1), "weekly_revenue": (c("_v") * snap).cast("long"),
        "new_margin_pct": F.when(ok & costed, F.when(net > 0, X.half_even((net - cost) / net * 100, 1)).otherwise(0.0)),
        "new_margin_delta": F.when(ok & costed, ((net - cost) * c("_v") - (cur / C.VAT - cost) * vel).cast("long")),
    })
    m = c("new_margin_pct")
    warning = (F.when(~ok, "no_list_price").when(~costed, "no_cost_data").when(m < 0, "below_cost")
               .when(m < C.MIN_MARGIN_PCT, "below_margin_floor").when(m < 20, "thin_margin"))
    return df.select(*KEYS, "manual_price", "snapped_price", "velocity", "weekly_revenue",
                     c("new_margin_pct").alias("margin_pct"), c("new_margin_delta").alias("margin_delta"),
                     warning.alias("warning"))


def promotion_grid(actions: DataFrame, elasticity: DataFrame, ladder: list[float] | None = None,
                   weeks: int = 4) -> DataFrame:
    """Projected revenue and margin per brand and discount step; marks the best margin."""
    known = elasticity.select("brand", F.col("codigo_padre").alias("parent_sku"), "elasticity")
    c = F.col
    steps = F.array(*[F.lit(float(s)) for s in (ladder or C.PRICE_LADDER)])
    now = c("current_price") / c("current_list_price")
    df = (
        actions.where("current_list_price > 0").join(known, ["brand", "parent_sku"], "left")
        .withColumn("_d0", 1 - now).withColumn("discount", F.explode(steps))
        .withColumn("_price", P.snap_price(c("current_list_price") * (1 - c("discount"))))
        .withColumn("_v", P.expected_velocity_bidir("current_velocity", "_d0", "discount", "elasticity"))
    )
    unit = F.when(c("unit_cost") > 0, c("_price") / C.VAT - c("unit_cost"))
    grid = df.groupBy("brand", "discount").agg(
        F.count(F.lit(1)).alias("n_items"), F.round(F.sum(c("_v") * weeks), 4).alias("units"),
        F.round(F.sum(c("_v") * c("_price") * weeks), 2).alias("revenue"),
        F.round(F.sum(unit * c("_v") * weeks), 2).alias("margin"))
    best = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("margin"), "discount"))
    return grid.withColumn("is_best", best == 1)
