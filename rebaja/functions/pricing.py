"""Price anchors, discount ladder, demand response and margin as Columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rebaja import constants as C
from rebaja.functions.columns import col, computed, half_even


def price_ladder() -> Column:
    return F.array(*[F.lit(s) for s in C.PRICE_LADDER])


def _first_at_most(p: Column, bounds: list[float], values: list[int], rest: int) -> Column:
    """Value of the first bound that is not under ``p``; a plain comparison chain compiles well."""
    out = F.when(p <= bounds[0], values[0])
    for bound, value in zip(bounds[1:], values[1:]):
        out = out.when(p <= bound, value)
    return out.otherwise(rest)


def snap_price(price: str | Column, direction: str = "nearest") -> Column:
    """Nearest, next lower or next higher price anchor; equal distances go down."""
    p, step = col(price).cast("double"), float(C.ANCHOR_STEP_ABOVE)
    anchors = C.PRICE_ANCHORS
    top = anchors[-1]
    if direction == "down":
        chain = None
        for a in reversed(anchors):
            chain = F.when(p >= a, a) if chain is None else chain.when(p >= a, a)
        inside = chain.otherwise(anchors[0])
        above = F.floor(p / step) * step - 10
    elif direction == "up":
        inside = _first_at_most(p, [float(a) for a in anchors], anchors, top)
        above = (F.floor(p / step) + 1) * step - 10
    else:
        middles = [(lo + hi) / 2 for lo, hi in zip(anchors, anchors[1:])]
        inside = _first_at_most(p, middles, anchors[:-1], top)
        above = F.rint(p / step) * step - 10
    return F.when(p.isNull(), F.lit(None).cast("long")).when(p <= 0, 0).when(p > top, above.cast("long")).otherwise(inside).cast("long")


def snap_discount(disc: str | Column) -> Column:
    """Closest ladder step; under 7 % is none, from 7 % on at least the first step."""
    d, steps = col(disc), C.PRICE_LADDER[1:]
    chain = F.when(d < 0.07, 0.0)
    for lo, hi in zip(steps, steps[1:]):
        chain = chain.when(F.abs(F.lit(lo) - d) <= F.abs(F.lit(hi) - d), lo)
    return F.when(d.isNull(), F.lit(None).cast("double")).otherwise(chain.otherwise(steps[-1]))


def step_lift(step: Column, otherwise: Column) -> Column:
    out = otherwise
    for s, lift in C.STEP_LIFT.items():
        out = F.when(step == s, lift).otherwise(out)
    return out


def usable(elasticity: str | Column) -> Column:
    """Elastic enough to price with; NULL is not."""
    return F.coalesce(col(elasticity) < -0.3, F.lit(False))


def expected_velocity(velocity, current: str | Column, new: str | Column, elasticity: str | Column) -> Column:
    """Weekly units at a deeper discount; unchanged when the discount is no deeper."""
    v, c, n, e = col(velocity), col(current), col(new), col(elasticity)
    change = (n - c) / F.greatest(1 - c, F.lit(0.01))
    lift = step_lift(n, 1 + change * 5)
    return (F.when(v <= 0, 0.5).when(n <= c, v)
            .when(usable(e), F.greatest(v * (1 - change * e), F.lit(0.5)))
            .otherwise(F.greatest(v * lift, F.lit(0.5))))


def expected_velocity_bidir(velocity, current: str | Column, new: str | Column, elasticity: str | Column) -> Column:
    """Weekly units at a deeper or shallower discount."""
    v, c, n, e = col(velocity), col(current), col(new), col(elasticity)
    change = (c - n) / F.greatest(1 - c, F.lit(0.01))
    lift = step_lift(n, 1 + F.abs(change) * 5)
    loss = F.least(F.lit(0.25) * ((c - n) / 0.15), F.lit(0.6))
    return (F.when(v <= 0, 0.5).when(n == c, v)
            .when(usable(e), F.greatest(v * (1 + e * change), F.lit(0.3)))
            .when(n > c, F.greatest(v * lift, F.lit(0.5)))
            .otherwise(F.greatest(v * (1 - loss), F.lit(0.3))))


def margin_pct(price: str | Column, cost: str | Column) -> Column:
    """Margin percent net of tax; NULL without a cost."""
    net = col(price) / C.VAT
    return F.when(col(cost) > 0, F.when(net > 0, (net - col(cost)) / net * 100).otherwise(0.0))


def with_best_step(df: DataFrame, out: str, list_price: str, current_price: str, current_disc: str, velocity: str,
                   cost: str, elasticity: str, ladder: list[float] | None = None,
                   min_margin: float = C.MIN_MARGIN_PCT, min_move: float = C.MIN_PRICE_MOVE,
                   allow_increase: bool = True) -> DataFrame:
    """Adds the ladder step with the highest weekly profit (revenue without a cost) as struct ``out``.

    NULL when no step clears the cost and margin floors. Fields: step, price,
    velocity, profit, revenue, margin_pct, feasible (steps) and action (``hold``,
    ``increase`` or ``decrease``, by the direction of the price). The candidates
    are a column of their own, so each row prices the ladder once.
    """
    lp, cur, disc, vel, c = (F.col(x) for x in (list_price, current_price, current_disc, velocity, cost))
    steps = F.array(*[F.lit(float(s)) for s in (ladder or C.PRICE_LADDER)])
    if not allow_increase:
        steps = F.filter(steps, lambda s: s >= disc)
    costed = F.coalesce(c > 0, F.lit(False))

    def priced(s: Column) -> Column:
        return F.struct(s.alias("step"), snap_price(lp * (1 - s)).alias("price"),
                        expected_velocity_bidir(velocity, current_disc, s, elasticity).alias("velocity"))

    def option(o: Column) -> Column:
        net, v = o["price"] / C.VAT, o["velocity"]
        profit = F.when(costed, (net - c) * v).otherwise(v * o["price"])
        # rounded so that equal profits tie; the shallower step wins a tie
        return F.struct(F.round(profit, 6).alias("rank"), (-o["step"]).alias("shallow"), o["price"].alias("price"), v.alias("velocity"),
                        profit.alias("profit"), (v * o["price"]).alias("revenue"),
                        F.when(costed & (net > 0), (net - c) / net * 100).alias("margin"))

    def allowed(o: Column) -> Column:
        return (o["price"] > 0) & (~costed | ((o["price"] / C.VAT >= c) & (o["margin"] >= min_margin)))

    raw, opts, best = f"{out}_raw", f"{out}_opts", F.col(f"{out}_best")
    step, move = F.abs(best["shallow"]), best["price"] - F.col(f"{out}_now")
    action = (F.when((F.abs(move) < min_move) & (step == F.col(f"{out}_held")), "hold")
              .when(move > 0, "increase").when(move < 0, "decrease").otherwise("hold"))
    result = F.struct(
        step.alias("step"), best["price"].alias("price"), best["velocity"].alias("velocity"),
        best["profit"].alias("profit"), best["revenue"].alias("revenue"), half_even(best["margin"], 1).alias("margin_pct"),
        F.transform(opts, lambda o: F.abs(o["shallow"])).alias("feasible"), action.alias("action"))
    return (
        computed(computed(df, **{
            raw: F.transform(steps, priced), f"{out}_held": snap_discount(disc),
            f"{out}_now": F.when(cur.isNull() | (cur == 0), 0).otherwise(snap_price(cur))}
        ), **{opts: F.filter(F.transform(raw, option), allowed)})
        .withColumn(f"{out}_best", F.array_max(opts))
        .transform(lambda d: computed(d, **{out: F.when((lp > 0) & vel.isNotNull() & best.isNotNull(), result)}))
        .drop(raw, opts, f"{out}_best", f"{out}_held", f"{out}_now")
    )
