"""The weekly run: every step as a table, for all brands in one job.

A step is computed on first use and written once to the shared folder, so later
steps read a table instead of re-planning all that came before, and a lost
executor costs one step at most.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from rebaja.operators import channel as CH, elasticity as E, enhance as H, lifecycle as L, models as ML, outcomes as O
from rebaja.operators import parent as R, pricing as A, sizes as Z, weekly as W
from rebaja.plans.child import ChildInputs, build_child_features
from rebaja.session import materialise
from rebaja.sources.steps import StepStore


class WeeklyRun:
    """Steps over one set of entity tables (``sources.retail``, or folders: ``sources.folders``).

    ``fast_elasticity`` uses the slope without month and trend controls, which
    SQL can express as well. ``scores`` maps the parent table to a table with
    ``markdown_probability`` and ``raw_depth``; the default is a formula.
    """

    def __init__(self, tables, fast_elasticity: bool = True, scores=A.formula_scores):
        self.t, self.fast, self.scores = tables, fast_elasticity, scores

    @cached_property
    def sales(self) -> DataFrame:
        """Lines of products; bags, adjustments and other service SKUs enter no feature."""
        return W.exclude_service_skus(self.t.transactions)

    @cached_property
    def folios(self) -> DataFrame:
        """Distinct folios per SKU, store and week, for the panel and the weekly sales."""
        return materialise(W.folio_counts(self.sales), "folios")

    @cached_property
    def totals(self) -> DataFrame:
        """Sums of the lines per SKU, store and week, for the panel, the weekly and the parent sales."""
        return materialise(W.line_totals(self.sales), "line_totals")

    @cached_property
    def panel(self) -> DataFrame:
        return materialise(E.elasticity_panel(self.sales, self.t.products, self.t.reference_prices, self.folios, self.totals), "panel")

    @cached_property
    def elasticity(self) -> DataFrame:
        fit = E.elasticity_fast if self.fast else E.elasticity_by_parent
        return materialise(fit(self.panel), "elasticity")

    @cached_property
    def category_elasticity(self) -> DataFrame:
        """Per category; on the fast path the mean of its parents' slopes."""
        if not self.fast:
            return materialise(E.elasticity_by_category(self.panel), "category_elasticity")
        return self.elasticity.groupBy("brand", "primera_jerarquia", "segunda_jerarquia").agg(
            F.avg("elasticity").alias("elasticity"))

    def child_inputs(self) -> ChildInputs:
        t = self.t
        return ChildInputs(
            self.sales, t.products, t.stores, t.traffic, t.stock, t.costs, self.elasticity, t.official_prices,
            t.backorder, t.replenishment, t.weather, t.markdown_contribution, self.folios, self.totals)

    def child_features(self) -> DataFrame:
        return build_child_features(self.child_inputs())

    @cached_property
    def features(self) -> DataFrame:
        return materialise(self.child_features(), "features")

    @cached_property
    def parent_sales(self) -> DataFrame:
        """Sales per parent, store and week, of which stages and seasons are read."""
        return materialise(L.parent_weekly_sales(self.sales, self.t.products, self.totals), "parent_sales")

    @cached_property
    def lifecycle(self) -> DataFrame:
        return materialise(L.lifecycle_stage(self.parent_sales), "lifecycle")

    def seasons(self) -> DataFrame:
        return L.derive_season(self.parent_sales)

    @cached_property
    def sizes(self) -> DataFrame:
        return materialise(Z.size_availability_stock(self.t.stock, self.t.products), "sizes")

    def enhanced_features(self) -> DataFrame:
        df = H.enhance_features(self.features, self.elasticity, self.category_elasticity, self.lifecycle, self.sizes,
                                self.t.competitor_prices, self.seasons())
        return H.category_interactions(materialise(df, "enhanced_before_interactions"))

    @cached_property
    def enhanced(self) -> DataFrame:
        return materialise(self.enhanced_features(), "enhanced")

    def parent_features(self) -> DataFrame:
        weighted = R.weighted_size_features(self.t.stock, self.sales, self.t.products)
        return R.aggregate_to_parent(self.enhanced, self.t.products, weighted)

    @cached_property
    def parent(self) -> DataFrame:
        return materialise(self.parent_features(), "parent")

    def rows_for(self, weeks: DataFrame | None = None) -> DataFrame:
        scored = self.scores(self.parent)
        return A.pricing_rows(scored, self.t.products, self.t.stores, self.t.costs, self.t.rebates, self.elasticity, weeks)

    @cached_property
    def rows(self) -> DataFrame:
        return materialise(self.rows_for(), "pricing_rows")

    @cached_property
    def actions(self) -> DataFrame:
        return materialise(A.weekly_actions(self.rows), "actions")

    @cached_property
    def channel_actions(self) -> DataFrame:
        return materialise(CH.channel_actions(self.rows, self.actions, self.t.costs, self.elasticity), "channel_actions")

    @cached_property
    def history_rows(self) -> DataFrame:
        return materialise(self.rows_for(self.parent.select("brand", "week").distinct()), "history_rows")

    @cached_property
    def history(self) -> DataFrame:
        """Actions of every week, as past runs would have left them."""
        return materialise(A.weekly_actions(self.history_rows), "history")

    @cached_property
    def outcomes(self) -> DataFrame:
        decided = O.fixture_decisions(self.history)
        return materialise(O.outcomes(self.history, decided, self.t.transactions, self.t.products, self.t.costs), "outcomes")

    @cached_property
    def split(self) -> DataFrame:
        return materialise(ML.holdout_split(self.parent), "split")

    @cached_property
    def models(self) -> dict[str, ML.BrandModels]:
        """Models of every brand, trained on the weeks before its holdout."""
        return ML.train_brands(self.split.where("not is_holdout").drop("is_holdout"))

    @cached_property
    def holdout_scores(self) -> DataFrame:
        return materialise(ML.score_brands(self.split.where("is_holdout").drop("is_holdout"), self.models), "holdout_scores")

    def publish(self, store: StepStore) -> None:
        """Write the current week's steps into the store; a second run of the same week replaces them."""
        for name, step in {"features": self.current(self.features), "parent": self.current(self.parent), "sizes": self.current(self.sizes), "pricing_rows": self.rows,
                           "actions": self.actions, "channel_actions": self.channel_actions}.items():
            store.write(name, step)

    def current(self, step: DataFrame) -> DataFrame:
        """Rows of each brand's latest week."""
        last = step.groupBy("brand").agg(F.max("week").alias("week"))
        return step.join(F.broadcast(last), ["brand", "week"], "left_semi")
