"""A weekly run from entity folders: same features as from the source tables, service SKUs left out, brands pruned."""
from pyspark.sql import functions as F

from rebaja import constants as C
from rebaja.plans.weekly_run import WeeklyRun
from rebaja.sources.folders import EntityFolders, write_entities
from rebaja.sources.tables import ENTITIES


class WithBags:
    """The given tables, where a service SKU is sold with every hundredth line or so."""

    def __init__(self, tables):
        self.tables = tables

    def __getattr__(self, entity):
        df = getattr(self.tables, entity)
        if entity == "transactions":
            bags = df.where(F.pmod(F.xxhash64("folio", "sku"), F.lit(100)) == 0).withColumn("sku", F.lit(C.SERVICE_SKUS[1]))
            return df.unionByName(bags)
        return df


def test_run_from_folders(spark, run, tmp_path):
    root = str(tmp_path)
    write_entities(WithBags(run.t), root)
    folders = EntityFolders(spark, root)
    assert all(set(getattr(folders, e).columns) == set(s.fieldNames()) for e, s in ENTITIES.items())
    assert folders.transactions.where(F.col("sku").isin(C.SERVICE_SKUS)).count() > 0
    again = WeeklyRun(folders)
    assert again.features.where(F.col("sku").isin(C.SERVICE_SKUS)).count() == 0
    assert again.features.count() == run.features.count() and again.lifecycle.count() == run.lifecycle.count()
    sums = ["units_sold", "velocity_4w", "stock_on_hand", "open_qty" if "open_qty" in run.features.columns else "units_sold"]
    total = [f.agg(*[F.round(F.sum(c), 4) for c in sums]).first() for f in (run.features, again.features)]
    assert total[0] == total[1]


def test_brands_prune_folders(spark, run, tmp_path):
    write_entities(run.t, str(tmp_path), ["costs", "stores"])
    brand = run.t.costs.agg(F.min("brand")).first()[0]
    one = EntityFolders(spark, str(tmp_path), [brand])
    assert {r.brand for r in one.costs.select("brand").distinct().collect()} == {brand}
    assert "PartitionFilters: [" in (plan := one.costs._jdf.queryExecution().executedPlan().toString()) and "brand#" in plan.split("PartitionFilters: [")[1][:40]
    assert one.stores.count() == run.t.stores.count()
