"""Registered queries against DuckDB on the small tables. ``compare.py`` checks all of them."""
import pytest

from compare import compare, connect
from conftest import SF
from rebaja.plans import queries as Q

CHECKED = """weekly_sales price_features child_features elasticity_fast lifecycle_stage size_availability_stock enhanced_features parent_features
snap_prices weekly_actions_all_weeks channel_actions cross_store_alerts apply_decisions outcomes walk_forward_metrics""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, con, name):
    diff, _ = compare(spark, con, SF, name, Q.typed_sql(name))
    assert diff is None


def test_every_result_has_declared_types():
    assert set(Q.BUILDERS) == set(Q.RESULT_TYPES)
    assert set(Q.TEXTS) <= set(Q.BUILDERS)


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert {"sku", "centro", "week", "velocity_4w"} <= set(df.columns) and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_nested_loops(spark, run):
    for name in ("weekly_sales", "velocity_features", "lifecycle_stage", "parent_features", "channel_actions", "match_offers"):
        plan = Q.BUILDERS[name](run)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_price_scan_reads_only_its_columns(run):
    plan = Q.BUILDERS["column_pruned_read"](run)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<fecha:timestamp,centro:string,sku:string,cantidad:bigint,precio_final:double>" in plan and "PushedFilters: []" in plan
    assert "folio" not in plan and "descuento" not in plan
