import numpy as np
import pytest
from pyspark.sql import functions as F

from rebaja.operators import lookups


def quantiles(spark, values_by_key, probs):
    rows = [(k, float(v)) for k, vs in values_by_key.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    return {r.k: r for r in lookups.exact_quantiles(df, ["k"], "v", probs).collect()}


def test_equals_numpy_with_one_hot_group(spark):
    rng = np.random.default_rng(3)
    data = {"hot": np.round(rng.lognormal(1, 1, 6000), 3), "ties": np.repeat([1.0, 2.0, 5.0], [50, 3, 47]), "one": [4.5],
            "two": [1.0, 2.0], "small": rng.normal(size=7)}
    probs = {"lo": 0.33, "mid": 0.5, "hi": 0.95, "top": 1.0, "bottom": 0.0}
    got = quantiles(spark, data, probs)
    for key, values in data.items():
        assert got[key].n == len(values)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), abs=1e-9), (key, name)


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "k string, v double")
    row = lookups.exact_quantiles(df, ["k"], "v", {"m": 0.5}).first()
    assert (row.n, row.m) == (2, 2.0)


def test_prefix_lookup_takes_the_longest(spark):
    skus = spark.createDataFrame([("A", "NI12-BLK-7"), ("A", "NI12"), ("A", "ZZ"), ("B", "NI12-BLK-7")], "brand string, sku string")
    keys = spark.createDataFrame([("A", "NI", 1.0), ("A", "NI12", 2.0), ("A", "NI12-BLK", 3.0)], "brand string, code string, v double")
    got = {(r.brand, r.sku): r.v for r in lookups.prefix_lookup(skus, keys, "sku", "code", "v").collect()}
    assert got == {("A", "NI12-BLK-7"): 3.0, ("A", "NI12"): 2.0}
    exact = {(r.brand, r.sku): r.v for r in lookups.prefix_lookup(skus, keys, "sku", "code", "v", True).collect()}
    assert exact == {("A", "NI12"): 2.0}


def test_join_sides_are_equi_joins(spark):
    skus = spark.range(10).select(F.lit("A").alias("brand"), F.concat(F.lit("NI"), "id").alias("sku"))
    keys = skus.select("brand", F.col("sku").alias("code"), F.lit(1.0).alias("v"))
    plan = lookups.prefix_lookup(skus, keys, "sku", "code", "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
