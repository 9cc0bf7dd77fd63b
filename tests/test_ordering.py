"""Total orders, running values and lookups against plain Python, with a hot key."""
import itertools
import random

import pytest

from rebaja.operators.ordering import lookup, places, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.4 else rng.choice("abc"), i, rng.randrange(1000)) for i in range(5000)]
    return data, spark.createDataFrame(data, "k string, i long, v long").repartition(7)


def test_places_number_the_whole_order(spark, rows):
    data, df = rows
    got = {r.i: r.place for r in places(df, ["v", "i"]).collect()}
    assert got == {i: n for n, (_, i, _) in enumerate(sorted(data, key=lambda r: (r[2], r[1])), 1)}
    assert places(df.where("false"), ["v", "i"]).count() == 0


def test_running_values_cross_ranges(spark, rows):
    data, df = rows
    out = running(df, ["k"], ["i"], {"s": ("sum", "v"), "x": ("bit_xor", "v"), "m": ("max", "v")})
    got = {(r.k, r.i): (r.s, r.x, r.m) for r in out.collect()}
    want = {}
    for k, group in itertools.groupby(sorted(data), key=lambda r: r[0]):
        s = x = m = 0
        for _, i, v in group:
            s, x, m = s + v, x ^ v, max(m, v)
            want[k, i] = (s, x, m)
    assert got == want


def test_lookup_is_a_join(spark, rows):
    data, df = rows
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("unused", 3)], "k string, w int")
    assert sorted(map(tuple, lookup(df, table, ["k"]).select("k", "i", "v", "w").collect())) == sorted(map(tuple, df.join(table, "k").select("k", "i", "v", "w").collect()))
    left = lookup(df, table, ["k"], "left")
    assert left.count() == len(data) and left.where("w is null").count() == sum(k in "bc" for k, _, _ in data)
    assert lookup(df.where("false"), table, ["k"]).count() == 0
