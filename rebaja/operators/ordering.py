"""Total orders, running values and lookups that spread a hot key over many tasks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja.session import materialise

#: A key with more than 1/HOT of the rows is looked up by broadcast; there are fewer than HOT such keys.
HOT = 1000
_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "bit_xor": lambda a, b: F.coalesce(a, F.lit(0).cast("long")).bitwiseXOR(b),
          "max": lambda a, b: F.greatest(a, b)}


def laid_out(df: DataFrame, order: Sequence[str | Column], name: str = "ordered") -> DataFrame:
    """``df`` written in the total order ``order``, with its range ``_part`` and the place ``_row`` inside it.

    Equal rows of the order are dealt by it as they come, so give an order
    that tells apart all rows that matter. ``df`` is planned twice (bounds are
    sampled first), so it should be a table.
    """
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    table = materialise(rows, name)
    return table.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def places(df: DataFrame, order: Sequence[str | Column], out: str = "place", name: str = "places") -> DataFrame:
    """``df`` with its place from 1 on in the total order: rows before its range, plus its row there. No task sees all rows."""
    rows = laid_out(df, order, name)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per range, so this window and the broadcast are bounded by the number of partitions
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[str, str]], name: str = "running") -> DataFrame:
    """``df`` with running values per key up to and with each row: ``values`` maps a column to (``sum``, ``bit_xor`` or ``max``; input).

    Rows are laid out by key and order. Inside a range a window runs over each
    key; a key that began in earlier ranges gets their total added. Only the
    first key of a range can have begun before, so there is one such total per
    range at most, whatever the keys. Keys must not be null.
    """
    keys, rows = list(keys), laid_out(df, [*keys, *order], name)
    within = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({c: getattr(F, f)(v).over(within) for c, (f, v) in values.items()})
    heads = F.broadcast(rows.where("_row = 0").select("_part", *keys))
    told = rows.join(F.broadcast(rows.where("_row = 0").select(*keys).distinct()), keys, "left_semi")
    totals = told.groupBy("_part", *keys).agg(*[getattr(F, f)(v).alias(f"_t_{c}") for c, (f, v) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_part", *keys, *[getattr(F, f)(f"_t_{c}").over(earlier).alias(f"_c_{c}") for c, (f, _) in values.items()]).join(heads, ["_part", *keys])
    out = local.join(F.broadcast(carry), ["_part", *keys], "left")
    return out.withColumns({c: _MERGE[f](F.col(f"_c_{c}"), F.col(c)) for c, (f, _) in values.items()}).drop("_part", "_row", *[f"_c_{c}" for c in values])


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with the one row that ``table`` has per key; both should be tables.

    Keys with more than 1/HOT of all rows are fewer than HOT: their rows stay
    where they are and meet a broadcast. All others are shuffled by the key.
    """
    on, n = list(on), rows.count()
    hot = F.broadcast(rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > n // HOT).select(*on))
    some = rows.join(hot, on, "left_semi").join(F.broadcast(table.join(hot, on, "left_semi")), on, how)
    rest = rows.join(hot, on, "left_anti").join(table.join(hot, on, "left_anti"), on, how)
    return some.unionByName(rest)
