"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from rebaja.session import materialise

U64 = np.uint64


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the whole ``text`` (null: empty); every other column is left behind, so names cannot clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def sampled(key: str | Column, wanted: int, total: int) -> Column:
    """True for about ``wanted`` of ``total`` rows, chosen by hash of ``key``.

    The share is held to 10^-12, so that it does not round to nothing where
    ``total`` is many billions.
    """
    hashed, digits = F.xxhash64(key), F.lit(1_000_000)
    place = F.pmod(hashed, digits) * digits + F.pmod(F.shiftright(hashed, 24), digits)
    return place < F.lit(int(1e12 * min(1.0, wanted / max(total, 1))))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that what a task holds besides one Arrow batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def light_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Short runs of rows of at most ``size`` bytes of ``column``, or of one longer row."""
    for batch in slices(batches, rows):
        ends, at = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def prefix_sums(values: Column, block: int = 64) -> Column:
    """Sums of the elements before each element of an integer array.

    Two levels (sums of blocks, then inside a block), so a text with very many
    matches costs no square of their number.
    """
    def running(array: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before"))
        zero = F.struct(start.cast("long").alias("sum"), F.array().cast("array<long>").alias("before"))
        return F.aggregate(array, zero, step, lambda acc: acc["before"])

    longs = values.cast("array<long>")
    n_blocks = F.floor((F.size(longs) + block - 1) / block).cast("int")
    blocks = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice(longs, i * block + 1, block))).otherwise(F.array().cast("array<array<long>>"))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), lambda b, start: running(b, start)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the links a[i]-b[i]: (node, smallest node), roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the links (a, b): (node, component), where component is the smallest node; roots are left out.

    Large-star and small-star steps until nothing changes, each round written to
    the shared folder. A round moves as many rows as there are links, whatever
    the degree of a node; no links or labels reach the driver.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a > b").distinct()

    def lowest(of: DataFrame) -> DataFrame:
        return of.groupBy("u").agg(F.min("v").alias("low"))

    links = materialise(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), f"{name}-links")
    seen = None
    while True:
        both = links.selectExpr("a AS u", "b AS v").unionByName(links.selectExpr("b AS u", "a AS v"))
        large = tidy(both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("a"), F.least("u", "low").alias("b")))
        down = large.selectExpr("a AS u", "b AS v")
        low = lowest(down)
        small = down.join(low, "u").where("v <> low").selectExpr("v AS a", "low AS b").unionByName(low.selectExpr("u AS a", "low AS b"))
        links = materialise(tidy(small), f"{name}-links")
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return links.selectExpr("a AS node", "b AS component")
        seen = state
