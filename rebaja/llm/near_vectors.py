"""Near-duplicate vectors: codes meet in multi-index Hamming tables, original vectors decide.

Two codes within 15 bits of each other lie within one bit in one of the eight
bytes at least, and most that are farther apart do too. How far apart pairs at
the very threshold lie depends on the vectors (a common mean widens the angle of
the codes), so it is read off pairs made at cosine 0.95 around the sampled rows.
If the tables miss over one pair in ten thousand, every pair is judged:
tables at two bits a byte would meet more pairs than there are.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rebaja.llm.binary_codes import BYTES, DISTANCE, coded, encode, vectors_of
from rebaja.llm.common import U64, components, forest
from rebaja.session import materialise

RADIUS, COSINE = 15, 0.95  # the radius that the tables hold without loss, and at least used
#: Share of pairs at the threshold that the tables may miss, and how many pairs it is read off.
MISS, MADE = 1e-4, 65_536
#: Vectors of one table cell held by a task; a fuller cell is cut into chunks that every vector near it meets in turn.
CELL = 8192
FOUND = "uid bigint, n bigint, root bigint"


def _bytes(code: np.ndarray) -> np.ndarray:
    return code[:, None].view(np.uint8).reshape(-1, BYTES)


def reach(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> int | None:
    """Radius of codes that holds pairs at ``COSINE`` around the sampled rows, or None if the byte tables do not.

    Partners lie in random directions and in those of differences of rows. Rows nearer the mean have wider angles;
    the misses are counted for each quarter of the rows by that distance, so that a cone is not hidden by the rest.
    """
    rng, widest = np.random.default_rng(7), RADIUS
    if not len(sample):
        return widest
    sample = np.resize(sample, (max(len(sample), 4096), sample.shape[1]))
    quarter = np.argsort(np.argsort(np.linalg.norm(sample - mean, axis=1), kind="stable")) * 4 // len(sample)
    code = encode(sample, mean, projection)
    for between_rows in (False, True):
        made, missed = np.zeros(4), np.zeros(4)
        for _ in range(-(-MADE // len(sample))):
            toward = sample[rng.integers(len(sample), size=len(sample))] - sample[rng.integers(len(sample), size=len(sample))] if between_rows else rng.standard_normal(sample.shape)
            toward = toward - np.einsum("ij,ij->i", toward, sample)[:, None] * sample
            length = np.linalg.norm(toward, axis=1)
            ok = length > 1e-9
            there = COSINE * sample[ok] + math.sqrt(1 - COSINE ** 2) * toward[ok] / length[ok, None]
            apart = DISTANCE[_bytes(code[ok]), _bytes(encode(there, mean, projection))]
            made += np.bincount(quarter[ok], minlength=4)
            missed += np.bincount(quarter[ok][apart.min(1) > 1], minlength=4)
            widest = max(widest, int(apart.sum(1, dtype=np.int64).max(initial=0)))
        if (missed > MISS * made).any():
            return None
    return widest


def _all_links(home: tuple, probe: tuple):
    """Ordered links (probe, home) of all pairs, in blocks."""
    step = max(1, 2_000_000 // len(home[0]))
    for i in range(0, len(probe[0]), step):
        x, y = np.nonzero(probe[2][i:i + step] @ home[2].T >= COSINE)
        x += i
        differ = probe[0][x] != home[0][y]
        yield x[differ], y[differ]


def _links(table: int, home: tuple, probe: tuple, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered links (probe, home) whose first table with bytes within one bit is this one. Each side: (uid, code, unit vectors)."""
    homes, probes = _bytes(home[1])[:, table], _bytes(probe[1])[:, table]
    order = np.argsort(homes, kind="stable")
    ends = np.searchsorted(homes[order], np.arange(257))
    a, b = [], []
    for value in np.unique(probes).tolist():
        at = np.flatnonzero(probes == value)
        near = np.concatenate([order[ends[v]:ends[v + 1]] for v in np.flatnonzero(DISTANCE[value] <= 1).tolist()])
        if not len(near):
            continue
        step = max(1, 2_000_000 // len(near))
        for i in range(0, len(at), step):
            rows = at[i:i + step]
            x, y = np.nonzero(np.bitwise_count(probe[1][rows][:, None] ^ home[1][near][None]) <= radius)
            x, y = rows[x], near[y]
            differ = probe[0][x] != home[0][y]
            x, y = x[differ], y[differ]
            apart = DISTANCE[_bytes(probe[1][x]), _bytes(home[1][y])] <= 1
            first = apart.argmax(1) == table
            x, y = x[first], y[first]
            for j in range(0, len(x), 20_000):
                xs, ys = x[j:j + 20_000], y[j:j + 20_000]
                ok = np.einsum("ij,ij->i", probe[2][xs], home[2][ys]) >= COSINE
                a.append(xs[ok])
                b.append(ys[ok])
    empty = np.array([], np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _compare(radius: int | None):
    def compare(batches):
        """Sorted cells: the vectors at home in a cell come first and are held, then all that are near it pass by."""
        from rebaja.llm.binary_codes import unit

        def told(table, home, probe):
            for x, y in _all_links(home, probe) if radius is None else [_links(table, home, probe, radius)]:
                if not len(x):
                    continue
                who, n = np.unique(x, return_counts=True)
                node, root = forest(probe[0][x], home[0][y])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[probe[0][who], node]), pa.array(np.r_[n, np.zeros(len(node), np.int64)]), pa.array(np.r_[np.full(len(who), -1), root])], names=["uid", "n", "root"])

        key, held = None, []
        pending: list = []

        def settle():
            nonlocal held
            if len(held) > 1:
                held = [tuple(np.concatenate(c) for c in zip(*held))]
            return held[0] if held else None

        for batch in batches:
            cell = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            home = batch.column(3).to_numpy(zero_copy_only=False)
            part = (batch.column(4).to_numpy(), batch.column(6).to_numpy().view(U64), unit(vectors_of(batch.column(5))))
            edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)]).tolist() + [len(cell)]
            for i, j in zip(edges[:-1], edges[1:]):
                if tuple(cell[i]) != key:
                    if pending and (own := settle()) is not None:
                        yield from told(int(key[0]), own, own)
                    key, held, pending = tuple(cell[i]), [], []
                n = int(home[i:j].sum())  # homes first
                if n:
                    held.append(tuple(c[i:i + n] for c in part))
                    pending = [True]
                if i + n < j:
                    if pending and (own := settle()) is not None:
                        yield from told(int(key[0]), own, own)
                    pending = []
                    if (own := settle()) is not None:
                        yield from told(int(key[0]), own, tuple(c[i + n:j] for c in part))
        if pending and (own := settle()) is not None:
            yield from told(int(key[0]), own, own)
    return compare


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors`` (vec_id, embedding).

    A cell of a table is the set of byte values that agree in the first ``t``
    bits, with ``t`` from the number of vectors, so that a cell holds about
    ``CELL``. A vector is at home in its cell of each of the eight tables and
    passes by the ``t`` cells one bit away. Every ordered pair is judged in one
    table only; what leaves a task are counts per vector and a spanning star
    of the links, never the links. Vectors that are null, zero, not finite or
    of an unusual length link with nothing. Repeated vec_ids are separate
    vectors; a null vec_id names a component only if all of it are null.
    """
    rows, codes, (mean, projection, sample) = coded(vectors, "near")
    radius = reach(sample, mean, projection)
    t = 0 if radius is None else min(8, max(0, math.ceil(math.log2(max(codes.count(), 1) / CELL))))
    byte = lambda k: F.shiftrightunsigned("code", 8 * k).bitwiseAND(255)  # noqa: E731  byte k of the little-endian code
    tables = codes.withColumn("at", F.explode(F.array(*[F.struct(F.lit(k).alias("table"), F.shiftright(byte(k), 8 - t).cast("int").alias("cell")) for k in range(1 if radius is None else BYTES)])))
    tables = tables.select("uid", "vector", "code", "at.table", "at.cell")
    # cells are at most 8 x 256, whatever the input
    chunks = tables.groupBy("table", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("chunks"))
    sent = tables.withColumn("to", F.explode(F.array(F.col("cell"), *[F.col("cell").bitwiseXOR(1 << b) for b in range(t)])))
    sent = sent.join(F.broadcast(chunks.withColumnRenamed("cell", "to")), ["table", "to"])
    own = F.pmod(F.xxhash64("uid"), F.col("chunks"))
    sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sent = sent.select("table", "to", "chunk", ((F.col("cell") == F.col("to")) & (own == F.col("chunk"))).alias("home"), "uid", "vector", "code")
    dealt = sent.repartition("table", "to", "chunk").sortWithinPartitions("table", "to", "chunk", F.desc("home"))
    found = materialise(dealt.mapInArrow(_compare(radius), FOUND), "near-links")
    counts = found.where("n > 0").groupBy("uid").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("n = 0").selectExpr("uid AS a", "root AS b"), "near").withColumnRenamed("node", "uid")
    placed = rows.join(counts, "uid", "left").join(roots, "uid", "left").withColumn("root", F.coalesce("component", "uid"))
    low = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return placed.join(low, "root").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
