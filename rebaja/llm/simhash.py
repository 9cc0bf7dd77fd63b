"""Near duplicates by SimHash: fingerprints meet at the anchors of a covering code.

A pair of fingerprints that differ in at most 3 of 64 bits differs in at most
one bit of its first or of its second half. Anchors of a half are the words of
the perfect code of 31 bits with one free bit: every half lies within 1 of its
home anchor (the covering radius). A half is sent to all anchors within the
radius plus the threshold left to it, 1 + 1 = 2, so it meets the home anchor of
every half at distance 1. That is 17 anchors a half at most; over all 64 bits
at once radius 1 and threshold 3 would need some ten thousand.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from rebaja.llm.common import U64, components, forest, free_name, slices, texts
from rebaja.session import materialise

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Rows of one anchor compared at once; an anchor with more is cut into blocks that meet each other in turn.
BLOCK = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = xxhash.xxh64_digest(joined, seed)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts, ends, digest = (ends - sizes)[: 1 - size].tolist(), ends[size - 1:].tolist(), xxhash.xxh64_digest
        hashes = b"".join([digest(joined[i:j], seed) for i, j in zip(starts, ends)])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = sum(np.unpackbits(bits[i:i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(bits), 65536))
    return int.from_bytes(np.packbits(counts * 2 > len(bits)).tobytes(), "big")


def _fingerprints(text):
    return text.map(lambda t: fingerprint(t or "")).astype("uint64").astype("int64")


fingerprint_column = F.pandas_udf(_fingerprints, T.LongType(), F.PandasUDFType.SCALAR)


# Syndromes of the 31-bit code: the one-bit error at place p (1 to 31) has syndrome p. For each syndrome,
# the error patterns of weight 1 and 2 that lead to a word of the code, the single one first.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
_ERRORS = [[0]] + [[1 << (s - 1)] + [1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, 32) if p < p ^ s and p != s] for s in range(1, 32)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of 32-bit words within distance 2: (row, anchor, whether it is the row's home)."""
    low, free = half & U64(0x7FFFFFFF), half & U64(0x80000000)
    syndrome = sum((np.bitwise_count(low & U64(c)).astype(np.int64) & 1) << k for k, c in enumerate(_CHECKS))
    rows, found, home = [], [], []
    for s in range(32):
        at = np.flatnonzero(syndrome == s)
        for k, error in enumerate(_ERRORS[s]):
            rows.append(at)
            found.append((low[at] ^ U64(error)) | free[at])
            home.append(np.full(len(at), k == 0))
        rows.append(at)  # the free bit turned, and at most one more
        found.append((low[at] ^ U64(_ERRORS[s][0])) | (free[at] ^ U64(0x80000000)))
        home.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _spread(batches):
    for batch in slices(batches, 8192):
        fp = batch.column(0).to_numpy().view(U64)
        for k, half in enumerate((fp & U64(0xFFFFFFFF), fp >> U64(32))):
            row, anchor, home = anchors(half)
            yield pa.RecordBatch.from_arrays([pa.array((anchor | U64(k << 32)).view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _linked(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each anchor (rows sorted by anchor) between a home fingerprint and any other."""
    a, b, at, step = [], [], np.arange(len(anchor)), 0
    while len(at):
        step += 1
        at = at[at + step < len(anchor)]
        at = at[anchor[at] == anchor[at + step]]
        near = at[(home[at] | home[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= THRESHOLD)]
        a.append(fp[near])
        b.append(fp[near + step])
    return forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)) if a else (np.array([], np.int64),) * 2


def _out(a, b, anchor=None, home=None):
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if b is not None else pa.nulls(n, pa.int64()),
                                       pa.array(anchor) if anchor is not None else pa.nulls(n, pa.int64()), pa.array(home) if home is not None else pa.nulls(n, pa.bool_())], names=["a", "b", "anchor", "home"])


def _compare(batches):
    """Links of sorted rows, as a spanning star per component of what is held; rows of a crowded anchor are handed on."""
    held = [np.array([], np.int64), np.array([], U64), np.array([], bool)]
    crowded = None
    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64), batch.column(2).to_numpy(zero_copy_only=False)]
        held = [np.concatenate(x) for x in zip(held, new)]
        if crowded is not None:
            n = np.searchsorted(held[0], crowded, "right")
            if n:
                yield _out(held[1][:n], None, held[0][:n], held[2][:n])
                held = [x[n:] for x in held]
        if len(held[0]) < 100_000:
            continue
        cut = np.searchsorted(held[0], held[0][-1])  # the last anchor may go on
        yield from _groups(*[x[:cut] for x in held])
        held = [x[cut:] for x in held]
        if len(held[0]) > BLOCK:
            crowded = held[0][0]
            yield _out(held[1], None, held[0], held[2])
            held = [x[:0] for x in held]
    if len(held[0]):
        yield from _groups(*held)


def _groups(anchor, fp, home):
    _, at, size = np.unique(anchor, return_inverse=True, return_counts=True)
    small = size[at] <= BLOCK
    if not small.all():
        yield _out(fp[~small], None, anchor[~small], home[~small])
    a, b = _linked(anchor[small], fp[small], home[small])
    if len(a):
        yield _out(a, b)


def _blocks(batches):
    """Rows of crowded anchors, sorted by (anchor, block) with the homes of the block first: every row meets them."""
    key, homes = None, []
    for batch in batches:
        anchor, block, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        edges = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])]).tolist() + [len(anchor)]
        for i, j in zip(edges[:-1], edges[1:]):
            if (anchor[i], block[i]) != key:
                key, homes = (anchor[i], block[i]), []
            own = fp[i:j][home[i:j]].view(U64)
            if len(own):
                homes.append(own)
            if not homes:
                continue
            base, rows = np.concatenate(homes), fp[i:j].view(U64)
            for k in range(0, len(rows), 512):
                x, y = np.nonzero(np.bitwise_count(rows[k:k + 512, None] ^ base[None]) <= THRESHOLD)
                a, b = rows[k + x], base[y]
                other = a != b
                if other.any():
                    yield _out(*forest(a[other].view(np.int64), b[other].view(np.int64)))


def near_fingerprints(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` to (node, component) of the links at ``THRESHOLD`` or fewer bits; roots are left out.

    Copies of a text share a fingerprint and count once here, so the work
    follows the number of different texts. Within an anchor only a spanning
    star leaves the task. An anchor with over ``BLOCK`` rows is met in blocks
    spread over tasks, without loss.
    """
    dealt = prints.mapInArrow(_spread, "anchor bigint, fp bigint, home boolean").repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = materialise(dealt.mapInArrow(_compare, "a bigint, b bigint, anchor bigint, home boolean"), "simhash-links")
    rest = found.where("anchor IS NOT NULL")
    n = rest.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    rest = rest.join(n, "anchor").withColumn("own", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
    met = rest.select("anchor", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.col("a").alias("fp"), "home", "own")
    met = met.select("anchor", "block", "fp", (F.col("home") & (F.col("own") == F.col("block"))).alias("home"))
    more = met.repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home")).mapInArrow(_blocks, "a bigint, b bigint, anchor bigint, home boolean")
    return components(found.where("anchor IS NULL").select("a", "b").unionByName(more.select("a", "b")), "simhash")


def near_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (fp, doc_id, ...) to (fp, root, component_id): the group, and the smallest doc_id of its rows. Groups of repeated ids can share the latter."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = near_fingerprints(prints.select("fp")).withColumnRenamed("node", "fp")
    placed = prints.join(groups, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return placed.join(lowest, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint as 16 hex digits, component_id.

    A null text is empty; texts without words share fingerprint zero and link
    like any other. Repeated doc_ids are separate rows. A null doc_id never
    names a component unless no row of it has an id.
    """
    rows = materialise(texts(docs).select("doc_id", fingerprint_column("text").alias("fp")), "simhash")
    return rows.join(near_groups(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest doc_id stays, of several such the first read."""
    fp, row = free_name(docs, "__fp"), free_name(docs, "__row")
    rows = materialise(docs.withColumn(fp, fingerprint_column(F.coalesce("text", F.lit("")))).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    keys = rows.select(F.col(fp).alias("fp"), F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"))
    best = keys.join(near_groups(keys), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    return rows.join(best.select(F.col("best.row").alias(row)), row, "left_semi").select(*docs.columns)
