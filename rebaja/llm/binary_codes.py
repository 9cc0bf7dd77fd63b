"""Learned binary codes: a rotation by iterative quantisation, signs as 64 bits."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rebaja.llm.common import U64, sampled, slices
from rebaja.session import materialise

BITS, BYTES = 64, 8
#: Documented bound of the sample that the rotation is fitted on. Every row is coded.
SAMPLE = 8192
#: For each byte its distance to every other.
DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])


def fit_rotation(sample: np.ndarray, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to 64) of vectors brought to length one: principal axes, then the rotation that brings them nearest to their signs.

    Of fewer than 64 dimensions several rotations are learned side by side.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    x = sample - mean
    axes = np.linalg.eigh(x.T @ x + 1e-12 * np.eye(d))[1][:, ::-1][:, :BITS]
    parts, width = [], axes.shape[1]
    for _ in range(-(-BITS // width)):
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        y = x @ axes
        for _ in range(rounds if len(sample) else 0):
            u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        parts.append(axes @ turn)
    return mean, np.concatenate(parts, axis=1)[:, :BITS]


def encode(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes of vectors of length one."""
    bits = (vectors - mean) @ projection >= 0
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(U64)


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of equal-length binary values as doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def coded(vectors: DataFrame, name: str) -> tuple[DataFrame, DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(all, usable, fit): all rows of ``vectors`` (vec_id, embedding) with a row number ``uid``; of the usable ones also the vector as doubles and its code.

    ``fit`` is the mean and projection of the codes, and the sample (of length one) they were fitted on.

    A vector that is null, zero, or holds a null or a non-finite component is
    not usable, nor is one whose length differs from that of most.
    """
    value = F.col("embedding").cast("array<double>")
    good = (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"), F.monotonically_increasing_id().alias("uid"))
    rows = materialise(rows, f"{name}-rows")
    usual = rows.where("good").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = usual["d"] if usual else 1
    usable = rows.where(F.col("good") & (F.size("embedding") == d))
    n = usable.count()
    sample = usable.where(sampled("uid", SAMPLE, n)).select("uid", "embedding").orderBy("uid").collect()
    sample = unit(np.array([r.embedding for r in sample], float).reshape(-1, d)) if sample else np.zeros((0, d))
    mean, projection = fit_rotation(sample)

    def code(batches):
        for batch in slices(batches, 4096):
            raw = np.asarray(batch.column(2).flatten(), float).reshape(-1, d)
            if not len(raw):
                continue
            rows_of = [r.tobytes() for r in raw.astype("<f8")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows_of, pa.binary()), pa.array(encode(unit(raw), mean, projection).view(np.int64))], names=["uid", "vec_id", "vector", "code"])

    return rows.select("uid", "vec_id"), materialise(usable.select("uid", "vec_id", "embedding").mapInArrow(code, "uid bigint, vec_id bigint, vector binary, code bigint"), f"{name}-codes"), (mean, projection, sample)
