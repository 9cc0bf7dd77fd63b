"""Nearest vectors by multi-index hashing: probing of code bytes, then the original vectors."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rebaja.llm.binary_codes import BYTES, DISTANCE, coded, unit
from rebaja.llm.common import U64

#: Rows of one index shard, and queries sent to it together: what one task holds.
SHARD, QUERIES = 8192, 4096


def least_apart(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Per vector of length one, for s = 0 to 8: a bound below the squared distance to any vector whose code differs by over s bits in every byte.

    A bit differs only across its plane, so the distance along the plane's normal is at least that of the vector from
    the plane. The bound adds up the s + 1 nearest planes of each byte and holds for every mean and every distribution.
    """
    planes = ((vectors - mean) @ projection) ** 2 / np.linalg.norm(projection, 2) ** 2  # normals may overlap below 64 dimensions
    sums = np.sort(planes.reshape(-1, BYTES, 8), axis=2).sum(axis=1).cumsum(axis=1)
    return np.column_stack([sums, np.full(len(sums), np.inf)])


class MultiIndex:
    """Eight tables, one for each byte of the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bytes_ = codes[:, None].view(np.uint8).reshape(-1, BYTES)
        self.order = [np.argsort(bytes_[:, k], kind="stable") for k in range(BYTES)]
        self.ends = [np.searchsorted(bytes_[o, k], np.arange(257)) for k, o in enumerate(self.order)]

    def probe(self, code: np.ndarray, flips: int) -> np.ndarray:
        """Rows with a byte exactly ``flips`` bits from that of the code. Over 0 to s flips this is every code within 8 s + 7 bits."""
        found = []
        for k, value in enumerate(np.array([code], U64).view(np.uint8)):
            for v in np.flatnonzero(DISTANCE[value] == flips).tolist():
                found.append(self.order[k][self.ends[k][v]:self.ends[k][v + 1]])
        return np.concatenate(found)


def search_shard(index: MultiIndex, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray, code: np.ndarray, uid: int, vector: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the ``k`` nearest of one shard and their cosines; the radius grows until no vector left can be as near (``least`` of ``least_apart``)."""
    seen = np.zeros(len(uids), bool)
    seen[uids == uid] = True
    rows, scores = np.array([], np.int64), np.array([])
    for flips in range(BYTES + 1):
        if 2 * np.count_nonzero(seen) > len(seen):
            new = np.flatnonzero(~seen)  # the rest at once
        else:
            new = index.probe(code, flips)
            new = np.unique(new[~seen[new]])
        seen[new] = True
        rows, scores = np.r_[rows, new], np.r_[scores, vectors[new] @ vector]
        best = np.lexsort((ids[rows], -scores))[:k]
        rows, scores = rows[best], scores[best]
        if seen.all() or len(rows) == k and least[flips] > 2 * (1 - scores[-1]) + 1e-9:
            break
    return rows, scores


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row of ``vectors`` where ``is_query``, itself left out.

    Rows are dealt to shards of about ``SHARD``, each with its own multi-index;
    queries go to every shard in blocks of about ``QUERIES``; the best of each
    shard are merged. Probing goes on in a shard until no vector left can be as
    near as the k-th best so far, if need be over the whole shard: no bucket or
    candidate list is cut, and the result is that of brute force. Vectors that are null, zero, not finite or
    of an unusual length take no part; of equal scores the smaller vec_id is nearer.
    """
    _, codes, (mean, projection, _) = coded(vectors, "search")
    asked = codes.where(is_query)
    shards, blocks = max(1, -(-codes.count() // SHARD)), max(1, -(-asked.count() // QUERIES))
    spread = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
    base = codes.withColumn("shard", spread(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))
    asks = asked.withColumn("block", spread(blocks).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("asks", F.lit(True)).select(*base.columns)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        own, queries = rows[~rows.asks], rows[rows.asks]
        out = []
        if len(own) and len(queries):
            stack = lambda r: unit(np.frombuffer(b"".join(r.vector), "<f8").reshape(len(r), -1))
            index, held = MultiIndex(own.code.to_numpy().view(U64)), stack(own)
            missing = np.iinfo(np.int64).max
            ids, uids = own.vec_id.fillna(missing).to_numpy(np.int64), own.uid.to_numpy()
            asking = stack(queries)
            for code, uid, vec_id, vector, least in zip(queries.code.to_numpy().view(U64), queries.uid, queries.vec_id, asking, least_apart(asking, mean, projection)):
                at, scores = search_shard(index, ids, uids, held, code, uid, vector, least, k)
                out += [(uid, vec_id, own.vec_id.iloc[i], s) for i, s in zip(at.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["uid", "query_id", "vec_id", "score"]).astype({"query_id": "Int64", "vec_id": "Int64"})

    found = base.unionByName(asks).groupBy("shard", "block").applyInPandas(search, "uid bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
