"""Packing by lexical retrieval: documents that match a seed by BM25 fill its window."""
from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rebaja.llm.common import slices, texts
from rebaja.llm.wordcache import Library, PartCache, warm
from rebaja.session import materialise

WINDOW, END_ID, VOCABULARY = 2048, 1, 1 << 16
#: Ids of one shard of the index: a shard lives in one task.
SHARD_IDS = 1 << 19
K1, B = 1.2, 0.75
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_FULL = 1 << 62  # sequences of one whole window are numbered from here


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut(tokenizer: str, end_id: int):
    """Each document to its whole windows, done at once, and a tail of less than a window that waits for others."""
    def cut(batches):
        gc.disable()  # many small objects, no cycles
        cache, part, n = warm((tokenizer, "packing"), lambda: PartCache(Library(tokenizer, spaced=False), spaced=False)), TaskContext.get().partitionId(), 0
        rng = np.random.default_rng(11)
        mix = rng.integers(1, 1 << 63, VOCABULARY, dtype=np.int64)  # a random order of the vocabulary
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(cache(text), "<u2"), np.uint16(end_id))
                for at in range(0, len(ids) - WINDOW + 1, WINDOW):
                    rows.append((doc_id, at, WINDOW, _crc(ids[at:at + WINDOW]), len(ids), _FULL + (part << 32) + n, 0, None, None))
                    n += 1
                rest = ids[len(ids) // WINDOW * WINDOW:]
                if len(rest):
                    rows.append((doc_id, len(ids) - len(rest), len(rest), None, len(ids), None, None, rest.tobytes(), int(mix[rest].min())))
            kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in f"{PIECE}, ids binary, sign bigint".split(", ")])
    return cut


def term_counts(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tail, term, how often) of each term of each tail, by tail and term: one sort for all tails."""
    kind = np.uint32 if len(tails) <= 1 << 16 else np.uint64
    keys = np.repeat(np.arange(len(tails), dtype=kind) << kind(16), [len(t) for t in tails]) | np.concatenate([*tails, np.empty(0, "<u2")]).astype(kind)
    keys.sort()
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return (keys[at] >> kind(16)).astype(np.intp), (keys[at] & kind(0xFFFF)).astype(np.intp), np.diff(np.r_[at, len(keys)])


def _frequencies(batches):
    """Documents per id, summed inside the task."""
    df, n, total = np.zeros(VOCABULARY, np.int64), 0, 0
    for batch in slices(batches):
        tails = [np.frombuffer(data, "<u2") for data in batch.column(0).to_pylist()]
        df += np.bincount(term_counts(tails)[1], minlength=VOCABULARY)
        n, total = n + len(tails), total + sum(map(len, tails))
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, at]), pa.array(np.r_[n, total, df[at]])], names=["id", "n"])


class Shard:
    """BM25 inverted index of the tails of one shard, with the statistics of all tails."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        docs, ids, tf = term_counts(tails)
        told = idf[ids] > 0
        docs, ids, tf = docs[told], ids[told], tf[told]
        sizes = np.array([len(t) for t in tails])
        weights = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[docs] / mean))
        self.terms = np.split(ids, np.searchsorted(docs, np.arange(1, len(tails))))
        order = np.argsort(ids.astype("<u2"), kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        self.ends = np.cumsum(np.bincount(ids, minlength=VOCABULARY))
        self.starts = np.r_[0, self.ends[:-1]]
        self.n = len(tails)

    def scores(self, doc: int) -> np.ndarray:
        """Score of every tail of the shard with the terms of one as the query."""
        a, b = self.starts[self.terms[doc]], self.ends[self.terms[doc]]
        size = b - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.docs[at], self.weights[at], self.n).astype(float)  # whole numbers if no term tells


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (tail, from, to). A seed takes its unused neighbours, best first; the one that no longer fits is cut and its rest is the next seed."""
    index = Shard(tails, idf, mean)
    at = np.zeros(len(tails), np.int64)
    left = np.array([len(t) for t in tails])
    windows, nxt, seed = [], 0, None
    while True:
        if seed is None:
            while nxt < len(tails) and not left[nxt]:
                nxt += 1
            if nxt == len(tails):
                return windows
            seed = nxt
        score = index.scores(seed)
        score[seed] = np.inf
        free = np.flatnonzero(left)
        order = free[np.argsort(-score[free], kind="stable")]
        room, rows, seed = window, [], None
        for k in order.tolist():
            take = min(room, int(left[k]))
            rows.append((k, int(at[k]), int(at[k]) + take))
            at[k] += take
            left[k] -= take
            room -= take
            if not room:
                seed = k if left[k] else None
                break
        windows.append(rows)


def _pack(idf: np.ndarray, mean: float):
    def pack(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if not rows:
            return
        rows.sort(key=lambda r: (r[4], r[0] is None, r[0] or 0, r[1], r[3]))  # one order, however the rows came
        shard, tails = TaskContext.get().partitionId(), [np.frombuffer(r[3], "<u2") for r in rows]
        out = []
        for n, window in enumerate(pack_shard(tails, idf, mean)):
            offset = 0
            for k, i, j in window:
                doc_id, start, doc_tokens = rows[k][:3]
                out.append((doc_id, start + i, j - i, _crc(tails[k][i:j]), doc_tokens, (shard << 32) + n, offset))
                offset += j - i
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[f.split()[0] for f in PIECE.split(", ")])
    return pack


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """All ids of all whole texts in sequences of at most 2048, one row per piece.

    Whole windows of long documents are sequences of their own. The tails are
    dealt to shards by a MinHash of their ids, so that alike tails tend to
    meet, and by document within it, so that a frequent value is split; shards
    hold about ``shard_ids`` ids whatever the input. Document frequencies are
    those of all tails; what reaches the driver is one number per vocabulary
    entry. Only the last window of a shard may be short. A null or empty text
    is its end id alone; repeated doc_ids are separate documents.
    """
    cut = materialise(texts(docs).mapInArrow(_cut(tokenizer, end_id), f"{PIECE}, ids binary, sign bigint"), "packing")
    tails = cut.where("ids IS NOT NULL")
    told = {r.id: r.n for r in tails.select("ids").mapInArrow(_frequencies, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    n, total = told.pop(-1, 0), told.pop(-2, 0)
    df = np.zeros(VOCABULARY)
    df[list(told)] = list(told.values())
    idf = np.where(df > 0, np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))), 0)  # an id in over half of the tails says nothing
    shards = max(1, -(-total // shard_ids))
    dealt = tails.select("doc_id", "start", "doc_tokens", "ids", "sign").withColumn("tie", F.xxhash64("doc_id", "ids")).repartitionByRange(shards, "sign", "tie")
    packed = dealt.select("doc_id", "start", "doc_tokens", "ids", "sign").mapInArrow(_pack(idf, total / max(n, 1)), PIECE)
    return cut.where("ids IS NULL").select(*packed.columns).unionByName(packed)


def packing_pieces(docs: DataFrame) -> DataFrame:
    """``pack_documents`` with the public word-level vocabulary."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
