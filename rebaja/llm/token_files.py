"""Token ids of documents in ORC files: run-length coded integers, row indexes and Bloom filters on the document id."""
from __future__ import annotations

import gc
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rebaja.llm.common import slices, texts
from rebaja.llm.wordcache import Library, PartCache, warm
from rebaja.session import shared_dir

END_ID = 2
SCHEMA = "doc_id bigint, part int, start bigint, n_tokens bigint, ids array<int>"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, row_stride: int = 1000, stripe_mb: int = 64) -> None:
    """Write one row per document to ORC files at ``path``, in ascending doc_id over the files in order.

    Each file is one range of doc_id. ``part`` is its number and ``start`` the
    count of ids before the document within it, so that places in the whole
    stream need the totals of the parts only. Rows of one doc_id are ordered by
    a hash of their text; a null doc_id comes first; a null or empty text has
    the end id alone. A doc_id that holds very many rows is spread over parts
    by the hash and by the place of the row in its input.
    """
    def encode(batches):
        gc.disable()  # many small objects, no cycles
        cache, part, before = warm((tokenizer, "token-files"), lambda: PartCache(Library(tokenizer, spaced=True), spaced=True, limit=600_000)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in slices(batches):
            ids = [cache(x) + end for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // 2 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            flat = np.frombuffer(b"".join(ids), "<u2").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(before + ends - sizes), pa.array(sizes), lists],
                                             names=["doc_id", "part", "start", "n_tokens", "ids"])
            before += int(sizes.sum())

    order = ["doc_id", "tie", "row"]
    dealt = texts(docs).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    sorted_rows = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    (sorted_rows.select("doc_id", "text").mapInArrow(encode, SCHEMA).write
     .option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(row_stride)).option("orc.stripe.size", str(stripe_mb << 20))
     .orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files, split by stripes; with ``doc_ids``, stripes and row groups without them are passed over."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document: its place in the stream of all ids, its length, and a checksum of its ids as stored."""
    def digest(batches):
        for batch in slices(batches, 4096):
            lists = batch.column(3)
            at, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(data[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                                             names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    # one row per file: a prefix sum over them, small enough to send to every task whatever the size of the table
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    found = rows.select("doc_id", "part", "start", "ids").mapInArrow(digest, "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write all of ``docs``, read the files back and describe each document from them."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/rebaja-tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer or vocabulary())
    return token_index(spark, path)
