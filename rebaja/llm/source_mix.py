"""Mixing sources to target weights: block quotas split among output shards by a multivariate-hypergeometric tree."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rebaja.operators.ordering import lookup, places, running
from rebaja.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and of an output shard.
BLOCK, SHARD = 256, 1 << 20
#: Halvings of the tree done in one task before its branches are dealt out again.
LEVELS = 5
SHARDS_A_TASK = 16
SEED = 20_011


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size): adds ``source_no`` from 1 in code point order (null last), and ``target``.

    The weights repeat along that order and share ``share`` of all words. A
    source whose part is above ``ceiling`` times its size gets that much, and
    the excess is shared anew by weight until none is above: one aggregate a
    round, two sums reach the driver. Stops after as many rounds as there are
    distinct bounds at most; few in practice.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = places(sizes, [F.col("source").asc_nulls_last()], "source_no", "mix-sources")
    rows = rows.withColumn("weight", F.element_at(cycle, ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))).withColumn("most", ceiling * F.col("source_size"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = before = 0.0
    while True:
        over = F.col("weight") * level >= F.col("most")
        stopped, free = rows.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, (share * total - stopped) / free if free else level
        if not level > before:
            break
    return rows.withColumn("target", F.least("most", F.col("weight") * level)).drop("weight", "most")


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permuted(at: np.ndarray, n: np.ndarray, key: int | np.ndarray, back: bool = False) -> np.ndarray:
    """Places ``at`` of a keyed permutation of 0..n-1 (``back``: its inverse): a Feistel network, walked until inside."""
    at, n = np.asarray(at, np.uint64).copy(), np.asarray(n, np.uint64)
    keys = np.broadcast_to(np.asarray(key, np.uint64) * np.uint64(8), at.shape)
    half = (np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(at))
    while len(todo):
        x, h, m, k = at[todo], half[todo], low[todo], keys[todo]
        left, right = x >> h, x & m
        for r in range(3, -1, -1) if back else range(4):
            if back:
                left, right = right ^ (_mixed(left, k + np.uint64(r)) & m), left
            else:
                left, right = right, left ^ (_mixed(right, k + np.uint64(r)) & m)
        at[todo] = left << h | right
        todo = todo[at[todo] >= n[todo]]
    return at.astype(np.int64)


def _key(source_no: int, epoch: int) -> int:
    return (SEED * 1_000_003 + source_no * 2 + epoch) & (1 << 59) - 1


def quotas(source_no: int, size: int, target: float, block: int = BLOCK) -> list[tuple[int, int, int, int]]:
    """Draws from a source: (epoch, its blocks, blocks drawn, words that the last draw has too many).

    Whole epochs take every block. The last one takes the first places of the
    permutation until the target is met and cuts the draw that goes past it,
    so a source gets its target to the word.
    """
    out, want, n = [], min(round(target), int(np.ceil(target))), -(-size // block)
    for epoch in range(-(-want // size) if size else 0):
        part = min(want - epoch * size, size)
        lacking, last = n * block - size, int(permuted(np.array([n - 1]), np.array([n]), _key(source_no, epoch), back=True)[0])
        drawn = -(-part // block)
        drawn += drawn * block - (lacking if drawn > last else 0) < part
        out.append((epoch, n, drawn, drawn * block - (lacking if drawn > last else 0) - part))
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good. Past the library's range by inversion over 12 deviations around the mean."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    share, n = good / (good + bad), good + bad
    mean, wide = drawn * share, 12 * (drawn * share * (1 - share) * (n - drawn) / n) ** 0.5 + 12
    low, high = max(0, drawn - bad, int(mean - wide)), min(good, drawn, int(mean + wide))
    k = np.arange(low, high, dtype=float)
    log = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))))])
    mass = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1]))


def split_node(counts: np.ndarray, left: int, seed: Sequence[int]) -> np.ndarray:
    """Of ``left`` blocks drawn from a node's, those of each colour."""
    rng, out, rest = np.random.default_rng(list(seed)), np.zeros(len(counts), np.int64), int(counts.sum())
    for i, have in enumerate(counts.tolist()):
        rest -= have
        out[i] = hypergeometric(rng, have, rest, left)
        left -= int(out[i])
    return out


CELL = "lo long, hi long, source_no long, epoch int, first long, n long"


def _grow(blocks: int, shards: int, levels: int):
    """A node (shards lo to hi) to its descendants ``levels`` halvings below."""
    upto = lambda shard: blocks * shard // shards

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source_no", "epoch"])
        colours = group[["source_no", "epoch"]].to_numpy()
        nodes = [(int(group.lo.iloc[0]), int(group.hi.iloc[0]), group["first"].to_numpy(), group.n.to_numpy())]
        for _ in range(levels):
            below = []
            for lo, hi, first, n in nodes:
                if hi - lo == 1:
                    below.append((lo, hi, first, n))
                    continue
                mid = (lo + hi) // 2
                left = split_node(n, upto(mid) - upto(lo), (SEED, lo, hi))
                below += [(lo, mid, first, left), (mid, hi, first + left, n - left)]
            nodes = below
        rows = [pd.DataFrame({"lo": lo, "hi": hi, "source_no": colours[:, 0], "epoch": colours[:, 1].astype(np.int32), "first": first, "n": n})[n > 0] for lo, hi, first, n in nodes]
        return pd.concat(rows)
    return grow


def _draws(sources, block):
    """Quota rows of the sources."""
    for batch in sources:
        rows = [(s, *q) for s, size, target in zip(batch.source_no, batch.source_size, batch.target) for q in quotas(int(s), int(size), float(target), block)]
        yield pd.DataFrame(rows, columns=["source_no", "epoch", "blocks", "n", "cut"])


def _blocks(cells):
    """Each cell (shard, colour, range of places) to the blocks at these places, some cells at a time."""
    for batch in cells:
        keys = np.array([_key(s, e) for s, e in zip(batch.source_no.tolist(), batch.epoch.tolist())], np.uint64)
        first, blocks, quota, cut = (batch[c].to_numpy() for c in ("first", "blocks", "quota", "cut"))
        for at in range(0, len(batch), 64):
            n = batch.n.to_numpy()[at:at + 64]
            cell = at + np.repeat(np.arange(len(n)), n)
            place = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + first[cell]
            block = permuted(place, blocks[cell], keys[cell])
            yield pd.DataFrame({"shard": batch.lo.to_numpy()[cell], "source_no": batch.source_no.to_numpy()[cell], "epoch": batch.epoch.to_numpy()[cell], "block": block,
                                "cut": np.where(place == quota[cell] - 1, cut[cell], 0)})


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, block: int = BLOCK, shard_words: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """All documents by source, and the mix as pieces of them.

    A source's documents, in the order of a hash, are one stream of words cut
    into blocks. Its target becomes a quota of blocks, exact to the word
    (``quotas``). A tree over the output shards splits the quotas: each node
    draws from the multivariate hypergeometric law how many blocks of each
    source its left half gets, so every shard has its fixed number of blocks
    and the sources in chance proportions. A shard owns a range of places of
    each source's permutation: draws are disjoint and need no exchange between
    shards. Inside a shard the blocks are shuffled.

    Pieces are (shard, place, source_no, epoch, block, doc_id, tie, at, start,
    length): ``length`` words of the document from word ``start``; the pieces
    of one (shard, place) are one block, in order of ``at``. Documents are (doc_id, tie, size, source_no, source_size,
    target, at), ``at`` being the place of the first word in the stream. A
    null text has no words; a null source is a source of its own, the last; a
    null doc_id is kept; repeated rows are separate documents; other columns
    are left behind; an empty table gives two empty ones. Same input, same mix.

    The vector of quotas of one tree node, a number per source, is held by a
    task; streams, blocks and pieces are spread by ranges and hashes, whatever
    the share of one source.
    """
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), "doc_id", "text").alias("tie")).withColumn("tag", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix-documents")
    sizes = rows.groupBy("tag", "source").agg(F.sum("size").alias("source_size"))
    sources = materialise(source_targets(materialise(sizes, "mix-sizes"), weights, share, ceiling), "mix-targets")
    every = lookup(rows.drop("source"), sources.drop("source"), ["tag"]).drop("tag")
    streams = running(materialise(every, "mix-told"), ["source_no"], ["tie", "doc_id", "size"], {"end": ("sum", "size")}, "mix-streams")
    laid = materialise(streams.withColumn("at", F.col("end") - F.col("size")).drop("end"), "mix-laid")

    colours = materialise(sources.select("source_no", "source_size", "target").mapInPandas(lambda b: _draws(b, block), "source_no long, epoch int, blocks long, n long, cut long"), "mix-quotas")
    total = colours.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total * block // shard_words))
    cells = colours.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "source_no", "epoch", F.lit(0).cast("long").alias("first"), "n")
    for _ in range(0, (shards - 1).bit_length(), LEVELS):
        cells = materialise(cells.groupBy("lo", "hi").applyInPandas(_grow(total, shards, LEVELS), CELL), "mix-tree")
    told = cells.join(colours.select("source_no", "epoch", "blocks", F.col("n").alias("quota"), "cut"), ["source_no", "epoch"])
    # a cell is a short row that unrolls to many blocks, so its bytes say nothing about the work: so many shards a task
    drawn = told.repartition(shards // SHARDS_A_TASK + 1, "lo").mapInPandas(_blocks, "shard long, source_no long, epoch int, block long, cut long")
    number = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "shard", "source_no", "epoch", "block"), "source_no", "epoch", "block"))
    drawn = drawn.withColumn("place", number)

    first = F.floor(F.col("at") / block)
    parts = laid.where("size > 0").withColumn("block", F.explode(F.sequence(first, F.floor((F.col("at") + F.col("size") - 1) / block))))
    began, ended = F.col("block") * block, F.least((F.col("block") + 1) * block, "source_size")
    met = drawn.join(parts, ["source_no", "block"]).withColumn("start", F.greatest(began - F.col("at"), F.lit(0)))
    length = F.least(F.col("size"), ended - F.col("cut") - F.col("at")) - F.col("start")
    pieces = met.withColumn("length", length).where("length > 0").select("shard", "place", "source_no", "epoch", "block", "doc_id", "tie", "at", "start", "length")
    return laid, pieces


def mixed_texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The blocks of a mix as text: (shard, place, text), words with one space between. Each document's words are cut once for all its pieces."""
    wanted = pieces.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("shard", "place", "at", "start", "length")).alias("pieces"))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), "text").alias("t"), "text").dropDuplicates(["d", "t"])
    words = texts.select("d", "t", F.explode(F.array(F.regexp_extract_all("text", F.lit(WORD), 0))).alias("words"))
    met = wanted.join(words, wanted["doc_id"].eqNullSafe(words["d"]) & (wanted["tie"] == words["t"]))
    cut = met.select(F.explode(F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["place"].alias("place"), p["at"].alias("at"), F.array_join(F.slice(
        F.col("words"), (p["start"] + 1).cast("int"), p["length"].cast("int")), " ").alias("text")))).alias("p")).select("p.*")
    # pieces of a block: no more than its words
    return cut.groupBy("shard", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), " ").alias("text"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and how many of its words the mix takes, repeats counted."""
    laid, pieces = mix(docs)
    told = ["doc_id", "size", "source_size", "target"]
    taken = pieces.select("source_no", "at", "length").unionByName(laid.where("size > 0").select("source_no", "at", F.lit(0).cast("long").alias("length"))).groupBy("source_no", "at").agg(F.sum("length").alias("taken"))
    some = laid.where("size > 0").join(taken, ["source_no", "at"]).select(*told, "taken")
    return some.unionByName(laid.where("size = 0").select(*told, F.lit(0).cast("long").alias("taken")))
