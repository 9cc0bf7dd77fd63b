"""A Z-fast trie of conversations: compacted nodes hashed at two-fattest depths, exits found by fat binary search, inserts in batches.

Every conversation is a sequence of turns (role, text). The prefix of its first
d turns is named by a 128-bit value, the XOR over the turns of a hash of
(position, role, text), so names are running values that ranges of turns can
compute apart. All tables are keyed by these names or by (conv_id, depth);
no conversation, node or group of equal conversations is gathered in a task.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja.llm.common import slices
from rebaja.operators.ordering import lookup, running
from rebaja.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Batches of insertion: hash classes of conv_id out of 16, by their upper ends.
BATCHES = (1, 4, 16)
#: Turns of an edge, or conv_ids of a list, that one row stands for at most.
RUN = 4096


def _turns(messages: DataFrame) -> DataFrame:
    """(conv_id, i, a, b, words): turns by number (null first), then role and text; a, b: 128-bit symbol of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = messages.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), role.alias("role"), F.sha2(text, 256).alias("sha"), F.lit(1).cast("long").alias("one"))
    ordered = running(materialise(rows, "trie-messages"), ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "sha", "a", "b"], {"i": ("sum", "one")}, "trie-turns")
    return materialise(ordered.select("conv_id", "i", "a", "b", "words"), "trie-numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, base, h, k), and their rebuilt turns (conv_id, depth, a, b, words): the first h of conversation c - c % 20, then own ones after the first h."""
    sizes = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    convs = sizes.select("conv_id", "n", F.expr("conv_id - conv_id % 20").alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = materialise(convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv_id", "base", "h", "k"), "trie-conversations")
    heads = turns.where("i <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "i", "a", "b", "words")
    lead = convs.where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).join(heads, ["base", "i"]).select("conv_id", F.col("i").alias("depth"), "a", "b", "words")
    own = lookup(turns, convs, ["conv_id"]).where("i > h").select("conv_id", (F.col("i") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "words")
    return convs, lead.unionByName(own)


def walks(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, total, words): names of the prefix with and without its last turn, words up to and in it."""
    z = [F.xxhash64(F.lit(k), "depth", "a", "b").alias(f"z{k}") for k in (1, 2)]
    rows = materialise(turns.select("conv_id", "depth", "words", *z), "trie-rebuilt")
    summed = running(rows, ["conv_id"], ["depth"], {"p1": ("bit_xor", "z1"), "p2": ("bit_xor", "z2"), "total": ("sum", "words")}, "trie-walks")
    return materialise(summed.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("z1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("z2")).alias("q2"), "total", "words"), "trie-named")


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", high, F.length(F.bin(low.bitwiseXOR(high))) - 1), F.length(F.bin(low.bitwiseXOR(high))) - 1)


def locate(trie: DataFrame, walk: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, n, at): depth of the deepest node of the trie on the path of each conversation (conv_id, n turns), by fat binary search.

    Each round every conversation still searching between depths ``at`` and
    ``upto`` asks the dictionary once, at the two-fattest depth between. A node
    whose name holds as well moves ``at`` down to it; one whose handle alone
    holds ends the search at its parent; none moves ``upto`` up. Rounds: the
    logarithm of the longest conversation.
    """
    state = materialise(ends.select("conv_id", "n", F.lit(0).cast("long").alias("at"), F.col("n").alias("upto")), "trie-search")
    names = walk.select("conv_id", "depth", "p1", "p2")
    handles = trie.select(F.col("handle").alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), "low", "high", "e1", "e2")
    while state.where("at < upto").limit(1).count():
        asked = state.where("at < upto").withColumn("depth", two_fattest(F.col("at"), F.col("upto")))
        found = asked.join(names, ["conv_id", "depth"]).join(handles, ["depth", "p1", "p2"], "left").select("conv_id", "n", "at", "upto", F.col("depth").alias("f"), "low", "high", "e1", "e2")
        reach = names.select("conv_id", F.col("depth").alias("high"), "p1", "p2")
        told = found.join(reach, ["conv_id", "high"], "left").withColumn("holds", F.coalesce((F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2")), F.lit(False)))
        at = F.when(F.col("holds"), F.col("high")).when(F.col("high").isNotNull(), F.col("low")).otherwise(F.col("at"))
        upto = F.when(F.col("holds"), F.greatest("upto", "high")).when(F.col("high").isNotNull(), F.col("low")).otherwise(F.col("f") - 1)
        state = materialise(state.where("at >= upto").unionByName(told.select("conv_id", "n", at.alias("at"), upto.alias("upto"))), "trie-search")
    return state.select("conv_id", "n", "at")


EDGE = ["low", "high", "e1", "e2", "l1", "l2", "s1", "s2", "handle", "h1", "h2", "rep"]


def _chunks(df: DataFrame, low: str, high: str) -> DataFrame:
    """A row per ``depth`` in (low, high], unrolled in runs so that no long array is made."""
    runs = df.where(f"{high} > {low}").withColumn("run", F.explode(F.sequence(F.col(low) + 1, F.col(high), F.lit(RUN).cast("long"))))
    return runs.withColumn("depth", F.explode(F.sequence("run", F.least(F.col("run") + RUN - 1, F.col(high))))).drop("run")


def insert(trie: DataFrame | None, walk: DataFrame, found: DataFrame) -> DataFrame:
    """The trie with the conversations (conv_id, n, at) added whose deepest node in it is at depth ``at``.

    Turns beyond that node are new. Edges that begin with the same turn as new
    ones are unrolled along a conversation that has them; names that then have
    several continuations or an end are nodes, and each node's edge reaches up
    to the node before it on the path of its smallest conversation.
    """
    new = walk.join(found, "conv_id").where("depth > at").select("conv_id", F.col("at").alias("from"), "depth", "p1", "p2", "q1", "q2", (F.col("depth") == F.col("n")).alias("stop"))
    kept = None
    if trie is not None:
        starts = new.where("depth = from + 1").select("depth", F.col("p1").alias("s1"), F.col("p2").alias("s2")).distinct()
        on = [trie["low"] + 1 == starts["depth"], trie["s1"] == starts["s1"], trie["s2"] == starts["s2"]]
        kept = trie.join(starts, on, "left_anti")
        cut = _chunks(trie.join(starts, on, "left_semi").select("low", "high", F.col("rep").alias("conv_id")), "low", "high").join(walk, ["conv_id", "depth"])
        new = new.unionByName(cut.select("conv_id", F.col("low").alias("from"), "depth", "p1", "p2", "q1", "q2", (F.col("depth") == F.col("high")).alias("stop")))
    new = materialise(new, "trie-new")
    names = new.groupBy("depth", "p1", "p2", "q1", "q2").agg(F.min("conv_id").alias("rep"), F.max("stop").alias("stop"))
    kids = names.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("kids"))
    nodes = names.join(kids, ["depth", "p1", "p2"], "left").where("stop OR kids > 1").select("depth", "p1", "p2", "rep")
    nodes = materialise(nodes, "trie-nodes")
    # along the path of a node's smallest conversation; a path with very many nodes streams through the window in order
    paths = new.select("conv_id", "from", "depth", "p1", "p2").join(nodes.select("rep").distinct().withColumnRenamed("rep", "conv_id"), "conv_id", "left_semi").join(nodes, ["depth", "p1", "p2"], "left_semi")
    above = F.lag("depth").over(Window.partitionBy("conv_id", "from").orderBy("depth"))
    low = paths.withColumn("low", F.coalesce(above, "from")).select(F.col("conv_id").alias("rep"), "low", "depth", "p1", "p2").join(nodes, ["rep", "depth", "p1", "p2"], "left_semi")
    edges = low.select("rep", "low", F.col("depth").alias("high"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), two_fattest(F.col("low"), F.col("depth")).alias("handle"))
    first = walk.select(F.col("conv_id").alias("rep"), (F.col("depth") - 1).alias("low"), F.col("q1").alias("l1"), F.col("q2").alias("l2"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    hand = walk.select(F.col("conv_id").alias("rep"), F.col("depth").alias("handle"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    edges = edges.join(first, ["rep", "low"]).join(hand, ["rep", "handle"]).select(*EDGE)
    return materialise(edges if kept is None else kept.select(*EDGE).unionByName(edges), "trie-edges")


def build_trie(walk: DataFrame, ends: DataFrame) -> DataFrame:
    """Compacted trie of the conversations (conv_id, n turns) with turns: an edge (low, high], its end name e, parent name l, first name s, handle and its name h, per node."""
    trie, before = None, 0
    for upto in BATCHES:
        part = F.pmod(F.xxhash64("conv_id"), F.lit(BATCHES[-1]))
        batch = ends.where((part >= before) & (part < upto) & (F.col("n") > 0))
        found = batch.select("conv_id", "n", F.lit(0).cast("long").alias("at")) if trie is None else locate(trie, walk, batch)
        trie, before = insert(trie, walk, found), upto
    return trie


def _subtree(values: DataFrame, jumps: list[DataFrame], sums: dict[str, str]) -> DataFrame:
    """Values of nodes (e1, e2) merged over their subtrees: after round k a node has those less than 2^k below it."""
    for jump in jumps:
        below = jump.join(values, ["e1", "e2"]).groupBy("u1", "u2").agg(*[getattr(F, f)(c).alias(f"_{c}") for c, f in sums.items()])
        both = values.join(below.withColumnsRenamed({"u1": "e1", "u2": "e2"}), ["e1", "e2"], "left")
        merge = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) if f == "sum" else F.least(c, f"_{c}") for c, f in sums.items()}
        values = materialise(both.select("e1", "e2", *[m.alias(c) for c, m in merge.items()]), "trie-sums")
    return values


def _jumps(trie: DataFrame) -> list[DataFrame]:
    """Ancestors 1, 2, 4, ... nodes up, until there are none; the root is named (0, 0)."""
    out, up = [], materialise(trie.select("e1", "e2", F.col("l1").alias("u1"), F.col("l2").alias("u2")), "trie-up")
    while up.limit(1).count():
        out.append(up)
        higher = up.select(F.col("e1").alias("u1"), F.col("e2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        up = materialise(lookup(up, higher, ["u1", "u2"]).select("e1", "e2", F.col("v1").alias("u1"), F.col("v2").alias("u2")), "trie-up")
    return out


def _lists(ends: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256): SHA-256 of the ascending conv_ids of each name. Runs of ids are joined apart; a list's runs, not its ids, meet in one task."""
    def join(batches):
        for batch in batches:
            for part in slices([batch], RUN):
                e1, e2, ids = (c.to_pylist() for c in part.columns)
                rows, at = [], 0
                for i in range(1, len(ids) + 1):
                    if i == len(ids) or e1[i] != e1[at] or e2[i] != e2[at]:
                        rows.append((e1[at], e2[at], ids[at], ",".join(map(str, ids[at:i]))))
                        at = i
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (*[pa.int64()] * 3, pa.string()))], names=["e1", "e2", "first", "ids"])

    def digest(batches):
        key, sha = None, None
        done: list = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], names=["e1", "e2", "ends_sha256"])
            done.clear()
            return out

        for batch in batches:
            for e1, e2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (e1, e2) != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (e1, e2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(done) >= RUN:
                yield flush()
        if key is not None:
            done.append((*key, sha.hexdigest()))
            yield flush()

    order = ["e1", "e2", "conv_id"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "e1 long, e2 long, first long, ids string")
    return runs.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first").mapInArrow(digest, "e1 long, e2 long, ends_sha256 string")


def trie_nodes(convs: DataFrame, walk: DataFrame) -> DataFrame:
    """Every node of the trie of all conversations, its edges unrolled to one row per depth."""
    last = walk.groupBy("conv_id").agg(F.max_by(F.struct("depth", "p1", "p2"), "depth").alias("last"))
    zero = F.lit(0).cast("long")
    ends = materialise(convs.select("conv_id").join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.depth", zero).alias("n"), F.coalesce("last.p1", zero).alias("e1"), F.coalesce("last.p2", zero).alias("e2")), "trie-ends")
    if not ends.limit(1).count():
        return ends.select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in RESULT)])
    trie = build_trie(walk, ends)
    jumps = _jumps(trie)
    # a node that has no edge below it is childless; every childless node is the end of a conversation
    kids = trie.groupBy(F.col("l1").alias("e1"), F.col("l2").alias("e2")).agg(F.count("*").alias("n_children"))
    root = ends.sparkSession.range(1).select(zero.alias("e1"), zero.alias("e2"))
    every = trie.select("e1", "e2").unionByName(root)
    here = ends.groupBy("e1", "e2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("member"))
    own = every.join(kids, ["e1", "e2"], "left").join(here, ["e1", "e2"], "left").select(
        "e1", "e2", F.coalesce("n_convs", zero).alias("n_convs"), "member", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"))
    told = _subtree(materialise(own, "trie-own"), jumps, {"n_convs": "sum", "member": "min", "n_leaves": "sum"})
    bottom = walk.select(F.col("conv_id").alias("rep"), F.col("depth").alias("high"), F.col("total").alias("w_high"))
    top = walk.select(F.col("conv_id").alias("rep"), (F.col("depth") - 1).alias("low"), (F.col("total") - F.col("words")).alias("w_low"))
    edges = materialise(trie.join(bottom, ["rep", "high"]).join(top, ["rep", "low"]).join(told, ["e1", "e2"]).join(kids, ["e1", "e2"], "left")
                        .withColumn("saved", (F.col("n_convs") - 1) * (F.col("w_high") - F.col("w_low"))), "trie-told")
    saved = _subtree(materialise(edges.select("e1", "e2", "saved").unionByName(root.withColumn("saved", zero)), "trie-saved"), jumps, {"saved": "sum"})
    parents = told.select(F.col("e1").alias("l1"), F.col("e2").alias("l2"), F.col("member").alias("above"))
    full = materialise(edges.join(saved.select("e1", "e2", F.col("saved").alias("under")), ["e1", "e2"]).withColumn("below", F.col("under") - F.col("saved"))
                       .select("e1", "e2", "l1", "l2", "low", "high", "member", "n_convs", "n_children", "n_leaves", "w_high", "below"), "trie-full")
    full = lookup(full, parents, ["l1", "l2"])
    lists = _lists(ends)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    steps = _chunks(full.withColumn("conv_id", F.col("member")), "low", "high").join(walk.select("conv_id", "depth", (F.col("total") - F.col("words")).alias("w_before")), ["conv_id", "depth"])
    end = F.col("depth") == F.col("high")
    inner = steps.select("conv_id", "depth", F.when(F.col("depth") == F.col("low") + 1, F.col("above")).otherwise(F.col("member")).alias("parent_conv_id"), "n_convs",
                         F.when(end, F.coalesce("n_children", zero)).otherwise(1).cast("long").alias("n_children"), "n_leaves",
                         ((F.col("n_convs") - 1) * (F.col("w_high") - F.col("w_before")) + F.col("below")).alias("saved_tokens"), F.when(end, F.col("e1")).alias("e1"), F.when(end, F.col("e2")).alias("e2"))
    top = told.where("e1 = 0 AND e2 = 0").join(saved, ["e1", "e2"]).join(kids, ["e1", "e2"], "left").select(
        F.col("member").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        F.col("saved").alias("saved_tokens"), "e1", "e2")
    rows = inner.where("e1 IS NOT NULL").unionByName(top).join(lists, ["e1", "e2"], "left").drop("e1", "e2").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return inner.where("e1 IS NULL").drop("e1", "e2").withColumn("ends_sha256", empty).unionByName(rows)


RESULT = ("conv_id long", "depth long", "parent_conv_id long", "n_convs long", "n_children long", "n_leaves long", "saved_tokens long", "ends_sha256 string")


def trie_digest(messages: DataFrame) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations.

    Null roles and texts are empty; turns with one number are ordered by role
    and text hash; rows without a conv_id belong to no conversation and are
    left out; repeated rows are turns of their own; other columns are left
    behind; no conversations, no nodes (not even the root).
    """
    convs, turns = rebuilt(_turns(messages))
    return trie_nodes(convs, walks(turns))


#: Every prefix of every conversation by name, each node counted for all its prefixes. The checksum of conv_id goes bit by bit.
SQL = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
               FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, max(i) AS own, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for x in string_split(conv_id::VARCHAR, '')])),
          lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) % 4 AS h FROM turns GROUP BY conv_id),
led AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS k FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
built AS (SELECT c.conv_id, t.i AS depth, role, text FROM led c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
          UNION ALL SELECT c.conv_id, t.i - c.h + c.k, role, text FROM led c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
prefixes AS (SELECT conv_id, 0 AS depth, '' AS name, 0 AS words FROM convs
             UNION ALL SELECT conv_id, depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM built),
nodes AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends
          FROM (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM prefixes) GROUP BY name, depth),
kids AS (SELECT substr(name, 1, 64 * (depth - 1)::INT) AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (name)),
under AS (SELECT substr(name, 1, (64 * d)::INT) AS name, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM told) GROUP BY 1)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
FROM told t JOIN under USING (name) LEFT JOIN nodes p ON t.depth > 0 AND p.name = substr(t.name, 1, 64 * (t.depth - 1)::INT)"""
