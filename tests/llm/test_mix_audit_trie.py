"""Source mix, filter audit and prefix trie against brute force, SQL and odd tables."""
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rebaja.llm import filter_audit, prefix_trie, source_mix
from rebaja.llm.queries import QUERIES, SQL
from rebaja.session import materialise

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.mark.parametrize("name, table", [("op12_filter_audit", "documents"), ("op13_prefix_trie", "conversations")])
def test_same_as_sql(spark, name, table):
    df, con = QUERIES[name](spark, SF), duckdb.connect()
    for view in (table, "labels"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    want = con.execute(SQL[name])
    assert [c[0] for c in want.description] == df.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))


# ---------------------------------------------------------------- mix

def water(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """Targets by giving the excess out again until none is above."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    target, free, left = {}, list(sizes), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > ceiling * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["aa", "b", "ccc"], k=rng.choice([0, 1, 5, 40, 900, 5000]))), rng.choice(["hot", "hot", "s1", "S2", "tiny", None, "é"]), 7) for i in range(150)]
    rows += [(999, "one two", "lone", 7), (None, "no id", "s1", 7), (5, None, "none", 7)] + [(77, "same row", "s1", 7)] * 4
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, at int").repartition(5)


def test_mix_meets_targets(spark, mixed):
    rows, df = mixed
    got = source_mix.mix_digest(df)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = got.collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(WORDS(t or ""))) for i, t, *_ in rows)
    sizes = defaultdict(int)
    for _, text, source, _ in sorted(rows, key=lambda r: (r[2] is None, (r[2] or "").encode())):
        sizes[source] += len(WORDS(text or ""))
    want = water({s: n for s, n in sizes.items()})
    by_size = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_size[r.source_size, round(r.target, 6)][0] += r.taken
    assert {k: v[0] for k, v in by_size.items()} == {(sizes[s], round(t, 6)): round(t) for s, t in want.items()}
    assert sorted(map(str, source_mix.mix_digest(df.repartition(3)).collect())) == sorted(map(str, got))


def test_mix_pieces_are_blocks_of_shards(spark, mixed):
    _, df = mixed
    laid, pieces = source_mix.mix(df, block=64, shard_words=4096)
    rows = pieces.collect()
    words = defaultdict(int)
    seen = set()
    for r in rows:
        words[r.shard, r.place] += r.length
        at = (r.source_no, r.epoch, r.at, r.start)
        assert at not in seen  # a word is drawn once an epoch
        seen.add(at)
    shards = sorted({s for s, _ in words})
    assert shards == list(range(len(shards))) and len(shards) > 20 and max(words.values()) <= 64
    sizes = [sum(s == shard for s, _ in words) for shard in shards]
    assert max(sizes) - min(sizes) <= 1
    # each shard has each source in about its share of the mix
    share = np.array([[sum(r.length for r in rows if r.shard == s and r.source_no == n) for n in range(1, 9)] for s in shards])
    big = share.sum(0).argmax()
    assert np.abs(share[:, big] / share.sum(1) - share[:, big].sum() / share.sum()).max() < 0.35
    texts = source_mix.mixed_texts(df, pieces).collect()
    assert {(r.shard, r.place): len(WORDS(r.text)) for r in texts} == dict(words)


def test_mix_of_nothing(spark, mixed):
    none = mixed[1].where("false")
    assert source_mix.mix_digest(none).count() == 0
    blank = spark.createDataFrame([(1, " \n", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in source_mix.mix_digest(blank).collect()] == [(0, 0.0, 0)] * 2


def test_permutation_and_law():
    for n in (1, 2, 7, 64, 1000):
        at = np.arange(n)
        out = source_mix.permuted(at, np.full(n, n), 99)
        assert sorted(out.tolist()) == at.tolist()
        assert (source_mix.permuted(out, np.full(n, n), 99, back=True) == at).all()
    rng = np.random.default_rng(1)
    draws = np.array([source_mix.hypergeometric(rng, 6 * 10**8, 14 * 10**8, 10**6) for _ in range(400)])
    sd = (10**6 * 0.3 * 0.7 * (1 - 10**6 / 2e9)) ** 0.5
    assert abs(draws.mean() - 3e5) < 6 * sd / 20 and 0.85 < draws.std() / sd < 1.15
    counts = np.array([5, 0, 100, 3])
    many = np.array([source_mix.split_node(counts, 54, (i,)) for i in range(600)])
    assert (many.sum(1) == 54).all() and (many <= counts).all() and np.abs(many.mean(0) - counts / 2).max() < 0.5


# ---------------------------------------------------------------- audit

def slow_audit(rows, quality, toxic):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = []
    for i, text, lang in rows:
        t, w = text or "", WORDS(text or "")
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", {k for k, v in bad.items() if v}, i in quality, i in toxic))
    out = []
    for part in sorted({d[0] for d in docs}):
        mine, total = [d for d in docs if d[0] == part], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [d for d in mine if f in d[1] and not d[1] & before]
                total[f] += len(gone)
                out.append([part, "".join(order), k + 1, sum(not d[1] & (before | {f}) for d in mine), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                            sum(d[2] for d in gone), sum(d[3] for d in gone), f])
        out = [[*r[:9], total[r[9]]] if r[0] == part else r for r in out]
    return sorted(map(tuple, out))


def test_audit_of_odd_rows(spark):
    rng = random.Random(8)
    pool = ["", None, "A B C", "x " * 300, "#", " ".join(f"w{i}" for i in range(150)), "É" * 20, "ONE " + " ".join(f"v{i}" for i in range(120)), "tab\x0bsep\x1cjoined " * 60]
    rows = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(120)] + [(3, "#", "en")] * 30 + [(50, " ".join(f"c{i}" for i in range(100)), "only clean")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(4, None, None), (None, 1, True), (7, 1, False), (7, 1, False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, fails string").repartition(4)
    lab = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(df, lab).collect()))
    assert got == slow_audit(rows, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t and i is not None})
    assert {r[0] for r in got} == {"", "de", "en", "only clean"} and len(got) == 4 * 600
    assert filter_audit.audit(df.where("false"), lab).count() == 0
    assert filter_audit.audit(df, lab.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_sends_no_set_or_label_through_the_driver(spark, monkeypatch):
    rows = [(i % 40, "A b $ " * (i % 7), "en" if i % 3 else "es") for i in range(60)] + [(None, "same", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = [(i, int(i % 4 == 0), int(i % 4 == 1)) for i in range(30)] + [(3, 1, 0), (None, 1, 1)]
    lab = materialise(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "labels")  # a file, whose size is known to the planner
    plans = {}

    def kept(out, name):
        plans[name] = out._jdf.queryExecution().sparkPlan().toString()
        return materialise(out, name)

    monkeypatch.setattr(filter_audit, "materialise", kept)
    got = sorted(map(tuple, filter_audit.audit(df, lab).collect()))
    assert got == slow_audit(rows, {i for i, q, _ in labels if q and i is not None}, {i for i, _, t in labels if t and i is not None})
    assert plans["audit-counts"].count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plans["audit-counts"]


# ---------------------------------------------------------------- trie

def slow_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        lead = sorted(own.get(c - int(np.fmod(c, 20)), []))[:h]
        seqs[c] = [(t[2], t[4]) for t in lead + sorted(own[c])[h:]]
    nodes, kids, memo, out = defaultdict(list), defaultdict(list), {}, []
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            nodes[tuple(seqs[c][:d])].append(c)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(nodes, key=len, reverse=True):
        memo[n] = (sum(memo[k][0] for k in kids[n]) or 1, (len(nodes[n]) - 1) * (len(WORDS(n[-1][1])) if n else 0) + sum(memo[k][1] for k in kids[n]))
        ends = ",".join(str(c) for c in nodes[n] if len(seqs[c]) == len(n))
        out.append((nodes[n][0], len(n), nodes[n[:-1]][0] if n else None, len(nodes[n]), len(kids[n]), *memo[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_of_odd_and_deep_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "", None, "c"])) for c in range(-30, 130) for t in range(rng.choice([0, 1, 2, 3, 5, 9]))]
    rows += [(200, t, "user", f"deep {t // 3}") for t in range(70)] + [(201, t, "user", f"deep {t // 3}" if t < 40 else "off") for t in range(60)]
    rows += [(300, None, "user", "x y z")] * 3 + [(300, 2, None, None), (None, 1, "user", "nobody's"), (10**12, 1, "u", "w " * 5000), (45, -1, "", "first")]
    rows += [(1000 + c, t, "user", "everyone says this") for c in range(150) for t in range(4)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(6)
    got = prefix_trie.trie_digest(df)
    assert sorted(map(tuple, got.collect()), key=str) == slow_trie(rows)
    assert prefix_trie.trie_digest(df.where("false")).columns == got.columns and prefix_trie.trie_digest(df.where("conv_id IS NULL")).count() == 0
    alone = spark.createDataFrame([(2, 1, "user", "a")], "conv_id long, turn long, role string, text string")  # crc32 of '2' is 1 mod 4: no turns are left
    assert sorted(map(tuple, prefix_trie.trie_digest(alone).collect()), key=str) == slow_trie([(2, 1, "user", "a")])


def test_fat_search_finds_the_deepest_node(spark):
    """Exit depths of new conversations against a scan of all nodes; handles are two-fattest numbers."""
    rng = random.Random(2)
    seqs = {c: [rng.choice("ab") for _ in range(rng.randrange(1, 30))] for c in range(200)}
    turns = spark.createDataFrame([(c, d, hash(x) % 1000, ord(x), 1) for c, s in seqs.items() for d, x in enumerate(s, 1)], "conv_id long, depth long, a long, b long, words long")
    walk = prefix_trie.walks(turns)
    ends = walk.groupBy("conv_id").agg(F.max("depth").alias("n"))
    trie = prefix_trie.build_trie(walk, ends.where("conv_id < 120"))
    for r in trie.collect():
        assert r.handle == max(range(r.low + 1, r.high + 1), key=lambda x: x & -x)
    known = [seqs[c] for c in range(120)]
    kids, stops = defaultdict(set), {tuple(s) for s in known}
    for s in known:
        for d, x in enumerate(s):
            kids[tuple(s[:d])].add(x)
    nodes = {p for p in {tuple(s[:d]) for s in known for d in range(len(s) + 1)} if len(kids[p]) > 1 or p in stops}
    want = {c: max([d for d in range(1, len(s) + 1) if tuple(s[:d]) in nodes], default=0) for c, s in seqs.items() if c >= 120}
    assert {r.conv_id: r.at for r in prefix_trie.locate(trie, walk, ends.where("conv_id >= 120")).collect()} == want
