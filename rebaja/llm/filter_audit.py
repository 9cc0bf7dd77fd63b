"""How filters interact: one id table per filter, anti and semi joins against the ids that earlier filters remove."""
from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from rebaja.operators.ordering import lookup
from rebaja.session import materialise, shared_dir

WORD, MARKS = r"[^\x20\x09-\x0D]+", "[#$%&*|]"
NAMES = "ABCDE"


def text_filters() -> dict[str, Column]:
    """Failure conditions on ``text`` alone, by letter."""
    words, size = F.regexp_extract_all("text", F.lit(WORD), 0), F.col("n_words")
    return {"A": size < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * size,
            "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]", "")) > 10 * F.length("text"), "D": F.col("text").rlike(MARKS)}


def failing_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents as (row, doc_id, part), and the written relation (filter, row, doc_id, part) with one folder of ids per filter.

    ``row`` numbers the rows of the input, so repeated rows and ids stay
    apart. A null text is empty, a null lang the part ''. E compares whole
    texts by their SHA-256; a null doc_id is smaller than none and never fails
    it. Other columns are left behind.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("n_words", F.size(F.regexp_extract_all("text", F.lit(WORD), 0)))
    told = rows.select("doc_id", "part", F.sha2("text", 256).alias("sha"), F.array_compact(F.array(*[F.when(c, k) for k, c in text_filters().items()])).alias("fails"))
    base = materialise(told.withColumn("row", F.monotonically_increasing_id()), "audit-rows")
    # texts that occur once cannot fail E; the rest meet the smallest id of their text, a very frequent text by broadcast
    groups = materialise(base.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "audit-texts")
    repeated = lookup(base.select("row", "doc_id", "part", "sha"), groups, ["sha"]).where("doc_id > first")
    ids = base.select(F.explode("fails").alias("filter"), "row", "doc_id", "part").unionByName(repeated.select(F.lit("E").alias("filter"), "row", "doc_id", "part"))
    path = f"{shared_dir(docs.sparkSession)}/filter-audit/{uuid.uuid4().hex}"
    ids.write.partitionBy("filter").parquet(path)
    return base.select("row", "doc_id", "part"), docs.sparkSession.read.schema("row long, doc_id long, part string, filter string").parquet(path)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step.

    For each of the 32 sets of filters, ``gone`` holds the ids that any of
    them removes. The left-anti join of a filter's ids with the set before it
    gives what the filter removes there; its left-semi joins with the ids of
    good and of toxic rows give the label losses. The ids of a filter less
    what it removes were gone before: redundant. Survivors follow from the
    removals of the steps. All joins are on ids that are told apart by row, so
    no part, filter or frequent text gathers in a task; counts alone meet the
    orders. Sets and labels grow with the input and are planned from the size
    of their files, before rows are repeated per set, so their joins are merges:
    no driver gathers them for a broadcast. A part without failures has rows of zeros; no documents, no rows.
    """
    spark = docs.sparkSession
    every, ids = failing_ids(docs)
    bit = F.expr("shiftleft(1, ascii(filter) - 65)")
    fails = ids.select(bit.alias("bit"), "row", "doc_id", "part")
    marked = [fails.withColumn("kind", F.lit("all"))]
    for kind, column in (("good", "quality"), ("toxic", "toxic")):
        chosen = labels.where(F.col(column) == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
        marked.append(fails.join(chosen.hint("merge"), "doc_id", "left_semi").withColumn("kind", F.lit(kind)).select(*marked[0].columns))
    rows = marked[0].unionByName(marked[1]).unionByName(marked[2])
    sets = F.explode(F.sequence(F.lit(0), F.lit(31)))
    gone = fails.select("row", "bit", sets.alias("before")).where(F.col("before").bitwiseAND(F.col("bit")) != 0).select("before", "row")
    asked = rows.select("kind", "part", "bit", "row", sets.alias("before")).where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    counts = materialise(asked.join(gone.hint("merge"), ["before", "row"], "left_anti").groupBy("part", "before", "bit").agg(
        *[F.count_if(F.col("kind") == k).alias(c) for k, c in (("all", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]), "audit-counts")
    return _over_orders(spark, every.groupBy("part").agg(F.count("*").alias("documents")), counts)


def _over_orders(spark, parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts per set and filter, laid along all orders: 600 rows per part."""
    steps = [("".join(order), k + 1, sum(1 << NAMES.index(f) for f in order[:k]), 1 << NAMES.index(order[k])) for order in itertools.permutations(NAMES) for k in range(5)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    pairs = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(1 << f).alias("bit")) for f in range(5) for s in range(32) if not s >> f & 1])
    dense = parts.select("part", "documents", F.explode(pairs).alias("pair")).select("part", "documents", "pair.*").join(counts, ["part", "before", "bit"], "left")
    alone = F.max_by("removed", "before")  # the set of all others is the largest number among the sets without the filter
    first = F.max(F.when(F.col("before") == 0, F.col("removed")))
    filled = dense.fillna(0, ["removed", "good_lost", "toxic_lost"])
    per_filter = filled.groupBy("part", "bit").agg(first.alias("failing"), alone.alias("unique_fails"))
    laid = filled.join(F.broadcast(steps), ["before", "bit"]).join(per_filter, ["part", "bit"])
    shapley = laid.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    laid = laid.join(shapley, ["part", "bit"])
    # one order is told by its number of five rows, so the running sum of removals is over the steps before
    taken = laid.groupBy("part", "filter_order").agg(F.collect_list(F.struct("step", "removed")).alias("taken"))
    past = F.aggregate(F.filter("taken", lambda t: t["step"] <= F.col("step")), F.lit(0).cast("long"), lambda a, t: a + t["removed"])
    return laid.join(taken, ["part", "filter_order"]).select(
        "part", "filter_order", "step", (F.col("documents") - past).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley")


_MASKS = r"""
SELECT coalesce(lang, '') AS part, doc_id,
       (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
       + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INT AS mask
FROM (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents))"""

#: Failures as a bit mask per document, counted per part and mask; every figure is a sum over masks.
SQL = rf"""
WITH masks AS ({_MASKS}),
told AS (SELECT part, mask, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
         count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT chr((65 + i)::INT) AS f, 1 << i::INT AS bit FROM range(5) t(i)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, s::INT AS step, 1 << (ascii(substr(filter_order, s::INT, 1)) - 65) AS bit,
          list_sum([1 << (ascii(x) - 65) for x in string_split(substr(filter_order, 1, s::INT - 1), '') if x <> ''])::INT AS earlier FROM orders, range(1, 6) t(s)),
figures AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS removed,
       sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
       sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS toxic_lost
       FROM told, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM figures"""
