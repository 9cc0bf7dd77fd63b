"""Joins of names that are alike: a prefix filter over pairs of letters finds candidates, edit distance decides."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rebaja.functions import columns as X
from rebaja.operators import competitors as K
from rebaja.session import materialise


def letter_pairs(name: Column) -> Column:
    """Pairs of neighbouring letters of the padded name; the second "ab" of a name is another element than the first."""
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2)))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, 1, i), lambda o: o == p)).cast("string")))


def edit_similarity(a: str, b: str) -> Column:
    """One minus edit distance over the longer length, to six places; two empty names are not alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.round(1 - F.levenshtein(F.col(a), F.col(b)) / longer, 6)).otherwise(0.0)


def _prefixes(names: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """The rarest letter pairs of each name, one row each: as many as an alike name could lack, and one more.

    An edit spoils two pairs, and a name of n letters is at most n / threshold
    long on the other side, so n (1 - threshold) / threshold edits are the most.
    """
    pairs = names.select(*keys, "name", "side", F.explode(letter_pairs(F.col("name"))).alias("pair"))
    counts = pairs.groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("n"))
    edits = F.floor(F.length("name") * F.lit((1 - threshold) / threshold) + 1e-9)
    rare = (
        pairs.join(counts, [*keys, "pair"]).groupBy(*keys, "name", "side")
        .agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("_pairs"))
        .withColumn("_pairs", F.slice("_pairs", F.lit(1), (edits * 2 + 1).cast("int")))
    )
    return rare.select(*keys, "name", "side", F.explode("_pairs.pair").alias("pair"))


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.75, keys: Sequence[str] = ("brand",)) -> DataFrame:
    """All pairs of names (``left_name``, ``right_name``, ``score``) of equal ``keys`` whose edit similarity reaches ``threshold``.

    ``left`` and ``right``: the keys and ``name``. Repeated names count once;
    null and empty names are alike to none. Two names that are alike share one
    of their rarest pairs of letters, so pairs come from an equi-join on those
    and bounds on the lengths, without loss; the rest is never compared. Needs
    a threshold above 2/3: below, a name could lack all pairs of one like it.
    """
    if not 2 / 3 < threshold <= 1:
        raise ValueError("threshold must be above 2/3 and at most 1")
    sides = [df.where("name <> ''").select(*keys, "name").distinct().withColumn("side", F.lit(s)) for s, df in enumerate((left, right))]
    rows = _prefixes(sides[0].unionByName(sides[1]), keys, threshold)
    a = rows.where("side = 0").drop("side").withColumnRenamed("name", "left_name")
    b = rows.where("side = 1").drop("side").withColumnRenamed("name", "right_name")
    la, lb = F.length("left_name"), F.length("right_name")
    near = F.least(la, lb) + 1e-9 >= F.greatest(la, lb) * F.lit(threshold)
    met = a.join(b, [*keys, "pair"]).where(near).select(*keys, "left_name", "right_name").distinct()
    return met.withColumn("score", edit_similarity("left_name", "right_name")).where(F.col("score") >= threshold)


def match_names(ours: DataFrame, offers: DataFrame, min_score: float = 0.75) -> DataFrame:
    """Offers that are our product, whichever search found them; best per (parent, competitor), as in ``match_offers``.

    ``ours``: brand, codigo_padre, product_name, vendor_brand, ean11;
    ``offers``: brand, competitor, offer_id, name, offer_brand, ean11. An equal
    EAN settles a match. Otherwise brands must agree, and the better of two
    scores counts: of the names without their brands, and of those with the
    words in alphabetical order.
    """
    c = F.col
    mine = ours.select("brand", "codigo_padre", c("ean11").alias("_ean"), X.normalise_name("vendor_brand").alias("_vb"),
                       X.strip_brand(X.normalise_name("product_name"), "vendor_brand").alias("left_name"))
    theirs = offers.select("brand", "competitor", "offer_id", "ean11", X.normalise_name("offer_brand").alias("_ob"),
                           X.strip_brand(X.normalise_name("name"), "offer_brand").alias("right_name"))
    # of equal offers the first wins; both sides are read five times, so they are written once
    theirs = materialise(theirs.groupBy("brand", "competitor", "ean11", "_ob", "right_name").agg(F.min("offer_id").alias("offer_id")), "offers")
    mine = materialise(mine, "catalogue")
    by_ean = mine.where("_ean <> ''").join(theirs, (mine.brand == theirs.brand) & (mine["_ean"] == theirs.ean11)).select(
        mine.brand, "codigo_padre", "competitor", "offer_id", F.lit(1.0).alias("score"), F.lit(True).alias("ean"))

    def ordered(name: str) -> Column:
        return F.array_join(F.array_sort(F.split(name, " ")), " ")

    forms = []
    for form in (c, ordered):
        a, b = (df.select("brand", form(n).alias("name")) for df, n in ((mine, "left_name"), (theirs, "right_name")))
        alike = similar_names(a, b, min_score)
        hit = mine.withColumn("left_name", form("left_name")).join(alike, ["brand", "left_name"]).join(
            theirs.withColumn("right_name", form("right_name")), ["brand", "right_name"])
        agree = (c("_vb") == "") | (c("_ob") == "") | c("_ob").contains(c("_vb")) | c("_vb").contains(c("_ob"))
        forms.append(hit.where(agree).select("brand", "codigo_padre", "competitor", "offer_id", "score", F.lit(False).alias("ean")))
    found = by_ean.unionByName(forms[0]).unionByName(forms[1]).withColumns({
        "match_method": K.classify_match(c("score"), c("ean")), "match_score": F.round("score", 3), "_order": ~c("ean")})
    best = found.groupBy("brand", "codigo_padre", "competitor").agg(
        F.min_by(F.struct("offer_id", "match_method", "match_score"), F.struct("_order", -c("match_score"), "offer_id")).alias("_m"))
    return best.select("brand", "codigo_padre", "competitor", "_m.*")
