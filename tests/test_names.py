"""Joins of alike names against all pairs, and the tiers of a match."""
import random

import pytest

from rebaja.operators import names as N


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.7, 0.75, 0.9, 1.0])
def test_similar_names_are_brute_force(spark, threshold):
    rng = random.Random(5)
    words = ["bondi", "clifton", "mach", "aa", "aaa", "abab", "a", "x", "speedgoat", "9", "10", "gtx", "mid"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            s.insert(rng.randint(0, len(s)), rng.choice("abx 9"))
            if rng.random() < 0.6:
                s.pop(rng.randrange(len(s)))
        return "".join(s)

    left = [(rng.choice("AB"), s) for s in base] + [("A", None), ("A", ""), (None, "bondi"), ("A", "bondi")] * 2
    right = [(rng.choice("AB"), changed(s)) for s in base * 3] + [("A", None), ("A", ""), (None, "bondi"), ("A", "bondi")] * 2
    frames = [spark.createDataFrame(rows, "brand string, name string") for rows in (left, right)]
    got = [(r.brand, r.left_name, r.right_name, r.score) for r in N.similar_names(*frames, threshold).collect()]
    want = {}
    for k, a in left:
        for j, b in right:
            if k is not None and k == j and a and b:
                score = round(1 - distance(a, b) / max(len(a), len(b)), 6)
                if score >= threshold:
                    want[k, a, b] = score
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == pytest.approx(want)
    assert N.similar_names(frames[0].where("false"), frames[1], threshold).count() == 0


def test_similar_names_needs_a_threshold(spark):
    empty = spark.createDataFrame([], "brand string, name string")
    for bad in (0.5, 2 / 3, 1.1):
        with pytest.raises(ValueError):
            N.similar_names(empty, empty, bad)


def test_all_tiers(spark):
    ours = spark.createDataFrame(
        [("A", "P", "BONDI 9", "Hoka", "780"), ("A", "Q", "SPEEDGOAT MID 6 GTX", "Hoka", None), ("A", "R", "ARAHI LOW 17", "Hoka", ""), ("B", "P", "BONDI 9", "Hoka", None)],
        "brand string, codigo_padre string, product_name string, vendor_brand string, ean11 string")
    offers = spark.createDataFrame([
        ("A", "paris", "1", "Other thing", "Nike", "780"), ("A", "paris", "2", "Hoka Bondi 9 Mujer", "HOKA", None),
        ("A", "ripley", "3", "Hoka Mid Speedgoat 6 GTX", "HOKA", None), ("A", "ripley", "4", "Hoka Mid Speedgoat 6 GTX", "HOKA", None),
        ("A", "paris", "5", "Speedgoat Mid 667 GTR", None, None), ("A", "web", "6", "Speedgoat Mad 77 GTR", "", None),
        ("A", "web", "7", "Arahi Low 17", "Nike", ""), ("A", "web", "8", None, None, None)],
        "brand string, competitor string, offer_id string, name string, offer_brand string, ean11 string")
    got = {(r.brand, r.codigo_padre, r.competitor): (r.offer_id, r.match_method) for r in N.match_names(ours, offers).collect()}
    assert got == {("A", "P", "paris"): ("1", "exact_ean"), ("A", "Q", "ripley"): ("3", "high_name"), ("A", "Q", "paris"): ("5", "medium_name"),
                   ("A", "Q", "web"): ("6", "low_name")}
