"""Models per brand: ranking metrics against brute force, early stopping, folds, comparison and permutation importance."""
import random

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from rebaja.operators import models as ML
from rebaja.session import materialise

SMALL = ML.Settings(rounds=8, depth=3, max_bins=32, step=0.3)


def slow_rank(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap, before = 0.0, 0
    for cut in sorted({p for _, p in rows}, reverse=True):
        tp, n = sum(p >= cut for p in pos), sum(p >= cut for _, p in rows)
        ap, before = ap + (tp - before) * tp / n, tp
    return auc, ap / len(pos) if pos else None


def test_ranking_metrics_are_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(400)]
    rows += [("only", 1, 0.5)] * 3 + [("a", None, 0.4), ("b", 1, None)]
    df = spark.createDataFrame(rows, "brand string, y int, p double").repartition(5)
    got = {r.brand: (r.n, r.auc, r.avg_precision) for r in ML.ranking_metrics(df, "y", "p", ["brand"]).collect()}
    assert set(got) == {"a", "b", None, "only"}
    for brand, (n, auc, ap) in got.items():
        own = [(y, p) for b, y, p in rows if b == brand and y is not None and p is not None]
        want = slow_rank(own)
        assert n == len(own) and auc == (want[0] if want[0] is None else pytest.approx(want[0])) and ap == pytest.approx(want[1])
    assert ML.auc(df.where("false"), "y", "p") == {"auc": None, "avg_precision": None}


@pytest.fixture(scope="module")
def planted(run):
    """Rows of the parent table whose target follows one planted column; brands disagree on its sign, so one model for all would fail."""
    key = F.xxhash64("codigo_padre", "centro", "week")
    sign = F.when(F.col("brand") == "SUR", 1).otherwise(-1)
    df = run.parent.withColumn("planted", (F.pmod(key, F.lit(1000)) / 1000.0)).withColumn(
        "should_reprice", F.when(sign * (F.col("planted") - 0.6) + (F.pmod(key, F.lit(7)) - 3) / 60.0 > 0, 1).otherwise(0))
    return df.select("brand", "codigo_padre", "centro", "week", "planted", "velocity_4w", "discount_rate", "primera_jerarquia", "segunda_jerarquia", "genero", "grupo_etario",
                     "should_reprice", "optimal_disc_margin", "will_discount_4w", "future_max_disc_4w")


@pytest.fixture(scope="module")
def halves(planted):
    split = ML.holdout_split(planted)
    return split.where("not is_holdout").drop("is_holdout"), split.where("is_holdout").drop("is_holdout")


@pytest.fixture(scope="module")
def trained(halves):
    return ML.train_brands(halves[0], SMALL, SMALL)


def test_each_brand_has_its_own_models(halves, trained):
    train, test = halves
    assert sorted(trained) == ["CENTRO", "NORTE", "SUR"] and {m.mode for m in trained.values()} == {"margin"}
    scored = ML.score_brands(test, trained)
    assert scored.count() == test.count()
    rank = {r.brand: r.auc for r in ML.ranking_metrics(scored, "class_label", by=["brand"]).collect()}
    assert min(rank.values()) > 0.9, rank
    assert ML.score_brands(test, {}).count() == 0


def test_rounds_stop_early(halves):
    train, _ = halves
    own = ML.with_validation(train.where("brand = 'SUR'"))
    weeks = own.where("is_validation").select("week").distinct()
    assert weeks.count() == ML.VALIDATION_WEEKS and weeks.agg(F.min("week")).first()[0] > own.where("not is_validation").agg(F.max("week")).first()[0]
    model = ML.train_classifier(own, "should_reprice", ML.Settings(rounds=60, depth=3, max_bins=32, step=0.5, tolerance=0.05))
    assert 1 <= model.stages[-1].getNumTrees < 60
    whole = ML.train_classifier(train.where("brand = 'SUR'"), "should_reprice", ML.Settings(rounds=4, depth=2, max_bins=32))
    assert whole.stages[-1].getNumTrees == 4  # nothing judges the rounds


def test_brand_overrides_and_targets(spark, planted):
    odd = planted.where("brand <> 'CENTRO'").withColumn("should_reprice", F.when(F.col("brand") == "SUR", F.col("should_reprice")))
    got = ML.train_brands(odd, SMALL, SMALL, {"SUR": {"rounds": 2}}, weeks=10_000)
    assert got["SUR"].mode == "margin" and got["SUR"].rounds == (2, 2)
    assert "NORTE" not in got or got["NORTE"].mode == "revenue" and got["NORTE"].class_target == "will_discount_4w"


def test_permutation_finds_the_planted_column(halves, trained):
    rows = ML.permutation_importance(halves[1], trained).collect()
    for brand in trained:
        own = sorted((r for r in rows if r.brand == brand), key=lambda r: -r.importance)
        assert own[0].feature == "planted" and own[0].importance > 0.1 and all(abs(r.importance) < 0.1 for r in own[1:])
    assert {r.feature for r in rows} >= {"planted", "velocity_4w", "genero"}


def test_folds_and_comparison(planted):
    folds = ML.cross_validate(planted, 2, SMALL, SMALL).collect()
    assert {(r.brand, r.fold) for r in folds} == {(b, f) for b in ("CENTRO", "NORTE", "SUR") for f in (0, 1)}
    assert {(r.task, r.metric) for r in folds} == {("classifier", m) for m in ("auc", "avg_precision", "precision", "recall", "f1")} | {("regressor", m) for m in ("mae", "rmse", "r2")}
    assert all(r.value > 0.9 for r in folds if r.metric == "auc")
    models = ML.compare_models(planted, SMALL, SMALL).collect()
    assert {(r.brand, r.model) for r in models} == {(b, m) for b in ("CENTRO", "NORTE", "SUR") for m in ("boosting", "forest", "linear")}
    assert all(r.value > 0.8 for r in models if r.metric == "auc")


def test_kinds_learn_from_matrices_written_once(planted, monkeypatch):
    """Each brand has one matrix per target, whatever the kinds; a kind fares as if it were trained by itself."""
    names = []

    def counted(df, name):
        names.append(name)
        return materialise(df, name)

    monkeypatch.setattr(ML, "materialise", counted)
    got = {(r.brand, r.task, r.metric): r.value for r in ML.compare_models(planted, SMALL, SMALL).where("model = 'linear'").collect()}
    assert names.count("training_rows") == 1 and names.count("matrix") == 6
    split = ML.holdout_split(planted)
    train, test = split.where("not is_holdout").drop("is_holdout"), split.where("is_holdout").drop("is_holdout")
    alone = ML.train_brands(train, models=(LogisticRegression(regParam=0.01, weightCol="weight"), LinearRegression(regParam=0.01)))
    want = {(r.brand, r.task, r.metric): r.value for r in ML.model_metrics(ML.score_brands(test, alone), ["brand"]).collect()}
    assert got == pytest.approx(want) and len(got) == 24


def test_rounds_of_boosting_are_not_cut_into_small_tasks(halves):
    """A small table is boosted in one task however many files it came in; a large one keeps its partitions."""
    seen = []

    class Spy(GBTClassifier):
        def _fit(self, dataset):
            seen.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    ML.train_classifier(halves[0].repartition(24, "week"), "should_reprice", estimator=Spy(maxIter=1, maxDepth=2, weightCol="weight"))
    assert seen == [1]
    assert [ML.boosting_tasks(n) for n in (0, 1, ML.ROWS_PER_TASK, ML.ROWS_PER_TASK + 1, 1000 * ML.ROWS_PER_TASK)] == [1, 1, 1, 2, 1000]
