"""Training and scoring with pyspark.ml, a pair of models per brand."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from rebaja import constants as C
from rebaja.functions import columns as X
from rebaja.operators import parent as R
from rebaja.operators.ordering import places, running
from rebaja.session import materialise


@dataclass(frozen=True)
class Settings:
    """Size of a boosted model. It stops before ``rounds`` when a round betters the loss of the validation rows by less than ``tolerance`` of it.

    ``subsample`` (rows), ``features`` (columns of a node) and ``max_bins`` bound the work of a round.
    """

    rounds: int = 300
    depth: int = 6
    step: float = 0.05
    subsample: float = 0.8
    features: str = "0.8"
    max_bins: int = 64
    tolerance: float = 0.01
    seed: int = 42


CLASSIFIER = Settings()
REGRESSOR = Settings(rounds=500, depth=7, step=0.03, features="0.7", tolerance=0.002)
#: Weeks before the newest of a brand's training weeks that judge each round.
VALIDATION_WEEKS = 8
#: Fits of brands that run side by side; Spark shares the cores among them.
PARALLEL = 4
#: Rows for which a round of boosting gets one task: each level of each tree is a job, so small tasks cost more to send than to run.
ROWS_PER_TASK = 32_768
PERCENT = 100.0


def choose_targets(df: DataFrame, min_rows: int = 100) -> tuple[str, str, str]:
    """(mode, class target, depth target): margin targets where enough rows have them."""
    if "should_reprice" in df.columns and df.agg(F.count("should_reprice")).first()[0] > min_rows:
        return "margin", "should_reprice", "optimal_disc_margin"
    return "revenue", "will_discount_4w", "future_max_disc_4w"


def feature_columns(df: DataFrame, target: str) -> list[str]:
    numeric = {"int", "bigint", "double", "float", "smallint"}
    return [n for n, t in df.dtypes if t in numeric and n not in C.NON_FEATURES and n != target]


def _as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    flags = {f"{c}__missing": F.col(c).isNull().cast("double") for c in columns}
    return df.withColumns({**{c: F.col(c).cast("double") for c in columns}, **flags})


def prepare_matrix(df: DataFrame, target: str) -> tuple[DataFrame, list, list[str]]:
    """Rows with a target, the feature stages and the feature names.

    Trees here do not route missing values, so a missing number becomes the
    median plus a flag. Categories are indexed once, on the training rows.
    Columns without any value are left out.
    """
    rows = df.where(F.col(target).isNotNull())
    columns = feature_columns(rows, target)
    filled = rows.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    columns = [c for c in columns if filled[c]]
    cats = [c for c in C.CATEGORICAL_COLUMNS if c in df.columns]
    ready = _as_doubles(rows, columns)
    indexed, imputed = [f"{c}__ix" for c in cats], [f"{c}__f" for c in columns]
    names = indexed + imputed + [f"{c}__missing" for c in columns]
    stages = [
        StringIndexer(inputCols=cats, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        Imputer(inputCols=columns, outputCols=imputed, strategy="median"),
        VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"),
    ]
    return ready, stages, names


def time_series_folds(df: DataFrame, n: int = 4) -> DataFrame:
    """Expanding folds as rows (brand, fold, week, role): train weeks, then the next block to validate."""
    weeks = R.ranked_weeks(df)
    total = weeks.groupBy("brand").agg((F.floor(F.count(F.lit(1)) / (n + 1))).alias("_size"))
    f, at = F.col("fold"), F.col("oldest")
    role = F.when(at <= (f + 1) * F.col("_size"), "train").when(at <= (f + 2) * F.col("_size"), "validate")
    return (
        weeks.join(F.broadcast(total), "brand").withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(n)])))
        .withColumn("role", role).where("role is not null").select("brand", "fold", "week", "role")
    )


def holdout_split(df: DataFrame, weeks: int = C.HOLDOUT_WEEKS) -> DataFrame:
    """Adds ``is_holdout``: the last weeks of a brand, if it has more than ``weeks + 4`` of them."""
    ranked = R.ranked_weeks(df)
    size = ranked.groupBy("brand").agg(F.count(F.lit(1)).alias("_n"))
    cut = ranked.join(F.broadcast(size), "brand").where(F.col("_n") > weeks + 4).where(F.col("newest") == weeks).select(
        "brand", F.col("week").alias("_cut"))
    return df.join(F.broadcast(cut), "brand", "left").withColumn("is_holdout", X.true(F.col("week") >= F.col("_cut"))).drop("_cut")


def with_validation(df: DataFrame, weeks: int = VALIDATION_WEEKS) -> DataFrame:
    """Adds ``is_validation``: the newest weeks of each brand, if it has more than twice as many; they judge the rounds and train nothing."""
    ranked = R.ranked_weeks(df)
    size = ranked.groupBy("brand").agg(F.count(F.lit(1)).alias("_n"))
    late = ranked.join(F.broadcast(size), "brand").where((F.col("_n") > 2 * weeks) & (F.col("newest") <= weeks)).select("brand", "week", F.lit(True).alias("is_validation"))
    return df.join(F.broadcast(late), ["brand", "week"], "left").fillna(False, ["is_validation"])


def _boosting(kind, settings: Settings, early: bool, **more):
    stop = {"validationIndicatorCol": "is_validation", "validationTol": settings.tolerance} if early else {}
    return kind(maxIter=settings.rounds, maxDepth=settings.depth, stepSize=settings.step, subsamplingRate=settings.subsample, featureSubsetStrategy=settings.features,
                maxBins=settings.max_bins, seed=settings.seed, **stop, **more)


@dataclass
class Matrix:
    """Rows with one target, written as the few columns that models of any kind learn from, and the fitted feature stages that made them."""

    stages: list
    rows: DataFrame


def classifier_matrix(df: DataFrame, target: str) -> Matrix:
    """Rows with a class target, the positive class weighted by (1-p)/p."""
    ready, stages, _ = prepare_matrix(df, target)
    p = ready.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.5
    weight = (1 - p) / p if p > 0 else 1.0
    return _matrix(ready.withColumns({"label": F.col(target).cast("double"), "weight": F.when(F.col(target) == 1, float(weight)).otherwise(1.0)}), stages)


def regressor_matrix(df: DataFrame, target: str) -> Matrix:
    """Rows with a depth target, which is learnt in percent: early stopping measures gains against a floor of 0.01 that shares of one would never pass."""
    ready, stages, _ = prepare_matrix(df, target)
    return _matrix(ready.withColumn("label", PERCENT * F.col(target).cast("double")), stages)


def _matrix(ready: DataFrame, stages: list) -> Matrix:
    prepared = Pipeline(stages=stages).fit(ready)
    keep = [c for c in ("features", "label", "weight", "is_validation") if c in ready.columns or c == "features"]
    return Matrix(prepared.stages, materialise(prepared.transform(ready).select(*keep), "matrix"))


def fit_classifier(own: Matrix, settings: Settings = CLASSIFIER, estimator=None) -> PipelineModel:
    """Boosted trees, or ``estimator``; with a column ``is_validation``, boosting stops early on its rows."""
    return _fit(own, estimator or _boosting(GBTClassifier, settings, _judged(own.rows), weightCol="weight"))


def fit_regressor(own: Matrix, settings: Settings = REGRESSOR, estimator=None) -> PipelineModel:
    """Boosted regression trees, or ``estimator``; early stopping as in ``fit_classifier``."""
    return _fit(own, estimator or _boosting(GBTRegressor, settings, _judged(own.rows)))


def train_classifier(df: DataFrame, target: str, settings: Settings = CLASSIFIER, estimator=None) -> PipelineModel:
    """``fit_classifier`` on rows that only this model learns from."""
    return fit_classifier(classifier_matrix(df, target), settings, estimator)


def train_regressor(df: DataFrame, target: str, settings: Settings = REGRESSOR, estimator=None) -> PipelineModel:
    """``fit_regressor`` on rows that only this model learns from."""
    return fit_regressor(regressor_matrix(df, target), settings, estimator)


def _judged(ready: DataFrame) -> bool:
    """Whether there are rows on both sides of ``is_validation``."""
    return "is_validation" in ready.columns and ready.select("is_validation").distinct().count() == 2


def boosting_tasks(rows: int) -> int:
    """Most tasks that a round of boosting is cut into; tables with more rows keep the partitions they are read in."""
    return max(1, -(-rows // ROWS_PER_TASK))


def _fit(own: Matrix, model) -> PipelineModel:
    """The model's many passes read the written matrix of its few columns."""
    matrix = own.rows
    if isinstance(model, (GBTClassifier, GBTRegressor)):  # forests do all their trees at once, their tasks are long
        matrix = matrix.coalesce(boosting_tasks(matrix.count()))
    matrix = matrix.persist()
    try:
        return PipelineModel(own.stages + [model.fit(matrix)])
    finally:
        matrix.unpersist()


@dataclass
class BrandModels:
    """Models of one brand and what they were trained for."""

    brand: str
    mode: str
    class_target: str
    depth_target: str
    classifier: PipelineModel
    regressor: PipelineModel

    @property
    def rounds(self) -> tuple[int, int]:
        return self.classifier.stages[-1].getNumTrees, self.regressor.stages[-1].getNumTrees


def depth_rows(df: DataFrame, mode: str) -> DataFrame:
    """Rows that the depth model learns from: those with a margin target, else those that were marked down."""
    return df if mode == "margin" else df.where("will_discount_4w = 1")


@dataclass
class BrandRows:
    """What the models of one brand learn from."""

    brand: str
    mode: str
    class_target: str
    depth_target: str
    classes: Matrix
    depths: Matrix


def brand_rows(df: DataFrame, weeks: int = VALIDATION_WEEKS) -> list[BrandRows]:
    """The matrices of each brand, each written once whatever kinds of models are fitted on it.

    A brand whose class target has one value only has none, as has one without
    a depth target.
    """
    rows = materialise(with_validation(df, weeks), "training_rows")  # counted, indexed and summed many times
    brands = [r.brand for r in rows.select("brand").distinct().orderBy("brand").collect()]

    def prepared(brand: str) -> BrandRows | None:
        own = rows.where(F.col("brand") == brand)
        mode, cls, reg = choose_targets(own)
        trained = own.where("not is_validation").agg(F.count_if(F.col(cls) == 1), F.count_if(F.col(cls) == 0)).first()
        if not all(trained) or depth_rows(own, mode).where(F.col(reg).isNotNull()).limit(1).count() == 0:
            return None
        depths = side.submit(regressor_matrix, depth_rows(own, mode), reg)
        return BrandRows(brand, mode, cls, reg, classifier_matrix(own, cls), depths.result())

    with ThreadPoolExecutor(PARALLEL) as side, ThreadPoolExecutor(PARALLEL) as pool:
        return [b for b in pool.map(prepared, brands) if b]


def fit_brands(rows: list[BrandRows], classifier: Settings = CLASSIFIER, regressor: Settings = REGRESSOR, overrides: dict[str, dict] | None = None,
               models: tuple | None = None) -> dict[str, BrandModels]:
    """One classifier and one depth model for each of ``brand_rows``; arguments as in ``train_brands``."""
    def fitted(own: BrandRows) -> BrandModels:
        change = (overrides or {}).get(own.brand, {})
        one, two = replace(classifier, **change), replace(regressor, **change)
        c, d = models or (None, None)
        depth = fits.submit(fit_regressor, own.depths, two, d and d.copy())
        return BrandModels(own.brand, own.mode, own.class_target, own.depth_target, fit_classifier(own.classes, one, c and c.copy()), depth.result())

    with ThreadPoolExecutor(PARALLEL) as fits, ThreadPoolExecutor(PARALLEL) as pool:
        return {m.brand: m for m in pool.map(fitted, rows)}


def train_brands(df: DataFrame, classifier: Settings = CLASSIFIER, regressor: Settings = REGRESSOR, overrides: dict[str, dict] | None = None,
                 models: tuple | None = None, weeks: int = VALIDATION_WEEKS) -> dict[str, BrandModels]:
    """One classifier and one depth model per brand, each with the brand's own targets, class weight, categories and medians.

    ``overrides`` maps a brand to changed settings. ``models`` gives other
    estimators than boosting. Brands (a handful) are trained side by side by
    threads that only submit Spark jobs; each fit is distributed over all rows
    of its brand. Brands without ``brand_rows`` get no models; see
    ``score_brands``.
    """
    return fit_brands(brand_rows(df, weeks), classifier, regressor, overrides, models)


def score_brands(df: DataFrame, models: dict[str, BrandModels]) -> DataFrame:
    """Every row scored by its brand's models: adds ``class_label``, ``depth_label`` (the brand's targets), ``markdown_probability`` and ``raw_depth``; rows of brands without models are left out."""
    parts = [score_week(df.where(F.col("brand") == m.brand), m.classifier, m.regressor)
             .withColumns({"class_label": F.col(m.class_target).cast("double"), "depth_label": F.col(m.depth_target).cast("double")}) for m in models.values()]
    if not parts:
        return df.where("false").withColumns({c: F.lit(None).cast("double") for c in ("markdown_probability", "raw_depth", "class_label", "depth_label")})
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _inputs(model: PipelineModel) -> list[str]:
    return model.stages[1].getInputCols()


def score_week(df: DataFrame, classifier: PipelineModel, regressor: PipelineModel) -> DataFrame:
    """``markdown_probability`` and ``raw_depth`` (within 0..0.60) on any rows."""
    drop = ["features", "rawPrediction", "probability", "prediction"]
    keep = list(df.columns)
    # the model's working columns take the names of its inputs, so the originals are kept aside
    aside = df.select(F.struct(*keep).alias("_row"), *keep)
    one = classifier.transform(_as_doubles(aside, _inputs(classifier)))
    one = one.select("_row", vector_to_array("probability")[1].alias("_p"))
    two = regressor.transform(_as_doubles(one.select("_row", "_p", "_row.*"), _inputs(regressor))).drop(*drop[:3])
    return two.select("_row.*", F.col("_p").alias("markdown_probability"),
                      X.clip(F.col("prediction") / PERCENT, low=0.0, high=0.60).alias("raw_depth"))


def classification_metrics(scored: DataFrame, target: str, prob: str = "markdown_probability",
                           by: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """Precision, recall and F1 by plain sums."""
    y, p = F.col(target) == 1, F.col(prob) >= cut
    df = scored.where(F.col(target).isNotNull())
    agg = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("_tp"), F.count_if(~y & p).alias("_fp"), F.count_if(y & ~p).alias("_fn"))
    pr, rc = X.ratio("_tp", F.col("_tp") + F.col("_fp"), 0.0), X.ratio("_tp", F.col("_tp") + F.col("_fn"), 0.0)
    return agg.withColumns({"precision": pr, "recall": rc}).withColumn(
        "f1", X.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)).drop("_tp", "_fp", "_fn")


def regression_metrics(scored: DataFrame, target: str, pred: str = "raw_depth", by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R² by plain sums."""
    y, err = F.col(target).cast("double"), F.col(target) - F.col(pred)
    df = scored.where(F.col(target).isNotNull())
    return (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"))


def ranking_metrics(scored: DataFrame, target: str, prob: str = "markdown_probability", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve and average precision: (by..., n, positives, auc, avg_precision).

    Rows are counted per score first, so ties are one group; the counts above
    a score are running sums over range partitions (``ordering.running``), no
    window sees all scores. A pair of equal scores counts half. Without a row
    of either class the area is null; without positives the precision is too.
    """
    by = by or []
    rows = scored.where(F.col(target).isNotNull() & F.col(prob).isNotNull())
    ties = rows.groupBy(*by, F.col(prob).cast("double").alias("_p")).agg(F.count_if(F.col(target) == 1).alias("_pos"), F.count_if(F.col(target) != 1).alias("_neg"))
    keyed = materialise(ties.withColumn("_key", F.to_json(F.struct(*by)) if by else F.lit("")), "score-ties")
    above = running(keyed, ["_key"], [F.desc("_p")], {"_tp": ("sum", "_pos"), "_fp": ("sum", "_neg")}, "score-ranks")
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return above.groupBy(*by).agg(
        (pos + neg).alias("n"), pos.alias("positives"),
        (F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2)) / F.nullif(pos * neg, F.lit(0))).alias("auc"),
        (F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))) / F.nullif(pos, F.lit(0))).alias("avg_precision"))


def auc(scored: DataFrame, target: str, prob: str = "markdown_probability") -> dict[str, float]:
    """Both figures of ``ranking_metrics`` over all rows."""
    return ranking_metrics(scored, target, prob).select("auc", "avg_precision").first().asDict()


def feature_importance(models: dict[str, BrandModels], spark, top: int | None = None) -> DataFrame:
    """Impurity importance of the classifier of each brand: (brand, feature, importance), the ``top`` of a brand or all."""
    rows = []
    for m in models.values():
        names = m.classifier.stages[-2].getInputCols()
        of = sorted(zip(names, m.classifier.stages[-1].featureImportances.toArray()), key=lambda r: (-r[1], r[0]))
        rows += [(m.brand, n, float(v)) for n, v in of[:top]]
    return spark.createDataFrame(rows, "brand string, feature string, importance double")


def permutation_importance(df: DataFrame, models: dict[str, BrandModels], seed: int = 42) -> DataFrame:
    """How much the area under the ROC curve falls when one column is re-paired among the rows: (brand, feature, auc, importance).

    Rows of a brand get places in a random but seeded order; each row takes
    the column from the row half a table further, by a join on places. All
    columns are scored in one pass: a row becomes one row per column, with the
    column's number and its missing flag exchanged together. Meant for held-out rows.
    """
    out = []
    for m in models.values():
        own = materialise(df.where((F.col("brand") == m.brand) & F.col(m.class_target).isNotNull()), "permuted")
        n = own.count()
        if not n:
            continue
        ready = PipelineModel(m.classifier.stages[:-1]).transform(_as_doubles(own, _inputs(m.classifier)))
        rows = materialise(ready.select(F.col(m.class_target).alias("label"), vector_to_array("features").alias("x"), F.xxhash64(F.lit(seed), *[F.col(c) for c in R.KEYS]).alias("tie")), "permuted")
        ranked = materialise(places(rows, ["tie", "x"], "place", "permuted"), "permuted")
        donor = ranked.select((F.pmod(F.col("place") - 1 + n // 2, F.lit(n)) + 1).alias("place"), F.col("x").alias("other"))
        names = m.classifier.stages[-2].getInputCols()
        slots: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            slots.setdefault(name.removesuffix("__missing").removesuffix("__f").removesuffix("__ix"), []).append(i)
        columns = F.array(F.struct(F.lit("").alias("feature"), F.array().cast("array<int>").alias("at")),
                          *[F.struct(F.lit(k).alias("feature"), F.array(*map(F.lit, v)).alias("at")) for k, v in slots.items()])
        pairs = ranked.join(donor, "place").withColumn("c", F.explode(columns))
        mixed = pairs.select("label", F.col("c.feature").alias("feature"), array_to_vector(
            F.transform("x", lambda v, i: F.when(F.array_contains("c.at", i), F.get("other", i)).otherwise(v))).alias("features"))
        scored = m.classifier.stages[-1].transform(mixed).select("feature", "label", vector_to_array("probability")[1].alias("p"))
        out.append(ranking_metrics(scored, "label", "p", ["feature"]).withColumn("brand", F.lit(m.brand)))
    if not out:
        return df.sparkSession.createDataFrame([], "brand string, feature string, auc double, importance double")
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    every = materialise(every, "permuted")
    base = every.where("feature = ''").select("brand", F.col("auc").alias("_base"))
    return every.where("feature <> ''").join(F.broadcast(base), "brand").select("brand", "feature", "auc", (F.col("_base") - F.col("auc")).alias("importance"))


def model_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of scored rows (``score_brands``) per group, long: (by..., task, metric, value)."""
    rank = ranking_metrics(scored, "class_label", by=by)
    flat = classification_metrics(scored, "class_label", by=by)
    fit = regression_metrics(scored.where("depth_label IS NOT NULL"), "depth_label", by=by)

    def long(df: DataFrame, task: str, names: list[str]) -> DataFrame:
        return df.select(*by, F.lit(task).alias("task"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])))
    return long(rank, "classifier", ["auc", "avg_precision"]).unionByName(long(flat, "classifier", ["precision", "recall", "f1"])).unionByName(long(fit, "regressor", ["mae", "rmse", "r2"]))


def store_profiles(parent: DataFrame) -> DataFrame:
    """Behaviour of each store over all its rows."""
    return parent.groupBy("centro").agg(
        F.avg("velocity_4w").alias("avg_velocity"), F.coalesce(F.stddev_samp("velocity_4w"), F.lit(0.0)).alias("std_velocity"),
        F.avg("discount_rate").alias("avg_discount"), F.avg("avg_precio_final").alias("avg_price"),
        F.countDistinct("codigo_padre").alias("n_skus"), F.avg("has_discount").alias("pct_discounted"),
        F.coalesce(F.avg("stock_on_hand"), F.lit(0.0)).alias("avg_stock"), F.coalesce(F.avg("weeks_of_cover"), F.lit(0.0)).alias("avg_woc"))


def store_clusters(profiles: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """k-means of scaled profiles: adds ``cluster`` and the ``silhouette`` of the whole clustering."""
    inputs = [c for c in profiles.columns if c != "centro"]
    stages = [VectorAssembler(inputCols=inputs, outputCol="_v"),
              StandardScaler(inputCol="_v", outputCol="features", withMean=True), KMeans(k=k, seed=seed, predictionCol="cluster")]
    out = Pipeline(stages=stages).fit(profiles).transform(profiles)
    quality = ClusteringEvaluator(predictionCol="cluster").evaluate(out)
    return out.drop("_v", "features").withColumn("silhouette", F.lit(float(quality)))


def compare_models(df: DataFrame, classifier: Settings = CLASSIFIER, regressor: Settings = REGRESSOR) -> DataFrame:
    """Boosting, forest and linear models of each brand on its last weeks: (brand, model, task, metric, value).

    All kinds learn from the same matrices, written once. Boosting and linear
    models are fitted side by side, as both are made of many short tasks;
    forests come after them, as short tasks would wait behind their long ones.
    """
    split = holdout_split(df)
    train, test = split.where("not is_holdout").drop("is_holdout"), split.where("is_holdout").drop("is_holdout")

    def forest(kind, s: Settings, **more):
        return kind(numTrees=s.rounds, maxDepth=s.depth, maxBins=s.max_bins, subsamplingRate=s.subsample, seed=s.seed, cacheNodeIds=True, **more)

    rows = brand_rows(train)
    with ThreadPoolExecutor(1) as side:
        linear = side.submit(fit_brands, rows, classifier, regressor, models=(LogisticRegression(regParam=0.01, weightCol="weight"), LinearRegression(regParam=0.01)))
        kinds = {"boosting": fit_brands(rows, classifier, regressor), "linear": linear.result()}
    kinds["forest"] = fit_brands(rows, classifier, regressor, models=(forest(RandomForestClassifier, classifier, weightCol="weight"), forest(RandomForestRegressor, regressor)))
    scored = None
    for name, models in kinds.items():
        part = score_brands(test, models).select("brand", "class_label", "depth_label", "markdown_probability", "raw_depth", F.lit(name).alias("model"))
        scored = part if scored is None else scored.unionByName(part)
    return model_metrics(materialise(scored, "compared"), ["brand", "model"])


def cross_validate(df: DataFrame, n: int = 2, classifier: Settings = CLASSIFIER, regressor: Settings = REGRESSOR) -> DataFrame:
    """Metrics of expanding folds per brand: (brand, fold, task, metric, value). One aggregate over the scored rows of all folds."""
    folds, scored = time_series_folds(df, n), None
    for fold in range(n):
        part = df.join(F.broadcast(folds.where(F.col("fold") == fold)), ["brand", "week"]).drop("fold")
        train, test = (part.where(F.col("role") == r).drop("role") for r in ("train", "validate"))
        one = score_brands(test, train_brands(train, classifier, regressor)).select("brand", "class_label", "depth_label", "markdown_probability", "raw_depth", F.lit(fold).alias("fold"))
        scored = one if scored is None else scored.unionByName(one)
    return model_metrics(materialise(scored, "folds"), ["brand", "fold"])
