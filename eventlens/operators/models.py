"""Event-impact models: MLlib pipelines, evaluation, registry, per-symbol logit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions import expressions as X
from eventlens.operators.datasets import PAIR_FEATURES
from eventlens.operators.features import CLASSIFICATION_FEATURES
from eventlens.session import checkpoint

SPLITS = ("train", "val", "test")
# Order in which a registrable model is chosen when the network scores best.
FALLBACK = ["boosted_trees", "boosted_leaves", "random_forest", "logistic_regression"]


# ---- scaling ----------------------------------------------------------------------------
def standard_scaler(features: list[str] = PAIR_FEATURES) -> list:
    """Assembler and scaler stages; fitted with the model, hence on training rows only."""
    return [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def _fit(rows: DataFrame, features: list[str], classifier) -> PipelineModel:
    return Pipeline(stages=[*standard_scaler(features), classifier]).fit(rows)


def _train(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def train_logistic(df: DataFrame, features: list[str] = PAIR_FEATURES) -> PipelineModel:
    """L2 penalty of one over the number of rows, i.e. a unit penalty on the summed loss."""
    rows = _train(df)
    return _fit(
        rows,
        features,
        LogisticRegression(
            labelCol="target", maxIter=1000, regParam=1.0 / max(rows.count(), 1),
            standardization=False,
        ),
    )


def train_random_forest(
    df: DataFrame, features: list[str] = PAIR_FEATURES, trees: int = 200, depth: int = 10
) -> PipelineModel:
    """Each row remembers its node of every tree, so that no level walks all trees from the root again."""
    forest = RandomForestClassifier(labelCol="target", numTrees=trees, maxDepth=depth, seed=42, cacheNodeIds=True)
    return _fit(_train(df), features, forest)


#: Two ensembles: one grows each tree to a depth, the other to about 31 leaves of 20 rows and more.
# ---- fixed values: shared rate, row and column shares, rounds and patience -----------------
BOOSTING = {"stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
DEPTH_WISE = {"maxDepth": 6, "minInstancesPerNode": 1}
LEAF_WISE = {"maxDepth": 5, "minInstancesPerNode": 20, "maxBins": 255}
ROUNDS, PATIENCE = 300, 20


def best_round(losses: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Number of rounds with the least loss before ``patience`` rounds in a row brought nothing
    better, and whether these rounds were seen. A first rise is not the end."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first ``n`` trees, a model like any other."""
    spark = SparkSession.active()
    trees = model._java_obj.trees()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kept = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for i, weight in enumerate(model.treeWeights[:n]):
        kept[i], weights[i] = trees[i], weight
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, kept, weights)
    return GBTClassificationModel(model._java_obj.copyValues(cut, model._java_obj.extractParamMap()))


def train_boosted_trees(
    df: DataFrame, features: list[str] = PAIR_FEATURES, rounds: int = ROUNDS, patience: int = PATIENCE, **shape
) -> PipelineModel:
    """Gradient-boosted trees up to the round that serves the validation split best.

    The loss on the validation rows after every round of a fitted ensemble comes from one
    pass over them. Boosting ends once ``patience`` rounds brought no better loss, and the trees
    after the best round are cut off. The first ensemble has the fewest rounds that can show the end, one
    and the patience; ensembles of 2, 4, 8 … times as many are fitted until it is seen, so no more
    rounds are fitted than about four times those needed. Without rows for validation all rounds count. ``shape`` are parameters of the trees (``DEPTH_WISE`` by default).
    """
    scaler = Pipeline(stages=standard_scaler(features)).fit(_train(df))
    train = checkpoint(scaler.transform(_train(df)).select("features", "target"))
    val = checkpoint(scaler.transform(df.filter(F.col("split") == "val")).select("features", "target"))
    trees = GBTClassifier(labelCol="target", **BOOSTING, **(shape or DEPTH_WISE))
    n, seen = min(rounds, patience + 1), False
    while not seen:
        fitted = trees.setMaxIter(n if not val.isEmpty() else rounds).fit(train)
        if val.isEmpty():
            return PipelineModel(stages=[*scaler.stages, fitted])
        best, seen = best_round(fitted.evaluateEachIteration(val), patience)
        seen, n = seen or n >= rounds, min(rounds, 2 * n)
    return PipelineModel(stages=[*scaler.stages, first_trees(fitted, best)])


def train_boosted_leaves(df: DataFrame, features: list[str] = PAIR_FEATURES, rounds: int = ROUNDS, patience: int = PATIENCE) -> PipelineModel:
    """The second ensemble: shallower trees whose leaves hold 20 rows at least."""
    return train_boosted_trees(df, features, rounds, patience, **LEAF_WISE)


def train_mlp(
    df: DataFrame,
    features: list[str] = PAIR_FEATURES,
    hidden: tuple[int, ...] = (128, 64),
    epochs: int = 50,
) -> PipelineModel:
    return _fit(
        _train(df),
        features,
        MultilayerPerceptronClassifier(
            labelCol="target", layers=[len(features), *hidden, 2], maxIter=epochs, seed=42
        ),
    )


TRAINERS = {
    "logistic_regression": train_logistic,
    "random_forest": train_random_forest,
    "boosted_trees": train_boosted_trees,
    "boosted_leaves": train_boosted_leaves,
    "mlp": train_mlp,
}


# ---- evaluation -------------------------------------------------------------------------
def evaluate_splits(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC per split; AUC 0 for a single class.

    Confusion counts of all splits come from one aggregate; the area under the curve from
    MLlib's distributed evaluator. Both read the scores several times, so each row is scored once and
    the scores are written.
    """
    scored = model.transform(df).select("split", "target", "prediction", "rawPrediction")
    scored = checkpoint(scored.withColumn("label", F.col("target").cast("double")))
    y, p = F.col("target") == 1, F.col("prediction") == 1
    counts = scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        X.count_if(y & p).alias("tp"),
        X.count_if(~y & p).alias("fp"),
        X.count_if(y & ~p).alias("fn"),
        X.count_if(~y & ~p).alias("tn"),
    )
    evaluator = BinaryClassificationEvaluator(labelCol="label", numBins=0)
    both = {
        r["split"] for r in counts.collect() if r["tp"] + r["fn"] and r["fp"] + r["tn"]
    }
    aucs = [
        (s, float(evaluator.evaluate(scored.filter(F.col("split") == s))) if s in both else 0.0)
        for s in SPLITS
    ]
    auc = df.sparkSession.createDataFrame(aucs, "split string, auc double")
    tp = F.col("tp")

    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    precision = zero(X.safe_ratio(tp, tp + F.col("fp")))
    recall = zero(X.safe_ratio(tp, tp + F.col("fn")))
    return counts.join(auc, "split").select(
        F.lit(name).alias("model"),
        "split",
        "n",
        ((tp + F.col("tn")) / F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        zero(X.safe_ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))).alias("f1"),
        "auc",
    )


def feature_importances(model: PipelineModel, spark: SparkSession, features: list[str], n: int = 10) -> DataFrame:
    """Top features of a tree model; empty for others."""
    weights = getattr(model.stages[-1], "featureImportances", None)
    rows = [] if weights is None else list(zip(features, map(float, weights.toArray()), strict=True))
    return (
        spark.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.col("importance").desc(), "feature")
        .limit(n)
    )


def compare_models(metrics: DataFrame) -> DataFrame:
    """One row per model, best test AUC first."""
    measures = ("accuracy", "precision", "recall", "f1", "auc")
    wide = [
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
        for s in SPLITS
        for m in measures
    ]
    return metrics.groupBy("model").agg(*wide).orderBy(F.col("test_auc").desc(), "model")


# ---- registry ---------------------------------------------------------------------------
REGISTRY = "version int, model string, test_auc double, is_champion boolean, path string"


def candidate_model(comparison: DataFrame) -> tuple[str, float]:
    """Best model if it can be registered, else the first of the fallback order."""
    ranked = [(r["model"], r["test_auc"]) for r in comparison.collect()]
    if ranked[0][0] in FALLBACK:
        return ranked[0]
    scores = dict(ranked)
    return next((m, scores[m]) for m in FALLBACK if m in scores)


def promote_champion(registry: DataFrame, model: str, test_auc: float, path: str) -> DataFrame:
    """Add a version; it becomes champion only with a strictly higher AUC.

    The registry holds one row per training run.
    """
    spark = registry.sparkSession
    new = spark.createDataFrame([(model, test_auc, path)], "model string, test_auc double, path string")
    last = registry.agg(F.coalesce(F.max("version"), F.lit(0))).scalar()
    best = registry.agg(F.max(F.when(F.col("is_champion"), F.col("test_auc")))).scalar()
    wins = best.isNull() | (F.lit(test_auc) > best)
    added = new.select(
        (last + 1).cast("int").alias("version"),
        "model",
        "test_auc",
        wins.alias("is_champion"),
        "path",
    )
    old = registry.withColumn("is_champion", F.col("is_champion") & ~wins)
    return old.select(*added.columns).unionByName(added)


def score_champion(
    model: PipelineModel, rows: DataFrame, features: list[str] = PAIR_FEATURES
) -> DataFrame:
    """UP/DOWN and probability for a batch; absent or null features count as 0."""
    have = set(rows.columns)
    filled = rows.withColumns(
        {
            f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)
            for f in features
        }
    )
    p = F.round(vector_to_array("probability")[1], 4)
    return (
        model.transform(filled)
        .withColumn("probability_up", p)
        .withColumn("prediction", F.when(vector_to_array("probability")[1] >= 0.5, "UP").otherwise("DOWN"))
        .select(*[c for c in rows.columns if c not in features], "prediction", "probability_up")
    )


# ---- per-symbol logit -------------------------------------------------------------------
def fit_logit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps on the summed logistic loss + half the squared weights; intercept first."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.eye(design.shape[1])
    penalty[0, 0] = 0.0
    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (p - y) + penalty @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        w -= step
        if np.max(np.abs(step)) < 1e-10:
            break
    return w


def stratified_folds(y: np.ndarray, folds: int = 5) -> np.ndarray:
    """Fold of each row: classes spread evenly, rows of a class in consecutive blocks."""
    _, first, coded = np.unique(y, return_index=True, return_inverse=True)
    by_appearance = np.argsort(np.argsort(first))[coded]
    ordered = np.sort(by_appearance)
    out = np.empty(len(y), dtype=int)
    for c in range(len(first)):
        sizes = [int(np.sum(ordered[i::folds] == c)) for i in range(folds)]
        out[by_appearance == c] = np.repeat(np.arange(folds), sizes)
    return out


LOGIT = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("n_training_samples", T.LongType()),
        T.StructField("up_ratio", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("accuracy_std", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("means", T.ArrayType(T.DoubleType())),
        T.StructField("scales", T.ArrayType(T.DoubleType())),
        T.StructField("coefs", T.ArrayType(T.DoubleType())),
    ]
)


def logistic_fit(
    df: DataFrame, features: list[str] = CLASSIFICATION_FEATURES, min_rows: int = 30
) -> DataFrame:
    """One fitted logit per symbol with 5-fold accuracy, all symbols in one job.

    A symbol's group is its trading days, at most one row per calendar day.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x, y = pdf[features].to_numpy(float), pdf["target"].to_numpy(int)
        if len(x) < min_rows or len(np.unique(y)) < 2:
            return pd.DataFrame(columns=LOGIT.names)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale == 0] = 1.0
        z = (x - mean) / scale
        w, fold, scores = fit_logit(z, y), stratified_folds(y), []
        for k in range(5):
            held = fold == k
            v = fit_logit(z[~held], y[~held])
            scores.append(float(np.mean(((v[0] + z[held] @ v[1:]) > 0) == (y[held] == 1))))
        row = (
            pdf["symbol"].iloc[0], len(x), float(y.mean()), float(np.mean(scores)),
            float(np.std(scores)), float(w[0]), mean, scale, w[1:],
        )
        return pd.DataFrame([row], columns=LOGIT.names)

    return (
        df.select("symbol", "date", "target", *features).groupBy("symbol").applyInPandas(fit, LOGIT)
    )


def logistic_summary(fits: DataFrame, features: list[str] = CLASSIFICATION_FEATURES) -> DataFrame:
    """One row per (symbol, feature) with coefficient, importance and the fit figures."""
    names = F.array(*[F.lit(f) for f in features])
    return fits.withColumn("_c", F.explode(F.arrays_zip(names.alias("feature"), "coefs"))).select(
        "symbol",
        F.col("_c.feature").alias("feature"),
        F.col("_c.coefs").alias("coefficient"),
        F.abs("_c.coefs").alias("importance"),
        "intercept",
        "accuracy",
        "accuracy_std",
        "n_training_samples",
        "up_ratio",
    )


def logistic_direction(
    fits: DataFrame, current: dict[str, float], features: list[str] = CLASSIFICATION_FEATURES
) -> DataFrame:
    """UP/DOWN for the given feature values, with contributions by size."""
    names = F.array(*[F.lit(f) for f in features])
    values = F.array(*[F.lit(float(current.get(f, 0.0))) for f in features])
    parts = F.transform(
        F.arrays_zip(
            names.alias("feature"), values.alias("value"), "coefs", "means", "scales"
        ),
        lambda e: F.struct(
            F.abs(e["coefs"] * (e["value"] - e["means"]) / e["scales"]).alias("size"),
            e["feature"].alias("feature"),
            e["coefs"].alias("coefficient"),
            e["value"].alias("value"),
            (e["coefs"] * (e["value"] - e["means"]) / e["scales"]).alias("contribution"),
        ),
    )
    total = F.aggregate("contributions", F.col("intercept"), lambda s, e: s + e["contribution"])
    return (
        fits.withColumn("contributions", F.sort_array(parts, asc=False))
        .withColumn("probability_up", 1 / (1 + F.exp(-total)))
        .select(
            "symbol",
            F.when(F.col("probability_up") >= 0.5, "UP").otherwise("DOWN").alias("prediction"),
            "probability_up",
            "accuracy",
            "n_training_samples",
            "contributions",
        )
    )
