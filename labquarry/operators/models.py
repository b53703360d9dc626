"""Models: MLlib where it has the estimator, and exact closed forms over Spark aggregates where it has not.

Every fit returns a Model, whose predict() adds `prediction` (and `prob_<class>` for classifiers). Rows that lack a
feature or the target teach nothing and get no prediction.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml import clustering as mlk
from pyspark.ml import regression as mlr
from pyspark.ml.classification import OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .tabular import OperatorError, as_text, numeric, q


@dataclass
class Model:
    """transform(df) adds the prediction; features, target, labels and task say what it was fitted on."""

    task: str
    features: list[str]
    target: str | None
    transform: Callable[[DataFrame], DataFrame]
    labels: list[str] = field(default_factory=list)
    importances: dict[str, float] = field(default_factory=dict)
    pipeline: PipelineModel | None = None
    linear: dict[str, float] | None = None
    ensembles: list[trees.Ensemble] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.transform(df)


def _known(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [q(c).isNotNull() for c in names], F.lit(True)))


def _labels(df: DataFrame, target: str, most: int = 1000) -> list[str]:
    found = [r[0] for r in df.select(as_text(q(target))).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise OperatorError(f"more than {most} classes")
    return sorted(found)


def _code(labels: list[str], c: Column) -> Column:
    """The place of a label, by a map literal as long as the labels."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in enumerate(labels) for x in (v, float(k))]), as_text(c))


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


CLASSIFIERS: dict[str, Callable[..., object]] = {
    "random_forest": lambda n, n_estimators=100, max_depth=0, seed=42, **_: mlc.RandomForestClassifier(numTrees=n_estimators, maxDepth=max_depth or 12, seed=seed),
    "extra_trees": lambda n, n_estimators=100, max_depth=0, seed=42, **_: mlc.RandomForestClassifier(numTrees=n_estimators, maxDepth=max_depth or 12, seed=seed, bootstrap=False, featureSubsetStrategy="sqrt"),
    "decision_tree": lambda n, max_depth=0, seed=42, **_: mlc.DecisionTreeClassifier(maxDepth=max_depth or 12, seed=seed),
    "logistic_regression": lambda n, C=1.0, max_iter=100, **_: mlc.LogisticRegression(regParam=1 / (C * max(1, n)), maxIter=max_iter, standardization=False),  # noqa: N803
    "svm": lambda n, C=1.0, max_iter=100, **_: mlc.LinearSVC(regParam=1 / (C * max(1, n)), maxIter=max_iter),  # noqa: N803
    "gradient_boosting": lambda n, n_estimators=100, max_depth=3, learning_rate=0.1, seed=42, **_: mlc.GBTClassifier(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, seed=seed),
}
REGRESSORS: dict[str, Callable[..., object]] = {
    "random_forest": lambda n, n_estimators=100, max_depth=0, seed=42, **_: mlr.RandomForestRegressor(numTrees=n_estimators, maxDepth=max_depth or 12, seed=seed),
    "extra_trees": lambda n, n_estimators=100, max_depth=0, seed=42, **_: mlr.RandomForestRegressor(numTrees=n_estimators, maxDepth=max_depth or 12, seed=seed, bootstrap=False, featureSubsetStrategy="all"),
    "decision_tree": lambda n, max_depth=0, seed=42, **_: mlr.DecisionTreeRegressor(maxDepth=max_depth or 12, seed=seed),
    "gradient_boosting": lambda n, n_estimators=100, max_depth=3, learning_rate=0.1, seed=42, **_: mlr.GBTRegressor(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, seed=seed),
    "lasso": lambda n, alpha=1.0, max_iter=1000, **_: mlr.LinearRegression(regParam=alpha, elasticNetParam=1.0, maxIter=max_iter, standardization=False),
    "elastic_net": lambda n, alpha=1.0, l1_ratio=0.5, max_iter=1000, **_: mlr.LinearRegression(regParam=alpha, elasticNetParam=l1_ratio, maxIter=max_iter, standardization=False),
}
_BINARY_ONLY = {"svm", "gradient_boosting"}
#: Histogram boosting: what its two forms set unless told otherwise. Trees grow level by level in both.
BOOSTED: dict[str, dict] = {
    "xgboost": {"max_depth": 6, "learning_rate": 0.3, "reg_lambda": 1.0, "min_child_weight": 1.0, "max_bins": 256},
    "hist_gradient_boosting": {"max_depth": 5, "learning_rate": 0.1, "reg_lambda": 0.0, "min_child_weight": 1e-3, "min_samples_leaf": 20, "max_bins": 255},
}


def _boosted(rows: DataFrame, kind: str, target: str, features: list[str], labels: list[str] | None, n_estimators: int = 100, **parameters) -> Model:
    """Boosted trees of operators/trees.py; unlike the others they take rows with missing features."""
    given = {k: v for k, v in parameters.items() if not (k == "max_depth" and not v)}
    found = trees.boost(rows, target, features, labels, rounds=n_estimators, **(BOOSTED[kind] | given))
    return _boosted_model(found, features, target, labels or [])


def _boosted_model(found: list[trees.Ensemble], features: list[str], target: str | None, labels: list[str]) -> Model:
    used = {c: 0.0 for c in features}
    for t in [t for e in found for t in e.trees]:
        for k, f in enumerate(t.feature):
            if f >= 0:
                used[features[f]] += t.cover[k]
    importance = {c: v / (sum(used.values()) or 1.0) for c, v in used.items()}
    if not labels:
        return Model("regression", features, target, lambda df: df.withColumn("prediction", found[0].column()), importances=importance, ensembles=found)
    scores = dict(zip(labels, [F.lit(0.0), found[0].column()] if len(found) == 1 else [e.column() for e in found], strict=False))
    return Model("classification", features, target, _scored(scores, True), labels, importance, ensembles=found)


def fit_classifier(df: DataFrame, kind: str, target: str, features: list[str] | None = None, **parameters) -> Model:
    """A classifier of CLASSIFIERS or BOOSTED, or mlp, naive_bayes, lda, qda or ridge. Two-class methods are fitted one against the rest."""
    features = features or [c for c in numeric(df) if c != target]
    if kind in BOOSTED:
        return _boosted(df, kind, target, features, _labels(_known(df, [target]), target), **parameters)
    rows = _known(df, [*features, target])
    labels = _labels(rows, target)
    if kind in ("naive_bayes", "lda", "qda"):
        return _gaussian(rows, kind, target, features, labels, **parameters)
    if kind == "ridge":
        return _ridge_classifier(rows, target, features, labels, parameters.get("alpha", 1.0))
    coded = rows.withColumn("_label", _code(labels, q(target)))
    n = coded.count()
    if kind == "mlp":
        hidden = [int(x) for x in str(parameters.get("hidden_layer_sizes", "100")).split(",")]
        estimator = mlc.MultilayerPerceptronClassifier(layers=[len(features), *hidden, max(2, len(labels))], maxIter=parameters.get("max_iter", 200), seed=parameters.get("seed", 42))
    elif kind in CLASSIFIERS:
        estimator = CLASSIFIERS[kind](n, **parameters)
    else:
        raise OperatorError(f"no classifier {kind!r}")
    if kind in _BINARY_ONLY and len(labels) > 2:
        estimator = OneVsRest(classifier=estimator)
    estimator.setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("_prediction")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), estimator]).fit(coded)
    return _ml_classifier(fitted, features, target, labels)


def _ml_classifier(fitted: PipelineModel, features: list[str], target: str, labels: list[str]) -> Model:


    def transform(rows: DataFrame) -> DataFrame:
        out = fitted.transform(rows)
        label = F.element_at(F.array(*map(F.lit, labels)), (F.col("_prediction") + 1).cast("int"))
        out = out.withColumn("prediction", label)
        if "probability" in out.columns:
            out = out.withColumns({f"prob_{x}": vector_to_array("probability")[k] for k, x in enumerate(labels)})
        return out.drop("_features", "_prediction", "rawPrediction", "probability", "_label")

    last = fitted.stages[-1]
    weights = getattr(last, "featureImportances", None)
    importance = dict(zip(features, map(float, weights.toArray()), strict=True)) if weights is not None else {}
    return Model("classification", features, target, transform, labels, importance, fitted)


def fit_regressor(df: DataFrame, kind: str, target: str, features: list[str] | None = None, **parameters) -> Model:
    """A regressor of REGRESSORS or BOOSTED, or linear, ridge or bayesian_ridge, which solve the normal equations."""
    features = features or [c for c in numeric(df) if c != target]
    rows = _known(df, [*features, target])
    if kind in BOOSTED:
        return _boosted(df, kind, target, features, None, **parameters)
    if kind in ("linear", "ridge", "bayesian_ridge"):
        return _least_squares(rows, kind, target, features, **parameters)
    if kind not in REGRESSORS:
        raise OperatorError(f"no regressor {kind!r}")
    estimator = REGRESSORS[kind](rows.count(), **parameters)
    estimator.setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("_prediction")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), estimator]).fit(rows.withColumn("_label", q(target).cast("double")))
    return _ml_regressor(fitted, features, target)


def _ml_regressor(fitted: PipelineModel, features: list[str], target: str) -> Model:
    last = fitted.stages[-1]
    weights = getattr(last, "featureImportances", None)
    importance = dict(zip(features, map(float, weights.toArray()), strict=True)) if weights is not None else {}
    linear = None
    if hasattr(last, "coefficients"):
        linear = dict(zip(features, map(float, last.coefficients.toArray()), strict=True)) | {"intercept": float(last.intercept)}
        importance = {c: abs(linear[c]) for c in features}
    return Model("regression", features, target, lambda rows: fitted.transform(rows).withColumnRenamed("_prediction", "prediction").drop("_features", "_label"), importances=importance, pipeline=fitted, linear=linear)


def moments(rows: DataFrame, columns: list[Column], group: Column | None = None) -> dict:
    """{group: (n, sums, sums of products)} in one aggregate; as wide as the columns, whatever the rows."""
    m = len(columns)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    c = [x.cast("double") for x in columns]
    keyed = rows.groupBy((group if group is not None else F.lit("all")).alias("_g"))
    out = {}
    for r in keyed.agg(F.count(F.lit(1)), *(F.sum(x) for x in c), *(F.sum(c[i] * c[j]) for i, j in pairs)).collect():
        s = np.zeros((m, m))
        for v, (i, j) in zip(r[2 + m :], pairs, strict=True):
            s[i, j] = s[j, i] = v
        out[r[0]] = (r[1], np.array(r[2 : 2 + m], float), s)
    return out


def _linear_form(features: list[str], weights, intercept: float) -> Column:
    return reduce(lambda a, b: a + b, [q(c).cast("double") * float(w) for c, w in zip(features, weights, strict=True)], F.lit(float(intercept)))


def _least_squares(rows: DataFrame, kind: str, target: str, features: list[str], alpha: float = 1.0, fit_intercept: bool = True, max_iter: int = 300, **_) -> Model:
    found = moments(rows, [*map(q, features), q(target)])
    if not found:
        raise OperatorError("no complete rows")
    n, total, s = found["all"]
    mean = total / n if fit_intercept else np.zeros_like(total)
    s = s - n * np.outer(mean, mean)
    a, b, yy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
    if kind == "linear":
        w = np.linalg.lstsq(a, b, rcond=None)[0]
    elif kind == "ridge":
        w = np.linalg.solve(a + alpha * np.eye(len(b)), b)
    else:
        noise, prior, w = 1 / max(yy / n, 1e-12), 1.0, np.zeros(len(b))
        values = np.clip(np.linalg.eigvalsh(a), 0, None)
        for _i in range(max_iter):
            new = np.linalg.solve(noise * a + prior * np.eye(len(b)), noise * b)
            gamma = float((noise * values / (prior + noise * values)).sum())
            sse = max(yy - 2 * new @ b + new @ a @ new, 1e-12)
            prior, noise = (gamma + 2e-6) / (float(new @ new) + 2e-6), (n - gamma + 2e-6) / (sse + 2e-6)
            done, w = np.abs(new - w).sum() < 1e-3, new
            if done:
                break
    intercept = float(mean[-1] - mean[:-1] @ w)
    form = _linear_form(features, w, intercept)
    linear = {c: float(x) for c, x in zip(features, w, strict=True)} | {"intercept": intercept}
    return Model("regression", features, target, lambda df: df.withColumn("prediction", form), importances={c: abs(linear[c]) for c in features}, linear=linear)


def _scored(scores: dict[str, Column], softmax: bool) -> Callable[[DataFrame], DataFrame]:
    def transform(df: DataFrame) -> DataFrame:
        best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-k).alias("k"), F.lit(x).alias("x")) for k, (x, s) in enumerate(scores.items()))))
        out = df.withColumn("_best", best)
        if softmax:
            top = F.col("_best")["s"]
            total = reduce(lambda a, b: a + b, [F.exp(s - top) for s in scores.values()])
            out = out.withColumns({f"prob_{x}": F.exp(s - top) / total for x, s in scores.items()})
        return out.withColumn("prediction", F.when(F.col("_best")["s"].isNotNull(), F.col("_best")["x"])).drop("_best")

    return transform


def _gaussian(rows: DataFrame, kind: str, target: str, features: list[str], labels: list[str], reg_param: float = 0.0, **_) -> Model:
    """Gaussian naive Bayes, linear and quadratic discriminants: one aggregate of class moments, scores as plain columns."""
    found = moments(rows, [q(c) for c in features], as_text(q(target)))
    total = sum(n for n, _, _ in found.values())
    means = {x: s / n for x, (n, s, _) in found.items()}
    scatter = {x: ss - n * np.outer(means[x], means[x]) for x, (n, _, ss) in found.items()}
    pooled = sum(scatter.values()) / max(1, total - len(found))
    whole = sum(ss for _, _, ss in found.values()) / total - np.outer(*[sum(s for _, s, _ in found.values()) / total] * 2)
    scores = {}
    for x in labels:
        n = found[x][0]
        if kind == "naive_bayes":
            cov = np.diag(np.diag(scatter[x]) / n + 1e-9 * max(1e-300, np.diag(whole).max()))
        elif kind == "lda":
            cov = pooled
        else:
            cov = (1 - reg_param) * scatter[x] / max(1, n - 1) + reg_param * np.eye(len(features))
        inverse = np.linalg.pinv(cov)
        sign, logdet = np.linalg.slogdet(cov)
        d = [q(c).cast("double") - float(m) for c, m in zip(features, means[x], strict=True)]
        square = reduce(lambda a, b: a + b, [d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d)) if inverse[i, j] != 0], F.lit(0.0))
        scores[x] = F.lit(math.log(n / total) - 0.5 * (logdet if sign > 0 else 0.0)) - square / 2
    return Model("classification", features, target, _scored(scores, True), labels)


def _ridge_classifier(rows: DataFrame, target: str, features: list[str], labels: list[str], alpha: float) -> Model:
    signs = [F.when(as_text(q(target)) == x, 1.0).otherwise(-1.0) for x in labels]
    n, total, s = moments(rows, [*map(q, features), *signs])["all"]
    mean, f = total / n, len(features)
    s = s - n * np.outer(mean, mean)
    w = np.linalg.solve(s[:f, :f] + alpha * np.eye(f), s[:f, f:])
    scores = {x: _linear_form(features, w[:, k], mean[f + k] - mean[:f] @ w[:, k]) for k, x in enumerate(labels)}
    return Model("classification", features, target, _scored(scores, False), labels, {c: float(np.abs(w[k]).mean()) for k, c in enumerate(features)})


def k_means(df: DataFrame, columns: list[str] | None = None, k: int = 3, seed: int = 42) -> tuple[DataFrame, Model]:
    """df with cluster, from 0; rows that lack a column get none."""
    columns = columns or numeric(df)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip"), mlk.KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster")]).fit(_known(df, columns))
    model = Model("clustering", columns, None, lambda rows: fitted.transform(rows.drop("cluster")).drop("_features"), pipeline=fitted)
    return model.predict(df), model


def pca(df: DataFrame, columns: list[str] | None = None, n_components: int | None = None, standardize: bool = True) -> dict[str, DataFrame]:
    """transformed (adds pc1, ...), loadings and variance; one aggregate of products, solved on the driver."""
    columns = columns or numeric(df)
    rows = _known(df, columns)
    n, total, s = moments(rows, [q(c) for c in columns])["all"]
    mean = total / n
    cov = (s - n * np.outer(mean, mean)) / max(1, n - 1)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None)) if standardize else np.ones(len(columns))
    sd = np.where(sd > 0, sd, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(values)[::-1][: n_components or len(columns)]
    values_all, values, vectors = np.clip(values, 0, None), np.clip(values[order], 0, None), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    pcs = {f"pc{k + 1}": reduce(lambda a, b: a + b, [(q(c).cast("double") - float(mean[i])) / float(sd[i]) * float(vectors[i, k]) for i, c in enumerate(columns)]) for k in range(len(order))}
    spark = df.sparkSession
    share = values / max(values_all.sum(), 1e-300)
    return {
        "transformed": rows.withColumns(pcs),
        "loadings": spark.createDataFrame([(c, *map(float, vectors[i])) for i, c in enumerate(columns)], "feature string, " + ", ".join(f"{p} double" for p in pcs)),
        "variance": spark.createDataFrame([(p, float(v), float(r), float(a)) for p, v, r, a in zip(pcs, values, share, np.cumsum(share), strict=True)], "component string, eigenvalue double, share double, cumulative double"),
    }


def feature_importance(model: Model, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(model.importances.items(), key=lambda x: -x[1]), "feature string, importance double")


def linear_contributions(model: Model, df: DataFrame) -> DataFrame:
    """Shapley values of a linear model, exact: weight times distance from the mean; columns shap_<feature> and shap_base."""
    if not model.linear:
        raise OperatorError("contributions have a closed form for linear models only")
    means = df.agg(*(F.avg(q(c)).alias(f"_m_{c}") for c in model.features))
    out = df.crossJoin(F.broadcast(means))  # one row
    base = reduce(lambda a, b: a + b, [q(f"_m_{c}") * model.linear[c] for c in model.features], F.lit(model.linear["intercept"]))
    out = out.withColumns({f"shap_{c}": (q(c) - q(f"_m_{c}")) * model.linear[c] for c in model.features} | {"shap_base": base})
    return out.drop(*(f"_m_{c}" for c in model.features))


def shap_values(model: Model, df: DataFrame, label: str | None = None) -> DataFrame:
    """df with shap_<feature> and shap_base of a model of trees (exact, path-dependent) or a linear one.

    label: of a forest or a decision tree, whose share of that label is explained, or of boosting beyond two labels (its margin).
    Boosting of two labels is explained by the margin of the second.
    """
    if model.linear:
        return linear_contributions(model, df)
    if model.ensembles:
        if len(model.ensembles) > 1 and label is None:
            raise OperatorError("which label is to be explained?")
        return trees.tree_shap(df, model.ensembles[model.labels.index(label) if len(model.ensembles) > 1 else 0])
    last = model.pipeline.stages[-1] if model.pipeline is not None else None
    if last is None or not (hasattr(last, "trees") or type(last).__name__.startswith("DecisionTree")):
        raise OperatorError("Shapley values are for trees and linear models")
    place = model.labels.index(label or model.labels[-1]) if model.task == "classification" else None
    return trees.tree_shap(df, trees.ml_trees(last, model.features, place))


SCORINGS = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "r2", "neg_mean_squared_error", "neg_mean_absolute_error", "neg_root_mean_squared_error")


def score(predicted: DataFrame, target: str, scoring: str) -> float:
    """One figure of predictions, from counts or sums in Spark."""
    from . import evaluation

    if scoring in ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro"):
        rows = {r["label"]: r for r in evaluation.classification_report(predicted, target, "prediction").where("label in ('accuracy', 'macro avg', 'weighted avg')").collect()}
        name, _, kind = scoring.partition("_")
        return float(rows["accuracy"]["f1"] if name == "accuracy" else rows[f"{kind} avg"][name])
    values = {r["metric"]: r["value"] for r in evaluation.regression_scores(predicted, target, "prediction").collect()}
    return {"r2": values["r2"], "neg_mean_squared_error": -values["mse"], "neg_mean_absolute_error": -values["mae"], "neg_root_mean_squared_error": -values["rmse"]}[scoring]


def cross_validate(df: DataFrame, fit: Callable[[DataFrame], Model], target: str, key: list[str], folds: int = 5, scoring: str = "accuracy", seed: int = 42) -> DataFrame:
    """(fold, score) of each fold, and rows mean and std; a row's fold depends on its key and the seed alone."""
    marked = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *(as_text(q(c)) for c in key)), F.lit(folds)))
    found = []
    for k in range(folds):
        model = fit(marked.where(F.col("_fold") != k).drop("_fold"))
        found.append(score(model.predict(marked.where(F.col("_fold") == k).drop("_fold")), target, scoring))
    rows = [(str(k + 1), s) for k, s in enumerate(found)] + [("mean", float(np.mean(found))), ("std", float(np.std(found)))]
    return df.sparkSession.createDataFrame(rows, "fold string, score double")


def grid_search(df: DataFrame, task: str, kind: str, target: str, key: list[str], grid: dict[str, list], features: list[str] | None = None, folds: int = 5, scoring: str | None = None) -> tuple[Model, DataFrame]:
    """The model of the best mean score, fitted on all rows, and (params, mean_score, std_score, rank) of each combination."""
    import itertools

    make = fit_classifier if task == "classification" else fit_regressor
    scoring = scoring or ("accuracy" if task == "classification" else "r2")
    rows = []
    for values in itertools.product(*grid.values()):
        p = dict(zip(grid, values, strict=True))
        cv = {r["fold"]: r["score"] for r in cross_validate(df, lambda d, p=p: make(d, kind, target, features, **p), target, key, folds, scoring).collect()}
        rows.append((p, cv["mean"], cv["std"]))
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][1], k))
    table = df.sparkSession.createDataFrame([(json.dumps(rows[k][0], sort_keys=True), rows[k][1], rows[k][2], i + 1) for i, k in enumerate(order)], "params string, mean_score double, std_score double, rank int")
    return make(df, kind, target, features, **rows[order[0]][0]), table


def save_model(model: Model, path: str, spark: SparkSession) -> None:
    """An MLlib model, or one of boosted trees, with what it was fitted on."""
    if model.pipeline is None and not model.ensembles:
        raise OperatorError("only MLlib models and boosted trees are saved")
    if model.pipeline is not None:
        model.pipeline.write().overwrite().save(f"{path}/pipeline")
    meta = {"task": model.task, "features": model.features, "target": model.target, "labels": model.labels, "ensembles": [asdict(e) for e in model.ensembles]}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(path: str, spark: SparkSession) -> Model:
    meta = json.loads(spark.read.text(f"{path}/about").first()[0])
    if meta.get("ensembles"):
        found = [trees.Ensemble(e["features"], e["base"], [trees.Tree(**t) for t in e["trees"]]) for e in meta["ensembles"]]
        return _boosted_model(found, meta["features"], meta["target"], meta["labels"])
    fitted = PipelineModel.load(f"{path}/pipeline")
    if meta["task"] == "classification":
        return _ml_classifier(fitted, meta["features"], meta["target"], meta["labels"])
    if meta["task"] == "regression":
        return _ml_regressor(fitted, meta["features"], meta["target"])
    return Model(meta["task"], meta["features"], None, lambda rows: fitted.transform(rows.drop("cluster")).drop("_features"), pipeline=fitted)
