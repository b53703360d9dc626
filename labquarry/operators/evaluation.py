"""Preparation and evaluation of models on tables: splits, scalers, encoders, confusion, curves, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special
from .information import mutual_information
from .running import accumulated
from .tabular import _need, as_text, numeric, q


def train_test_split(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42, stratify: str | None = None) -> dict[str, DataFrame]:
    """train and test; a row's side depends on its key and the seed alone. Stratified splits are exact in each class.

    key should be unique. Exact counts come from the order of a hash inside each class.
    """
    draw = F.xxhash64(F.lit(seed), *(as_text(q(c)) for c in key))
    if stratify is None:
        marked = df.withColumn("_test", F.pmod(draw, F.lit(1 << 40)) < int(test_size * (1 << 40)))
    else:
        by = Window.partitionBy(q(stratify))
        place = F.row_number().over(by.orderBy(draw, *(q(c) for c in key)))
        marked = df.withColumn("_test", place <= F.round(F.count(F.lit(1)).over(by) * test_size))
    return {"train": marked.where("not _test").drop("_test"), "test": marked.where("_test").drop("_test")}


def scale(df: DataFrame, columns: list[str] | None = None, method: str = "standard", fitted: DataFrame | None = None) -> dict[str, DataFrame]:
    """scaled, and the one-row scaler, which other tables can be scaled by. standard divides by the population deviation;
    a constant column gives 0."""
    columns = columns or numeric(df)
    if fitted is None:
        center, spread = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        fitted = df.agg(*(f(q(c)).cast("double").alias(f"{c}__{n}") for c in columns for n, f in (("center", center), ("spread", spread))))
    out = df.crossJoin(F.broadcast(fitted))  # one row
    scaled = {c: F.when(q(c).isNotNull(), F.coalesce(F.try_divide(q(c) - q(f"{c}__center"), q(f"{c}__spread")), F.lit(0.0))) for c in columns}
    return {"scaled": out.select(*(scaled[c].alias(c) if c in scaled else q(c) for c in df.columns)), "scaler": fitted}


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_encoded: the place of the value's text among the distinct texts, from 0. The distinct values are ranked, not the rows."""
    for c in columns:
        _need(df, c)
        text = as_text(q(c))
        labels = df.select(text.alias("_label")).distinct()
        labels = labels.withColumn(f"{c}_encoded", F.row_number().over(Window.orderBy("_label")) - 1)
        df = df.join(labels, text == F.col("_label"), "left").drop("_label")
    return df


def confusion(df: DataFrame, true: str, predicted: str, normalize: bool = False) -> DataFrame:
    """(true, predicted, value) for each pair of labels that occurs on either side; shares of the true label if normalized."""
    k = df.where(q(true).isNotNull() & q(predicted).isNotNull()).groupBy(q(true).cast("string").alias("true"), q(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    labels = k.select("true").union(k.select("predicted")).distinct()
    grid = labels.crossJoin(labels.withColumnRenamed("true", "predicted"))  # labels, not rows
    out = grid.join(k, ["true", "predicted"], "left").withColumn("value", F.coalesce("n", F.lit(0)).cast("double")).drop("n")
    if normalize:
        out = out.withColumn("value", F.coalesce(F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("true"))), F.lit(0.0)))
    return out


def classification_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) of each label, and rows accuracy, macro avg and weighted avg."""
    k = confusion(df, true, predicted)
    right = F.when(F.col("true") == F.col("predicted"), F.col("value")).otherwise(0.0)
    both = k.select(F.col("true").alias("label"), right.alias("tp"), F.col("value").alias("support"), F.lit(0.0).alias("picked")).union(k.select("predicted", F.lit(0.0), F.lit(0.0), "value"))
    s = both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("picked").alias("picked"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("picked")), "recall": ratio(F.col("tp"), F.col("support"))})
    s = s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    n = F.sum("support")
    measures = ("precision", "recall", "f1")
    macro = s.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in measures), n.alias("support"))
    weighted = s.agg(F.lit("weighted avg").alias("label"), *(ratio(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in measures), n.alias("support"))
    hits = ratio(F.sum("tp"), n)
    accuracy = s.agg(F.lit("accuracy").alias("label"), *(hits.alias(c) for c in measures), n.alias("support"))
    return s.select("label", *measures, "support").union(accuracy).union(macro).union(weighted)


def _curve_counts(df: DataFrame, true: str, score: str) -> DataFrame:
    """(score, tp, fp, p, n) at each distinct score, from the highest, by running sums that no single task holds."""
    k = df.where(q(true).isNotNull() & q(score).isNotNull()).groupBy(q(score).cast("double").alias("score")).agg(F.sum((q(true) == 1).cast("long")).alias("a"), F.count(F.lit(1)).alias("c"))
    k = accumulated(k.withColumn("b", F.col("c") - F.col("a")), "score", {"tp": "a", "fp": "b"}, descending=True)
    return k.crossJoin(F.broadcast(k.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))))  # one row


def roc_curve(df: DataFrame, true: str, score: str) -> DataFrame:
    """(score, tpr, fpr) at each distinct score; true is 0 or 1."""
    return _curve_counts(df, true, score).select("score", F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "n").alias("fpr"))


def roc_auc(df: DataFrame, true: str, score: str) -> DataFrame:
    c = _curve_counts(df, true, score)
    # A step's width is its own negatives; its height lies midway between the positives before and after it.
    area = F.try_divide("b", "n") * F.try_divide(F.col("tp") - F.col("a") / 2, "p")
    return c.agg(F.sum(area).alias("auc"))


def pr_curve(df: DataFrame, true: str, score: str) -> DataFrame:
    """(score, precision, recall) at each distinct score."""
    return _curve_counts(df, true, score).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "p").alias("recall"))


def average_precision(df: DataFrame, true: str, score: str) -> DataFrame:
    c = _curve_counts(df, true, score)
    return c.agg(F.sum(F.try_divide("a", "p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def regression_scores(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(metric, value): r2, mse, rmse, mae, median_ae, max_error and explained_variance, in one pass."""
    t, e = q(true).cast("double"), q(true).cast("double") - q(predicted)
    k = df.where(t.isNotNull() & e.isNotNull())
    row = k.agg(
        (1 - F.try_divide(F.sum(e * e), F.var_pop(t) * F.count(t))).alias("r2"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.median(F.abs(e)).alias("median_ae"), F.max(F.abs(e)).alias("max_error"), (1 - F.try_divide(F.var_pop(e), F.var_pop(t))).alias("explained_variance"),
    )
    return row.unpivot([], row.columns, "metric", "value")


def feature_scores(df: DataFrame, target: str, columns: list[str] | None = None, task: str = "classification") -> DataFrame:
    """(feature, score, p): F of a one-way layout by class (classification), or of the correlation with a numeric target (regression);
    or mutual information with a class (mutual_information), which has no p."""
    if task == "mutual_information":
        return mutual_information(df, target, columns).withColumn("p", F.lit(None).cast("double"))
    columns = columns or [c for c in numeric(df) if c != target]
    if task == "classification":
        long = df.where(q(target).isNotNull()).select(q(target).cast("string").alias("g"), *(q(c).cast("double").alias(c) for c in columns)).unpivot(["g"], columns, "feature", "v").where("v is not null")
        m = long.groupBy("feature", "g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
        t = m.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("b"), F.sum(F.col("n") * F.col("s")).alias("w"))
        t = t.withColumns({"score": F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))), "d1": F.col("k") - 1, "d2": F.col("n") - F.col("k")})
    else:
        row = df.agg(F.array(*(F.struct(F.lit(c).alias("feature"), F.corr(q(c).cast("double"), q(target).cast("double")).alias("r"), F.sum((q(c).isNotNull() & q(target).isNotNull()).cast("long")).alias("n")) for c in columns)).alias("x"))
        t = row.select(F.explode("x").alias("x")).select("x.*").withColumns({"d1": F.lit(1), "d2": F.col("n") - 2})
        t = t.withColumn("score", F.try_divide(F.col("r") ** 2 * F.col("d2"), 1 - F.col("r") ** 2))
    return t.withColumn("p", special.p_f(F.col("score"), F.col("d1"), F.col("d2"))).select("feature", "score", "p")


def select_features(df: DataFrame, target: str, k: int = 5, columns: list[str] | None = None, task: str = "classification") -> dict[str, DataFrame]:
    """selected: the target and the k best features; scores: of all. The features, not the rows, are looked at on the driver."""
    scores = feature_scores(df, target, columns, task)
    best = [r["feature"] for r in scores.orderBy(F.desc_nulls_last("score"), "feature").limit(max(1, k)).collect()]
    return {"selected": df.select(*(q(c) for c in df.columns if c in best or c == target)), "scores": scores}
