"""Trees as data: histogram boosting with regularised leaves, and Shapley values of trees.

A tree is arrays of nodes, small whatever the rows; predictions and Shapley values are columns made of it. Boosting reads
the rows as bins: each level of a round's trees is one aggregate of gradient and hessian sums by (tree, node, feature,
bin), whose best splits are found in Spark too, so that the driver gets a row for each node.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import drop_stored, stored
from .tabular import OperatorError, as_text, q


@dataclass
class Tree:
    """Node k sends a row left if its feature's value is at most threshold[k] (missing: if missing_left[k]); feature -1 marks a leaf.

    cover: the rows (or hessian) that came to a node when the tree was taught."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for own, x in ((self.feature, -1), (self.threshold, math.nan), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover)):
            own.append(x)
        return len(self.feature) - 1

    def split(self, k: int, feature: int, threshold: float, missing_left: bool, left: int, right: int) -> None:
        self.feature[k], self.threshold[k], self.missing_left[k], self.left[k], self.right[k] = feature, threshold, missing_left, left, right

    def goes_left(self, k: int, x: Column) -> Column:
        return F.coalesce(F.when(~F.isnan(x), x <= self.threshold[k]), F.lit(self.missing_left[k]))

    def column(self, features: list[Column], k: int = 0, leaf=None) -> Column:
        """The value of the leaf that a row comes to, or leaf(k)."""
        if self.feature[k] < 0:
            return leaf(k) if leaf else F.lit(self.value[k])
        return F.when(self.goes_left(k, features[self.feature[k]]), self.column(features, self.left[k], leaf)).otherwise(self.column(features, self.right[k], leaf))

    def leaves(self) -> list[tuple[float, dict[int, tuple[list[tuple[int, bool]], float]]]]:
        """(value, {feature: ([(node, left)], share)}) of each leaf: the turns on its path by feature, and the product of the
        shares of cover that those turns keep."""
        out, todo = [], [(0, {})]
        while todo:
            k, path = todo.pop()
            if self.feature[k] < 0:
                out.append((self.value[k], path))
                continue
            for child, is_left in ((self.left[k], True), (self.right[k], False)):
                turns, share = path.get(self.feature[k], ([], 1.0))
                todo.append((child, path | {self.feature[k]: ([*turns, (k, is_left)], share * self.cover[child] / self.cover[k] if self.cover[k] else 0.0)}))
        return out

    def mean(self) -> float:
        """The value expected of rows distributed like those that taught the tree."""
        return sum(v * math.prod(s for _, s in path.values()) for v, path in self.leaves())


@dataclass
class Ensemble:
    """base plus the sum of the trees, over columns named by features."""

    features: list[str]
    base: float
    trees: list[Tree]

    def column(self) -> Column:
        x = [q(c).cast("double") for c in self.features]
        return reduce(lambda a, b: a + b, [t.column(x) for t in self.trees], F.lit(self.base))


def _path_weights(shares: list[float]) -> list[list[float]]:
    """Shapley values of a leaf of value 1: for each pattern of turns taken (bit j: feature j's), one for each feature on the path."""
    u = len(shares)
    weight = [math.factorial(k) * math.factorial(u - k - 1) / math.factorial(u) for k in range(u)]
    table = []
    for pattern in range(1 << u):
        taken = [pattern >> j & 1 for j in range(u)]
        row = []
        for i in range(u):
            poly = np.ones(1)  # coefficient k: the sum over sets of k other features that are known
            for j in range(u):
                if j != i:
                    poly = np.convolve(poly, [shares[j], taken[j]])
            row.append(float((taken[i] - shares[i]) * (poly @ weight)))
        table.append(row)
    return table


def tree_shap(df: DataFrame, ensemble: Ensemble, prefix: str = "shap_") -> DataFrame:
    """df with shap_<feature> and shap_base: path-dependent Shapley values of the ensemble's sum, exact.

    They add up to the prediction less shap_base, the mean over the rows that taught the trees as their covers tell. Each
    leaf is a table, made beforehand, of what it gives each feature on its path for each pattern of turns that a row takes; a row's
    value is a sum of look-ups in columns. Missing values go as the trees send them. The tables double with each feature on a path.
    """
    x = [q(c).cast("double") for c in ensemble.features]
    parts: list[list[Column]] = [[] for _ in ensemble.features]
    for tree in ensemble.trees:
        for value, path in tree.leaves():
            if not path or not value:
                continue
            own = list(path.items())
            table = _path_weights([share for _, (_, share) in own])
            bits = []
            for j, (feature, (turns, _)) in enumerate(own):
                went = [tree.goes_left(k, x[feature]) if is_left else ~tree.goes_left(k, x[feature]) for k, is_left in turns]
                bits.append(F.when(reduce(lambda a, b: a & b, went), F.lit(1 << j)).otherwise(F.lit(0)))
            mask = reduce(lambda a, b: a + b, bits) + 1
            for j, (feature, _) in enumerate(own):
                parts[feature].append(F.element_at(F.array(*(F.lit(value * row[j]) for row in table)), mask))
    base = ensemble.base + sum(t.mean() for t in ensemble.trees)
    sums = {f"{prefix}{c}": reduce(lambda a, b: a + b, p, F.lit(0.0)) for c, p in zip(ensemble.features, parts, strict=True)}
    return df.withColumns(sums | {f"{prefix}base": F.lit(base)})


def ml_trees(model, features: list[str], label: int | None = None) -> Ensemble:
    """An MLlib tree, forest or boosted ensemble as an Ensemble: a forest's mean, boosting's weighted sum (a margin for
    classifiers), or, with the place of a label, the share of it in the leaves."""
    members = list(model.trees) if hasattr(model, "trees") else [model]
    boosted = type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1 / len(members)] * len(members)

    def read(node, tree: Tree, scale: float) -> int:
        stats = node.impurityStats()
        if label is None or boosted:
            value = float(node.prediction())
        else:
            own = list(stats.stats())
            value = own[label] / sum(own)
        k = tree.add(value * scale, float(stats.count()))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            left, right = read(node.leftChild(), tree, scale), read(node.rightChild(), tree, scale)
            tree.split(k, split.featureIndex(), float(split.threshold()), False, left, right)
        return k

    trees = []
    for member, w in zip(members, weights, strict=True):
        tree = Tree()
        read(member._java_obj.rootNode(), tree, float(w))
        trees.append(tree)
    return Ensemble(features, 0.0, trees)


def shap_summary(shap: DataFrame, features: list[str], prefix: str = "shap_") -> DataFrame:
    """(feature, mean_abs, mean): the size and the mean of each feature's values over all rows."""
    row = shap.agg(*(F.avg(F.abs(q(prefix + c))).alias(f"a{k}") for k, c in enumerate(features)), *(F.avg(q(prefix + c)).alias(f"m{k}") for k, c in enumerate(features)))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"a{k}").alias("mean_abs"), F.col(f"m{k}").alias("mean")) for k, c in enumerate(features)))
    return row.select(F.inline(cells))


def cut_points(df: DataFrame, features: list[str], max_bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """For each feature, at most max_bins - 1 values by which rows are binned: quantiles, in one aggregate. Missing values and NaN are left out."""
    shares = [k / max_bins for k in range(1, max_bins)]
    x = lambda c: F.when(~F.isnan(q(c).cast("double")), q(c).cast("double"))
    row = df.agg(*(F.percentile_approx(x(c), shares, accuracy).alias(f"c{k}") for k, c in enumerate(features)), *(F.min(x(c)).alias(f"l{k}") for k, c in enumerate(features))).first()
    return [sorted({float(v) for v in row[f"c{k}"] or []} - {row[f"l{k}"]}) for k in range(len(features))]


def _threshold(cuts: list[float], upto: int) -> float:
    """The highest value in bins 0 to upto: bin b has the values from cuts[b - 1] to below cuts[b]."""
    return float(np.nextafter(cuts[upto], -math.inf)) if upto < len(cuts) else math.inf


def boost(
    df: DataFrame, target: str, features: list[str], labels: list[str] | None = None, rounds: int = 100, max_depth: int = 6, learning_rate: float = 0.3, reg_lambda: float = 1.0, gamma: float = 0.0,
    min_child_weight: float = 1.0, min_samples_leaf: int = 1, max_bins: int = 256, subsample: float = 1.0, seed: int = 42, cuts: list[list[float]] | None = None,
) -> list[Ensemble]:
    """Boosted trees of second order: one Ensemble of margins for a numeric target (squared error) or two labels (logistic: margin of
    the second), one for each label beyond two (softmax).

    A node's best split has the highest gain in regularised score (gain of less than gamma or nothing: a leaf), ties to the first
    feature and the lower bin; missing values go to the side that gains more. A leaf's value is -G / (H + reg_lambda) times
    learning_rate. Rows without a target teach nothing. Margins are stored after each round, so a lost executor costs one round.
    """
    x = lambda c: F.coalesce(q(c).cast("double"), F.lit(math.nan))
    rows = df.where(q(target).isNotNull())
    cuts = cuts or cut_points(rows, features, max_bins)
    k_out = 1 if labels is None or len(labels) < 3 else len(labels)
    if labels is None:
        y = q(target).cast("double")
    else:
        y = F.array_position(F.array(*map(F.lit, labels)), as_text(q(target))).cast("double") - 1
        rows = rows.where(y >= 0)
    names = [f"_x{k}" for k in range(len(features))]
    rows = rows.select(*(x(c).alias(n) for c, n in zip(features, names, strict=True)), y.alias("_y"))
    varied = [k for k, c in enumerate(cuts) if c]
    binned = Bucketizer(splitsArray=[[-math.inf, *cuts[k], math.inf] for k in varied], inputCols=[names[k] for k in varied], outputCols=[f"_b{k}" for k in varied], handleInvalid="keep").transform(rows) if varied else rows
    bins = F.array(*(F.when(F.isnan(n), -1).otherwise(F.col(f"_b{k}").cast("int") if cuts[k] else F.lit(0)) for k, n in enumerate(names)))
    told = rows.agg(F.avg("_y").alias("m"), *(F.count(F.when(F.col("_y") == k, 1)).alias(f"n{k}") for k in range(k_out)), F.count(F.lit(1)).alias("n")).first()
    if not told["n"]:
        raise OperatorError("no rows with a target")
    if labels is None:
        base = [float(told["m"])]
    elif k_out == 1:
        p = min(max(float(told["m"]), 1e-6), 1 - 1e-6)
        base = [math.log(p / (1 - p))]
    else:
        base = [math.log(max(told[f"n{k}"], 0.5) / told["n"]) for k in range(k_out)]

    def sloped(table: DataFrame) -> DataFrame:
        """_g and _h, the slopes of the loss at the margins _m."""
        m = [F.col("_m")[k] for k in range(k_out)]
        if labels is None:
            g, h = [m[0] - F.col("_y")], [F.lit(1.0)]
        elif k_out == 1:
            p = 1 / (1 + F.exp(-m[0]))
            g, h = [p - F.col("_y")], [F.greatest(p * (1 - p), F.lit(1e-16))]
        else:
            top = F.array_max("_m")
            total = reduce(lambda a, b: a + b, [F.exp(v - top) for v in m])
            p = [F.exp(v - top) / total for v in m]
            g, h = [v - (F.col("_y") == k).cast("double") for k, v in enumerate(p)], [F.greatest(2 * v * (1 - v), F.lit(1e-16)) for v in p]
        return table.withColumns({"_g": F.array(*g), "_h": F.array(*h)})

    now = stored(sloped(binned.select(bins.alias("_b"), "_y", F.array(*map(F.lit, base)).alias("_m"), F.monotonically_increasing_id().alias("_i"))))
    trees: list[list[Tree]] = [[] for _ in range(k_out)]
    at = [F.col("_b")[f] for f in range(len(features))]
    for t in range(rounds):
        used = now if subsample >= 1 else now.where(F.pmod(F.xxhash64(F.lit(seed + t), "_i"), F.lit(1 << 20)) < int(subsample * (1 << 20)))
        grown = [Tree() for _ in range(k_out)]
        open_ = [{g.add(0.0, 0.0)} for g in grown]
        splits: list[dict[int, tuple[int, int, bool]]] = [{} for _ in range(k_out)]

        def where(k: int, node: int = 0) -> Column:
            if node not in splits[k]:
                return F.lit(node)
            f, s, missing = splits[k][node]
            go = F.when(at[f] < 0, F.lit(missing)).otherwise(at[f] <= s)
            return F.when(go, where(k, grown[k].left[node])).otherwise(where(k, grown[k].right[node]))

        for _ in range(max_depth):
            if not any(open_):
                break
            nodes = used.select("_b", F.explode(F.arrays_zip(F.array(*(F.lit(k) for k in range(k_out))).alias("k"), F.array(*(where(k) for k in range(k_out))).alias("node"), F.col("_g").alias("g"), F.col("_h").alias("h"))).alias("e"))
            wanted = reduce(lambda a, b: a | b, [(F.col("e.k") == k) & F.col("e.node").isin([*own]) for k, own in enumerate(open_) if own])
            best = _best_splits(nodes.where(wanted).select("e.*", F.posexplode("_b").alias("f", "bin")), reg_lambda, min_child_weight, min_samples_leaf)
            after: list[set[int]] = [set() for _ in range(k_out)]
            for r in best.collect():  # a row for each node
                k, node, tree = r["k"], r["node"], grown[r["k"]]
                tree.cover[node], tree.value[node] = r["hs"], -r["gs"] / (r["hs"] + reg_lambda) * learning_rate
                b = r["best"]
                if b is None or b["gain"] <= 0 or b["gain"] / 2 <= gamma:
                    continue
                sides = [(b["gl"], b["hl"]), (r["gs"] - b["gl"], r["hs"] - b["hl"])]
                left, right = (tree.add(-g / (h + reg_lambda) * learning_rate, h) for g, h in sides)
                tree.split(node, -b["f"], _threshold(cuts[-b["f"]], -b["bin"]), b["missing_left"], left, right)
                splits[k][node] = (-b["f"], -b["bin"], b["missing_left"])
                after[k] |= {left, right}
            open_ = after
        for own, tree in zip(trees, grown, strict=True):
            own.append(tree)
        if all(len(g.feature) == 1 and abs(g.value[0]) < 1e-12 for g in grown):
            break

        def leaf(k: int, node: int = 0) -> Column:
            if node not in splits[k]:
                return F.lit(grown[k].value[node])
            f, s, missing = splits[k][node]
            go = F.when(at[f] < 0, F.lit(missing)).otherwise(at[f] <= s)
            return F.when(go, leaf(k, grown[k].left[node])).otherwise(leaf(k, grown[k].right[node]))

        if t < rounds - 1:
            moved = F.array(*(F.col("_m")[k] + leaf(k) for k in range(k_out)))
            after_round = stored(sloped(now.select("_b", "_y", moved.alias("_m"), "_i")))
            drop_stored(now)
            now = after_round
    drop_stored(now)
    return [Ensemble(features, b, own) for b, own in zip(base, trees, strict=True)]


def _best_splits(cells: DataFrame, reg_lambda: float, min_child_weight: float, min_samples_leaf: int) -> DataFrame:
    """(k, node, gs, hs, best) of rows (k, node, f, bin, g, h): each node's sums and its best split, f and bin negated; bin -1 is of missing values."""
    key = ["k", "node", "f"]
    hist = cells.groupBy(*key, "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("c"))
    hist = hist.repartition("k", "node")  # a node's cells, as many as features and bins, stay together from here on
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("bin") >= 0
    sums = {f"{c}s": F.sum(c).over(whole) for c in "ghc"} | {f"{c}m": F.coalesce(F.sum(F.when(~known, F.col(c))).over(whole), F.lit(0)) for c in "ghc"} | {f"{c}l": F.sum(F.when(known, F.col(c)).otherwise(0)).over(upto) for c in "ghc"}
    hist = hist.withColumns(sums | {"last": F.max("bin").over(whole)})

    def choice(missing_left: bool) -> Column:
        gl, hl, cl = (F.col(f"{c}l") + (F.col(f"{c}m") if missing_left else F.lit(0)) for c in "ghc")
        gr, hr, cr = F.col("gs") - gl, F.col("hs") - hl, F.col("cs") - cl
        score = lambda g, h: g * g / (h + reg_lambda + 1e-300)
        gain = F.round(score(gl, hl) + score(gr, hr) - score(F.col("gs"), F.col("hs")), 9)
        fits = known & (cl >= max(1, min_samples_leaf)) & (cr >= max(1, min_samples_leaf)) & (hl >= min_child_weight) & (hr >= min_child_weight) & ((F.col("bin") < F.col("last")) | (F.col("cm") > 0))
        if missing_left:
            fits = fits & (F.col("cm") > 0) & (F.col("bin") < F.col("last"))
        return F.when(fits & (gain > 0), F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), F.lit(missing_left).alias("missing_left"), gl.cast("double").alias("gl"), hl.cast("double").alias("hl")))

    hist = hist.withColumns({"a": choice(False), "b": choice(True)})
    best = F.greatest(F.max("a"), F.max("b"))
    return hist.groupBy("k", "node").agg(F.max(F.when(F.col("f") == 0, F.col("gs"))).alias("gs"), F.max(F.when(F.col("f") == 0, F.col("hs"))).alias("hs"), best.alias("best"))
