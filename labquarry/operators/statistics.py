"""Descriptive statistics and tests. Raw data is reduced by Spark aggregates; p-values are taken of the few result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special
from .running import accumulated, percentiles
from .tabular import OperatorError, numeric, q


def _known(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    df = df.where(q(value).isNotNull() & ~F.isnan(q(value).cast("double")))
    v = q(value).cast("double").alias("v")
    return df.select(v) if group is None else df.where(q(group).isNotNull()).select(q(group).cast("string").alias("g"), v)


def ranked(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """df with rank, the mean rank of equal values inside `by`, and ties, how many are equal.

    Values are counted first; the counts are summed in order without a task that holds all distinct values.
    """
    counts = accumulated(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties")), value, {"upto": "ties"}, by)
    counts = counts.withColumn("rank", F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2)
    counts = counts.select(*(F.col(c).alias(f"_r_{c}") for c in [*by, value]), "rank", "ties")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*by, value]])
    return df.join(counts, on).drop(*(f"_r_{c}" for c in [*by, value]))


def describe(df: DataFrame, columns: list[str] | None = None, group: str | None = None, ci_level: float = 0.95) -> DataFrame:
    """One row a column (and group): n, mean, median, std, sem, min, max, quartiles, iqr, range, cv_percent, skewness, kurtosis, ci_low, ci_high.

    Skewness and kurtosis are corrected for bias (null below 3 and 4 values); quantiles interpolate.
    """
    columns = columns or [c for c in numeric(df) if c != group]
    keys = [q(group).cast("string").alias("group")] if group else []
    long = df.select(*keys, *(q(c).cast("double").alias(c) for c in columns)).unpivot(["group"] if group else [], columns, "column", "v")
    long = long.where("v is not null")
    if group:
        long = long.where(F.col("group").isNotNull())
    n, v = F.count("v"), F.col("v")
    s = long.groupBy(*(["group"] if group else []), "column").agg(
        n.alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"),
    )
    n = F.col("n").cast("double")
    skew = F.when(n >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / F.try_divide(n - 2, F.when(n > 2, F.lit(1.0))))
    kurt = F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    s = s.withColumns({"sem": F.col("std") / F.sqrt(n), "iqr": F.col("q3") - F.col("q1"), "range": F.col("max") - F.col("min"), "cv_percent": F.try_divide(F.col("std") * 100, F.abs("mean")), "skewness": skew, "kurtosis": kurt})
    crit = special._column(lambda d: [special.t_quantile(0.5 + ci_level / 2, x) if x > 0 else float("nan") for x in d], F.col("n") - 1)
    s = s.withColumn("_t", crit).withColumns({"ci_low": F.col("mean") - F.col("_t") * F.col("sem"), "ci_high": F.col("mean") + F.col("_t") * F.col("sem")})
    return s.drop("_t", "g1", "g2")


def summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(stat, columns...): count, mean, std, min, quartiles and max of numeric columns, one row each."""
    columns = columns or numeric(df)
    forms = {"count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"), "25%": "p0", "50%": "p1", "75%": "p2", "max": lambda c: F.max(c).cast("double")}
    long = df.select(*(q(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns))).unpivot([], [f"c{k}" for k in range(len(columns))], "column", "v")
    parts = percentiles(long, "v", [0.25, 0.5, 0.75], ["column"])
    parts = parts.agg(*(F.max(F.when(F.col("column") == f"c{k}", F.col(x))).alias(f"_{x}_{k}") for k in range(len(columns)) for x in ("p0", "p1", "p2")))  # one row
    row = df.agg(*(f(q(c)).alias(f"_{name}_{k}") for k, c in enumerate(columns) for name, f in forms.items() if callable(f))).crossJoin(F.broadcast(parts))
    row = row.select(*(F.array(*(F.struct(F.lit(name).alias("stat"), F.col(f"`_{name if callable(f) else f}_{k}`").alias("v")) for name, f in forms.items())).alias(c) for k, c in enumerate(columns)))
    out = row.select(F.explode(F.arrays_zip(*columns)).alias("x"))
    return out.select(F.col(f"x.`{columns[0]}`.stat").alias("stat"), *(F.col(f"x.`{c}`.v").alias(c) for c in columns))


def _moments(df: DataFrame, value: str, group: str) -> DataFrame:
    return _known(df, value, group).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, ss_between, ss_within, df_between, df_within, f, p."""
    m = _moments(df, value, group)
    s = m.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("sum"), F.sum(F.col("n") * F.col("mean") ** 2).alias("square"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"))
    s = s.withColumns({"ss_between": F.col("square") - F.col("sum") ** 2 / F.col("n"), "df_between": F.col("groups") - 1, "df_within": F.col("n") - F.col("groups")})
    s = s.withColumn("f", F.try_divide(F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within")))
    return s.withColumn("p", special.p_f(F.col("f"), F.col("df_between"), F.col("df_within"))).drop("sum", "square")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, h (corrected for ties), p."""
    r = ranked(_known(df, value, group), [])
    g = r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"), F.sum(F.col("ties") ** 2 - 1).alias("t"))
    s = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.sum("t").alias("t"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (n**3 - n))
    s = s.withColumn("h", h)
    return s.withColumn("p", special.p_chi2(F.col("h"), F.col("groups") - 1)).drop("s", "t")


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row like anova(): analysis of variance of the distances from the group's median."""
    k = _known(df, value, group)
    m = k.groupBy("g").agg(F.median("v").alias("m")).withColumnRenamed("g", "_g")
    return anova(k.join(m, F.col("g") == F.col("_g")).select("g", F.abs(F.col("v") - F.col("m")).alias("v")), "v", "g")


def bartlett(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, statistic, p."""
    m = _moments(df, value, group)
    s = m.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("var")).alias("a"), F.sum((F.col("n") - 1) * F.log("var")).alias("b"), F.sum(1 / (F.col("n") - 1)).alias("c"))
    k, rest = F.col("groups"), F.col("n") - F.col("groups")
    stat = (rest * F.log(F.col("a") / rest) - F.col("b")) / (1 + (F.col("c") - 1 / rest) / (3 * (k - 1)))
    s = s.withColumn("statistic", stat)
    return s.withColumn("p", special.p_chi2(F.col("statistic"), F.col("groups") - 1)).select("groups", "n", "statistic", "p")


def f_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: the ratio of two groups' variances, the first by name over the second, and its two-sided p."""
    m = _moments(df, value, group)
    s = m.agg(F.sort_array(F.collect_list(F.struct("g", "n", "var"))).alias("m")).where(F.size("m") == 2)  # two groups only
    s = s.select((F.col("m")[0]["var"] / F.col("m")[1]["var"]).alias("f"), (F.col("m")[0]["n"] - 1).alias("d1"), (F.col("m")[1]["n"] - 1).alias("d2"))
    p = special.p_f(F.col("f"), F.col("d1"), F.col("d2"))
    return s.withColumn("p", p).withColumn("p", 2 * F.least("p", 1 - F.col("p")))


def _pairs(m: DataFrame) -> DataFrame:
    a = m.select(*(F.col(c).alias(f"{c}1") for c in m.columns))
    b = m.select(*(F.col(c).alias(f"{c}2") for c in m.columns))
    return a.join(b, F.col("g1") < F.col("g2"))  # groups, not rows


def pairwise_t(df: DataFrame, value: str, group: str, method: str = "welch", alternative: str = "two-sided", correction: str = "none") -> DataFrame:
    """(group1, group2, n1, n2, mean1, mean2, statistic, df, p, p_adj) for each pair; method student, welch or z."""
    p = _pairs(_moments(df, value, group))
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "var1", "var2"))
    gap = F.col("mean1") - F.col("mean2")
    if method == "student":
        d = n1 + n2 - 2
        stat = F.try_divide(gap, F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / d * (1 / n1 + 1 / n2)))
    else:
        a, b = v1 / n1, v2 / n2
        stat = F.try_divide(gap, F.sqrt(a + b))
        d = F.try_divide((a + b) ** 2, a**2 / (n1 - 1) + b**2 / (n2 - 1))
    p = p.withColumns({"statistic": stat, "df": F.lit(None).cast("double") if method == "z" else d})
    value_p = special.p_normal(F.col("statistic"), alternative) if method == "z" else special.p_t(F.col("statistic"), F.col("df"), alternative)
    out = p.withColumn("p", value_p).select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), "n1", "n2", "mean1", "mean2", "statistic", "df", "p")
    return adjusted(out, "p", correction)


def mann_whitney(df: DataFrame, value: str, group: str, alternative: str = "two-sided", correction: str = "none") -> DataFrame:
    """(group1, group2, n1, n2, u, z, p, p_adj) for each pair, by ranks within the pair, with ties and continuity corrected."""
    k = _known(df, value, group)
    counts = k.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    groups = k.select("g").distinct()
    pairs = _pairs(groups)
    # Values are counted by group first; a pair then ranks distinct values, not rows.
    both = counts.join(pairs, (F.col("g") == F.col("g1")) | (F.col("g") == F.col("g2")))
    cells = both.groupBy("g1", "g2", "v").agg(F.sum(F.when(F.col("g") == F.col("g1"), F.col("c")).otherwise(0)).alias("a"), F.sum("c").alias("t"))
    before = Window.partitionBy("g1", "g2").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    s = cells.groupBy("g1", "g2").agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    gap = u - n1 * n2 / 2
    z = {"two-sided": F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), "greater": gap - 0.5, "less": gap + 0.5}[alternative]
    s = s.withColumns({"u": u, "z": F.try_divide(z, sd)}).withColumn("p", special.p_normal(F.col("z"), alternative))
    return adjusted(s.select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), "n1", "n2", "u", "z", "p"), "p", correction)


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, correction: str = "none") -> DataFrame:
    """(group1, group2, n1, n2, d, p, p_adj): the largest gap of two distribution functions; p of the limiting distribution."""
    counts = _known(df, value, group).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))
    both = counts.join(_pairs(sizes), (F.col("g") == F.col("g1")) | (F.col("g") == F.col("g2")))
    cells = both.groupBy("g1", "g2", "n1", "n2", "v").agg(F.sum(F.when(F.col("g") == F.col("g1"), F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("g") == F.col("g2"), F.col("c")).otherwise(0)).alias("b"))
    upto = Window.partitionBy("g1", "g2").orderBy("v")
    gap = F.abs(F.sum("a").over(upto) / F.col("n1") - F.sum("b").over(upto) / F.col("n2"))
    s = cells.withColumn("gap", gap).groupBy("g1", "g2", "n1", "n2").agg(F.max("gap").alias("d"))
    s = s.withColumn("p", special.p_kolmogorov(F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))))
    return adjusted(s.select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), "n1", "n2", "d", "p"), "p", correction)


def dunn(df: DataFrame, value: str, group: str, correction: str = "none") -> DataFrame:
    """(group1, group2, z, p, p_adj): differences of mean ranks over all groups, ties corrected."""
    r = ranked(_known(df, value, group), [])
    g = r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("m"), F.sum(F.col("ties") ** 2 - 1).alias("t"))
    total = g.agg(F.sum("n").cast("double").alias("all_n"), F.sum("t").alias("all_t"))
    p = _pairs(g.select("g", "n", "m")).crossJoin(F.broadcast(total))  # one row
    n = F.col("all_n")
    sd = F.sqrt((n * (n + 1) / 12 - F.col("all_t") / (12 * (n - 1))) * (1 / F.col("n1") + 1 / F.col("n2")))
    p = p.withColumn("z", (F.col("m1") - F.col("m2")) / sd).withColumn("p", special.p_normal(F.col("z")))
    return adjusted(p.select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), "z", "p"), "p", correction)


def tukey(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group1, group2, n1, n2, mean_diff, q, p, p_adj) for each pair: honest differences of means, unequal sizes by Kramer.

    p is of the studentized range over all groups, and so adjusted already.
    """
    m = _moments(df, value, group)
    total = m.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"))
    p = _pairs(m).crossJoin(F.broadcast(total))  # one row
    free = F.col("all") - F.col("k")
    gap = F.col("mean1") - F.col("mean2")
    p = p.withColumn("mean_diff", gap).withColumn("q", F.try_divide(F.abs(gap), F.sqrt(F.try_divide(F.col("within"), free) / 2 * (1 / F.col("n1") + 1 / F.col("n2")))))
    p = p.withColumn("p", special.p_range(F.col("q"), F.col("k"), free))
    return p.select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), "n1", "n2", "mean_diff", "q", "p", F.col("p").alias("p_adj"))


def fisher_z(df: DataFrame, value: str, group: str, alternative: str = "two-sided", correction: str = "none") -> DataFrame:
    """(group1, group2, n1, n2, r1, r2, z, p, p_adj) for each pair: values are correlations, compared by their groups' means.

    Means are kept within 0.9999 of 0; groups of fewer than four have null z and p.
    """
    p = _pairs(_moments(df, value, group).select("g", "n", F.col("mean").alias("r")))
    enough = (F.col("n1") >= 4) & (F.col("n2") >= 4)
    a, b = (F.atanh(F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.col(r)))) for r in ("r1", "r2"))
    p = p.withColumn("z", F.when(enough, F.try_divide(a - b, F.sqrt(F.try_divide(F.lit(1.0), F.col("n1") - 3) + F.try_divide(F.lit(1.0), F.col("n2") - 3)))))
    p = p.withColumn("p", special.p_normal(F.col("z"), alternative))
    return adjusted(p.select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), "n1", "n2", "r1", "r2", "z", "p"), "p", correction)


CORRECTIONS = ("none", "bonferroni", "sidak", "holm-sidak", "holm", "simes-hochberg", "fdr_bh", "fdr_by")


def adjusted(df: DataFrame, p: str = "p", method: str = "none") -> DataFrame:
    """df with p_adj; null p stay null and count for nothing. Equal p get equal results, those of their highest rank (going up: lowest).

    Distinct p are counted and ranked by range partitions, and so are the steps' running extremes: no task holds all tests.
    """
    if method not in CORRECTIONS:
        raise OperatorError(f"no correction {method!r}")
    if method == "none":
        return df.withColumn("p_adj", q(p))
    known = df.where(q(p).isNotNull())
    m = F.col("_m").cast("double")
    if method in ("bonferroni", "sidak"):
        tests = known.agg(F.count(F.lit(1)).alias("_m"))
        value = F.least(q(p) * m, F.lit(1.0)) if method == "bonferroni" else 1 - F.pow(1 - q(p), m)
        return df.crossJoin(F.broadcast(tests)).withColumn("p_adj", F.when(q(p).isNotNull(), value)).drop("_m")
    upward = method in ("holm", "holm-sidak")
    ranks = accumulated(known.groupBy(q(p).alias("_value")).agg(F.count(F.lit(1)).alias("_ties")), "_value", {"_upto": "_ties"})
    inverse = F.aggregate(F.sequence(F.col("_upto") - F.col("_ties") + 1, F.col("_upto")), F.lit(0.0), lambda a, k: a + 1 / k)
    whole = ranks.agg(F.sum("_ties").alias("_m"), *([F.sum(inverse).alias("_harmonic")] if method == "fdr_by" else []))
    i = (F.col("_upto") - F.col("_ties") + 1 if upward else F.col("_upto")).cast("double")
    v = F.col("_value")
    step = {"holm": (m - i + 1) * v, "holm-sidak": 1 - F.pow(1 - v, m - i + 1), "simes-hochberg": (m - i + 1) * v, "fdr_bh": m / i * v, "fdr_by": m / i * (F.col("_harmonic") if method == "fdr_by" else 1) * v}[method]
    steps = ranks.crossJoin(F.broadcast(whole)).select("_value", step.alias("_step"))  # one row
    out = accumulated(steps, "_value", {"_run": "_step"}, descending=not upward, how="max" if upward else "min")
    out = out.select(F.col("_value").alias("_of"), F.least("_run", F.lit(1.0)).alias("p_adj")).hint("merge")  # as many rows as distinct p
    return df.drop("p_adj").join(out, q(p) == F.col("_of"), "left").drop("_of")


def effect_sizes(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group1, group2, cohens_d, hedges_g, glass_delta) of each pair."""
    p = _pairs(_moments(df, value, group))
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "var1", "var2"))
    gap = F.col("mean1") - F.col("mean2")
    d = F.try_divide(gap, F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)))
    return p.select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), d.alias("cohens_d"), (d * (1 - 3 / (4 * (n1 + n2 - 2) - 1))).alias("hedges_g"), F.try_divide(gap, F.sqrt(v2)).alias("glass_delta"))


def variance_explained(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: eta_squared and omega_squared of a one-way layout."""
    a = anova(df, value, group)
    b, w = F.col("ss_between"), F.col("ss_within")
    ms = w / F.col("df_within")
    return a.select((b / (b + w)).alias("eta_squared"), ((b - F.col("df_between") * ms) / (b + w + ms)).alias("omega_squared"))


def contingency(df: DataFrame, first: str, second: str) -> dict[str, DataFrame]:
    """observed and expected counts (first, second, count / expected) and test (chi2, df, p, n, cramers_v)."""
    k = df.where(q(first).isNotNull() & q(second).isNotNull()).groupBy(q(first).alias("a"), q(second).alias("b")).agg(F.count(F.lit(1)).alias("count"))
    rows, cols = k.groupBy("a").agg(F.sum("count").alias("ra")), k.groupBy("b").agg(F.sum("count").alias("cb"))
    full = rows.crossJoin(cols).join(k, ["a", "b"], "left").withColumn("count", F.coalesce("count", F.lit(0)))  # categories, not rows
    n = k.agg(F.sum("count").cast("double").alias("n"))
    cells = full.crossJoin(F.broadcast(n)).withColumn("expected", F.col("ra") * F.col("cb") / F.col("n"))
    t = cells.agg(F.sum((F.col("count") - F.col("expected")) ** 2 / F.col("expected")).alias("chi2"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("df"), F.first("n").alias("n"), F.least(F.count_distinct("a"), F.count_distinct("b")).alias("k"))
    t = t.withColumn("p", special.p_chi2(F.col("chi2"), F.col("df"))).withColumn("cramers_v", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.col("k") - 1)))).drop("k")
    name = {"a": first, "b": second}
    return {"observed": full.select("a", "b", "count").withColumnsRenamed(name), "expected": cells.select("a", "b", "expected").withColumnsRenamed(name), "test": t}


def kaplan_meier(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """([group,] time, at_risk, events, censored, survival, std_err) at each time; std_err by Greenwood's sum."""
    g = q(group).cast("string") if group else F.lit("all")
    k = df.where(q(time).isNotNull() & q(event).isNotNull()).select(g.alias("group"), q(time).cast("double").alias("time"), q(event).cast("int").alias("e"))
    s = k.where("group is not null").groupBy("group", "time").agg(F.sum("e").alias("events"), F.sum(1 - F.col("e")).alias("censored"))
    later = Window.partitionBy("group").orderBy(F.desc("time"))
    upto = Window.partitionBy("group").orderBy("time")
    s = s.withColumn("at_risk", F.sum(F.col("events") + F.col("censored")).over(later))
    left = 1 - F.col("events") / F.col("at_risk")
    # Once nobody is left the product is 0 and stays there.
    gone = F.max(F.when(left <= 0, 1).otherwise(0)).over(upto)
    logs = F.sum(F.log(F.when(left > 0, left).otherwise(F.lit(1.0)))).over(upto)
    survival = F.when(gone == 1, F.lit(0.0)).otherwise(F.exp(logs))
    hazard = F.sum(F.when(left > 0, F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events")))).otherwise(F.lit(0.0))).over(upto)
    s = s.withColumns({"survival": survival, "_h": hazard}).withColumn("std_err", F.col("survival") * F.sqrt("_h")).drop("_h")
    return s.select("group", "time", "at_risk", "events", "censored", "survival", "std_err")


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(group1, group2, observed, expected, chi2, p) of each pair of groups."""
    k = df.where(q(time).isNotNull() & q(event).isNotNull() & q(group).isNotNull()).select(q(group).cast("string").alias("g"), q(time).cast("double").alias("t"), q(event).cast("int").alias("e"))
    cells = k.groupBy("g", "t").agg(F.sum("e").alias("d"), F.count(F.lit(1)).alias("c"))
    pairs = _pairs(k.select("g").distinct())
    both = cells.join(pairs, (F.col("g") == F.col("g1")) | (F.col("g") == F.col("g2")))
    own = F.col("g") == F.col("g1")
    at = both.groupBy("g1", "g2", "t").agg(F.sum("d").alias("d"), F.sum("c").alias("c"), F.sum(F.when(own, F.col("d")).otherwise(0)).alias("d1"), F.sum(F.when(own, F.col("c")).otherwise(0)).alias("c1"))
    later = Window.partitionBy("g1", "g2").orderBy(F.desc("t"))
    at = at.withColumns({"n": F.sum("c").over(later).cast("double"), "n1": F.sum("c1").over(later).cast("double")}).where("d > 0")
    e = F.col("d") * F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, F.col("d") * F.col("n1") / F.col("n") * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(0.0)
    s = at.groupBy("g1", "g2").agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("v"))
    s = s.withColumn("chi2", F.try_divide((F.col("observed") - F.col("expected")) ** 2, F.col("v")))
    return s.withColumn("p", special.p_chi2(F.col("chi2"), F.lit(1))).select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), "observed", "expected", "chi2", "p")


def ols(df: DataFrame, xs: list[str], y: str, intercept: bool = True, degree: int = 1) -> dict:
    """coefficients (term, coefficient, std_error, t, p) and fit (n, r_squared, ...), by the normal equations.

    Sums of products are one aggregate; only that matrix, as wide as the terms, is solved on the driver. A degree above
    1 fits a polynomial of one x.
    """
    import numpy as np

    terms = [(x, q(x).cast("double")) for x in xs] if degree == 1 else [(f"{xs[0]}^{k}" if k > 1 else xs[0], q(xs[0]).cast("double") ** k) for k in range(1, degree + 1)]
    terms = ([("intercept", F.lit(1.0))] if intercept else []) + terms
    known = df.where(reduce(lambda a, b: a & b, [q(c).isNotNull() for c in [*xs, y]]))
    v = [c for _, c in terms] + [q(y).cast("double")]
    m = len(v)
    row = known.agg(F.count(F.lit(1)), *(F.sum(v[i] * v[j]) for i in range(m) for j in range(i, m)), F.sum(v[-1])).first()
    n, s = row[0], np.zeros((m, m))
    for value, (i, j) in zip(row[1:-1], [(i, j) for i in range(m) for j in range(i, m)], strict=True):
        s[i, j] = s[j, i] = value or 0.0
    inverse = np.linalg.pinv(s[:-1, :-1])
    beta = inverse @ s[:-1, -1]
    sse = float(max(0.0, s[-1, -1] - 2 * beta @ s[:-1, -1] + beta @ s[:-1, :-1] @ beta))
    sst = float(s[-1, -1] - ((row[-1] or 0.0) ** 2 / n if intercept and n else 0.0))
    free = n - len(terms)
    error = np.sqrt(np.maximum(0, np.diag(inverse)) * sse / free) if free > 0 else np.full(len(terms), np.nan)
    with np.errstate(all="ignore"):
        t = beta / error
        p = 2 * special.t_sf(np.abs(t), free) if free > 0 else np.full(len(terms), np.nan)
    spark = df.sparkSession
    clean = lambda x: None if x != x else float(x)
    table = spark.createDataFrame([(name, *map(clean, r)) for (name, _), r in zip(terms, zip(beta, error, t, p, strict=True), strict=True)], "term string, coefficient double, std_error double, t double, p double")
    fit = spark.createDataFrame([(n, clean(1 - sse / sst if sst else float("nan")), clean(sse), free)], "n long, r_squared double, sse double, df_residual long")
    predicted = reduce(lambda a, b: a + b, [c * float(b) for (_, c), b in zip(terms, beta, strict=True)])
    return {"coefficients": table, "fit": fit, "residuals": df.withColumns({"predicted": predicted}).withColumn("residual", q(y) - F.col("predicted")), "predict": predicted}


def correlations(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(a, b, value) of each pair of columns: pearson, spearman, euclidean, cosine, cityblock, chebyshev or correlation.

    Distances are between columns, over rows where both are known. One aggregate serves all pairs.
    """
    columns = columns or numeric(df)
    if method == "spearman":
        base = df
        for k, c in enumerate(columns):
            counts = base.where(q(c).isNotNull()).groupBy(q(c).alias(f"_c{k}")).agg(F.count(F.lit(1)).alias("_t"))
            counts = accumulated(counts, f"_c{k}", {"_upto": "_t"})
            counts = counts.select(f"_c{k}", (F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / 2).alias(f"_r{k}"))
            base = base.join(counts, q(c) == F.col(f"_c{k}"), "left").drop(f"_c{k}")
        value = {c: F.col(f"_r{k}") for k, c in enumerate(columns)}
        df, method = base, "pearson"
    else:
        value = {c: q(c).cast("double") for c in columns}

    def of(a: Column, b: Column) -> Column:
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        return {
            "pearson": lambda: F.corr(a, b),
            "correlation": lambda: 1 - F.corr(a, b),
            "euclidean": lambda: F.sqrt(F.sum((a - b) ** 2)),
            "cityblock": lambda: F.sum(F.abs(a - b)),
            "chebyshev": lambda: F.max(F.abs(a - b)),
            "cosine": lambda: 1 - F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b)),
        }[method]()

    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), of(value[a], value[b]).alias("value")) for a, b in pairs)).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def grubbs(df: DataFrame, value: str, group: str | None = None, alpha: float = 0.05) -> DataFrame:
    """([group,] n, mean, std, extreme, g, critical, is_outlier): the value farthest from its group's mean, tested two-sided."""
    k = _known(df, value, group) if group else _known(df, value).withColumn("g", F.lit("all"))
    m = k.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    m = m.withColumn("extreme", F.when(F.col("high") - F.col("mean") >= F.col("mean") - F.col("low"), F.col("high")).otherwise(F.col("low")))
    t = special._column(lambda n: [special.t_quantile(1 - alpha / (2 * x), x - 2) if x > 2 else float("nan") for x in n], F.col("n"))
    m = m.withColumns({"g_value": F.try_divide(F.abs(F.col("extreme") - F.col("mean")), F.col("std")), "_t": t})
    n = F.col("n").cast("double")
    m = m.withColumn("critical", (n - 1) / F.sqrt(n) * F.sqrt(F.col("_t") ** 2 / (n - 2 + F.col("_t") ** 2)))
    return m.select(F.col("g").alias("group"), "n", "mean", "std", "extreme", F.col("g_value").alias("g"), "critical", F.coalesce(F.col("g_value") > F.col("critical"), F.lit(False)).alias("is_outlier"))


def bland_altman(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: n, bias, sd, loa_low, loa_high of the differences of two methods, over rows where both are known."""
    d = q(first) - q(second)
    s = df.where(d.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return s.withColumns({"loa_low": F.col("bias") - 1.96 * F.col("sd"), "loa_high": F.col("bias") + 1.96 * F.col("sd")})


def volcano(df: DataFrame, fold_change: str, p: str, fc_threshold: float = 1.0, p_threshold: float = 0.05) -> DataFrame:
    """Significant rows, with neg_log10_p; rows without a positive p go."""
    known = df.where(q(fold_change).isNotNull() & (q(p) > 0))
    return known.where((F.abs(q(fold_change)) >= fc_threshold) & (q(p) <= p_threshold)).withColumn("neg_log10_p", -F.log10(q(p)))
