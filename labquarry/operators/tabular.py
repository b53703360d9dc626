"""The tabular core: every operator is a function from DataFrames to DataFrames and stays lazy.

Rows have no order of their own. Operators whose result depends on it (first of duplicates, forward fill, top rows
with ties) take order_by, the columns that define it. NaN counts as missing: read tables through sources.clean(), which
turns it to null. Unknown columns are errors unless an operator says otherwise.
"""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ..functions.expressions import assignment, compiled
from ..storage import stored

def _everything() -> WindowSpec:
    return Window.partitionBy(F.lit(1))



class OperatorError(ValueError):
    """The parameters do not fit the table."""


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def as_text(c: Column) -> Column:
    """Text of any value; missing ones read 'nan'."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def _need(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise OperatorError(f"no column {', '.join(missing)}")


def _order(order_by: list[str], down: bool = False) -> list[Column]:
    return [q(c).desc_nulls_last() if down else q(c).asc_nulls_last() for c in order_by]


# Rows


def filter_rows(df: DataFrame, query: str) -> DataFrame:
    """Rows for which the expression holds; a blank one keeps all."""
    if not query.strip():
        return df
    df, mask, extra = compiled(df, query)
    return df.where(mask).drop(*extra)


def drop_rows(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose stripped text is none of the values; no values keep all."""
    _need(df, column)
    values = [v.strip() for v in values if v.strip()]
    return df.where(~F.trim(as_text(q(column))).isin(values)) if values else df


def _glob(pattern: str) -> str:
    return fnmatch.translate(pattern).replace(r"(?s:", "(?s)(?:").replace(r"\Z", "$").replace(r"\z", "$")


def split_by_value(df: DataFrame, column: str, values: list[str], case_sensitive: bool = True) -> dict[str, DataFrame]:
    """matched and rest: rows whose text is one of the values; a value with * is a glob pattern."""
    _need(df, column)
    text = as_text(q(column))
    if not case_sensitive:
        text, values = F.lower(text), [v.lower() for v in values]
    tests = [text.rlike("^" + _glob(v)) if "*" in v else text == v for v in values]
    mask = reduce(lambda a, b: a | b, tests, F.lit(False))
    return {"matched": df.where(mask), "rest": df.where(~mask)}


def sort_rows(df: DataFrame, by: list[str], descending: bool = False) -> DataFrame:
    """Sorted by the columns that exist, all in one direction, missing values last in either."""
    if not by:
        return df
    known = [c for c in by if c in df.columns]
    if not known:
        raise OperatorError("none of the sort columns exists")
    return df.orderBy(*_order(known, descending))


def top_n(df: DataFrame, column: str, n: int = 5, largest: bool = True, order_by: list[str] | None = None) -> dict[str, DataFrame]:
    """top_n: the n rows with the largest (smallest) values, in rank order; rest: the others.

    order_by breaks ties and should be unique. The top is a bounded heap per partition; the rest is what does not
    reach the last of them, compared with that one row, so that nothing sorts the whole table.
    """
    _need(df, column)
    n = max(1, n)
    keys = [q(column).desc_nulls_last() if largest else q(column).asc_nulls_last(), *_order(order_by or [])]
    top = df.orderBy(*keys).limit(n)
    names = list(dict.fromkeys([column, *(order_by or [])]))
    taken = top.select(*(q(c).alias(f"_t_{k}") for k, c in enumerate(names))).distinct()
    on = reduce(lambda a, b: a & b, [q(c).eqNullSafe(F.col(f"_t_{k}")) for k, c in enumerate(names)])
    return {"top_n": top, "rest": df.join(F.broadcast(taken), on, "left_anti")}  # n rows


def random_sample(df: DataFrame, n: int = 10, seed: int | None = None, key: list[str] | None = None) -> dict[str, DataFrame]:
    """sampled: exactly n rows (all, if fewer); rest: the others.

    Rows are drawn by a hash of the seed and the key columns (all columns, if none are given), so a seed gives the same
    sample however the table is partitioned.
    """
    keys = key or df.columns
    seed = seed if seed is not None and seed > 0 else 0
    draw = F.xxhash64(F.lit(seed), *(as_text(q(c)) for c in keys))
    drawn = df.withColumn("_draw", draw)
    picked = top_n(drawn, "_draw", n, False, keys)
    return {"sampled": picked["top_n"].drop("_draw"), "rest": picked["rest"].drop("_draw")}


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str = "first", order_by: list[str] | None = None) -> dict[str, DataFrame]:
    """unique and dropped. Missing values equal each other; unknown subset names are left out; keep is first, last or none."""
    by = [c for c in subset or df.columns if c in df.columns] or df.columns
    groups = Window.partitionBy(*map(q, by))
    if keep == "none":
        marked = df.withColumn("_keep", F.count(F.lit(1)).over(groups) == 1)
    else:
        order = _order(order_by or by, keep == "last")
        marked = df.withColumn("_keep", F.row_number().over(groups.orderBy(*order)) == 1)
    return {"unique": marked.where("_keep").drop("_keep"), "dropped": marked.where("not _keep").drop("_keep")}


def extract_object(df: DataFrame, column: str, row_index: int, order_by: list[str]) -> DataFrame:
    """The one value of a column at a row, counted from 1 in the order given."""
    _need(df, column, *order_by)
    if row_index < 1:
        raise OperatorError("rows count from 1")
    rows = df.orderBy(*_order(order_by)).limit(row_index).withColumn("_n", F.row_number().over(Window.orderBy(*_order(order_by))))
    return rows.where(F.col("_n") == row_index).select(q(column))


# Columns


def math_column(df: DataFrame, formula: str) -> DataFrame:
    """`name = expression` adds or replaces a column; a blank formula changes nothing."""
    if not formula.strip():
        return df
    name, text = assignment(formula)
    df, value, extra = compiled(df, text)
    if isinstance(df.select(value).schema[0].dataType, T.BooleanType):
        value = F.coalesce(value, F.lit(False))  # a comparison with a missing value is false
    return df.withColumn(name, value).drop(*extra)


def select_columns(df: DataFrame, patterns: list[str], drop: bool = False) -> DataFrame:
    """Keeps (drops) columns by name or glob, in the order named; a plain unknown name is an error, a glob may match none."""
    names: list[str] = []
    for p in patterns:
        if any(c in p for c in "*?["):
            names += [c for c in df.columns if fnmatch.fnmatchcase(c, p)]
        else:
            _need(df, p)
            names.append(p)
    names = list(dict.fromkeys(names))
    return df.drop(*names) if drop else df.select(*map(q, names))


def rename_group(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replaces values, compared as text; with any mapping the whole column becomes text."""
    _need(df, column)
    if not mapping:
        return df
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    text = as_text(q(column))
    return df.withColumn(column, F.coalesce(F.try_element_at(table, text), text))


def cast_columns(df: DataFrame, columns: list[str], kind: str, coerce: bool = True) -> DataFrame:
    """float, int (rounded half to even), str, bool, category or datetime; values that do not fit become null (or fail)."""
    _need(df, *columns)

    def cast(c: Column) -> Column:
        to = (lambda t: c.try_cast(t)) if coerce else (lambda t: c.cast(t))
        number = to("double")
        if kind == "float":
            return F.nanvl(number, F.lit(None).cast("double"))
        if kind == "int":
            return F.bround(F.nanvl(number, F.lit(None).cast("double"))).cast("long")
        if kind in ("str", "category"):
            return as_text(c) if kind == "str" else c.cast("string")
        if kind == "bool":
            return ~F.lower(F.trim(as_text(c))).isin("false", "0", "no", "nan", "none", "", "0.0")
        if kind == "datetime":
            return to("timestamp")
        raise OperatorError(f"no type {kind!r}")

    return df.withColumns({c: cast(q(c)) for c in columns})


def string_column(df: DataFrame, column: str, operation: str, pattern: str = "", replace_with: str = "", result: str = "", use_regex: bool = False) -> DataFrame:
    """strip, upper, lower, title, replace, extract, split or zfill; missing values read 'nan'."""
    _need(df, column)
    text, out = as_text(q(column)), result or column
    if operation == "split":
        parts = F.split(text, re.escape(pattern or " ") if not use_regex else pattern, 2)
        left, right = (f"{result}_left", f"{result}_right") if result else (column, f"{column}_right")
        return df.withColumns({left: F.get(parts, 0), right: F.get(parts, 1)})
    if operation == "title":  # a letter is a capital where none stands before it
        chars = F.filter(F.split(text, ""), lambda x: x != "")
        before = F.concat(F.array(F.lit("")), F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))))
        value = F.array_join(F.zip_with(chars, before, lambda c, b: F.when(F.coalesce(b, F.lit("")).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))), "")
    elif operation == "replace":
        value = F.regexp_replace(text, pattern, replace_with) if use_regex else F.replace(text, F.lit(pattern), F.lit(replace_with))
    elif operation == "extract":
        wrapped = pattern if "(" in pattern and ")" in pattern else f"({pattern})"
        value = F.when(text.rlike(wrapped), F.regexp_extract(text, wrapped, 1))
    elif operation == "zfill":
        width = int(pattern or 4)
        sign = F.regexp_extract(text, r"^[+-]", 0)
        padded = F.concat(sign, F.lpad(F.substr(text, F.length(sign) + 1), F.greatest(F.lit(width) - F.length(sign), F.lit(0)), F.lit("0")))
        value = F.when(F.length(text) >= width, text).otherwise(padded)
    elif operation in ("strip", "upper", "lower"):
        value = {"strip": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), "upper": F.upper, "lower": F.lower}[operation](text)
    else:
        raise OperatorError(f"no operation {operation!r}")
    return df.withColumn(out, value)


# Aggregates and shapes

_AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg, "median": F.median, "min": F.min, "max": F.max,
    "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
}


def aggregate(df: DataFrame, operation: str, group_by: list[str] | None = None, columns: list[str] | None = None, sort_by: str | None = None) -> DataFrame:
    """sum, mean, median, min, max, count, std, var or auc of numeric columns, by group; rows without a group are left out.

    Without groups there is one row, with a leading column `stat`. auc is the trapezoid over sort_by (the first numeric
    column that is neither aggregated nor a group, if none is named), of rows where both are known; it needs two points.
    """
    group_by = group_by or []
    _need(df, *group_by)
    numbers = [c for c in numeric(df) if c not in group_by]
    columns = [c for c in columns if c in numbers] if columns else [c for c in numbers if c != sort_by]
    if not columns:
        raise OperatorError("no numeric columns")
    for c in group_by:
        df = df.where(q(c).isNotNull())
    if operation != "auc":
        out = df.groupBy(*map(q, group_by)).agg(*(_AGGREGATES[operation](q(c)).alias(c) for c in columns))
    else:
        x = sort_by or next((c for c in numbers if c not in columns), None)
        if x is None:
            raise OperatorError("auc needs a column to sort by")
        areas = [area_under(df, x, c, group_by) for c in columns]
        if group_by:
            together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), areas, df.select(*map(q, group_by)).distinct())
            out = together.groupBy(*map(q, group_by)).agg(*(F.max(q(c)).alias(c) for c in columns))
        else:
            out = reduce(lambda a, b: a.crossJoin(b), areas)  # tables of one row
    return out if group_by else out.select(F.lit(operation).alias("stat"), *map(q, columns))


def area_under(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by..., y): the area under y over x by trapezoids, rows in order of x and then y; null for less than two known rows.

    Rows with a null in x or y are left out, equal ones counted first. Range partitions are summed apart, and between two
    that follow each other comes the trapezoid of their ends: one row a partition and group, and no task that holds a group.
    """
    by = by or []
    keys = [f"_k{i}" for i in range(len(by))]
    known = df.select(*(q(c).alias(k) for c, k in zip(by, keys, strict=True)), q(x).cast("double").alias("_x"), q(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    points = known.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(points.repartitionByRange(n, *keys, "_x", "_y").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy("_x", "_y")
    area = lambda x0, y0, x1, y1: (x1 - x0) * (y1 + y0) / 2
    placed = placed.withColumn("_a", area(F.lag("_x").over(inside), F.lag("_y").over(inside), F.col("_x"), F.col("_y")))
    end = F.struct("_x", "_y")
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_a").alias("_a"), F.sum("_n").alias("_n"), F.min(end).alias("_f"), F.max(end).alias("_l"))
    before = F.lag("_l").over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part"))
    parts = parts.withColumn("_e", area(before["_x"], before["_y"], F.col("_f._x"), F.col("_f._y")))
    total = F.coalesce(F.sum("_a"), F.lit(0.0)) + F.coalesce(F.sum("_e"), F.lit(0.0))
    return parts.groupBy(*keys).agg(F.when(F.sum("_n") > 1, total).alias(y)).select(*(q(k).alias(c) for c, k in zip(by, keys, strict=True)), q(y))


def value_counts(df: DataFrame, column: str, percent: bool = False) -> DataFrame:
    """(column, count[, pct]): how often each known value occurs; pct is rounded half to even to 2 places."""
    _need(df, column)
    out = df.where(q(column).isNotNull()).groupBy(q(column)).agg(F.count(F.lit(1)).alias("count"))
    if percent:
        total = F.sum("count").over(_everything())
        out = out.withColumn("pct", F.bround(F.col("count") * 100.0 / total, 2))
    return out


def melt(df: DataFrame, ids: list[str] | None = None, values: list[str] | None = None, name: str = "Group", value: str = "Value") -> DataFrame:
    """Wide to long; rows without a value go, and columns of different types become text."""
    ids = ids or []
    values = values or [c for c in df.columns if c not in ids]
    _need(df, *ids, *values)
    kinds = {df.schema[c].dataType for c in values}
    if len(kinds) > 1:
        kind = "double" if all(isinstance(k, T.NumericType) for k in kinds) else "string"
        df = df.select(*map(q, ids), *(q(c).cast(kind).alias(c) for c in values))
    return df.unpivot([q(c) for c in ids], [q(c) for c in values], name, value).where(q(value).isNotNull())


def pivot(df: DataFrame, index: list[str], column: str, value: str, labels: list | None = None) -> DataFrame:
    """Long to wide by the mean; rows lacking index, column or value go, new columns are sorted.

    labels: the values that become columns. If they are not given they are looked up, and may be 2000 at most.
    """
    _need(df, *index, column, value)
    for c in [*index, column, value]:
        df = df.where(q(c).isNotNull())
    if labels is None:
        labels = sorted(r[0] for r in df.select(q(column)).distinct().limit(2001).collect())
        if len(labels) > 2000:
            raise OperatorError("more than 2000 columns")
    out = df.groupBy(*map(q, index)).pivot(column, labels).agg(F.avg(q(value)))
    return out if index else out.select(F.lit(value).alias("index"), *(q(str(x)) for x in labels))


def collect_by_group(df: DataFrame, group: str, value: str, order_by: list[str], labels: list | None = None) -> DataFrame:
    """One column a group, its values side by side by their place in the group; shorter groups end in nulls."""
    _need(df, group, value)
    place = F.row_number().over(Window.partitionBy(q(group)).orderBy(*_order(order_by)))
    rows = df.where(q(group).isNotNull()).select(place.alias("_place"), q(group), q(value))
    return pivot_first(rows, "_place", group, value, labels).drop("_place")


def pivot_first(df: DataFrame, index: str, column: str, value: str, labels: list | None) -> DataFrame:
    return df.groupBy(index).pivot(column, labels).agg(F.first(q(value)))


def concat_rows(top: DataFrame | None, bottom: DataFrame | None, fill_missing: bool = True) -> DataFrame:
    """One table under the other, by name; columns of different types become text. A missing table passes the other."""
    if top is None or bottom is None:
        return top if bottom is None else bottom
    common = [c for c in top.columns if c in bottom.columns]
    if not fill_missing:
        top, bottom = top.select(*map(q, common)), bottom.select(*map(q, common))
    for c in common:
        a, b = top.schema[c].dataType, bottom.schema[c].dataType
        if a != b:
            kind = "double" if isinstance(a, T.NumericType) and isinstance(b, T.NumericType) else "string"
            top, bottom = top.withColumn(c, q(c).cast(kind)), bottom.withColumn(c, q(c).cast(kind))
    return top.unionByName(bottom, allowMissingColumns=True)


def concat_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two tables side by side, aligned by the row label `key`; rows of one side only get nulls."""
    _need(left, key)
    _need(right, key)
    clash = [c for c in right.columns if c != key and c in left.columns]
    right = right.withColumnsRenamed({c: f"{c}_y" for c in clash})
    left = left.withColumnsRenamed({c: f"{c}_x" for c in clash})
    return left.join(right, key, "full")


def join_tables(left: DataFrame, right: DataFrame, left_key: str, right_key: str = "", how: str = "inner") -> DataFrame:
    """inner, left, right or outer join on one pair of keys; missing keys match each other, clashing names get _x and _y."""
    right_key = right_key or left_key
    _need(left, left_key)
    _need(right, right_key)
    same = left_key == right_key
    clash = {c for c in left.columns if c in right.columns} - ({left_key} if same else set())
    a = left.select(*(q(c).alias(f"{c}_x" if c in clash else c) for c in left.columns))
    b = right.select(*(q(c).alias("_right_key" if same and c == right_key else f"{c}_y" if c in clash else c) for c in right.columns))
    lk = f"{left_key}_x" if left_key in clash else left_key
    rk = "_right_key" if same else f"{right_key}_y" if right_key in clash else right_key
    out = a.join(b, a[f"`{lk}`"].eqNullSafe(b[f"`{rk}`"]), {"outer": "full"}.get(how, how))
    if same:
        out = out.withColumn(lk, F.coalesce(q(lk), q(rk))).drop(rk)
    return out


def two_table_math(left: DataFrame, right: DataFrame, operation: str = "/", left_column: str = "", right_column: str = "", order_by: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """(left_value, right_value, operation, result) of the first known values of two columns; dividing by 0 fails."""

    def first(df: DataFrame, column: str, order: list[str], name: str) -> tuple[DataFrame, str]:
        column = column or next(iter(numeric(df)), "")
        _need(df, column)
        known = df.where(q(column).isNotNull())
        return (known.orderBy(*_order(order)) if order else known).limit(1).select(q(column).cast("double").alias(name)), column

    (a, ca), (b, cb) = first(left, left_column, order_by[0], "left_value"), first(right, right_column, order_by[1], "right_value")
    x, y = F.col("left_value"), F.col("right_value")
    value = {"/": F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(F.try_divide(x, y)), "*": x * y, "+": x + y, "-": x - y}[operation]
    return a.crossJoin(F.broadcast(b)).select("left_value", "right_value", F.lit(f"{ca} {operation} {cb}").alias("operation"), value.alias("result"))  # one row each


# Missing values and scales


def fill_missing(df: DataFrame, mode: str, columns: list[str] | None = None, value: str = "0", order_by: list[str] | None = None) -> DataFrame:
    """drop, constant, mean, median, mode, forward or back. Means and medians fill numeric columns only.

    A constant is a whole number, a number if it has a point, or else text, which turns the column to text. Forward and
    back fills run in order_by over the whole table, which one task has to hold; give groups to fill_within() instead
    where the table is large.
    """
    columns = columns or df.columns
    _need(df, *columns)
    if mode == "drop":
        return df.dropna(subset=columns)
    if mode == "constant":
        number = float(value) if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)", value) else int(value) if re.fullmatch(r"[+-]?\d+", value) else None

        def filled(c: str) -> Column:
            if number is None or not isinstance(df.schema[c].dataType, T.NumericType):
                return F.coalesce(q(c).cast("string"), F.lit(value))
            return F.coalesce(q(c), F.lit(number))

        return df.withColumns({c: filled(c) for c in columns})
    if mode in ("forward", "back"):
        return fill_within(df, mode, columns, [], order_by or [])
    if mode not in ("mean", "median", "mode"):
        raise OperatorError(f"no mode {mode!r}")
    if mode != "mode":
        columns = [c for c in columns if c in numeric(df)]
    measure = {"mean": F.avg, "median": F.median, "mode": lambda c: F.mode(c, True)}[mode]
    if not columns:
        return df
    # One row, so it is joined to every row without a shuffle.
    row = df.agg(*(measure(q(c)).alias(f"_fill_{k}") for k, c in enumerate(columns)))
    out = df.crossJoin(F.broadcast(row))
    return out.select(*(F.coalesce(q(c), F.col(f"_fill_{columns.index(c)}")).alias(c) if c in columns else q(c) for c in df.columns))


def fill_within(df: DataFrame, mode: str, columns: list[str], groups: list[str], order_by: list[str]) -> DataFrame:
    """Forward or back fill inside each group, in order_by."""
    by = Window.partitionBy(*(map(q, groups) if groups else [F.lit(1)])).orderBy(*_order(order_by))
    if mode == "forward":
        by = by.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(q(c), True).over(by) for c in columns})
    by = by.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(q(c), True).over(by) for c in columns})


def normalize(df: DataFrame, method: str, columns: list[str] | None = None, suffix: str = "_norm") -> DataFrame:
    """minmax, zscore, log10, log2, ln or robust; a constant column gives 0; a blank suffix overwrites."""
    columns = columns or numeric(df)
    _need(df, *columns)
    logs = {"log10": lambda c: F.log10(c + 1), "log2": lambda c: F.log2(c + 1), "ln": F.log1p}
    if method in logs:
        return df.withColumns({f"{c}{suffix}": logs[method](q(c)) for c in columns})
    center, spread = {
        "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        "zscore": (F.avg, F.stddev_samp),
        "robust": (F.median, lambda c: F.percentile(c, 0.75) - F.percentile(c, 0.25)),
    }[method]
    # All statistics in one pass and one row.
    row = df.agg(*(f(q(c)).cast("double").alias(f"_{n}_{k}") for k, c in enumerate(columns) for n, f in (("c", center), ("s", spread))))
    out = df.crossJoin(F.broadcast(row))
    scaled = {f"{c}{suffix}": F.when(q(c).isNotNull(), F.when(F.coalesce(F.col(f"_s_{k}"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise((q(c) - F.col(f"_c_{k}")) / F.col(f"_s_{k}"))) for k, c in enumerate(columns)}
    return out.withColumns(scaled).drop(*(f"_{n}_{k}" for k in range(len(columns)) for n in "cs"))


def group_normalize(df: DataFrame, group: str, controls: dict[str, str] | str, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns over the mean of their group's control group; a control mean of 0 or none gives null.

    controls: one control for all groups, or a map from group to control. Rows of a group without a known control stay.
    """
    _need(df, group)
    columns = columns or [c for c in numeric(df) if c != group]
    text = q(group).cast("string")
    control = F.lit(controls) if isinstance(controls, str) else F.try_element_at(F.create_map(*[F.lit(x) for p in controls.items() for x in p]), text)
    means = df.where(q(group).isNotNull()).groupBy(text.alias("_control")).agg(*(F.avg(q(c)).alias(f"_mean_{k}") for k, c in enumerate(columns)))
    out = df.withColumn("_of", control).join(means, F.col("_of") == F.col("_control"), "left")
    values = {c: F.when(F.col("_control").isNull(), q(c).cast("double")).otherwise(F.try_divide(q(c), F.col(f"_mean_{k}"))) for k, c in enumerate(columns)}
    return out.select(*(values[c].alias(c) if c in values else q(c) for c in df.columns))


def _reference_row(df: DataFrame, column: str, value: str, targets: list[str], order_by: list[str]) -> DataFrame:
    rows = df.where(F.trim(q(column).cast("string")) == value)
    return (rows.orderBy(*_order(order_by)) if order_by else rows).limit(1).select(*(q(c).cast("double").alias(f"_ref_{k}") for k, c in enumerate(targets)))


def blank_subtract(df: DataFrame, column: str, value: str = "BG", targets: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Takes the reference row's values off the targets; a missing reference leaves them."""
    _need(df, column)
    targets = targets or [c for c in numeric(df) if c != column]
    row = _reference_row(df, column, value, targets, order_by or [])
    out = df.join(F.broadcast(row), F.lit(True), "left")  # one row
    values = {c: F.when(F.col(f"_ref_{k}").isNull(), q(c).cast("double")).otherwise(q(c) - F.col(f"_ref_{k}")) for k, c in enumerate(targets)}
    return out.select(*(values[c].alias(c) if c in values else q(c) for c in df.columns))


def row_normalize(df: DataFrame, column: str, value: str = "Control", targets: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Divides the targets by the reference row's values; a missing reference or one of 0 leaves them."""
    _need(df, column)
    targets = targets or [c for c in numeric(df) if c != column]
    row = _reference_row(df, column, value, targets, order_by or [])
    out = df.join(F.broadcast(row), F.lit(True), "left")  # one row
    values = {c: F.when(F.coalesce(F.col(f"_ref_{k}"), F.lit(0.0)) == 0, q(c).cast("double")).otherwise(F.try_divide(q(c), F.col(f"_ref_{k}"))) for k, c in enumerate(targets)}
    return out.select(*(values[c].alias(c) if c in values else q(c) for c in df.columns))


def edit_cells(df: DataFrame, key: str, edits: list[tuple]) -> DataFrame:
    """Applies (key, column, value) edits by hand; values are cast to the column's type."""
    _need(df, key, *(c for _, c, _ in edits))
    kinds = dict(df.dtypes)
    for k, c, v in edits:
        df = df.withColumn(c, F.when(q(key) == F.lit(k), F.lit(v).cast(kinds[c])).otherwise(q(c)))
    return df


def save_table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV, TSV or Parquet by the path's extension, with a header; written in parallel unless one file is asked for."""
    out = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    if path.endswith(".parquet"):
        out.parquet(path)
    else:
        out.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)


def run_script(inputs: list[DataFrame], function) -> dict[str, DataFrame]:
    """User code: function(*inputs) returns a DataFrame or a dict of them; per-batch code belongs in mapInPandas there."""
    out = function(*inputs)
    return out if isinstance(out, dict) else {"out_1": out}
