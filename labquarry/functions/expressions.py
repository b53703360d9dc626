"""The expression dialect of filters and column formulas, compiled to Spark columns.

Supported: comparison chains, and/or/not and &, |, ~, in and not in with lists, backticked names, numbers, strings,
True/False/None, arithmetic with ** and //, %, column statistics such as `x.mean()`, and numpy-style functions such as
`@np.log(x)` or `log(x)`. Nothing is ever evaluated as code. A missing value is unequal to everything: `!=` and `not in`
keep it, other comparisons do not.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """The text is not an expression of the dialect, or names a column that the table lacks."""


_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<tick>`[^`]+`)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>@?[^\W\d]\w*(?:\.[^\W\d]\w*)*)|(?P<op>\*\*|//|==|!=|<=|>=|&&|\|\||[-+*/%<>&|~(),\[\].=]))")
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "count": F.count,
}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "log2": F.log2, "log1p": F.log1p,
    "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil, "round": F.bround,
    "isnan": F.isnull, "sign": F.signum, "power": F.pow, "maximum": F.greatest, "minimum": F.least,
}
_COMPARE = {"==", "!=", "<", "<=", ">", ">="}
# Strengths of binary operators, weakest first. & and | bind as strongly as in Python, and does not.
_STRENGTH = {"or": 1, "||": 1, "and": 2, "&&": 2, "|": 5, "&": 6, "+": 7, "-": 7, "*": 8, "/": 8, "//": 8, "%": 8, "**": 10}


class _Parser:
    def __init__(self, text: str, columns: list[str]):
        self.columns, self.tokens, self.statistics, at = columns, [], [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, expected: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (expected and self.tokens[self.at][1] != expected):
            raise ExpressionError(f"expected {expected or 'more'}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def column(self, name: str) -> Column:
        if name not in self.columns:
            raise ExpressionError(f"no column {name!r}")
        return F.col(f"`{name}`")

    def parse(self) -> Column:
        out = self.binary(0)
        if self.peek() is not None:
            raise ExpressionError(f"unexpected {self.peek()!r}")
        return out

    def binary(self, least: int) -> Column:
        left = self.comparison(least) if least <= 4 else self.unary()
        while (op := self.peek()) in _STRENGTH and _STRENGTH[op] >= max(least, 1):
            strength = _STRENGTH[op]
            if strength > 4 >= least and least > 0:
                break
            self.take()
            right = self.binary(strength if op == "**" else strength + 1)
            left = self.apply(op, left, right)
        return left

    def comparison(self, least: int) -> Column:
        if self.peek() == "not":
            self.take()
            return ~F.coalesce(self.comparison(least), F.lit(False))
        left = self.binary(5)
        found, out = True, None
        while found:
            op, found = self.peek(), False
            if op in _COMPARE:
                self.take()
                right = self.binary(5)
                part = _compare(op, left, right)
                out, left, found = part if out is None else out & part, right, True
            elif op in ("in", "not") and (op == "in" or self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in"):
                self.take()
                if op == "not":
                    self.take("in")
                member = left.isin(self.list())
                part = member if op == "in" else ~F.coalesce(member, F.lit(False))
                out = part if out is None else out & part
        return left if out is None else out

    def list(self) -> list:
        close = {"[": "]", "(": ")"}.get(self.peek() or "")
        if not close:
            raise ExpressionError("expected a list")
        self.take()
        out = []
        while self.peek() != close:
            kind, value = self.take()
            sign = 1
            if value == "-":
                sign, (kind, value) = -1, self.take()
            out.append(_literal(kind, value, sign))
            if self.peek() == ",":
                self.take()
        self.take()
        return out

    def unary(self) -> Column:
        op = self.peek()
        if op == "-":
            self.take()
            return -self.binary(9)
        if op == "+":
            self.take()
            return self.binary(9)
        if op == "~":
            self.take()
            return ~F.coalesce(self.unary(), F.lit(False))
        out = self.atom()
        while self.peek() == ".":
            self.take()
            out = self.statistic(out, self.take()[1])
        return out

    def statistic(self, c: Column, name: str) -> Column:
        self.take("(")
        self.take(")")
        if name == "isnull" or name == "isna":
            return c.isNull()
        if name == "notnull" or name == "notna":
            return c.isNotNull()
        if name == "abs":
            return F.abs(c)
        if name not in STATISTICS:
            raise ExpressionError(f"no statistic {name!r}")
        self.statistics.append(STATISTICS[name](c).alias(f"_statistic_{len(self.statistics)}"))
        return F.col(f"_statistic_{len(self.statistics) - 1}")

    def atom(self) -> Column:
        kind, value = self.take()
        if value == "(":
            out = self.binary(0)
            self.take(")")
            return out
        if kind == "tick":
            return self.column(value[1:-1])
        if kind in ("num", "str"):
            return F.lit(_literal(kind, value))
        if kind != "name":
            raise ExpressionError(f"unexpected {value!r}")
        if value in ("True", "False", "None"):
            return F.lit({"True": True, "False": False, "None": None}[value])
        plain = value.removeprefix("@").removeprefix("np.")
        if self.peek() == "(":
            if plain in FUNCTIONS and value not in self.columns:
                self.take()
                arguments = []
                while self.peek() != ")":
                    arguments.append(self.binary(0))
                    if self.peek() == ",":
                        self.take()
                self.take()
                return FUNCTIONS[plain](*arguments)
            name, _, method = value.rpartition(".")
            if name and name in self.columns:
                return self.statistic(self.column(name), method)
            raise ExpressionError(f"no function {value!r}")
        return self.column(value)

    @staticmethod
    def apply(op: str, a: Column, b: Column) -> Column:
        if op in ("and", "&&", "&"):
            return a & b
        if op in ("or", "||", "|"):
            return a | b
        if op == "/":
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op == "//":
            return F.floor(F.try_divide(a.cast("double"), b.cast("double")))
        if op == "%":  # the sign of the divisor, as Python has it
            return a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double")))
        if op == "**":
            return F.pow(a, b)
        return {"+": a + b, "-": a - b, "*": a * b}[op]


def _literal(kind: str, value: str, sign: int = 1):
    if kind == "num":
        return sign * (float(value) if re.search(r"[.eE]", value) else int(value))
    if kind == "str":
        return re.sub(r"\\(.)", r"\1", value[1:-1])
    if value in ("True", "False"):
        return value == "True"
    raise ExpressionError(f"expected a value, found {value!r}")


def _compare(op: str, a: Column, b: Column) -> Column:
    if op == "!=":
        return ~a.eqNullSafe(b) | a.isNull()
    return {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def compiled(df: DataFrame, text: str) -> tuple[DataFrame, Column, list[str]]:
    """(df, column, names): the column that the text stands for, over df.

    Where a comparison meets a missing value the column is null, which a filter takes for false; so plain comparisons
    reach the scan. What is negated is made false first.

    Statistics of whole columns are one row of aggregates, added to each row as the columns `names`.
    """
    parser = _Parser(text, df.columns)
    column = parser.parse()
    if parser.statistics:
        df = df.crossJoin(F.broadcast(df.agg(*parser.statistics)))  # one row
    return df, column, [f"_statistic_{k}" for k in range(len(parser.statistics))]


def assignment(text: str) -> tuple[str, str]:
    """(name, expression) of `name = expression`."""
    name, eq, rest = text.partition("=")
    if not eq or rest.startswith("=") or not name.strip():
        raise ExpressionError("expected name = expression")
    return name.strip().strip("`"), rest
