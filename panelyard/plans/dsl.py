"""The factor formula language, compiled to stages of Spark columns.

Formulas are Python expressions over fields, parameters and earlier features with
a fixed list of functions.  The compiler never evaluates anything: a formula
becomes columns, and a window function over another window function starts a new
stage.  All windows of a stage go into one projection, so Spark shares their
sorts; equal sub-expressions are compiled once.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions import frames

# Short names of panel fields.
ALIASES = {
    "open": "adj_open", "high": "adj_high", "low": "adj_low", "close": "adj_close",
    "volume": "volume_shares", "amount": "amount_cny", "market_cap": "total_mv_cny", "industry": "industry_l1_code",
}
SHIFTS, WINDOWS, SECTIONS = {"ret", "lag", "delta"}, {"mean", "std", "slope", "max", "min"}, {"cs_rank", "cs_percentile", "cs_zscore"}
LEAST_WINDOW = {"lag": 0, "slope": 2}


class FormulaError(ValueError):
    """The formula is outside the language."""


class ContractError(ValueError):
    """A factor's declaration and its formulas disagree."""


def parsed(formula: str) -> ast.expr:
    try:
        return ast.parse(formula.strip(), mode="eval").body
    except SyntaxError as error:
        raise FormulaError(f"not an expression: {formula!r}") from error


@dataclass
class Value:
    column: Column
    stage: int
    key: str
    scalar: bool = False


@dataclass
class Compiler:
    """Turns formulas into stages of named columns over a panel with the given columns."""

    columns: list[str]
    parameters: dict[str, float] = field(default_factory=dict)
    allowed: set[str] | None = None
    least_group: int = 10
    section_mask: str | None = None
    features: dict[str, Value] = field(default_factory=dict)
    stages: dict[int, dict[str, Column]] = field(default_factory=dict)
    made: dict[str, Value] = field(default_factory=dict)

    def feature(self, name: str, formula: str) -> Value:
        if name in self.columns or name in ALIASES or name in self.parameters:
            raise ContractError(f"feature {name!r} hides a field or parameter")
        value = self._stored(self._clean(self.compile(parsed(formula))), f"f_{name}")
        self.features[name] = value
        return value

    def apply(self, panel: DataFrame) -> DataFrame:
        out = panel.withColumn("_ordinal", F.row_number().over(frames.history())) if any("_ordinal" in repr(c) for s in self.stages.values() for c in s.values()) else panel
        for stage in sorted(self.stages):
            out = out.withColumns(self.stages[stage])
        return out

    def _clean(self, value: Value) -> Value:
        return Value(frames.finite(value.column.cast("double")), value.stage, f"finite({value.key})")

    def _stored(self, value: Value, hint: str = "x") -> Value:
        """The value as a named column, made in its stage and there for later ones."""
        if value.key not in self.made:
            name = f"_{hint}_{len(self.made)}"
            self.stages.setdefault(value.stage, {})[name] = value.column
            self.made[value.key] = Value(F.col(name), value.stage + 1, name)
        return self.made[value.key]

    def compile(self, node: ast.expr) -> Value:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return Value(F.lit(node.value), 0, repr(node.value), True)
        if isinstance(node, ast.Name):
            return self._name(node.id)
        if isinstance(node, ast.BinOp):
            return self._arithmetic(node)
        if isinstance(node, ast.UnaryOp):
            x = self.compile(node.operand)
            kinds = {ast.USub: ("-", lambda c: -c), ast.UAdd: ("+", lambda c: c), ast.Not: ("not", lambda c: ~c)}
            if type(node.op) in kinds:
                sign, fn = kinds[type(node.op)]
                return Value(fn(x.column), x.stage, f"{sign}({x.key})", x.scalar)
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            return self._comparison(node)
        if isinstance(node, ast.BoolOp):
            parts = [self.compile(v) for v in node.values]
            both = isinstance(node.op, ast.And)
            out = parts[0].column
            for p in parts[1:]:
                out = out & p.column if both else out | p.column
            return self._joined(out, f"{'and' if both else 'or'}", parts)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return self._call(node)
        raise FormulaError(f"not in the language: {type(node).__name__}")

    def _joined(self, column: Column, name: str, parts: list[Value]) -> Value:
        return Value(column, max(p.stage for p in parts), f"{name}({','.join(p.key for p in parts)})", all(p.scalar for p in parts))

    def _name(self, name: str) -> Value:
        if name in self.features:
            return self.features[name]
        if name in self.parameters:
            return Value(F.lit(self.parameters[name]), 0, repr(self.parameters[name]), True)
        column = ALIASES.get(name, name)
        if column not in self.columns:
            raise FormulaError(f"unknown field or feature: {name}")
        if self.allowed is not None and column not in self.allowed:
            raise FormulaError(f"field {name!r} is not among the required fields")
        return Value(F.col(column), 0, column)

    def _arithmetic(self, node: ast.BinOp) -> Value:
        a, b = self.compile(node.left), self.compile(node.right)
        kinds = {ast.Add: ("+", lambda x, y: x + y), ast.Sub: ("-", lambda x, y: x - y), ast.Mult: ("*", lambda x, y: x * y), ast.Div: ("/", frames.ratio), ast.Pow: ("**", F.pow)}
        if type(node.op) not in kinds:
            raise FormulaError(f"not in the language: {type(node.op).__name__}")
        sign, fn = kinds[type(node.op)]
        return self._joined(fn(a.column, b.column), sign, [a, b])

    def _comparison(self, node: ast.Compare) -> Value:
        a, b = self.compile(node.left), self.compile(node.comparators[0])
        kinds = {ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
        if type(node.ops[0]) not in kinds:
            raise FormulaError(f"not in the language: {type(node.ops[0]).__name__}")
        name = kinds[type(node.ops[0])]
        # A missing side compares false, and unequal to everything.
        return self._joined(F.coalesce(getattr(a.column, name)(b.column), F.lit(name == "__ne__")), name, [a, b])

    def _call(self, node: ast.Call) -> Value:
        name, named = node.func.id, {k.arg: k.value for k in node.keywords}
        if name in SHIFTS | WINDOWS:
            return self._history(name, self.compile(node.args[0]), window_of(node, self.parameters))
        if name in SECTIONS or name == "group_mean":
            if name == "group_mean" and "by" not in named:
                raise FormulaError("group_mean needs by=")
            return self._section(name, self.compile(node.args[0]), self.compile(named["by"]) if "by" in named else None)
        parts = [self.compile(a) for a in node.args] + [self.compile(v) for v in named.values()]
        c = [p.column for p in parts]
        if name == "abs" and len(c) == 1:
            return self._joined(F.abs(c[0]), name, parts)
        if name == "log" and len(c) == 1:
            return self._joined(F.ln(F.when(c[0] > 0, c[0])), name, parts)
        if name == "where" and len(c) == 3:
            return self._joined(F.when(F.coalesce(c[0], F.lit(False)), c[1]).otherwise(c[2]), name, parts)
        if name == "clip" and parts:
            bounds = dict(zip(["lower", "upper"], parts[1 : len(node.args)])) | dict(zip(named, parts[len(node.args) :]))
            x = c[0]
            if "lower" in bounds:
                x = F.when(x.isNotNull(), F.greatest(x, bounds["lower"].column))
            if "upper" in bounds:
                x = F.when(x.isNotNull(), F.least(x, bounds["upper"].column))
            return self._joined(x, f"clip[{sorted(bounds)}]", parts)
        raise FormulaError(f"unknown function or arguments: {name}")

    def _plain(self, x: Value) -> Value:
        """A column that a window can read: fields as they are, all else stored by the stage before."""
        return x if x.key in self.columns or x.key.startswith("_") else self._stored(x)

    def _history(self, name: str, x: Value, n: int) -> Value:
        x = self._plain(x)
        w = frames.history()
        past = F.lag(x.column, n).over(w) if n else x.column
        if name == "ret":
            column = frames.ratio(x.column, past) - 1
        elif name in ("lag", "delta"):
            column = past if name == "lag" else x.column - past
        elif name == "slope":
            column = frames.slope(x.column, F.col("_ordinal"), n)
        else:
            column = frames.rolling(x.column, n, name)
        return self._stored(Value(column, x.stage, f"{name}[{n}]({x.key})"))

    def _section(self, name: str, x: Value, by: Value | None) -> Value:
        masked = Value(F.when(F.col(self.section_mask), x.column), x.stage, f"masked({x.key})") if self.section_mask else x
        x = self._plain(Value(masked.column.cast("double"), masked.stage, f"double({masked.key})"))
        keys = []
        if by is not None:
            group = Value(F.when(F.col(self.section_mask), by.column), by.stage, f"masked({by.key})") if self.section_mask else by
            group = self._plain(group)
            keys = [group.key if group.key in self.columns else group.column._jc.toString()]
            x = Value(x.column, max(x.stage, group.stage), x.key)
        fn = {"cs_zscore": frames.zscore, "group_mean": lambda c, *k: F.avg(c).over(frames.section(*k))}.get(name, frames.pct_rank)
        column = fn(x.column, *keys)
        if keys:
            column = frames.large_group(column, x.column, keys[0], self.least_group)
        return self._stored(Value(column, x.stage, f"{name}[{keys}]({x.key})"))


def window_of(node: ast.Call, parameters: dict[str, float]) -> int:
    """The whole number that a window function takes, at its least or more."""
    name = node.func.id
    given = next((k.value for k in node.keywords if k.arg == "window"), node.args[1] if len(node.args) > 1 else None)
    value = given.value if isinstance(given, ast.Constant) else parameters.get(given.id) if isinstance(given, ast.Name) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or int(value) != value or value < LEAST_WINDOW.get(name, 1):
        raise FormulaError(f"{name} takes a whole number of {LEAST_WINDOW.get(name, 1)} or more")
    return int(value)


def lookback(formula: str, parameters: dict[str, float], features: dict[str, int]) -> int:
    """Rows of history that the formula reads before the current one."""

    def needs(node: ast.AST) -> int:
        if isinstance(node, ast.Name):
            return features.get(node.id, 0)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            if node.func.id in SHIFTS:
                return needs(node.args[0]) + window_of(node, parameters)
            if node.func.id in WINDOWS:
                return needs(node.args[0]) + max(0, window_of(node, parameters) - 1)
            return max([0, *map(needs, node.args), *(needs(k.value) for k in node.keywords)])
        return max((needs(child) for child in ast.iter_child_nodes(node)), default=0)

    return needs(parsed(formula))
