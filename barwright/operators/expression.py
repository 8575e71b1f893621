"""The boolean expression language over bars, compiled to Columns.

An expression is parsed by Python's own parser and translated node by node; whatever is not listed here (attributes,
subscripts, lambdas, comprehensions, names other than price fields, calls of other functions) is refused. Functions
take any sub-expression; a kernel's argument becomes a named column first, so nesting adds levels, not copies.
"""

from __future__ import annotations

import ast
import operator
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as win
from ..functions.indicators import Kernels

FIELDS = ("open", "high", "low", "close", "volume")
BARS_SCHEMA = "ticker string, ts date, open double, high double, low double, close double, volume double"


class ExpressionError(ValueError):
    """An expression that can't be used, with the reason."""


@dataclass(frozen=True)
class Value:
    """A translated node: its column, whether it is boolean, and the plain number if it is one."""

    column: Column
    boolean: bool = False
    number: float | None = None


class Compiler:
    """Translates one expression over `Kernels`."""

    def __init__(self, kernels: Kernels):
        self.k = kernels

    def name(self, v: Value, node: ast.AST) -> str:
        """The name of a column that holds v."""
        if isinstance(node, ast.Name):
            return node.id.lower()
        return self.k.put(f"x_{zlib.crc32(ast.dump(node).encode()):08x}", lambda: v.column.cast("double"))

    def compile(self, text: str) -> Column:
        """The expression's column, never null; an expression that isn't boolean is refused."""
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except (SyntaxError, ValueError, AttributeError) as error:
            raise ExpressionError(f"syntax: {error}") from error
        value = self.visit(tree.body)
        if not value.boolean or value.number is not None:
            raise ExpressionError("the result must be a condition")
        return win.is_true(value.column)

    def visit(self, node: ast.AST) -> Value:
        handler = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if handler is None:
            raise ExpressionError(f"{type(node).__name__} is not allowed")
        return handler(node)

    def on_constant(self, node: ast.Constant) -> Value:
        if isinstance(node.value, bool):
            return Value(F.lit(node.value), boolean=True)
        if isinstance(node.value, (int, float)):
            return Value(F.lit(float(node.value)), number=float(node.value))
        raise ExpressionError(f"constant {node.value!r} is not allowed")

    def on_name(self, node: ast.Name) -> Value:
        if node.id.lower() not in FIELDS:
            raise ExpressionError(f"unknown name {node.id}")
        return Value(F.col(node.id.lower()))

    def on_boolop(self, node: ast.BoolOp) -> Value:
        parts = [self.visit(v) for v in node.values]
        if not all(p.boolean for p in parts):
            raise ExpressionError("and, or need conditions")
        join = operator.and_ if isinstance(node.op, ast.And) else operator.or_
        return Value(reduce(join, [win.is_true(p.column) for p in parts]), boolean=True)

    def on_unaryop(self, node: ast.UnaryOp) -> Value:
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            if not v.boolean:
                raise ExpressionError("not needs a condition")
            return Value(~win.is_true(v.column), boolean=True)
        if v.boolean or not isinstance(node.op, (ast.USub, ast.UAdd)):
            raise ExpressionError("a sign needs a number")
        negative = isinstance(node.op, ast.USub)
        return Value(-v.column if negative else v.column, number=None if v.number is None else (-v.number if negative else v.number))

    def on_binop(self, node: ast.BinOp) -> Value:
        a, b = self.visit(node.left), self.visit(node.right)
        if a.boolean or b.boolean:
            raise ExpressionError("arithmetic needs numbers")
        plain = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}.get(type(node.op))
        if plain:
            number = plain(a.number, b.number) if a.number is not None and b.number is not None else None
            return Value(plain(a.column, b.column), number=number)
        if isinstance(node.op, ast.Div):
            number = a.number / b.number if a.number is not None and b.number else None
            return Value(F.try_divide(a.column, b.column), number=number)
        raise ExpressionError(f"{type(node.op).__name__} is not allowed")

    def on_compare(self, node: ast.Compare) -> Value:
        tests = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
        values = [self.visit(v) for v in (node.left, *node.comparators)]
        found = []
        for op, a, b in zip(node.ops, values, values[1:], strict=False):
            if type(op) not in tests:
                raise ExpressionError(f"{type(op).__name__} is not allowed")
            missing = F.lit(isinstance(op, ast.NotEq))  # a missing side differs from anything
            found.append(F.coalesce(tests[type(op)](a.column, b.column), missing))
        return Value(reduce(operator.and_, found), boolean=True)

    def on_call(self, node: ast.Call) -> Value:
        if not isinstance(node.func, ast.Name) or node.func.id.lower() not in FUNCTIONS:
            raise ExpressionError("only the listed functions can be called")
        if any(isinstance(a, ast.Starred) for a in node.args) or any(kw.arg is None for kw in node.keywords):
            raise ExpressionError("arguments must be plain")
        make, names, defaults = FUNCTIONS[node.func.id.lower()]
        given = dict(zip(names, node.args, strict=False))
        if len(node.args) > len(names):
            raise ExpressionError("too many arguments")
        for kw in node.keywords:
            if kw.arg not in names or kw.arg in given:
                raise ExpressionError(f"unexpected argument {kw.arg}")
            given[kw.arg] = kw.value
        missing = [n for n in names if n not in given and n not in defaults]
        if missing:
            raise ExpressionError(f"missing {', '.join(missing)}")
        return make(self, {n: given.get(n) for n in names}, defaults)

    # arguments
    def series(self, node: ast.AST) -> str:
        v = self.visit(node)
        if v.boolean:
            raise ExpressionError("a number is needed, not a condition")
        return self.name(v, node)

    def number(self, node: ast.AST | None, default: float | None) -> float:
        if node is None:
            return default
        v = self.visit(node)
        if v.number is None:
            raise ExpressionError("a plain number is needed")
        return v.number

    def period(self, node: ast.AST | None, default: float | None = None) -> int:
        n = self.number(node, default)
        if n < 1:
            raise ExpressionError("periods start at 1")
        return int(n)


def _kernel(method: Callable[[Kernels, str, list], str], *params: tuple[str, float | None, str]):
    """A function of a series and numeric parameters (name, default, kind)."""

    def make(c: Compiler, given: dict, defaults: dict) -> Value:
        x = c.series(given["series"])
        values = [(c.period if kind == "n" else c.number)(given[n], d) for n, d, kind in params]
        return Value(F.col(method(c.k, x, values)))

    return make, ("series", *(n for n, *_ in params)), {n: d for n, d, _ in params if d is not None}


def _mfi(c: Compiler, given: dict, defaults: dict) -> Value:
    series = [c.series(given[n]) for n in ("high", "low", "close", "volume")]
    return Value(F.col(c.k.mfi(*series, c.period(given["period"], 14))))


def _cross(over: bool):
    def make(c: Compiler, given: dict, defaults: dict) -> Value:
        a, b = c.visit(given["a"]), c.visit(given["b"])
        if a.number is not None and b.number is not None:
            raise ExpressionError("two plain numbers never cross")
        cols = [F.col(c.name(v, n)) if v.number is None else v.column for v, n in ((a, given["a"]), (b, given["b"]))]
        return Value((win.crossed_over if over else win.crossed_under)(*cols), boolean=True)

    return make, ("a", "b"), {}


def _pair(pick: Callable):
    def make(c: Compiler, given: dict, defaults: dict) -> Value:
        a, b = c.visit(given["a"]).column, c.visit(given["b"]).column
        return Value(F.when(a.isNotNull() & b.isNotNull(), pick(a, b)))

    return make, ("a", "b"), {}


_N, _BAND = ("period", None, "n"), (("period", 20, "n"), ("std", 2.0, "x"))
_MACD = (("fast", 12, "n"), ("slow", 26, "n"), ("signal", 9, "n"))
FUNCTIONS = {
    "sma": _kernel(lambda k, x, p: k.sma(x, *p), _N),
    "ema": _kernel(lambda k, x, p: k.ema(x, *p), _N),
    "rsi": _kernel(lambda k, x, p: k.rsi(x, *p), ("period", 14, "n")),
    "macd_line": _kernel(lambda k, x, p: k.macd(x, *p)[0], *_MACD),
    "macd_signal": _kernel(lambda k, x, p: k.macd(x, *p)[1], *_MACD),
    "macd_hist": _kernel(lambda k, x, p: k.macd(x, *p)[2], *_MACD),
    "bb_mid": _kernel(lambda k, x, p: k.bands(x, *p)[0], *_BAND),
    "bb_upper": _kernel(lambda k, x, p: k.bands(x, *p)[1], *_BAND),
    "bb_lower": _kernel(lambda k, x, p: k.bands(x, *p)[2], *_BAND),
    "bbw": _kernel(lambda k, x, p: k.band_width(x, *p), *_BAND),
    "percent_b": _kernel(lambda k, x, p: k.percent_b(x, *p), *_BAND),
    "mfi": (_mfi, ("high", "low", "close", "volume", "period"), {"period": 14}),
    "stdev": _kernel(lambda k, x, p: k.std(x, *p, ddof=1), _N),
    "highest": _kernel(lambda k, x, p: k.highest(x, *p), _N),
    "lowest": _kernel(lambda k, x, p: k.lowest(x, *p), _N),
    "crossover": _cross(True),
    "crossunder": _cross(False),
    "abs": (lambda c, given, d: Value(F.abs(c.visit(given["x"]).column)), ("x",), {}),
    "min": _pair(F.least),
    "max": _pair(F.greatest),
}


def evaluate(k: Kernels, text: str) -> str:
    """The name of the expression's boolean column."""
    column = Compiler(k).compile(text)
    return k.put(f"expr_{zlib.crc32(text.strip().encode()):08x}", lambda: column)


def validate(spark: SparkSession, text: str) -> str | None:
    """None for an expression that compiles and passes analysis over an empty bar table, else what is wrong."""
    try:
        k = Kernels(spark.createDataFrame([], BARS_SCHEMA))
        name = evaluate(k, text)
        k.df.select(name).schema  # noqa: B018
    except Exception as error:  # the message is the result
        return str(error)
    return None


def literals(text: str) -> list[tuple[float, int, int]]:
    """(value, start, end) of the expression's numbers, in text order."""
    return sorted(
        ((float(n.value), n.col_offset, n.end_col_offset) for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool)), key=lambda x: x[1]
    )


def with_numbers(text: str, values: list[float]) -> str:
    """The expression with its numbers replaced, whole numbers staying whole where the text had them so."""
    for (_, start, end), value in reversed(list(zip(literals(text), values, strict=True))):
        shown = f"{value:g}" if any(c in text[start:end] for c in ".eE") else str(round(value))
        text = text[:start] + shown + text[end:]
    return text
