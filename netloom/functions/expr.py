"""Expressions that become Columns or NumPy values and know their derivatives."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, functions as F


def wrap(x) -> "Expr":
    return x if isinstance(x, Expr) else Const(float(x))


class Expr:
    """Arithmetic builds trees; ``diff``, ``column`` and ``value`` read them."""

    def __add__(self, o): return Op("+", self, wrap(o))
    def __radd__(self, o): return Op("+", wrap(o), self)
    def __sub__(self, o): return Op("-", self, wrap(o))
    def __rsub__(self, o): return Op("-", wrap(o), self)
    def __mul__(self, o): return Op("*", self, wrap(o))
    def __rmul__(self, o): return Op("*", wrap(o), self)
    def __truediv__(self, o): return Op("/", self, wrap(o))
    def __rtruediv__(self, o): return Op("/", wrap(o), self)
    def __neg__(self): return Op("*", Const(-1.0), self)

    def names(self) -> set[str]:
        return set()


class Const(Expr):
    def __init__(self, v: float):
        self.v = v

    def diff(self, name): return Const(0.0)
    def column(self, env): return F.lit(self.v)
    def value(self, env): return self.v


class Var(Expr):
    def __init__(self, name: str):
        self.name = name

    def diff(self, name): return Const(1.0 if name == self.name else 0.0)
    def column(self, env): return env[self.name] if self.name in env else F.col(self.name)
    def value(self, env): return env[self.name]
    def names(self): return {self.name}


class Op(Expr):
    def __init__(self, op: str, a: Expr, b: Expr):
        self.op, self.a, self.b = op, a, b

    def diff(self, name):
        da, db = self.a.diff(name), self.b.diff(name)
        if self.op in "+-":
            return simple(self.op, da, db)
        if self.op == "*":
            return simple("+", simple("*", da, self.b), simple("*", self.a, db))
        return simple("/", simple("-", simple("*", da, self.b), simple("*", self.a, db)), simple("*", self.b, self.b))

    def _apply(self, a, b):
        return a + b if self.op == "+" else a - b if self.op == "-" else a * b if self.op == "*" else a / b

    def column(self, env): return self._apply(self.a.column(env), self.b.column(env))
    def value(self, env): return self._apply(self.a.value(env), self.b.value(env))
    def names(self): return self.a.names() | self.b.names()


def simple(op: str, a: Expr, b: Expr) -> Expr:
    """An operation with zeros, ones and constants folded."""
    ca, cb = (x.v if isinstance(x, Const) else None for x in (a, b))
    if ca is not None and cb is not None and not (op == "/" and cb == 0):
        return Const(Op(op, a, b).value({}))
    if op == "+" and ca == 0 or op == "*" and ca == 1:
        return b
    if op in "+-" and cb == 0 or op in "*/" and cb == 1:
        return a
    if op == "*" and 0 in (ca, cb) or op == "/" and ca == 0:
        return Const(0.0)
    return Op(op, a, b)


class Fn(Expr):
    """A function of one argument: exp, log, tanh, sigmoid, softplus or sqrt."""

    COLUMN = {
        "exp": F.exp, "log": F.log, "tanh": F.tanh, "sqrt": F.sqrt,
        "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
        "softplus": lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
    }
    NUMPY = {
        "exp": np.exp, "log": np.log, "tanh": np.tanh, "sqrt": np.sqrt,
        "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
        "softplus": lambda x: np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x))),
    }

    def __init__(self, fn: str, a):
        if fn not in self.COLUMN:
            raise ValueError(f"no derivative is known for {fn!r}; give the partial derivatives yourself")
        self.fn, self.a = fn, wrap(a)

    def diff(self, name):
        outer = {
            "exp": lambda: self, "log": lambda: 1 / self.a, "tanh": lambda: 1 - self * self, "sqrt": lambda: 0.5 / self,
            "sigmoid": lambda: self * (1 - self), "softplus": lambda: Fn("sigmoid", self.a),
        }[self.fn]()
        return simple("*", outer, self.a.diff(name))

    def column(self, env): return self.COLUMN[self.fn](self.a.column(env))
    def value(self, env): return self.NUMPY[self.fn](self.a.value(env))
    def names(self): return self.a.names()


def exp(x): return Fn("exp", x)
def log(x): return Fn("log", x)
def tanh(x): return Fn("tanh", x)
def sigmoid(x): return Fn("sigmoid", x)
def softplus(x): return Fn("softplus", x)
def sqrt(x): return Fn("sqrt", x)


class Transform:
    """A bijection from the line to an admissible set."""

    def forward(self, raw): raise NotImplementedError
    def inverse(self, v: float) -> float: raise NotImplementedError
    default = 0.0


class Real(Transform):
    def forward(self, raw): return wrap(raw)
    def inverse(self, v): return float(v)
    def inverse_column(self, v: Column) -> Column: return v


class Positive(Transform):
    default = 1.0

    def forward(self, raw): return exp(wrap(raw))

    def inverse(self, v):
        if v <= 0:
            raise ValueError("a positive value is needed")
        return math.log(max(v, 1e-30))

    def inverse_column(self, v: Column) -> Column:
        return F.when(v > 0, F.log(F.greatest(v, F.lit(1e-30)))).otherwise(F.raise_error(F.lit("a positive value is needed")))


class Interval(Transform):
    """(low, high) by a scaled tanh; values at or beyond the ends are moved just inside."""

    def __init__(self, low: float, high: float):
        if not low < high:
            raise ValueError("low must be below high")
        self.middle, self.half = (low + high) / 2, (high - low) / 2
        self.default = self.middle

    def forward(self, raw): return self.middle + self.half * tanh(wrap(raw))
    def inverse(self, v): return math.atanh(min(max((v - self.middle) / self.half, -1 + 1e-6), 1 - 1e-6))

    def inverse_column(self, v: Column) -> Column:
        return F.atanh(F.least(F.greatest((v - self.middle) / self.half, F.lit(-1 + 1e-6)), F.lit(1 - 1e-6)))


def columns(params: Mapping[str, float]) -> dict[str, Column]:
    return {k: F.lit(float(v)) for k, v in params.items()}
