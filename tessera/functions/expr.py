"""Element-wise expressions over tensors and scalars.

An expression is a small tree built with Python operators:

    T(x) * T(mu).pow(-1)          T(x) + 2          (S(3) * 4) * T(x)
    T(x).log()                    T(a).combine(T(b), my_fn)

Leaves are tensors (``T``) or scalars (``S``, Python numbers or Spark
``Column`` literals); inner nodes are the combination operators ``+ - * /``
(or any ``Callable[[Column, Column], Column]``) and the pre-processors
``pow(n)`` and ``log()``.  ``compile_expr`` turns the tree into one Spark
``Column``, so a whole tree is a single projection inside whole-stage
codegen; see ``operators.elementwise`` for how the tensors are aligned.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tensor import Tensor

Number = Union[int, float]


class Expr:
    """Base class of expression nodes."""

    # arithmetic -------------------------------------------------------
    def __add__(self, other: Any) -> Expr:
        return Binary("+", self, wrap(other))

    def __radd__(self, other: Any) -> Expr:
        return Binary("+", wrap(other), self)

    def __sub__(self, other: Any) -> Expr:
        return Binary("-", self, wrap(other))

    def __rsub__(self, other: Any) -> Expr:
        return Binary("-", wrap(other), self)

    def __mul__(self, other: Any) -> Expr:
        return Binary("*", self, wrap(other))

    def __rmul__(self, other: Any) -> Expr:
        return Binary("*", wrap(other), self)

    def __truediv__(self, other: Any) -> Expr:
        return Binary("/", self, wrap(other))

    def __rtruediv__(self, other: Any) -> Expr:
        return Binary("/", wrap(other), self)

    def __neg__(self) -> Expr:
        return Binary("*", Scalar(-1.0), self)

    # pre-processors ---------------------------------------------------
    def pow(self, exponent: Number | Column) -> Expr:
        return Unary("pow", self, exponent)

    def __pow__(self, exponent: Number) -> Expr:
        return self.pow(exponent)

    def log(self) -> Expr:
        """Natural logarithm; NULL for values <= 0 (Spark semantics)."""
        return Unary("log", self, None)

    def combine(self, other: Any, fn: Callable[[Column, Column], Column]) -> Expr:
        """Combine with any ``(Column, Column) -> Column`` function."""
        return Binary(fn, self, wrap(other))

    # tree walks -------------------------------------------------------
    def leaves(self) -> list[Tensor]:
        raise NotImplementedError


@dataclass(eq=False)
class Leaf(Expr):
    tensor: Tensor

    def leaves(self) -> list[Tensor]:
        return [self.tensor]


@dataclass(eq=False)
class Scalar(Expr):
    value: Number | Column

    def leaves(self) -> list[Tensor]:
        return []


@dataclass(eq=False)
class Unary(Expr):
    op: str
    child: Expr
    arg: Any

    def leaves(self) -> list[Tensor]:
        return self.child.leaves()


@dataclass(eq=False)
class Binary(Expr):
    op: str | Callable[[Column, Column], Column]
    left: Expr
    right: Expr

    def leaves(self) -> list[Tensor]:
        return self.left.leaves() + self.right.leaves()


def T(tensor: Tensor) -> Expr:
    """A tensor operand."""
    if not isinstance(tensor, Tensor):
        raise TypeError(f"T() takes a Tensor, got {type(tensor).__name__}")
    return Leaf(tensor)


def S(value: Number | Column) -> Expr:
    """A scalar operand (a number or a Spark Column literal)."""
    return Scalar(value)


def wrap(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, Tensor):
        return Leaf(x)
    if isinstance(x, (int, float, Column)):
        return Scalar(x)
    raise TypeError(f"cannot use {type(x).__name__} in a tensor expression")


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": operator.add,
    "-": operator.sub,
    "*": operator.mul,
    # A zero divisor gives NULL instead of failing the job (ANSI mode) or
    # silently producing infinity; ``on_invalid`` then decides what happens.
    "/": F.try_divide,
}


def _lit(v: Number | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def compile_expr(expr: Expr, column_of: Callable[[Tensor], Column]) -> Column:
    """Translate an expression tree into one Spark Column."""
    if isinstance(expr, Leaf):
        return column_of(expr.tensor)
    if isinstance(expr, Scalar):
        return _lit(expr.value)
    if isinstance(expr, Unary):
        c = compile_expr(expr.child, column_of)
        if expr.op == "pow":
            return F.pow(c, _lit(expr.arg))
        if expr.op == "log":
            return F.log(c)
        raise ValueError(f"unknown pre-processor {expr.op!r}")
    if isinstance(expr, Binary):
        fn = _BINARY[expr.op] if isinstance(expr.op, str) else expr.op
        return fn(compile_expr(expr.left, column_of), compile_expr(expr.right, column_of))
    raise TypeError(f"not an expression node: {expr!r}")


def render(expr: Expr, name_of: Callable[[Tensor], str] | None = None) -> str:
    """Readable text of an expression (for logs and error messages)."""
    name_of = name_of or (lambda t: "T(" + ",".join(t.indices) + ")")
    if isinstance(expr, Leaf):
        return name_of(expr.tensor)
    if isinstance(expr, Scalar):
        return str(expr.value)
    if isinstance(expr, Unary):
        inner = render(expr.child, name_of)
        return f"log({inner})" if expr.op == "log" else f"({inner})^{expr.arg}"
    if isinstance(expr, Binary):
        op = expr.op if isinstance(expr.op, str) else getattr(expr.op, "__name__", "fn")
        return f"({render(expr.left, name_of)} {op} {render(expr.right, name_of)})"
    return repr(expr)
