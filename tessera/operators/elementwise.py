"""Element-wise evaluation of an expression over aligned tensor cells.

Every *distinct* tensor in the expression is joined once on the full index
set (tensors of one ``tensors_from_table`` call share one side and need no join
among them), then the whole tree is evaluated as a single projection.  Because
each tensor stores at most one row per cell, these joins are one-to-one on
their keys: no key can fan out, so a hot coordinate cannot skew them.

``how="inner"`` (the default) keeps cells stored by every operand, the
original semantics of the element-wise operator.  ``how="outer"`` keeps
cells stored by any operand; with ``fill`` the missing operands read as
that value (``fill=0`` makes ``+`` a sparse sum).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr, compile_expr, render, wrap
from ..tensor import VALUE, Tensor, align


def guard(value: Column, on_invalid: str, what: str, finite: bool = False) -> Column:
    """NULL / NaN policy for a computed value, evaluated lazily per row.
    With ``finite``, infinity is invalid as well."""
    if on_invalid == "keep":
        return value
    if on_invalid == "raise":
        bad = value.isNull() | F.isnan(value)
        if finite:
            bad = bad | (F.abs(value) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"invalid value (NULL, NaN or infinite) in {what}"))).otherwise(value)
    raise ValueError(f"on_invalid must be 'raise' or 'keep', not {on_invalid!r}")


def elementwise(
    expr: Expr | Tensor,
    how: str = "inner",
    fill: float | None = None,
    on_invalid: str = "raise",
) -> Tensor | Column:
    """Evaluate ``expr`` cell by cell.

    Returns a ``Tensor`` over the common index set of the operands, or a
    ``Column`` when the expression holds no tensor (scalar ∘ scalar).
    ``on_invalid="raise"`` fails the job at the first NULL or NaN result
    (a zero divisor, ``log`` of a non-positive value, a missing operand);
    ``"keep"`` stores them.
    """
    expr = wrap(expr)
    if how not in ("inner", "outer"):
        raise ValueError("how must be 'inner' or 'outer'")
    tensors: list[Tensor] = []
    for t in expr.leaves():
        if not any(t is u for u in tensors):
            tensors.append(t)
    if not tensors:
        return compile_expr(expr, lambda t: F.lit(None))
    indices = list(align(tensors))

    names = {id(t): f"__e{n}" for n, t in enumerate(tensors)}
    groups: list[list[Tensor]] = []  # tensors that are columns of one table
    for t in tensors:
        same = next((g for g in groups if t.wide is not None and g[0].wide is t.wide), None)
        if same is None:
            groups.append([t])
        else:
            same.append(t)
    df = None
    for group in groups:
        side = _one_side(group, indices, names, how)
        df = side if df is None else df.join(side, indices, "inner" if how == "inner" else "full")

    def column_of(t: Tensor) -> Column:
        c = F.col(names[id(t)])
        return c if fill is None else F.coalesce(c, F.lit(float(fill)))

    value = guard(compile_expr(expr, column_of), on_invalid, render(expr))
    cards: dict[str, int] = {}
    for t in tensors:
        for i, c in t.cards.items():
            cards[i] = min(c, cards.get(i, c)) if how == "inner" else max(c, cards.get(i, c))
    return Tensor(df.select(*indices, value.alias(VALUE)), tuple(indices), cards)


def _one_side(group: list[Tensor], indices: list[str], names: dict[int, str], how: str) -> DataFrame:
    """The cells of tensors that share a table (or of one tensor)."""
    if len(group) == 1:
        return group[0].df.select(*indices, F.col(VALUE).alias(names[id(group[0])]))
    stored = [F.col(t.column).isNotNull() for t in group]
    cells = reduce(lambda a, b: a & b if how == "inner" else a | b, stored)
    return group[0].wide.filter(cells).select(*indices, *[F.col(t.column).alias(names[id(t)]) for t in group])


def sparse_sum(tensors: list[Tensor]) -> Tensor:
    """Σ of tensors over one index set, absent cells counting as zero.

    A union followed by one aggregate: no join, one shuffle, and partial
    sums before it, whatever the supports of the operands.
    """
    indices = list(align(tensors))
    union = None
    for t in tensors:
        part = t.df.select(*indices, F.col(VALUE))
        union = part if union is None else union.unionByName(part)
    cards: dict[str, int] = {}
    for t in tensors:
        for i, c in t.cards.items():
            cards[i] = max(c, cards.get(i, c))
    return Tensor(union.groupBy(*indices).agg(F.sum(VALUE).alias(VALUE)), tuple(indices), cards)
