"""Expression building blocks: tensor expressions and per-cell formulas."""

from .cell import beta_cell
from .exact import exact_sum
from .expr import Expr, S, T, compile_expr, render

__all__ = ["Expr", "S", "T", "beta_cell", "compile_expr", "exact_sum", "render"]
