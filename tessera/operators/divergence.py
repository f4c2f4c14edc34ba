"""β-divergence between an observed tensor and a model of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cell import beta_cell
from ..tensor import VALUE, Tensor, align

_X, _MU = "__x", "__mu"


def beta_divergence(x: Tensor, mu: Tensor, p: float = 1.0, missing: str = "zero") -> DataFrame:
    """Σ_cells d_p(x | mu) as a one-row DataFrame with column ``divergence``.

    ``missing="masked"`` sums over the cells both tensors store (the
    support of the observation).  ``missing="zero"`` reads an unstored cell
    of either tensor as zero and sums over the union of their supports
    (cells stored by neither cost d_p(0|0) = 0).
    """
    indices = list(align([x, mu]))
    left = x.df.select(*indices, F.col(VALUE).alias(_X))
    right = mu.df.select(*indices, F.col(VALUE).alias(_MU))
    if missing == "masked":
        joined = left.join(right, indices, "inner")
        cell = beta_cell(F.col(_X), F.col(_MU), p)
    elif missing == "zero":
        joined = left.join(right, indices, "full")
        cell = beta_cell(F.coalesce(F.col(_X), F.lit(0.0)), F.coalesce(F.col(_MU), F.lit(0.0)), p)
    else:
        raise ValueError("missing must be 'zero' or 'masked'")
    return joined.agg(F.sum(cell).alias("divergence"))
