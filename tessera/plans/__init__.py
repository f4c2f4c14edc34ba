"""Multi-step plans: the coupled factorization loop and lineage control."""

from .factorize import (
    CoupledModel,
    Factorization,
    FitResult,
    alpha,
    delta,
    factor_update,
    factorization_divergence,
    fit,
    materialize_observed,
    model_divergence,
    predict,
    q_denominator,
    q_numerator,
    run_epoch,
)
from .lineage import checkpoint_dir, cut_lineage

__all__ = [
    "CoupledModel",
    "Factorization",
    "FitResult",
    "alpha",
    "checkpoint_dir",
    "cut_lineage",
    "delta",
    "factor_update",
    "factorization_divergence",
    "fit",
    "materialize_observed",
    "model_divergence",
    "predict",
    "q_denominator",
    "q_numerator",
    "run_epoch",
]
