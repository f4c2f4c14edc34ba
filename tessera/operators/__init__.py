"""Tensor operators: contraction, element-wise expressions, divergences, checks."""

from .contract import contract, contract_full_space
from .divergence import beta_divergence
from .elementwise import elementwise, sparse_sum
from .shares import contract_one_round
from .validate import check, validate

__all__ = [
    "beta_divergence",
    "check",
    "contract",
    "contract_full_space",
    "contract_one_round",
    "elementwise",
    "sparse_sum",
    "validate",
]
