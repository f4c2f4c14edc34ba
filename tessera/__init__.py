"""tessera: tensor contraction and coupled factorization on Spark DataFrames.

A tensor is a DataFrame with one row per stored cell (index columns plus a
``value``).  Everything here builds ordinary DataFrame plans — joins,
aggregates, projections — so Catalyst and adaptive execution choose the
physical strategy.  Two kernels work on Arrow batches inside tasks: the
blocks of a factor update and Gram matrices.  No RDDs.
"""

from .functions import S, T, beta_cell
from .operators import (
    beta_divergence,
    check,
    contract,
    contract_full_space,
    contract_one_round,
    elementwise,
    sparse_sum,
    validate,
)
from .plans import (
    CoupledModel,
    Factorization,
    FitResult,
    alpha,
    delta,
    factor_update,
    fit,
    model_divergence,
    predict,
    q_denominator,
    q_numerator,
    run_epoch,
)
from .sources import (
    cardinalities,
    delinearize,
    density,
    formula_tensor,
    index_space,
    random_tensor,
    read_tensor,
    write_tensor,
)
from .tensor import Tensor, coalesce_cells, from_table, tensors_from_table

__all__ = [
    "CoupledModel",
    "Factorization",
    "FitResult",
    "alpha",
    "S",
    "T",
    "Tensor",
    "beta_cell",
    "beta_divergence",
    "cardinalities",
    "check",
    "coalesce_cells",
    "contract",
    "contract_full_space",
    "contract_one_round",
    "delinearize",
    "delta",
    "density",
    "elementwise",
    "factor_update",
    "fit",
    "formula_tensor",
    "from_table",
    "index_space",
    "model_divergence",
    "predict",
    "q_denominator",
    "q_numerator",
    "random_tensor",
    "read_tensor",
    "run_epoch",
    "sparse_sum",
    "tensors_from_table",
    "validate",
    "write_tensor",
]
