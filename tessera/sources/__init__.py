"""Sources and sinks: tensor files, tables, index spaces, generators."""

from .io import read_tensor, tensor_ddl, write_tensor
from .space import cardinalities, delinearize, density, formula_tensor, index_space, random_tensor

__all__ = [
    "cardinalities",
    "delinearize",
    "density",
    "formula_tensor",
    "index_space",
    "random_tensor",
    "read_tensor",
    "tensor_ddl",
    "write_tensor",
]
