"""Small fixtures shared by the tests (golden inputs of the original tests)."""

from pyspark.sql import functions as F

from tessera import Tensor, formula_tensor


def input1(spark):
    # input1(i, k) = 10 * (2(k-1) + i), i in 1..2, k in 1..4
    return formula_tensor(spark, ["i", "k"], {"i": 2, "k": 4},
                          lambda i, k: F.lit(10) * (F.lit(2) * (k - 1) + i))


def input2(spark):
    # input2(j, k) = 10 * (3(k-1) + j), j in 1..3, k in 1..4
    return formula_tensor(spark, ["j", "k"], {"j": 3, "k": 4},
                          lambda j, k: F.lit(10) * (F.lit(3) * (k - 1) + j))


def to_dict(t: Tensor):
    return {tuple(r[i] for i in t.indices): r["value"] for r in t.cells().collect()}


def from_rows(spark, indices, rows, cards=None):
    schema = ", ".join([f"{i} INT" for i in indices] + ["value DOUBLE"])
    return Tensor(spark.createDataFrame(rows, schema), tuple(indices), cards or {})
