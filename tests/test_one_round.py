"""Cyclic contractions with one exchange per operand, against NumPy and ``contract``."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import to_dict
from tessera import Tensor, contract, contract_one_round
from tessera.operators import shares
from tessera.operators.contract import _Operand
from tessera.operators.shares import _dealt, grid_shares, pass_shares, rows_sent


def sparse(spark, indices, shape, seed, types="INT"):
    rng = np.random.default_rng(seed)
    arr = rng.integers(1, 9, shape) * (rng.random(shape) < 0.4)
    rows = [tuple(int(c) for c in pos) + (float(arr[pos]),) for pos in np.ndindex(*shape) if arr[pos]]
    schema = ", ".join([f"{i} {types}" for i in indices] + ["value DOUBLE"])
    return Tensor(spark.createDataFrame(rows, schema), tuple(indices)), arr.astype(float)


def triangle(spark):
    a, na = sparse(spark, "ij", (9, 8), 1)
    b, nb = sparse(spark, "jk", (8, 7), 2, "BIGINT")  # the same index as another integer type
    c, nc = sparse(spark, "ik", (9, 7), 3)
    return [a, b, c], (na, nb, nc)


@pytest.mark.parametrize("output", ["", "i", "ik", "kj", "ijk"])
@pytest.mark.parametrize("parts", [1, 8, 30])
def test_triangle_equals_einsum(spark, output, parts):
    tensors, arrays = triangle(spark)
    got = to_dict(contract_one_round(tensors, list(output), parts=parts))
    want = np.einsum(f"ij,jk,ik->{output}", *arrays)
    assert got == {p: want[p] for p in np.ndindex(*want.shape) if want[p]}


def test_cycle_of_four_and_private_index(spark):
    a, na = sparse(spark, "ij", (5, 6), 4)
    b, nb = sparse(spark, "jk", (6, 4), 5)
    c, nc = sparse(spark, "kl", (4, 5), 6)
    d, nd = sparse(spark, "lim", (5, 5, 3), 7)
    got = to_dict(contract_one_round([a, b, c, d], ["j"]))
    want = np.einsum("ij,jk,kl,lim->j", na, nb, nc, nd)
    assert got == {(j,): want[j] for j in range(6) if want[j]}


def test_each_operand_is_exchanged_once_and_products_never(spark):
    tensors, _ = triangle(spark)
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    assert spark.conf.get(key) == "true"
    assert contract_one_round(tensors, [], parts=8).materialized and spark.conf.get(key) == "true"
    spark.conf.set(key, "false")
    try:
        total = contract_one_round(tensors, [], parts=8)
        plan = total.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, "true")
    # Three operands and the total.
    assert plan.count("Exchange") == 4 and plan.count("REPARTITION_BY_NUM") == 3
    assert plan.count("SortMergeJoin") == 2


@pytest.mark.parametrize("hashed", [3, 10_000])
def test_many_products_are_streamed_past_the_closing_operand(spark, monkeypatch, hashed):
    monkeypatch.setattr(shares, "MANY", 1)
    monkeypatch.setattr(shares, "HASHED", hashed)
    tensors, arrays = triangle(spark)
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, "false")
    try:
        out = contract_one_round(tensors, ["i"], parts=8, shares={"i": 1, "j": 8, "k": 1})
        plan = out.df._jdf.queryExecution().executedPlan().toString()
        got = to_dict(out)
    finally:
        spark.conf.set(key, "true")
    # All of the closing operand is in one grid cell: over twice 3 rows, so that the products are sorted.
    assert plan.count("ShuffledHashJoin") == (hashed != 3) and plan.count("SortMergeJoin") == 1 + (hashed == 3)
    want = np.einsum("ij,jk,ik->i", *arrays)
    assert got == {(i,): want[i] for i in range(len(want)) if want[i]}


def test_hashed_operand_gets_grid_cells_of_bounded_size():
    for parts in (8, 64):
        found = grid_shares(["sp", "pc", "sc"], [1e9] * 3, parts, 2)
        assert 1e9 / (found["s"] * found["c"]) <= shares.HASHED


def test_rows_sent_are_the_operands_times_the_absent_shares(spark):
    tensors, arrays = triangle(spark)
    shares = {"i": 2, "j": 4, "k": 2}
    for t, arr, copies in zip(tensors, arrays, (2, 2, 4)):
        dealt = _dealt(_Operand(t.cells(), list(t.indices), {}), shares, 16)
        assert dealt.count() == copies * np.count_nonzero(arr)


def test_hot_coordinate_is_dealt_by_the_other_indices(spark):
    rows = [(1 if n % 3 else n, n, 1.0) for n in range(3000)]
    a = spark.createDataFrame(rows, "i INT, j INT, value DOUBLE")
    cells = _dealt(_Operand(a, ["i", "j"], {}), {"i": 4, "j": 4, "k": 1}, 16).groupBy("__grid").count().collect()
    assert max(r["count"] for r in cells) < 3000 / 4  # two thirds of the rows have i = 1


def test_shares_follow_the_sizes(spark):
    assert grid_shares(["ij", "jk", "ik"], [1e6, 1e6, 1e6], 8) == {"i": 2, "j": 2, "k": 2}
    lopsided = grid_shares(["ij", "jk", "ik"], [1e9, 10, 10], 64)
    assert lopsided["k"] == 1 and lopsided["i"] * lopsided["j"] == 64


def test_empty_operand_and_refused_inputs(spark):
    tensors, _ = triangle(spark)
    none = tensors[1].with_df(tensors[1].df.where("false"))
    assert to_dict(contract_one_round([tensors[0], none, tensors[2]], ["i"])) == {}
    assert to_dict(contract_one_round([tensors[0], none, tensors[2]], [])) == to_dict(
        contract([tensors[0], none, tensors[2]], []))
    with pytest.raises(ValueError, match="no operand"):
        contract_one_round(tensors, ["z"])
    with pytest.raises(ValueError, match="common index"):
        contract_one_round([tensors[0], tensors[0].rename({"i": "x", "j": "y"})], ["i", "x"])


def shuffled(spark):
    """Files of exchanges on this machine's disk."""
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in tops for f in Path(top).glob("*/shuffle_*.data")}


def test_exchanges_and_tables_are_dropped_when_their_rows_are_written(spark):
    tensors, arrays = triangle(spark)
    kept = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = shuffled(spark)
    out = contract_one_round(tensors, ["i"], parts=8)
    for _ in range(50):
        if left := shuffled(spark) - before:  # they go a moment later
            time.sleep(0.2)
    assert not left and not [*kept.glob("one-round-*")]
    assert out.df.count() == np.count_nonzero(np.einsum("ij,jk,ik->i", *arrays))


@pytest.mark.parametrize("output, hashed", [("", 1000), ("i", 2), ("k", 1000), ("kj", 1000), ("ijk", 1000)])
def test_large_operands_are_contracted_in_passes(spark, monkeypatch, output, hashed):
    done, through = [], shares._gone_through
    monkeypatch.setattr(shares, "_gone_through", lambda *a: done.append(a[5]) or through(*a))
    for name, value in (("MANY", 1), ("FEW", 1), ("HASHED", hashed), ("_PASS_BITS", 3)):
        monkeypatch.setattr(shares, name, value)
    tensors, arrays = triangle(spark)
    got = to_dict(contract_one_round(tensors, list(output), parts=8))
    want = np.einsum(f"ij,jk,ik->{output}", *arrays)
    assert got == {p: want[p] for p in np.ndindex(*want.shape) if want[p]}
    assert done[0].count > 1 and done[0].shares[done[0].index] == 1


@pytest.mark.parametrize("size", [1e7, 1e8, 1e9])
def test_rows_dealt_at_a_time_are_in_proportion_to_the_operands(size):
    indices, rows = ["sp", "pc", "sc"], [size] * 3
    parts = int(size / 4e5)
    found = pass_shares(indices, rows, parts, 12, 2)
    at_once = [n * rows_sent([own], [1], found.shares) / (found.count if found.index in own else 1)
               for own, n in zip(indices, rows)]
    assert sum(at_once) <= 2 * size and found.cells >= 12
    in_cell = size / (found.shares["s"] * found.shares["c"] * found.count)
    assert found.index in "sc" and in_cell <= shares.HASHED
    # One round deals more, and the more the larger the operands are.
    assert rows_sent(indices, rows, grid_shares(indices, rows, parts, 2)) > 3 * size


def test_cells_whose_hashes_agree_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(shares, "MANY", 1)
    pairs = spark.range(400_000).select((F.col("id") % 640).alias("i"), F.floor(F.col("id") / 640).alias("k"))
    same = pairs.groupBy(F.hash("i", "k")).agg(F.collect_list(F.struct("i", "k")).alias("x")).where("size(x) > 1")
    (i, k), (i2, k2) = same.first().x[:2]
    a = spark.createDataFrame([(i, 1, 2.0), (i2, 1, 3.0)], "i BIGINT, j INT, value DOUBLE")
    b = spark.createDataFrame([(1, k, 5.0), (1, k2, 7.0)], "j INT, k BIGINT, value DOUBLE")
    c = spark.createDataFrame([(i, k, 1.0), (i2, k2, 10.0)], "i BIGINT, k BIGINT, value DOUBLE")
    got = to_dict(contract_one_round([Tensor(a, ("i", "j")), Tensor(b, ("j", "k")), Tensor(c, ("i", "k"))], ["i", "k"], parts=1))
    assert got == {(i, k): 10.0, (i2, k2): 210.0}


@pytest.mark.parametrize("types", ["STRING", "DATE"])
def test_indices_of_other_types_in_passes(spark, monkeypatch, types):
    for name, value in (("MANY", 1), ("FEW", 1), ("_PASS_BITS", 2)):
        monkeypatch.setattr(shares, name, value)
    tensors, arrays = triangle(spark)
    as_other = "CAST({0} AS STRING)" if types == "STRING" else "DATE_ADD(DATE'2020-01-01', CAST({0} AS INT))"
    tensors = [t.with_df(t.df.selectExpr(*[f"{as_other.format(i)} AS {i}" for i in t.indices], "value")) for t in tensors]
    want = np.einsum("ij,jk,ik->", *arrays)
    assert to_dict(contract_one_round(tensors, [], parts=8)) == {(): want}
    assert contract_one_round(tensors, ["i"], parts=8).df.count() == np.count_nonzero(np.einsum("ij,jk,ik->i", *arrays))
