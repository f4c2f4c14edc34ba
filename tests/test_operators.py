"""Contraction and element-wise identities against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import from_rows, to_dict
from tessera import (
    S,
    T,
    Tensor,
    beta_divergence,
    check,
    contract,
    contract_full_space,
    elementwise,
    sparse_sum,
    validate,
)
from tessera.operators.sampled import sampled_contract

DIMS = {"i": 3, "j": 4, "k": 2, "l": 3}


def dense(spark, idx, seed, density=1.0):
    rng = np.random.default_rng(seed)
    shape = [DIMS[i] for i in idx]
    arr = rng.uniform(0.5, 2.0, size=shape)
    if density < 1.0:
        arr = arr * (rng.uniform(size=shape) < density)
    rows = [tuple(int(c) + 1 for c in pos) + (float(arr[pos]),)
            for pos in np.ndindex(*shape) if arr[pos] != 0]
    return from_rows(spark, idx, rows, {i: DIMS[i] for i in idx}), arr


def einsum_dict(spec, arrays, out):
    res = np.einsum(spec, *arrays)
    if not out:
        return {(): float(res)}
    return {tuple(int(c) + 1 for c in pos): float(res[pos])
            for pos in np.ndindex(*res.shape) if res[pos] != 0}


@pytest.mark.parametrize("spec", ["ik,jk->ij", "ij,jk,kl->il", "ijk,jk->i", "ij,ij->",
                                  "ij,jk,ki->", "ij,kl->ik", "ik,jk->ijk"])
@pytest.mark.parametrize("density", [1.0, 0.6])
def test_contract_matches_einsum(spark, spec, density):
    ins, out = spec.split("->")
    tensors, arrays = [], []
    for n, idx in enumerate(ins.split(",")):
        t, a = dense(spark, list(idx), seed=n + 10, density=density)
        tensors.append(t)
        arrays.append(a)
    got = contract(tensors, list(out))
    want = einsum_dict(spec, arrays, out)
    got_d = {k: v for k, v in to_dict(got).items() if v != 0}
    assert got_d.keys() == want.keys()
    for k in want:
        assert got_d[k] == pytest.approx(want[k], rel=1e-12)
    # the order of the inputs and salting never change the result
    again = to_dict(contract(list(reversed(tensors)), list(out), salt=3))
    for k in want:
        assert again[k] == pytest.approx(want[k], rel=1e-12)


def test_contract_full_space_agrees(spark):
    a, _ = dense(spark, ["i", "k"], 1, 0.7)
    b, _ = dense(spark, ["k", "j"], 2, 0.7)
    x = to_dict(contract([a, b], ["i", "j"]))
    y = to_dict(contract_full_space([a, b], ["i", "j"], {"i": 3, "j": 4, "k": 2}))
    assert x.keys() == y.keys()
    assert all(x[k] == pytest.approx(y[k]) for k in x)


def test_contract_errors(spark):
    a, _ = dense(spark, ["i", "k"], 1)
    with pytest.raises(ValueError):
        contract([a], ["q"])


def test_contract_same_tensor_twice(spark):
    a, arr = dense(spark, ["i", "k"], 5)
    got = to_dict(contract([a, a.rename({"i": "j"})], ["i", "j"]))
    want = einsum_dict("ik,jk->ij", [arr, arr], "ij")
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_contract_broadcasts_small_bounded_sides(spark):
    a, _ = dense(spark, ["i", "k"], 1)
    b, _ = dense(spark, ["k", "j"], 2)
    plan = contract([a, b], ["i", "j"]).df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_elementwise_outer_fill_and_nary(spark):
    a = from_rows(spark, ["i"], [(1, 1.0), (2, 2.0)])
    b = from_rows(spark, ["i"], [(2, 10.0), (3, 30.0)])
    c = from_rows(spark, ["i"], [(2, 100.0)])
    assert to_dict(elementwise(T(a) + T(b))) == {(2,): 12.0}
    assert to_dict(elementwise(T(a) + T(b), how="outer", fill=0)) == {(1,): 1.0, (2,): 12.0, (3,): 30.0}
    assert to_dict(elementwise(T(a) * T(b) - T(c) + 1)) == {(2,): -79.0}
    assert to_dict(sparse_sum([a, b, c])) == {(1,): 1.0, (2,): 112.0, (3,): 30.0}


def test_elementwise_custom_combination(spark):
    a = from_rows(spark, ["i"], [(1, 3.0), (2, 5.0)])
    b = from_rows(spark, ["i"], [(1, 4.0), (2, 1.0)])
    got = to_dict(elementwise(T(a).combine(T(b), F.greatest)))
    assert got == {(1,): 4.0, (2,): 5.0}


def test_elementwise_invalid_values(spark):
    a = from_rows(spark, ["i"], [(1, 1.0), (2, 2.0)])
    z = from_rows(spark, ["i"], [(1, 0.0), (2, 4.0)])
    kept = to_dict(elementwise(T(a) / T(z), on_invalid="keep"))
    assert kept == {(1,): None, (2,): 0.5}
    with pytest.raises(Exception, match="invalid"):
        elementwise(T(a) / T(z)).df.collect()
    assert to_dict(elementwise(T(z).pow(-1))) == {(1,): float("inf"), (2,): 0.25}
    with pytest.raises(ValueError):
        elementwise(T(a) * T(from_rows(spark, ["j"], [(1, 1.0)])))


def test_validate_and_check(spark):
    t = from_rows(spark, ["i"], [(1, 1.0), (2, float("nan")), (3, None), (4, float("inf"))])
    r = validate(t).first()
    assert (r["cells"], r["nulls"], r["nans"], r["infs"]) == (4, 1, 1, 1)
    with pytest.raises(ValueError):
        check(t)
    ok = from_rows(spark, ["i"], [(1, 1.0)])
    assert check(ok)["cells"] == 1


def beta_np(x, mu, p):
    if p == 0:
        return 0.5 * (x - mu) ** 2
    if p == 1:
        return np.where(x == 0, mu, x * np.log(np.where(x == 0, 1, x) / mu) - x + mu)
    if p == 2:
        return x / mu - np.log(x / mu) - 1
    return x ** (2 - p) / ((1 - p) * (2 - p)) - x * mu ** (1 - p) / (1 - p) + mu ** (2 - p) / (2 - p)


@pytest.mark.parametrize("p", [0.0, 0.5, 1.0, 1.5, 2.0, 3.0])
def test_beta_divergence(spark, p):
    x, xa = dense(spark, ["i", "j"], 7)
    mu, ma = dense(spark, ["i", "j"], 8)
    got = beta_divergence(x, mu, p).first()["divergence"]
    assert got == pytest.approx(float(beta_np(xa, ma, p).sum()), rel=1e-10)
    assert beta_divergence(x, x, p).first()["divergence"] == pytest.approx(0.0, abs=1e-9)


def test_beta_divergence_missing_modes(spark):
    x = from_rows(spark, ["i"], [(1, 2.0)])
    mu = from_rows(spark, ["i"], [(1, 1.0), (2, 3.0)])
    masked = beta_divergence(x, mu, 1.0, missing="masked").first()["divergence"]
    zero = beta_divergence(x, mu, 1.0, missing="zero").first()["divergence"]
    d1 = 2 * np.log(2) - 2 + 1
    assert masked == pytest.approx(d1)
    assert zero == pytest.approx(d1 + 3.0)  # unstored x counts d(0|mu) = mu


@pytest.mark.parametrize("shape", ["matrix", "cp3", "tucker"])
def test_sampled_contract_matches_join(spark, shape):
    if shape == "matrix":
        x, _ = dense(spark, ["i", "j"], 1, 0.5)
        fs = [dense(spark, ["i", "k"], 2)[0], dense(spark, ["k", "j"], 3)[0]]
    elif shape == "cp3":
        x, _ = dense(spark, ["i", "j", "l"], 1, 0.5)
        fs = [dense(spark, ["i", "k"], 2)[0], dense(spark, ["j", "k"], 3)[0],
              dense(spark, ["l", "k"], 4)[0]]
    else:  # core tensor without the full rank: generic path
        x, _ = dense(spark, ["i", "j"], 1, 0.5)
        fs = [dense(spark, ["i", "k"], 2)[0], dense(spark, ["k", "l"], 3)[0],
              dense(spark, ["l", "j"], 4)[0]]
    full = to_dict(contract(fs, list(x.indices)))
    xs = to_dict(x)
    for salt in (None, 4):
        got = to_dict(sampled_contract(x, fs, lambda xv, h: xv * h, salt=salt))
        assert got.keys() == xs.keys()
        for k in xs:
            assert got[k] == pytest.approx(xs[k] * full[k], rel=1e-12)


def test_scalar_expression(spark):
    c = elementwise(S(2).pow(3) - 1)
    assert spark.range(1).select(c.alias("v")).first()["v"] == 7.0
    assert isinstance(elementwise(T(from_rows(spark, ["i"], [(1, 1.0)])) * 2), Tensor)


@pytest.mark.parametrize("target", [0, 1])
def test_sampled_gradient_matches_contraction(spark, target):
    from tessera.operators.sampled import sampled_gradient

    x, _ = dense(spark, ["i", "j"], 1, 0.6)
    fs = [dense(spark, ["i", "k"], 2)[0], dense(spark, ["k", "j"], 3)[0]]
    q = {"g": lambda xv, hat: xv / hat}
    hat = sampled_contract(x, fs, lambda xv, h: xv / h)
    want = to_dict(contract([hat, fs[1 - target]], list(fs[target].indices)))
    rows = sampled_gradient(x, fs, target, q)
    got = {}
    for r in rows.collect():
        key = tuple(r[i] for i in fs[target].indices)
        got[key] = got.get(key, 0.0) + r["g"]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_outer_product_without_a_bound(spark):
    a, b = from_rows(spark, ["i"], [(1, 2.0), (2, 3.0)]), from_rows(spark, ["j"], [(1, 5.0)], {"j": 10**9})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert to_dict(contract([a, b], ["i", "j"])) == {(1, 1): 10.0, (2, 1): 15.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_total_is_zero(spark):
    a, b = from_rows(spark, ["i"], [(1, 2.0)]), from_rows(spark, ["i"], [(2, 3.0)])
    assert contract([a, b], []).df.first()["value"] == 0.0


@pytest.mark.parametrize("p", [0.0, 0.5, 1.0, 1.5, 2.0, 3.0])
def test_beta_of_two_zeros_is_zero(spark, p):
    x = from_rows(spark, ["i"], [(1, 0.0), (2, 1.0)])
    assert beta_divergence(x, x, p, missing="masked").first()["divergence"] == pytest.approx(0.0, abs=1e-12)
