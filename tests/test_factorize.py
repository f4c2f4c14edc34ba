"""Multiplicative updates against a NumPy implementation of the same rule."""

import warnings

import numpy as np
import pytest

from helpers import from_rows, to_dict
from tessera import (
    CoupledModel,
    Factorization,
    contract,
    delta,
    factor_update,
    fit,
    random_tensor,
    run_epoch,
)
from tessera.plans import materialize_observed

I, J, K, R = 4, 5, 3, 3


def tensor(spark, idx, arr, keep=None):
    rows = [tuple(int(c) + 1 for c in pos) + (float(arr[pos]),)
            for pos in np.ndindex(*arr.shape) if keep is None or keep[pos]]
    return from_rows(spark, idx, rows, {i: n for i, n in zip(idx, arr.shape)})


def to_arr(t, shape):
    out = np.zeros(shape)
    for k, v in to_dict(t).items():
        out[tuple(c - 1 for c in k)] = v
    return out


def mu_numpy(xs, zs, fs, epochs, missing):
    """xs: name -> (array, mask); zs: name -> array; fs: [(x, a, b, p, phi)] with X ≈ Z_a @ Z_b."""
    zs = {k: v.copy() for k, v in zs.items()}
    order = []
    for _, a, b, _, _ in fs:
        order += [n for n in (a, b) if n not in order]
    for _ in range(epochs):
        for n in order:
            num = np.zeros_like(zs[n])
            den = np.zeros_like(zs[n])
            for x, a, b, p, phi in fs:
                if n not in (a, b):
                    continue
                arr, mask = xs[x]
                hat = zs[a] @ zs[b]
                m = mask if missing == "masked" else np.ones_like(hat, dtype=bool)
                q1 = np.where(mask, arr * hat ** (-p), 0.0)
                q2 = np.where(m, hat ** (1 - p), 0.0)
                if n == a:
                    num += q1 @ zs[b].T / phi
                    den += q2 @ zs[b].T / phi
                else:
                    num += zs[a].T @ q1 / phi
                    den += zs[a].T @ q2 / phi
            zs[n] = np.where(den > 0, zs[n] * num / np.where(den > 0, den, 1), zs[n])
    return zs


def build(spark, missing, p, phi2=None, sparse=False):
    rng = np.random.default_rng(0)
    z1, z2, z3 = rng.uniform(0.2, 1.0, (I, K)), rng.uniform(0.2, 1.0, (K, J)), rng.uniform(0.2, 1.0, (K, R))
    x1 = rng.uniform(0.5, 3.0, (I, J))
    mask1 = rng.uniform(size=(I, J)) < (0.6 if sparse else 1.1)
    x2 = rng.uniform(0.5, 3.0, (I, R))
    mask2 = np.ones_like(x2, dtype=bool)
    ts = {"X1": tensor(spark, ["i", "j"], x1, mask1), "Z1": tensor(spark, ["i", "k"], z1),
          "Z2": tensor(spark, ["k", "j"], z2)}
    fs = [Factorization("X1", ("Z1", "Z2"), p, 1.0)]
    np_fs = [("X1", "Z1", "Z2", p, 1.0)]
    if phi2 is not None:
        ts["X2"] = tensor(spark, ["i", "r"], x2, mask2)
        ts["Z3"] = tensor(spark, ["k", "r"], z3)
        fs.append(Factorization("X2", ("Z1", "Z3"), p, phi2))
        np_fs.append(("X2", "Z1", "Z3", p, phi2))
    model = CoupledModel(ts, fs, missing=missing)
    xs = {"X1": (np.where(mask1, x1, 0.0), mask1), "X2": (x2, mask2)}
    return model, xs, {"Z1": z1, "Z2": z2, "Z3": z3}, np_fs


@pytest.mark.parametrize("missing, p, sparse", [
    ("zero", 1.0, False), ("zero", 1.0, True), ("zero", 0.0, True), ("zero", 2.0, False),
    ("masked", 1.0, True), ("masked", 0.5, True), ("masked", 2.0, True),
])
def test_epochs_match_numpy(spark, missing, p, sparse):
    model, xs, zs, np_fs = build(spark, missing, p, sparse=sparse)
    m = materialize_observed(model)
    for _ in range(2):
        m = run_epoch(m)
    want = mu_numpy(xs, zs, np_fs, 2, missing)
    for name, shape in (("Z1", (I, K)), ("Z2", (K, J))):
        np.testing.assert_allclose(to_arr(m.tensors[name], shape), want[name], rtol=1e-9)


def test_coupled_matches_numpy(spark):
    model, xs, zs, np_fs = build(spark, "zero", 1.0, phi2=2.0, sparse=True)
    m = run_epoch(run_epoch(materialize_observed(model)))
    want = mu_numpy(xs, zs, np_fs, 2, "zero")
    for name, shape in (("Z1", (I, K)), ("Z2", (K, J)), ("Z3", (K, R))):
        np.testing.assert_allclose(to_arr(m.tensors[name], shape), want[name], rtol=1e-9)


@pytest.mark.parametrize("missing, p", [("zero", 1.0), ("zero", 0.0), ("masked", 1.0), ("zero", 2.0)])
def test_objective_never_rises(spark, missing, p):
    model, *_ = build(spark, missing, p, phi2=1.5, sparse=(missing == "masked"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        res = fit(model, epochs=4)
    j = res.objective
    assert len(j) == 4
    assert all(b <= a * (1 + 1e-9) for a, b in zip(j, j[1:]))
    rows = res.history.collect()
    assert len(rows) == 8 and {r["factorization"] for r in rows} == {"X1", "X2"}


def test_fit_tolerance_stops(spark):
    model, *_ = build(spark, "zero", 1.0)
    res = fit(model, epochs=50, tol=0.5)
    assert len(res.objective) < 50


def test_p1_denominator_shortcut_equals_full_form(spark):
    model, *_ = build(spark, "zero", 1.0)
    f = model.factorizations[0]
    fast = to_dict(delta(model, f, "Z1", 2))
    grid = tensor(spark, ["i", "j"], np.ones((I, J)))
    full = to_dict(contract([grid, model.tensors["Z2"]], ["i", "k"]))
    # the shortcut is over k only: it is constant along i
    assert set(fast) == {(k,) for k in range(1, K + 1)}
    assert all(fast[(k,)] == pytest.approx(v, rel=1e-12) for (i, k), v in full.items())


def test_observed_index_without_factor(spark):
    rng = np.random.default_rng(3)
    L = 2
    x = rng.uniform(0.5, 2.0, (I, J, L))
    z1, z2 = rng.uniform(0.2, 1.0, (I, K)), rng.uniform(0.2, 1.0, (K, J))
    ts = {"X": tensor(spark, ["i", "j", "l"], x), "Z1": tensor(spark, ["i", "k"], z1),
          "Z2": tensor(spark, ["k", "j"], z2)}
    m = run_epoch(CoupledModel(ts, [Factorization("X", ("Z1", "Z2"))]), checkpoint=False)
    hat = z1 @ z2
    q1 = (x / hat[:, :, None]).sum(axis=2)
    z1n = z1 * (q1 @ z2.T) / (L * z2.sum(axis=1))[None, :]
    hat = z1n @ z2
    q1 = (x / hat[:, :, None]).sum(axis=2)
    z2n = z2 * (z1n.T @ q1) / (L * z1n.sum(axis=0))[:, None]
    np.testing.assert_allclose(to_arr(m.tensors["Z1"], (I, K)), z1n, rtol=1e-9)
    np.testing.assert_allclose(to_arr(m.tensors["Z2"], (K, J)), z2n, rtol=1e-9)


def test_factors_are_checkpointed(spark):
    model, *_ = build(spark, "zero", 1.0)
    m = run_epoch(materialize_observed(model))
    plan = m.tensors["Z1"].df._jdf.queryExecution().analyzed().toString()
    assert len(plan.splitlines()) <= 3, plan


@pytest.mark.parametrize("missing", ["zero", "masked"])
def test_sparse_coupled_epoch_matches_numpy(spark, missing):
    model, xs, zs, np_fs = build(spark, missing, 1.0, phi2=2.0, sparse=True)
    m = run_epoch(materialize_observed(model))
    want = mu_numpy(xs, zs, np_fs, 1, missing)
    for name, shape in (("Z1", (I, K)), ("Z2", (K, J)), ("Z3", (K, R))):
        np.testing.assert_allclose(to_arr(m.tensors[name], shape), want[name], rtol=1e-9)


def test_p2_with_unstored_zeros_is_refused(spark):
    model, *_ = build(spark, "zero", 2.0, sparse=True)
    with pytest.raises(ValueError, match="infinite"):
        fit(model, epochs=1)
    dense_model, *_ = build(spark, "zero", 2.0, sparse=False)
    assert len(fit(dense_model, epochs=1).objective) == 1


@pytest.mark.parametrize("missing", ["zero", "masked"])
def test_chain_model_uses_general_path(spark, missing):
    # X(i,j) ≈ Σ_{k,l} A(i,k) G(k,l) B(l,j): no shared rank index, so the
    # updates go through the general contractions
    rng = np.random.default_rng(5)
    L = 2
    x = rng.uniform(0.5, 2.0, (I, J))
    mask = rng.uniform(size=(I, J)) < 0.7
    a, g, b = rng.uniform(0.2, 1.0, (I, K)), rng.uniform(0.2, 1.0, (K, L)), rng.uniform(0.2, 1.0, (L, J))
    ts = {"X": tensor(spark, ["i", "j"], x, mask), "A": tensor(spark, ["i", "k"], a),
          "G": tensor(spark, ["k", "l"], g), "B": tensor(spark, ["l", "j"], b)}
    model = CoupledModel(ts, [Factorization("X", ("A", "G", "B"))], missing=missing)
    m = run_epoch(materialize_observed(model))
    xm = np.where(mask, x, 0.0)
    ones = mask.astype(float) if missing == "masked" else np.ones_like(x)
    q = lambda a_, g_, b_: np.where(mask, xm / (a_ @ g_ @ b_), 0.0)
    a = a * (q(a, g, b) @ (g @ b).T) / (ones @ (g @ b).T)
    g = g * (a.T @ q(a, g, b) @ b.T) / (a.T @ ones @ b.T)
    b = b * ((a @ g).T @ q(a, g, b)) / ((a @ g).T @ ones)
    for name, arr in (("A", a), ("G", g), ("B", b)):
        np.testing.assert_allclose(to_arr(m.tensors[name], arr.shape), arr, rtol=1e-9)


def test_updates_without_broadcast_match(spark):
    # with broadcasting off, every factor join is a shuffle join; same numbers
    model, xs, zs, np_fs = build(spark, "zero", 1.0, phi2=2.0, sparse=True)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = run_epoch(materialize_observed(model))
        plan = m.tensors["Z1"].df._jdf.queryExecution().analyzed().toString()
        assert len(plan.splitlines()) <= 3
        want = mu_numpy(xs, zs, np_fs, 1, "zero")
        for name, shape in (("Z1", (I, K)), ("Z2", (K, J)), ("Z3", (K, R))):
            np.testing.assert_allclose(to_arr(m.tensors[name], shape), want[name], rtol=1e-9)
        upd = factor_update(m, "Z2").df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in upd
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("rank", [4, 20, 64, 100])
@pytest.mark.parametrize("missing", ["zero", "masked"])
def test_factor_update_at_any_rank(spark, rank, missing):
    rng = np.random.default_rng(rank)
    x, u, v = rng.random((5, 4)), rng.random((5, rank)) + 0.1, rng.random((rank, 4)) + 0.1
    as_tensor = lambda a, i: from_rows(
        spark, i, [(r + 1, c + 1, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])],
        {i[0]: a.shape[0], i[1]: a.shape[1]})
    m = CoupledModel({"X": as_tensor(x, ["i", "j"]), "U": as_tensor(u, ["i", "k"]), "V": as_tensor(v, ["k", "j"])},
                     [Factorization("X", ("U", "V"))], missing=missing)
    new = factor_update(m, "U")
    q = x / (u @ v)
    np.testing.assert_allclose(to_arr(new, u.shape), u * (q @ v.T) / v.sum(1), rtol=1e-9)


def test_plan_does_not_grow_with_the_rank(spark):
    def lines(rank):
        cards = {"i": 5, "j": 4, "k": rank}
        ts = {"X": random_tensor(spark, ["i", "j"], cards), "U": random_tensor(spark, ["i", "k"], cards),
              "V": random_tensor(spark, ["k", "j"], cards)}
        plan = factor_update(CoupledModel(ts, [Factorization("X", ("U", "V"))]), "U").df
        return len(plan._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert lines(64) == lines(4)


@pytest.mark.parametrize("p", [1.0, 0.5])
@pytest.mark.parametrize("missing", ["zero", "masked"])
def test_single_factor_model(spark, p, missing):
    rng = np.random.default_rng(1)
    x, z = rng.random((4, 3)) + 0.1, rng.random((4, 2)) + 0.1
    rows = lambda a: [(r + 1, c + 1, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    m = CoupledModel({"X": from_rows(spark, ["i", "j"], rows(x), {"i": 4, "j": 3}),
                      "Z": from_rows(spark, ["i", "k"], rows(z), {"i": 4, "k": 2})},
                     [Factorization("X", ("Z",), p)], missing=missing)
    hat = z.sum(1, keepdims=True)
    want = z * ((x * hat ** -p).sum(1, keepdims=True) / (3 * hat ** (1 - p)))
    np.testing.assert_allclose(to_arr(factor_update(m, "Z"), (4, 2)), want, rtol=1e-9)


def test_rank_coordinate_out_of_range_raises(spark):
    x = from_rows(spark, ["i", "j"], [(1, 1, 1.0)], {"i": 1, "j": 1})
    u = from_rows(spark, ["i", "k"], [(1, 1, 1.0), (1, 3, 1.0)], {"i": 1, "k": 2})
    v = from_rows(spark, ["k", "j"], [(1, 1, 1.0), (2, 1, 1.0)], {"k": 2, "j": 1})
    m = CoupledModel({"X": x, "U": u, "V": v}, [Factorization("X", ("U", "V"))], missing="masked")
    with pytest.raises(Exception, match="outside 1..2"):
        factor_update(m, "V").df.collect()


def test_zero_row_of_a_factor_stays_zero(spark):
    x = from_rows(spark, ["i", "j"], [(1, 1, 2.0), (2, 1, 3.0)], {"i": 2, "j": 1})
    u = from_rows(spark, ["i", "k"], [(1, 1, 0.0), (2, 1, 1.0)], {"i": 2, "k": 1})
    v = from_rows(spark, ["k", "j"], [(1, 1, 1.0)], {"k": 1, "j": 1})
    m = CoupledModel({"X": x, "U": u, "V": v}, [Factorization("X", ("U", "V"))], missing="masked")
    assert to_arr(factor_update(m, "U"), (2, 1)).tolist() == [[0.0], [3.0]]
    assert to_arr(factor_update(m, "V"), (1, 1)).tolist() == [[3.0]]


def test_two_factorizations_of_one_observation(spark):
    x = from_rows(spark, ["i", "j"], [(1, 1, 2.0), (1, 2, 3.0)], {"i": 1, "j": 2})
    u = from_rows(spark, ["i", "k"], [(1, 1, 1.0)], {"i": 1, "k": 1})
    v = from_rows(spark, ["k", "j"], [(1, 1, 1.0), (1, 2, 1.0)], {"k": 1, "j": 2})
    w = from_rows(spark, ["i", "k"], [(1, 1, 5.0)], {"i": 1, "k": 1})
    m = CoupledModel({"X": x, "U": u, "V": v, "W": w},
                     [Factorization("X", ("U", "V")), Factorization("X", ("W",))], missing="masked")
    got = [r["divergence"] for r in fit(m, 1).history.collect()]
    assert got[0] != got[1]


def test_epoch_refuses_infinite_objective(spark):
    x = from_rows(spark, ["i", "j"], [(1, 1, 2.0)], {"i": 1, "j": 2})
    u = from_rows(spark, ["i", "k"], [(1, 1, 1.0)], {"i": 1, "k": 1})
    v = from_rows(spark, ["k", "j"], [(1, 1, 1.0), (1, 2, 1.0)], {"k": 1, "j": 2})
    m = CoupledModel({"X": x, "U": u, "V": v}, [Factorization("X", ("U", "V"), 2.0)])
    with pytest.raises(ValueError, match="infinite"):
        run_epoch(m)
