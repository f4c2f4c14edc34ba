"""Blocked updates, Gram sums, absent rows, measured join order, one-scan tensors."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import from_rows, to_dict
from tessera import CoupledModel, Factorization, S, T, Tensor, contract, elementwise, factor_update, fit, predict
from tessera import tensors_from_table
from tessera.operators import blocks
from tessera.operators.contract import join_forest, join_tree, _Size
from tessera.plans import materialize_observed, model_divergence, run_epoch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dense_factor(spark, own, card, rank, drop=()):
    rows = [(a, k, ((a * 7 + k * 3) % 11 + 1) / 11.0) for a in range(1, card + 1) if a not in drop for k in range(1, rank + 1)]
    return from_rows(spark, [own, "k"], rows, {own: card, "k": rank})


def sample(spark, rank=5, drop=()):
    cells = [(i, j, float((i * j) % 9 + 1)) for i in range(1, 31) for j in range(1, 41) if j == 3 or (i * 3 + j) % 4 == 0]
    x = from_rows(spark, ["i", "j"], cells, {"i": 30, "j": 40})
    ts = {"X": x, "U": dense_factor(spark, "i", 30, rank), "V": dense_factor(spark, "j", 40, rank, drop)}
    return ts, {(i, j): v for i, j, v in cells}


def close(a, b):
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in a)


# -------------------------------------------------------------- blocks
@pytest.mark.parametrize("p,missing", [(1.0, "zero"), (1.0, "masked"), (0.5, "masked"), (1.5, "masked"), (0.0, "zero")])
@pytest.mark.parametrize("cells", [500_000, 40])
def test_blocked_update_equals_cell_rows(spark, p, missing, cells):
    ts, _ = sample(spark, drop=(7, 8))
    plain = CoupledModel(ts, [Factorization("X", ("U", "V"), p)], missing=missing)
    layout = blocks.blocked(ts["X"], [ts["U"], ts["V"]], block_cells=cells)
    made = CoupledModel(ts, plain.factorizations, missing=missing, layouts={0: layout})
    for a in ("U", "V"):
        close(to_dict(factor_update(made, a)), to_dict(factor_update(plain, a)))


def test_blocked_update_of_other_key_types_and_three_factors(spark):
    rows = [(f"u{i}", i % 5, i % 7 + 1, float(i % 11 + 1)) for i in range(400)]
    x = Tensor(spark.createDataFrame(rows, "a STRING, b LONG, c INT, value DOUBLE").groupBy("a", "b", "c").agg(
        F.sum("value").alias("value")), ("a", "b", "c"))
    z = {}
    for n, (own, keys, kind) in enumerate([("a", [f"u{i}" for i in range(390)], "STRING"), ("b", range(5), "INT"),
                                           ("c", range(1, 8), "LONG")]):
        cells = [(key, k, ((m * 5 + k * 3 + n) % 7 + 1) / 7.0) for m, key in enumerate(keys) for k in (1, 2, 3)]
        z[f"Z{n}"] = Tensor(spark.createDataFrame(cells, f"{own} {kind}, k INT, value DOUBLE"), (own, "k"), {"k": 3})
    plain = CoupledModel({"X": x, **z}, [Factorization("X", ("Z0", "Z1", "Z2"))], missing="masked")
    made = materialize_observed(plain)  # no cardinalities: vectors might have to be shuffled
    assert 0 in made.layouts
    for a in z:
        close(to_dict(factor_update(made, a)), to_dict(factor_update(plain, a)))


def test_a_key_of_most_cells_is_dealt_to_pieces_and_x_stays_in_place(spark):
    cells = [(i, 1 if i % 3 else i % 50 + 2, 1.0 + i % 5) for i in range(1, 2001)]
    x = from_rows(spark, ["i", "j"], cells, {"i": 2000, "j": 60})
    ts = {"X": x, "U": dense_factor(spark, "i", 2000, 3), "V": dense_factor(spark, "j", 60, 3)}
    layout = blocks.blocked(x, [ts["U"], ts["V"]], block_cells=50)
    sizes = [r["count"] for r in layout.cells.groupBy("__block").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 100
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = CoupledModel(ts, [Factorization("X", ("U", "V"))], missing="masked", layouts={0: layout})
        out = factor_update(m, "V")
        rows = blocks.blocked_gradient(layout, x, [ts["U"], ts["V"]], 1, 1.0, True, ["n", "d"])
        assert rows.count() <= 3 * 60 * len(sizes)
        before_scan = plan_of(out.df).split("tessera_blocks_")[0]
        assert before_scan.rstrip().splitlines()[-1].lstrip(" :+-").startswith("FileScan")
        assert "Exchange" not in "".join(before_scan.rstrip().splitlines()[-4:])  # the scan's own branch
        close(to_dict(out), to_dict(factor_update(CoupledModel(ts, m.factorizations, missing="masked"), "V")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_high_ranks_are_fitted_by_blocks(spark):
    ts, x = sample(spark, rank=16)
    res = fit(CoupledModel(ts, [Factorization("X", ("U", "V"))]), epochs=2)
    assert res.model.layouts and res.objective[1] < res.objective[0]
    u = np.array([[((i * 7 + k * 3) % 11 + 1) / 11 for k in range(1, 17)] for i in range(1, 31)])
    v = np.array([[((j * 7 + k * 3) % 11 + 1) / 11 for j in range(1, 41)] for k in range(1, 17)])
    X = np.zeros((30, 40))
    for (i, j), value in x.items():
        X[i - 1, j - 1] = value
    for _ in range(2):
        u = u * ((X / (u @ v)) @ v.T) / v.sum(axis=1)
        v = v * (u.T @ (X / (u @ v))) / u.sum(axis=0)[:, None]
    got = to_dict(res.model.tensors["V"])
    assert all(got[j, k] == pytest.approx(v[k - 1, j - 1], rel=1e-9) for j, k in got)


# ---------------------------------------------------------- Gram sums
def test_euclidean_updates_and_divergence_need_no_grid(spark):
    ts, x = sample(spark, rank=3)
    m = CoupledModel(ts, [Factorization("X", ("U", "V"), p=0.0)])
    u = np.array([[((i * 7 + k * 3) % 11 + 1) / 11 for k in range(1, 4)] for i in range(1, 31)])
    v = np.array([[((j * 7 + k * 3) % 11 + 1) / 11 for j in range(1, 41)] for k in range(1, 4)])
    X = np.zeros((30, 40))
    for (i, j), value in x.items():
        X[i - 1, j - 1] = value
    assert model_divergence(m).first()["divergence"] == pytest.approx(0.5 * ((X - u @ v) ** 2).sum())
    out = factor_update(m, "U")
    assert "keys=[i" in plan_of(out.df) and "keys=[i#" in plan_of(out.df)
    assert not any("j#" in line and "i#" in line and "HashAggregate(keys" in line for line in plan_of(out.df).splitlines())
    want = u * (X @ v.T) / (u @ v @ v.T)
    got = to_dict(out)
    assert all(got[i, k] == pytest.approx(want[i - 1, k - 1]) for i, k in got)
    new = run_epoch(m)
    assert model_divergence(new).first()["divergence"] < model_divergence(m).first()["divergence"]


def test_gram_sums_of_three_factors_and_an_uncovered_index(spark):
    rng = np.random.default_rng(3)
    dims = {"i": 3, "j": 4, "l": 2}
    fs = {n: rng.random((c, 2)) + 0.1 for n, c in dims.items()}
    x = {c: float(rng.integers(1, 9)) for c in itertools.product(range(1, 4), range(1, 5), range(1, 3), range(1, 3)) if rng.random() < 0.6}
    ts = {"X": from_rows(spark, ["i", "j", "l", "t"], [(*c, v) for c, v in x.items()], {**dims, "t": 2})}
    for n, f in fs.items():
        ts[n] = from_rows(spark, [n, "k"], [(a + 1, k + 1, float(f[a, k])) for a in range(len(f)) for k in range(2)],
                          {n: dims[n], "k": 2})
    m = CoupledModel(ts, [Factorization("X", ("i", "j", "l"), p=0.0)])
    hat = np.einsum("ik,jk,lk->ijl", fs["i"], fs["j"], fs["l"])[..., None].repeat(2, 3)
    X = np.zeros(hat.shape)
    for c, value in x.items():
        X[tuple(a - 1 for a in c)] = value
    assert model_divergence(m).first()["divergence"] == pytest.approx(0.5 * ((X - hat) ** 2).sum())
    want = fs["j"] * np.einsum("ijlt,ik,lk->jk", X, fs["i"], fs["l"]) / np.einsum("ijlt,ik,lk->jk", hat, fs["i"], fs["l"])
    got = to_dict(factor_update(m, "j"))
    assert all(got[j, k] == pytest.approx(want[j - 1, k - 1]) for j, k in got)


# -------------------------------------------------------- absent rows
@pytest.mark.parametrize("p", [0.0, 0.5, 1.0, 1.5])
@pytest.mark.parametrize("missing", ["zero", "masked"])
def test_absent_factor_rows_are_zeros(spark, p, missing):
    ts, _ = sample(spark, rank=2, drop=(3, 9))
    zeros = [(j, k, 0.0) for j in (3, 9) for k in (1, 2)]
    v = ts["V"]
    full = v.with_df(v.df.unionByName(spark.createDataFrame(zeros, v.df.schema)))
    got, want = (CoupledModel({**ts, "V": z}, [Factorization("X", ("U", "V"), p)], missing=missing) for z in (v, full))
    f = got.factorizations[0]
    close(to_dict(predict(got, f, on="support")), to_dict(predict(want, f, on="support")))
    a, b = (model_divergence(m).first()["divergence"] for m in (got, want))
    assert a == pytest.approx(b) and (a == float("inf")) == (p >= 1)
    close(to_dict(factor_update(got, "U")), to_dict(factor_update(want, "U")))
    shared = Tensor(ts["X"].df, ts["X"].indices)  # the general path: factors without a known rank
    loose = CoupledModel({"X": shared, "U": Tensor(ts["U"].df, ("i", "k")), "V": Tensor(v.df, ("j", "k"))},
                         [Factorization("X", ("U", "V"), p)], missing="masked")
    close(to_dict(predict(loose, f, on="support")), to_dict(predict(got, f, on="support")))


# ------------------------------------------------------- join order
def test_join_order_does_not_depend_on_operand_order(spark):
    d = from_rows(spark, ["i", "p"], [(i, (i * 7) % 90 + 1, 1.0) for i in range(1, 26)], {"i": 25, "p": 90})
    u, v = dense_factor(spark, "i", 25, 4), dense_factor(spark, "p", 90, 4)
    plans, values = set(), []
    for ops in itertools.permutations([d, u, v]):
        t = contract(list(ops), ["k"])
        values.append(to_dict(t))
        plans.add("".join(c for c in plan_of(t.df) if not c.isdigit()))
    assert len(plans) == 1
    for got in values[1:]:
        close(got, values[0])


def test_join_tree_avoids_products_and_large_intermediates():
    big = _Size(1e6, {"i": 1e3, "p": 1e5})
    u, v, w = _Size(4e3, {"i": 1e3, "k": 4}), _Size(4e5, {"p": 1e5, "k": 4}), _Size(10, {"z": 10})
    tree = join_tree([["i", "k"], ["z"], ["p", "k"], ["i", "p"]], [u, w, v, big], ["k"])
    assert 1 in tree  # the unlinked operand meets the rest last
    assert all(set(pair) != {0, 2} for pair in [tree, *[t for t in tree if isinstance(t, tuple)]] if len(pair) == 2
               and all(isinstance(x, int) for x in pair))


def test_dangling_cells_are_dropped_first(spark):
    a = from_rows(spark, ["i", "j"], [(i, j, 1.0) for i in range(1, 21) for j in range(1, 21)])
    b = from_rows(spark, ["j", "k"], [(j, 1, 2.0) for j in range(19, 30)])
    c = from_rows(spark, ["i", "l"], [(2, 5, 3.0), (40, 5, 3.0)])
    want = to_dict(contract([a, b, c], ["k", "l"]))
    assert to_dict(contract([a, b, c], ["k", "l"], semi_join=True)) == want == {(1, 5): 12.0}
    from tessera.operators.contract import _Operand, drop_dangling

    kept = drop_dangling([_Operand(t.cells(), list(t.indices), {}) for t in (a, b, c)])
    assert [o.df.count() for o in kept] == [2, 2, 1]
    assert join_forest([["i", "j"], ["j", "k"], ["i", "k"]]) is None
    tri = [from_rows(spark, ["i", "j"], [(1, 2, 2.0)]), from_rows(spark, ["j", "k"], [(2, 3, 5.0), (9, 9, 1.0)]),
           from_rows(spark, ["i", "k"], [(1, 3, 7.0)])]
    assert to_dict(contract(tri, [], semi_join=True)) == {(): 70.0}  # cyclic: not reduced, still right


def test_hot_keys_are_found_and_spread(spark):
    rows = [(i, 1 if i % 3 else i % 40 + 2, 1.0) for i in range(1, 6001)]
    a = from_rows(spark, ["i", "j"], rows)
    b = from_rows(spark, ["j", "k"], [(j, k, float(j + k)) for j in range(1, 42) for k in (1, 2)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, split = contract([a, b], ["i", "k"]), contract([a, b], ["i", "k"], skew=0.1)
        assert to_dict(plain) == to_dict(split)

        def largest(share):
            from tessera.operators.contract import _Operand, _join

            ops = [_Operand(t.cells(), list(t.indices), {}) for t in (a, b)]
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            out = _join(*ops, None, -1, share).df
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            spark.conf.unset("spark.sql.adaptive.enabled")
            return max(sizes) / sum(sizes)

        assert largest(None) > 0.6 and largest(0.1) < 0.25
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


# --------------------------------------------------- tensors of one scan
def test_tensors_from_table_equal_single_ones_and_need_no_join(spark):
    df = spark.createDataFrame([(1, 1, 2.0, None), (1, 1, 3.0, 4.0), (2, 1, None, 5.0), (2, 2, 7.0, None), (None, 1, 1.0, 1.0)],
                               "i INT, j INT, a DOUBLE, b DOUBLE")
    t = tensors_from_table(df, {"i": "i", "j": "j"}, {"a": "a", "b": "b", "n": F.lit(1.0)})
    assert to_dict(t["a"]) == {(1, 1): 5.0, (2, 2): 7.0} and to_dict(t["b"]) == {(1, 1): 4.0, (2, 1): 5.0}
    assert to_dict(t["n"]) == {(1, 1): 2.0, (2, 1): 1.0, (2, 2): 1.0}
    e = elementwise(T(t["a"]) * T(t["b"]) + T(t["n"]) * S(2))
    assert to_dict(e) == {(1, 1): 24.0} and "Join" not in plan_of(e.df)
    outer = elementwise(T(t["a"]) + T(t["b"]), how="outer", fill=0.0)
    assert to_dict(outer) == {(1, 1): 9.0, (2, 1): 5.0, (2, 2): 7.0} and "Join" not in plan_of(outer.df)
    other = from_rows(spark, ["i", "j"], [(1, 1, 10.0)])
    assert to_dict(elementwise(T(t["a"]) + T(other) * T(t["b"]))) == {(1, 1): 45.0}
    with pytest.raises(ValueError):
        tensors_from_table(df, {"i": "i"}, {"value": "a"})
