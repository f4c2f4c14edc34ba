"""

Every query reads the parquet tables of ``sf_dir`` (through the tensor
definitions in ``workload.py``) and returns a DataFrame.  Floating results
are rounded on both sides so that summation order cannot change the hash.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
import uuid
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import workload as W  # noqa: E402
from tessera import (  # noqa: E402
    CoupledModel,
    Factorization,
    S,
    T,
    beta_divergence,
    cardinalities,
    contract,
    contract_one_round,
    contract_full_space,
    delinearize,
    delta,
    density,
    elementwise,
    factor_update,
    fit,
    index_space,
    predict,
    random_tensor,
    read_tensor,
    run_epoch,
    validate,
    write_tensor,
)
from tessera.plans import alpha, checkpoint_dir, materialize_observed  # noqa: E402
from tessera.plans.factorize import factorization_divergence  # noqa: E402
from tessera.plans.factorize import q_denominator as denominator_q  # noqa: E402
from tessera.plans.factorize import q_numerator as numerator_q  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"


def _shared_folder(spark) -> str:
    """The checkpoint folder; where the session names none, one in the warehouse, which executors share too."""
    if not W.has_checkpoint_dir(spark):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return checkpoint_dir(spark)


# ------------------------------------------------------------- queries
def q_tensor_from_table(spark, d):
    return W.X1(spark, d).cells()


def q_contract_binary(spark, d):
    return W.rounded(contract([W.A(spark, d), W.B(spark, d)], ["n", "brand"]), 4)


def q_contract_three_way(spark, d):
    t = contract([W.A(spark, d), W.B(spark, d), W.R(spark, d)], ["region", "brand"])
    return W.rounded(t, 4)


def q_contract_any_order(spark, d):
    """The same contraction with the products-first order of operands; sizes decide."""
    t = contract([W.R(spark, d), W.B(spark, d), W.A(spark, d)], ["region", "brand"])
    return W.rounded(t, 4)


def _reduced_inputs(spark, d):
    """A, B of a few brands, R of one region: most cells of A have no partner."""
    b, r = W.B(spark, d), W.R(spark, d)
    return [W.A(spark, d), b.with_df(b.df.where(F.col("brand").endswith("1"))), r.with_df(r.df.where("region = 1"))]


def q_contract_reduced(spark, d):
    return W.rounded(contract(_reduced_inputs(spark, d), ["region", "brand"], semi_join=True), 4)


def q_contract_hot_keys(spark, d):
    """Nations are few, so each holds a share of A: its rows are spread over all partitions."""
    return W.rounded(contract([W.A(spark, d), W.R(spark, d)], ["region", "part"], skew=0.01), 4)


def q_contract_triangle(spark, d):
    """Supplier, part and customer in a cycle: each operand is exchanged once, their two-way product never."""
    _shared_folder(spark)
    return W.rounded(contract_one_round(W.triangle(spark, d), ["s"]), 2)


def q_contract_to_scalar(spark, d):
    return W.rounded(contract([W.A(spark, d), W.B(spark, d)], []), 2)


def q_contract_self(spark, d):
    x = W.X1(spark, d)
    return W.rounded(contract([x, x.rename({"i": "i2"})], ["i", "i2"]), 4)


def _x1_z2(spark, d):
    ts = W.x1_model_tensors(spark, d)
    return ts["X1"], ts["Z2"]


def q_contract_index_space(spark, d):
    x, z2 = _x1_z2(spark, d)
    r = cardinalities(W.X2(spark, d))["r"]
    space = {**x.cards, **z2.cards, "r": r}
    return W.rounded(contract([x, z2], ["i", "k"], index_space=space), 4)


def q_contract_range_restricted(spark, d):
    x, z2 = _x1_z2(spark, d)
    return W.rounded(contract([x, z2], ["i", "k"], index_space={"j": 20}), 4)


def q_contract_broadcast_output(spark, d):
    x, z2 = _x1_z2(spark, d)
    r = cardinalities(W.X2(spark, d))["r"]
    return W.rounded(contract([x, z2], ["i", "k", "r"], index_space={"r": r}), 4)


def q_contract_full_space(spark, d):
    x, z2 = _x1_z2(spark, d)
    return W.rounded(contract_full_space([x, z2], ["i", "k"], {**x.cards, **z2.cards}), 4)


def q_contract_salted(spark, d):
    return W.rounded(contract([W.A(spark, d), W.B(spark, d)], ["n", "brand"], salt=8), 4)


def _ew(build, digits=4, **kw):
    def q(spark, d):
        return W.rounded(elementwise(build(spark, d), **kw), digits)
    return q


q_ew_mul = _ew(lambda s, d: T(W.X1(s, d)) * T(W.Y1(s, d)))
q_ew_add = _ew(lambda s, d: T(W.X1(s, d)) + T(W.Y1(s, d)))
q_ew_sub = _ew(lambda s, d: T(W.X1(s, d)) - T(W.Y1(s, d)))
q_ew_div = _ew(lambda s, d: T(W.X1(s, d)) / T(W.Y1(s, d)))
q_ew_scalar_left = _ew(lambda s, d: 3 * T(W.X1(s, d)))
q_ew_scalar_right = _ew(lambda s, d: T(W.X1(s, d)) * 2)
q_ew_scalar_both = _ew(lambda s, d: (S(3) * 4) * T(W.X1(s, d)))
q_ew_pow = _ew(lambda s, d: T(W.X1(s, d)).pow(0.5) * S(2).pow(2) * T(W.Y1(s, d)).pow(-1), 6)
q_ew_log = _ew(lambda s, d: T(W.X1(s, d)).log(), 6)
q_ew_unary = _ew(lambda s, d: T(W.X1(s, d)).pow(-1), 8)
def _nested(s, d):
    x = T(W.X1(s, d))  # one tensor, read once
    return x * (S(F.log(F.lit(3.0))) * x)


q_ew_nested = _ew(_nested, 4)


def _nary(s, d):
    t = W.quantity_count_discount(s, d)  # one pass over the line items
    return T(t["X1"]) * T(t["Y1"]) - T(t["W1"]) + 3


q_ew_nary = _ew(_nary, 4)
q_ew_outer_fill = _ew(lambda s, d: T(W.A(s, d, True)) + T(W.A(s, d, False)), 4, how="outer", fill=0.0)


def q_index_space(spark, d):
    c = cardinalities(W.X1(spark, d))
    return index_space(spark, {"i": c["i"], "j": c["j"], "k": W.RANK})


def q_delinearize(spark, d):
    ev = W.table(spark, d, "events")
    return ev.select("event_id", *delinearize("event_id", ["a", "b", "c"], {"a": 10, "b": 20, "c": 1000}))


def q_random_tensor(spark, d):
    c = cardinalities(W.X1(spark, d))
    return random_tensor(spark, ["i", "j"], c, seed=7).cells()


def q_validate_counts(spark, d):
    return validate(elementwise((T(W.E(spark, d)) - 1).log(), on_invalid="keep"))


def q_density(spark, d):
    t = W.D(spark, d)
    c = cardinalities(t)
    return density(t, c["i"] * c["p"]).select("cells", "numel", F.round("density", 8).alias("density"))


def _beta(p):
    def q(spark, d):
        ts = W.x1_model_tensors(spark, d)
        mu = contract([ts["Z1"], ts["Z2"]], ["i", "j"])
        return beta_divergence(ts["X1"], mu, p, missing="zero").select(
            F.round("divergence", 2).alias("divergence"))
    return q


q_beta_div_p0, q_beta_div_p1, q_beta_div_p2, q_beta_div_p05 = (_beta(p) for p in (0.0, 1.0, 2.0, 0.5))


def q_beta_div_masked(spark, d):
    ts = W.sparse_model_tensors(spark, d)
    m = CoupledModel(ts, [Factorization("D", ("U", "V"))], missing="masked")
    mu = predict(m, m.factorizations[0], on="support")
    return beta_divergence(ts["D"], mu, 1.0, missing="masked").select(
        F.round("divergence", 2).alias("divergence"))


def _x1_model(spark, d, p=1.0, phi=1.0, missing="zero"):
    return CoupledModel(W.x1_model_tensors(spark, d), [Factorization("X1", ("Z1", "Z2"), p, phi)],
                        missing=missing)


def _coupled_model(spark, d):
    return CoupledModel(W.coupled_model_tensors(spark, d),
                        [Factorization("X1", ("Z1", "Z2")), Factorization("X2", ("Z1", "Z3"))])


def q_predict(spark, d):
    m = _x1_model(spark, d)
    return W.rounded(predict(m, m.factorizations[0]), 6)


def q_predict_support(spark, d):
    m = CoupledModel(W.sparse_model_tensors(spark, d), [Factorization("D", ("U", "V"))],
                     missing="masked")
    return W.rounded(predict(m, m.factorizations[0], on="support"), 6)


def _absent_model(spark, d, p, missing):
    return CoupledModel(W.absent_rows_tensors(spark, d), [Factorization("D", ("U", "V"), p)], missing=missing)


def q_predict_absent_rows(spark, d):
    """The model on the cells of D, 0 where V lacks the key."""
    m = _absent_model(spark, d, 1.0, "masked")
    return W.rounded(predict(m, m.factorizations[0], on="support"), 6)


def q_divergence_absent_rows(spark, d):
    """Divergences as text: a stored cell that the model can't reach costs infinity for p >= 1."""
    rows = []
    for p in (0.0, 0.5, 1.0, 1.5):
        for missing in ("zero", "masked"):
            m = _absent_model(spark, d, p, missing)
            x = F.col("divergence")
            rows.append(factorization_divergence(m, m.factorizations[0]).select(
                F.lit(p).alias("p"), F.lit(missing).alias("missing"),
                F.when(F.abs(x) == float("inf"), F.lit("infinite")).otherwise(
                    F.round(x, 0).cast("decimal(38,0)").cast("string")).alias("divergence")))
    return reduce(DataFrame.unionByName, rows)


def q_q1(spark, d):
    m = _x1_model(spark, d)
    return W.rounded(numerator_q(m, m.factorizations[0]), 6)


def q_q2(spark, d):
    m = _x1_model(spark, d, p=0.5)
    return W.rounded(denominator_q(m, m.factorizations[0]), 6)


def q_delta(spark, d):
    m = _x1_model(spark, d)
    return W.rounded(delta(m, m.factorizations[0], "Z1", 1), 4)


def q_alpha(spark, d):
    return W.rounded(alpha(_x1_model(spark, d, phi=2.0), "Z1", 1), 4)


def q_factor_update(spark, d):
    m = _x1_model(spark, d)
    return W.rounded(factor_update(m, "Z1"), 6)


def _epoch_query(make, out: Callable, check: bool = True):
    def q(spark, d):
        m, keep = make(spark, d), W.has_checkpoint_dir(spark)
        return out(run_epoch(materialize_observed(m) if keep else m, checkpoint=keep, check=check))
    return q


def _xhat_of(name):
    def out(m):
        f = next(f for f in m.factorizations if f.observed == name)
        return W.rounded(predict(m, f), 4)
    return out


q_epoch_single = _epoch_query(_x1_model, _xhat_of("X1"))
# X1 may lack cells, so its objective is infinite; the updates are defined all the same.
q_epoch_p2 = _epoch_query(lambda s, d: _x1_model(s, d, p=2.0), _xhat_of("X1"), check=False)
q_epoch_coupled = _epoch_query(_coupled_model, _xhat_of("X2"))
q_epoch_sparse = _epoch_query(
    lambda s, d: CoupledModel(W.sparse_model_tensors(s, d), [Factorization("D", ("U", "V"))]),
    lambda m: W.rounded(m.tensors["V"], 6),
)
def _sparse_p0(s, d):
    return CoupledModel(W.sparse_model_tensors(s, d), [Factorization("D", ("U", "V"), 0.0)])


q_epoch_p0_sparse = _epoch_query(_sparse_p0, lambda m: W.rounded(m.tensors["V"], 6))


def q_fit_p0_history(spark, d):
    res = fit(_sparse_p0(spark, d), epochs=2, checkpoint=W.has_checkpoint_dir(spark))
    return res.history.select("epoch", "factorization", F.round("divergence", 2).alias("divergence"))


q_epoch_masked = _epoch_query(
    lambda s, d: CoupledModel(W.sparse_model_tensors(s, d), [Factorization("D", ("U", "V"))],
                              missing="masked"),
    lambda m: W.rounded(m.tensors["V"], 6),
)


def q_fit_history(spark, d):
    res = fit(_coupled_model(spark, d), epochs=2, checkpoint=W.has_checkpoint_dir(spark))
    return res.history.select("epoch", "factorization", F.round("divergence", 2).alias("divergence"))


def q_fit_resumed(spark, d):
    """One epoch, then another call that goes on from its log."""
    log = f"{_shared_folder(spark)}/fit-{uuid.uuid4().hex}"
    fit(_coupled_model(spark, d), epochs=1, log=log)
    res = fit(_coupled_model(spark, d), epochs=2, log=log)
    return res.history.select("epoch", "factorization", F.round("divergence", 2).alias("divergence"))


def _sparse_rank(rank, missing):
    return _epoch_query(
        lambda s, d: CoupledModel(W.sparse_model_tensors(s, d, rank), [Factorization("D", ("U", "V"))],
                                  missing=missing),
        lambda m: W.rounded(m.tensors["V"], 6))


q_epoch_sparse_rank20 = _sparse_rank(20, "zero")
q_epoch_masked_rank20 = _sparse_rank(20, "masked")


def q_factor_update_single(spark, d):
    m = CoupledModel(W.user_rows_tensors(spark, d), [Factorization("X1", ("Z1",))])
    return W.rounded(factor_update(m, "Z1"), 6)


def q_alpha_coupled(spark, d):
    m = CoupledModel(W.coupled_model_tensors(spark, d),
                     [Factorization("X1", ("Z1", "Z2"), 1.0, 2.0), Factorization("X2", ("Z1", "Z3"), 0.5, 0.5)])
    return W.rounded(alpha(m, "Z1", 1), 4)


def q_contract_outer(spark, d):
    """Nation quantities times brand prices: no shared index, no known size."""
    a = contract([W.A(spark, d)], ["n"])
    b = contract([W.B(spark, d)], ["brand"])
    return W.rounded(contract([a, b], ["n", "brand"]), 2)


def q_ew_combine(spark, d):
    return W.rounded(elementwise(T(W.X1(spark, d)).combine(T(W.Y1(spark, d)), F.greatest)), 4)


def q_read_tensor(spark, d):
    t = read_tensor(spark, f"{d}/events.parquet", ["user_id", "event_type"], value="value",
                    index_type={"user_id": "LONG", "event_type": "STRING"})
    return W.rounded(t, 6)


def q_write_tensor(spark, d):
    """The cells that come back from a written tensor: in the checkpoint folder,
    or in the warehouse where the session names none; executors share both."""
    x = W.X1(spark, d)
    shared = checkpoint_dir(spark) if W.has_checkpoint_dir(spark) else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared}/tensor-{uuid.uuid4().hex}"
    write_tensor(x, path)
    return W.rounded(read_tensor(spark, path, ["i", "j"], coalesce=False), 4)


def q_write_tensor_clustered(spark, d):
    """A range on the second index of a table clustered on both."""
    path = f"{_shared_folder(spark)}/tensor-{uuid.uuid4().hex}"
    write_tensor(W.A(spark, d), path, cluster=True)
    t = read_tensor(spark, path, ["n", "part"], coalesce=False, ranges={"part": (101, 900)},
                    index_type={"n": "INT", "part": "LONG"})
    return W.rounded(t, 4)


def q_contract_exact(spark, d):
    """Every sum the same in every bit, on any partitions."""
    return W.rounded(contract([W.A(spark, d), W.B(spark, d)], ["n", "brand"], exact=True), 4)


def _beta_zero_cells(spark, d):
    """X1 with every third cell stored as 0, against itself shifted by one j: (0, 0) cells occur."""
    z = F.when((F.col("i") + F.col("j")) % 3 == 0, 0.0).otherwise(F.col("value"))
    x = W.X1(spark, d)
    return x.with_df(x.df.select("i", "j", z.alias("value")))


def q_beta_div_zero_cells(spark, d):
    x = _beta_zero_cells(spark, d)
    rows = [beta_divergence(x, x.map_values(lambda v: v * 2), p, missing="masked").select(
        F.lit(p).alias("p"), F.round("divergence", 2).alias("divergence")) for p in (0.0, 0.5, 1.0, 1.5, 2.0)]
    return reduce(DataFrame.unionByName, rows)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: supplier-nation × brand sales value, a sparse contraction."""
    return q_contract_binary(spark, SF_SMOKE)


def _optional(name: str):
    """The module ``name`` if it is there; errors inside it are not swallowed."""
    try:
        found = importlib.util.find_spec(name)
    except ModuleNotFoundError:
        found = None
    return importlib.import_module(name) if found else None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
    if llm := _optional("tessera.llm.queries"):
        out |= llm.queries()
        if pipeline := _optional("corpus_pipeline"):
            out["pipeline"] = pipeline.run
    return out


# ---------------------------------------------------------------- oracle
def _sql_contract(inputs: list[str], out: list[str], digits: int, scale: str | None = None,
                  prelude=None) -> str:
    b = W.SqlBuilder()
    if prelude:
        prelude(b)
    names = [b.tensor(n) if n in W.SQL_TENSORS else n for n in inputs]
    c = b.contract(names, out, scale=scale)
    cols = "".join(f"{i}, " for i in out)
    return b.render(f"SELECT {cols}ROUND(value, {digits}) AS value FROM {c}")


def _sql_ew(expr: str, tensors: list[str], digits: int, how: str = "JOIN") -> str:
    """``expr`` refers to the operands as v0, v1, ... (all on one index set)."""
    b = W.SqlBuilder()
    for t in tensors:
        b.tensor(t)
    idx = b.indices[tensors[0]]
    if how == "JOIN":
        cols = ", ".join(f"t0.{i}" for i in idx)
        src = f"{tensors[0]} t0" + "".join(
            f" JOIN {t} t{n} ON " + " AND ".join(f"t{n}.{i} = t0.{i}" for i in idx)
            for n, t in enumerate(tensors) if n)
    else:
        cols = ", ".join(f"COALESCE(t0.{i}, t1.{i}) AS {i}" for i in idx)
        src = f"{tensors[0]} t0 FULL JOIN {tensors[1]} t1 ON " + " AND ".join(
            f"t1.{i} = t0.{i}" for i in idx)
    vals = {f"v{n}": f"t{n}.value" for n in range(len(tensors))}
    e = expr
    for k in sorted(vals, reverse=True):
        e = e.replace(k, vals[k])
    return b.render(f"SELECT {cols}, ROUND({e}, {digits}) AS value FROM {src}")


def _x1_z2_prelude(b: W.SqlBuilder):
    W.sql_model_x1(b)


def _sql_index_space_contract() -> str:
    b = W.SqlBuilder()
    W.sql_model_x1(b)
    b.tensor("X2")
    c = b.contract(["X1", "Z2"], ["i", "k"], scale="(SELECT MAX(r) FROM X2)")
    return b.render(f"SELECT i, k, ROUND(value, 4) AS value FROM {c}")


def _sql_range_restricted() -> str:
    b = W.SqlBuilder()
    W.sql_model_x1(b)
    b.add("X1r", ["i", "j"], "SELECT * FROM X1 WHERE j BETWEEN 1 AND 20")
    b.add("Z2r", ["k", "j"], "SELECT * FROM Z2 WHERE j BETWEEN 1 AND 20")
    c = b.contract(["X1r", "Z2r"], ["i", "k"])
    return b.render(f"SELECT i, k, ROUND(value, 4) AS value FROM {c}")


def _sql_broadcast_output() -> str:
    b = W.SqlBuilder()
    W.sql_model_x1(b)
    b.tensor("X2")
    c = b.contract(["X1", "Z2"], ["i", "k"])
    return b.render(
        f"SELECT c.i, c.k, CAST(g.x AS INTEGER) AS r, ROUND(c.value, 4) AS value FROM {c} c "
        f"CROSS JOIN generate_series(1, (SELECT MAX(r) FROM X2)) g(x)")


def _sql_beta(p: float) -> str:
    b = W.SqlBuilder()
    W.sql_model_x1(b)
    mu = b.contract(["Z1", "Z2"], ["i", "j"])
    cell = W.sql_beta("COALESCE(x.value, 0.0)", "COALESCE(m.value, 0.0)", p)
    return b.render(f"SELECT ROUND(SUM({cell}), 2) AS divergence FROM X1 x FULL JOIN {mu} m "
                    f"ON x.i = m.i AND x.j = m.j")


def _sql_beta_masked() -> str:
    b = W.SqlBuilder()
    m = W.sql_model_sparse(b)
    mu = b.contract([b.support(m["D"]), "U", "V"], ["i", "p"])
    cell = W.sql_beta("x.value", "m.value", 1.0)
    return b.render(f"SELECT ROUND(SUM({cell}), 2) AS divergence FROM D x JOIN {mu} m "
                    f"ON x.i = m.i AND x.p = m.p")


def _sql_model_query(make, factorizations, missing, epochs, final) -> str:
    b = W.SqlBuilder()
    m = make(b)
    latents = {a: m[a] for _, lat, _, _ in factorizations for a in lat}
    cards = {i: m.get(f"card_{i}") for i in ("i", "j", "r", "p")}
    model = W.SqlModel(b, factorizations, latents, cards, missing)
    return final(b, model, epochs)


def _sql_xhat_after(name, digits=4):
    def final(b, model, epochs):
        for _ in range(epochs):
            model.epoch()
        x, lat = next((x, lat) for x, lat, _, _ in model.fs if x == name)
        xh = model.xhat(x, lat, "full")
        cols = "".join(f"{i}, " for i in b.indices[xh])
        return b.render(f"SELECT {cols}ROUND(value, {digits}) AS value FROM {xh}")
    return final


def _sql_q1() -> str:
    b = W.SqlBuilder()
    W.sql_model_x1(b)
    xs = b.contract([b.support("X1"), "Z1", "Z2"], ["i", "j"])
    q = b.join2("X1", xs, lambda u, v: f"{u} * POWER({v}, -1.0)")
    return b.render(f"SELECT i, j, ROUND(value, 6) AS value FROM {q}")


def _sql_q2() -> str:
    b = W.SqlBuilder()
    W.sql_model_x1(b)
    xf = b.contract(["Z1", "Z2"], ["i", "j"])
    return b.render(f"SELECT i, j, ROUND(POWER(value, 0.5), 6) AS value FROM {xf}")


def _sql_delta(scale: str | None) -> str:
    b = W.SqlBuilder()
    W.sql_model_x1(b)
    xs = b.contract([b.support("X1"), "Z1", "Z2"], ["i", "j"])
    q = b.join2("X1", xs, lambda u, v: f"{u} * POWER({v}, -1.0)")
    dl = b.contract([q, "Z2"], ["i", "k"], scale=scale)
    return b.render(f"SELECT i, k, ROUND(value, 4) AS value FROM {dl}")


def _sql_factor_update() -> str:
    fs = [("X1", ["Z1", "Z2"], 1.0, 1.0)]

    def final(b, model, epochs):
        z = model.update("Z1")
        return b.render(f"SELECT i, k, ROUND(value, 6) AS value FROM {z}")
    return _sql_model_query(W.sql_model_x1, fs, "zero", 1, final)


def _sql_epoch_masked() -> str:
    fs = [("D", ["U", "V"], 1.0, 1.0)]

    def final(b, model, epochs):
        model.epoch()
        v = model.cur["V"]
        return b.render(f"SELECT k, p, ROUND(value, 6) AS value FROM {v}")
    return _sql_model_query(W.sql_model_sparse, fs, "masked", 1, final)


def _sql_divergence_absent_rows() -> str:
    rows = []
    for p in (0.0, 0.5, 1.0, 1.5):
        for missing in ("zero", "masked"):
            cell = W.sql_beta("coalesce(x, 0.0)", "mu", p)
            where = "WHERE x IS NOT NULL" if missing == "masked" else ""
            rows.append(f"SELECT CAST({p} AS DOUBLE) AS p, '{missing}' AS missing, SUM({cell}) AS s FROM M {where}")
    return (W.sql_absent_rows() + "SELECT p, missing, CASE WHEN isinf(s) THEN 'infinite' "
            "ELSE CAST(CAST(ROUND(s, 0) AS DECIMAL(38,0)) AS VARCHAR) END AS divergence FROM ("
            + " UNION ALL ".join(rows) + ")")


def _sql_epoch_p0() -> str:
    def final(b, model, epochs):
        model.epoch()
        return b.render(f"SELECT k, p, ROUND(value, 6) AS value FROM {model.cur['V']}")
    return _sql_model_query(W.sql_model_sparse, [("D", ["U", "V"], 0.0, 1.0)], "zero", 1, final)


def _sql_fit_p0() -> str:
    def final(b, model, epochs):
        rows = []
        for e in range(1, epochs + 1):
            model.epoch()
            rows.append(model.divergence_rows(e))
        return b.render(" UNION ALL ".join(rows))
    return _sql_model_query(W.sql_model_sparse, [("D", ["U", "V"], 0.0, 1.0)], "zero", 2, final)


def _sql_epoch_sparse() -> str:
    fs = [("D", ["U", "V"], 1.0, 1.0)]

    def final(b, model, epochs):
        model.epoch()
        v = model.cur["V"]
        return b.render(f"SELECT k, p, ROUND(value, 6) AS value FROM {v}")
    return _sql_model_query(W.sql_model_sparse, fs, "zero", 1, final)


def _sql_rank20(missing: str) -> str:
    def make(b):
        return W.sql_model_sparse(b, 20)

    def final(b, model, epochs):
        model.epoch()
        return b.render(f"SELECT k, p, ROUND(value, 6) AS value FROM {model.cur['V']}")
    return _sql_model_query(make, [("D", ["U", "V"], 1.0, 1.0)], missing, 1, final)


def _sql_factor_update_single() -> str:
    b = W.SqlBuilder()
    W.sql_model_x1(b)
    return b.render(
        "SELECT z.i AS i, z.k AS k, ROUND(z.value * COALESCE(n.num, 0) / (SELECT cj FROM card_x1), 6) AS value "
        "FROM Z1 z LEFT JOIN (SELECT x.i, SUM(x.value / h.v) AS num FROM X1 x "
        "JOIN (SELECT i, SUM(value) AS v FROM Z1 GROUP BY i) h ON h.i = x.i GROUP BY x.i) n ON n.i = z.i")


def _sql_alpha_coupled() -> str:
    b = W.SqlBuilder()
    W.sql_model_coupled(b)
    parts = []
    for x, other, p, phi in (("X1", "Z2", 1.0, 2.0), ("X2", "Z3", 0.5, 0.5)):
        xs = b.contract([b.support(x), "Z1", other], b.indices[x])
        q = b.join2(x, xs, lambda u, v, p=p: f"{u} * POWER({v}, {-p})")
        parts.append(b.contract([q, other], ["i", "k"], scale=f"{1.0 / phi}"))
    union = " UNION ALL ".join(f"SELECT i, k, value FROM {t}" for t in parts)
    return b.render(f"SELECT i, k, ROUND(SUM(value), 4) AS value FROM ({union}) GROUP BY i, k")


def _sql_random_tensor() -> str:
    return ("WITH c AS (" + W.SQL_TENSORS["X1"][1] + "), m AS (SELECT MAX(i) AS ci, MAX(j) AS cj FROM c) "
            "SELECT CAST(id % ci + 1 AS INTEGER) AS i, CAST(id // ci + 1 AS INTEGER) AS j, "
            "ROUND(CAST(('0x' || substr(md5('7:' || id), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE), 5) AS value "
            "FROM m, generate_series(0, (SELECT ci * cj - 1 FROM m)) g(id)")


def _sql_beta_zero_cells() -> str:
    cells = ("SELECT CASE WHEN (i + j) % 3 = 0 THEN 0.0 ELSE value END AS x FROM ("
             + W.SQL_TENSORS["X1"][1] + ")")
    return " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS p, ROUND(SUM({W.sql_beta('x', '(2 * x)', p)}), 2) AS divergence FROM ({cells})"
        for p in (0.0, 0.5, 1.0, 1.5, 2.0))


def _sql_fit_history() -> str:
    fs = [("X1", ["Z1", "Z2"], 1.0, 1.0), ("X2", ["Z1", "Z3"], 1.0, 1.0)]

    def final(b, model, epochs):
        rows = []
        for e in range(1, epochs + 1):
            model.epoch()
            rows.append(model.divergence_rows(e))
        return b.render(" UNION ALL ".join(rows))
    return _sql_model_query(W.sql_model_coupled, fs, "zero", 2, final)


def oracle_sql() -> dict[str, str]:
    llm = _optional("tessera.llm.queries")
    return _tensor_sql() | (llm.oracle_sql() if llm else {})


def _tensor_sql() -> dict[str, str]:
    ew = _sql_ew
    return {
        "tensor_from_table": W.SQL_TENSORS["X1"][1],
        "contract_binary": _sql_contract(["A", "B"], ["n", "brand"], 4),
        "contract_three_way": _sql_contract(["A", "B", "R"], ["region", "brand"], 4),
        "contract_reduced": (
            "WITH A AS (" + W.SQL_TENSORS["A"][1] + "), B AS (" + W.SQL_TENSORS["B"][1] + "), R AS ("
            + W.SQL_TENSORS["R"][1] + ") SELECT R.region, B.brand, ROUND(SUM(A.value * B.value * R.value), 4) AS value "
            "FROM A JOIN B ON A.part = B.part JOIN R ON A.n = R.n "
            "WHERE B.brand LIKE '%1' AND R.region = 1 GROUP BY 1, 2"),
        "contract_hot_keys": _sql_contract(["A", "R"], ["region", "part"], 4),
        "contract_triangle": (
            W.SQL_TRIANGLE + "SELECT sp.s AS s, ROUND(SUM(sp.value * pc.value * sc.value), 2) AS value FROM sp "
            "JOIN pc ON sp.p = pc.p JOIN sc ON sp.s = sc.s AND pc.c = sc.c GROUP BY 1"),
        "contract_any_order": _sql_contract(["A", "B", "R"], ["region", "brand"], 4),
        "contract_to_scalar": _sql_contract(["A", "B"], [], 2),
        "contract_self": (
            "WITH X1 AS (" + W.SQL_TENSORS["X1"][1] + ") SELECT a.i AS i, b.i AS i2, "
            "ROUND(SUM(a.value * b.value), 4) AS value FROM X1 a JOIN X1 b ON a.j = b.j GROUP BY 1, 2"
        ),
        "contract_index_space": _sql_index_space_contract(),
        "contract_range_restricted": _sql_range_restricted(),
        "contract_broadcast_output": _sql_broadcast_output(),
        "contract_full_space": _sql_contract(["X1", "Z2"], ["i", "k"], 4, prelude=_x1_z2_prelude),
        "contract_salted": _sql_contract(["A", "B"], ["n", "brand"], 4),
        "ew_mul": ew("v0 * v1", ["X1", "Y1"], 4),
        "ew_add": ew("v0 + v1", ["X1", "Y1"], 4),
        "ew_sub": ew("v0 - v1", ["X1", "Y1"], 4),
        "ew_div": ew("v0 / NULLIF(v1, 0)", ["X1", "Y1"], 4),
        "ew_scalar_left": ew("3.0 * v0", ["X1"], 4),
        "ew_scalar_right": ew("v0 * 2.0", ["X1"], 4),
        "ew_scalar_both": ew("(3.0 * 4.0) * v0", ["X1"], 4),
        "ew_pow": ew("POWER(v0, 0.5) * POWER(2.0, 2.0) * POWER(v1, -1.0)", ["X1", "Y1"], 6),
        "ew_log": ew("CASE WHEN v0 > 0 THEN LN(v0) END", ["X1"], 6),
        "ew_unary": ew("POWER(v0, -1.0)", ["X1"], 8),
        "ew_nested": ew("v0 * (LN(3.0) * v0)", ["X1"], 4),
        "ew_nary": ew("v0 * v1 - v2 + 3.0", ["X1", "Y1", "W1"], 4),
        "ew_outer_fill": ew("COALESCE(v0, 0.0) + COALESCE(v1, 0.0)", ["AR", "AN"], 4, how="FULL"),
        "index_space": (
            "WITH c AS (" + W.SQL_TENSORS["X1"][1] + ") SELECT CAST(a.x AS INTEGER) AS i, "
            "CAST(b.x AS INTEGER) AS j, CAST(k.x AS INTEGER) AS k "
            "FROM generate_series(1, (SELECT MAX(i) FROM c)) a(x) "
            "CROSS JOIN generate_series(1, (SELECT MAX(j) FROM c)) b(x) "
            f"CROSS JOIN generate_series(1, {W.RANK}) k(x)"
        ),
        "delinearize": (
            "SELECT event_id, CAST(event_id % 10 + 1 AS INTEGER) AS a, "
            "CAST((event_id // 10) % 20 + 1 AS INTEGER) AS b, "
            "CAST((event_id // 200) % 1000 + 1 AS INTEGER) AS c FROM events"
        ),
        "validate_counts": (
            "WITH E AS (" + W.SQL_TENSORS["E"][1] + ") SELECT COUNT(*) AS cells, "
            "COUNT(*) FILTER (WHERE value - 1 <= 0) AS nulls, "
            "CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infs FROM E"
        ),
        "density": (
            "WITH D AS (" + W.SQL_TENSORS["D"][1] + ") SELECT COUNT(*) AS cells, "
            "MAX(i) * MAX(p) AS numel, ROUND(COUNT(*) / (MAX(i) * MAX(p)), 8) AS density FROM D"
        ),
        "beta_div_p0": _sql_beta(0.0),
        "beta_div_p1": _sql_beta(1.0),
        "beta_div_p2": _sql_beta(2.0),
        "beta_div_p05": _sql_beta(0.5),
        "beta_div_masked": _sql_beta_masked(),
        "predict": _sql_contract(["Z1", "Z2"], ["i", "j"], 6, prelude=_x1_z2_prelude),
        "predict_support": (lambda b: (
            W.sql_model_sparse(b),
            b.render("SELECT i, p, ROUND(value, 6) AS value FROM "
                     + b.contract([b.support("D"), "U", "V"], ["i", "p"])))[1])(W.SqlBuilder()),
        "predict_absent_rows": W.sql_absent_rows() + "SELECT i, p, ROUND(mu, 6) AS value FROM M WHERE x IS NOT NULL",
        "divergence_absent_rows": _sql_divergence_absent_rows(),
        "q1": _sql_q1(),
        "q2": _sql_q2(),
        "delta": _sql_delta(None),
        "alpha": _sql_delta("0.5"),
        "factor_update": _sql_factor_update(),
        "factor_update_single": _sql_factor_update_single(),
        "epoch_sparse_rank20": _sql_rank20("zero"),
        "epoch_masked_rank20": _sql_rank20("masked"),
        "alpha_coupled": _sql_alpha_coupled(),
        "random_tensor": _sql_random_tensor(),
        "beta_div_zero_cells": _sql_beta_zero_cells(),
        "contract_outer": (
            "WITH A AS (" + W.SQL_TENSORS["A"][1] + "), B AS (" + W.SQL_TENSORS["B"][1] + "), "
            "a1 AS (SELECT n, SUM(value) AS v FROM A GROUP BY n), b1 AS (SELECT brand, SUM(value) AS v FROM B GROUP BY brand) "
            "SELECT n, brand, ROUND(a1.v * b1.v, 2) AS value FROM a1 CROSS JOIN b1"),
        "ew_combine": ew("GREATEST(v0, v1)", ["X1", "Y1"], 4),
        "read_tensor": ("SELECT user_id, event_type, ROUND(SUM(value), 6) AS value FROM events "
                        "WHERE user_id IS NOT NULL GROUP BY 1, 2"),
        "write_tensor": "SELECT i, j, ROUND(value, 4) AS value FROM (" + W.SQL_TENSORS["X1"][1] + ")",
        "write_tensor_clustered": ("SELECT n, part, ROUND(value, 4) AS value FROM (" + W.SQL_TENSORS["A"][1]
                                   + ") WHERE part BETWEEN 101 AND 900"),
        "contract_exact": _sql_contract(["A", "B"], ["n", "brand"], 4),
        "epoch_single": _sql_model_query(W.sql_model_x1, [("X1", ["Z1", "Z2"], 1.0, 1.0)], "zero", 1,
                                         _sql_xhat_after("X1")),
        "epoch_p2": _sql_model_query(W.sql_model_x1, [("X1", ["Z1", "Z2"], 2.0, 1.0)], "zero", 1,
                                     _sql_xhat_after("X1")),
        "epoch_coupled": _sql_model_query(
            W.sql_model_coupled, [("X1", ["Z1", "Z2"], 1.0, 1.0), ("X2", ["Z1", "Z3"], 1.0, 1.0)],
            "zero", 1, _sql_xhat_after("X2")),
        "epoch_masked": _sql_epoch_masked(),
        "epoch_p0_sparse": _sql_epoch_p0(),
        "fit_p0_history": _sql_fit_p0(),
        "epoch_sparse": _sql_epoch_sparse(),
        "fit_history": _sql_fit_history(),
        "fit_resumed": _sql_fit_history(),
    }
