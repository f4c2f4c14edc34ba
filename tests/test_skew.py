"""Hot keys: salted plans give the same result as plain ones."""

import pytest

from helpers import to_dict
from tessera import CoupledModel, Factorization, Tensor, contract, factor_update, fit
from tessera.operators.sampled import sampled_contract


def hot_tensor(spark, n=3000, hot_share=3):
    # j = 1 holds a third of all cells
    rows = [(i, 1 if i % hot_share == 0 else (i % 17) + 2, float(i % 7 + 1)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "i INT, j INT, value DOUBLE")
    return Tensor(df, ("i", "j"))  # no cardinalities: no proven bound


def factor(spark, own, card, rank=3, bounded=True):
    rows = [(a, k, ((a * 7 + k * 3) % 11 + 1) / 11.0) for a in range(1, card + 1) for k in range(1, rank + 1)]
    df = spark.createDataFrame(rows, f"{own} INT, k INT, value DOUBLE")
    cards = {own: card, "k": rank} if bounded else {"k": rank}
    return Tensor(df, (own, "k"), cards)


def plan_of(t):
    return t.df._jdf.queryExecution().executedPlan().toString()


def test_salted_contraction_equals_plain(spark):
    x = hot_tensor(spark)
    z = Tensor(factor(spark, "j", 19, bounded=False).df, ("j", "k"))
    plain = to_dict(contract([x, z], ["i", "k"]))
    salted_t = contract([x, z], ["i", "k"], salt=6)
    assert "__salt" in plan_of(salted_t) or "__salt" in str(salted_t.df._jdf.queryExecution().analyzed())
    salted = to_dict(salted_t)
    assert plain.keys() == salted.keys()
    assert all(plain[k] == pytest.approx(salted[k], rel=1e-12) for k in plain)


def test_salted_copies_are_not_broadcast(spark, tmp_path):
    # A file small enough for Spark to broadcast; its copies would go through the driver.
    factor(spark, "j", 19, bounded=False).df.write.parquet(f"{tmp_path}/z")
    z = Tensor(spark.read.parquet(f"{tmp_path}/z"), ("j", "k"))
    x = hot_tensor(spark)
    assert "BroadcastHashJoin" in plan_of(contract([x, z], ["i", "k"]))
    for t in (contract([x, z], ["i", "k"], salt=6), contract([x, z], ["i", "k"], skew=0.2)):
        assert "__salt" in plan_of(t)
        assert not [x for x in plan_of(t).splitlines() if "BroadcastHashJoin" in x and "__salt" in x]
    y = Tensor(spark.range(1, 3001).selectExpr("CAST(id AS INT) AS i", "1 AS k", "2.0D AS value"), ("i", "k"), {"k": 3})
    plan = plan_of(sampled_contract(x, [y, z.with_cards({"k": 3})], salt=5))
    assert "__salt" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("salt", [None, 5])
def test_sampled_with_unbounded_factors(spark, salt):
    x = hot_tensor(spark)
    zi = factor(spark, "i", 3000, bounded=False)
    zj = factor(spark, "j", 19, bounded=False)
    want = to_dict(contract([zi, zj], ["i", "j"]))
    got = to_dict(sampled_contract(x, [zi, zj], salt=salt))
    xs = to_dict(x)
    assert got.keys() == xs.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
    if salt:
        assert "__salt" in str(sampled_contract(x, [zi, zj], salt=salt).df._jdf.queryExecution().analyzed())


def skewed_model(spark, salt=None):
    x = hot_tensor(spark, n=300).with_cards({"i": 300, "j": 19})
    tensors = {"X": x, "U": factor(spark, "i", 300), "V": factor(spark, "j", 19)}
    return CoupledModel(tensors, [Factorization("X", ("U", "V"))], missing="masked", salt=salt)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_update_exchanges_partial_sums_after_a_shuffled_join(spark, no_broadcast):
    plan = plan_of(factor_update(skewed_model(spark), "V"))
    above = plan[:plan.index("Union")]  # the joins are below the union
    assert "SortMergeJoin" not in above and "SortMergeJoin" in plan
    assert "Exchange hashpartitioning" in above and "partial_sum" in above


def test_update_with_broadcast_keeps_flat_keys(spark):
    assert "__cell" not in plan_of(factor_update(skewed_model(spark), "V"))


def test_salted_fit_of_a_hot_key(spark, no_broadcast):
    plain, salted = (fit(skewed_model(spark, salt), epochs=1) for salt in (None, 4))
    assert salted.objective == pytest.approx(plain.objective, rel=1e-9)
    for z in ("U", "V"):
        want, got = to_dict(plain.model.tensors[z]), to_dict(salted.model.tensors[z])
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
