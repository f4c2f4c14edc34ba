"""Golden values of the original contraction and element-wise tests."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import input1, input2, to_dict
from tessera import S, T, contract, contract_full_space, elementwise

GOLDEN = {(1, 1): 11800.0, (1, 2): 13400.0, (1, 3): 15000.0,
          (2, 1): 14000.0, (2, 2): 16000.0, (2, 3): 18000.0}


def test_contraction_golden(spark):
    out = contract([input1(spark), input2(spark)], ["i", "j"])
    assert to_dict(out) == GOLDEN


def test_contraction_full_space_golden(spark):
    out = contract_full_space([input1(spark), input2(spark)], ["i", "j"], {"i": 2, "j": 3, "k": 4})
    assert to_dict(out) == GOLDEN


def test_unused_index_in_space_multiplies(spark):
    out = contract([input1(spark), input2(spark)], ["i", "j"],
                   index_space={"i": 2, "j": 3, "k": 4, "r": 5})
    assert to_dict(out) == {k: 5 * v for k, v in GOLDEN.items()}
    naive = contract_full_space([input1(spark), input2(spark)], ["i", "j"],
                                {"i": 2, "j": 3, "k": 4, "r": 5})
    assert to_dict(naive) == to_dict(out)


def test_absent_output_index_broadcast(spark):
    out = contract([input1(spark), input2(spark)], ["i", "j", "r"], index_space={"r": 3})
    d = to_dict(out)
    assert len(d) == 18
    assert all(d[(i, j, r)] == GOLDEN[(i, j)] for (i, j, r) in d)
    with pytest.raises(ValueError):
        contract([input1(spark), input2(spark)], ["i", "j", "r"])


def v_of(i, k):
    return 10.0 * (2 * (k - 1) + i)


@pytest.mark.parametrize("case, build, expect", [
    (1, lambda x: T(x) * T(x), lambda v: v * v),
    (2, lambda x: T(x) * 2, lambda v: 2 * v),
    (3, lambda x: 3 * T(x), lambda v: 3 * v),
    (5, lambda x: T(x).pow(-1) * T(x), lambda v: 1.0),
    (6, lambda x: T(x) * T(x).pow(-1), lambda v: 1.0),
    (7, lambda x: T(x).pow(-1) * T(x).pow(-1), lambda v: 1 / (v * v)),
    (8, lambda x: T(x) * S(2).pow(2), lambda v: 4 * v),
    (9, lambda x: T(x) * (S(F.log(F.lit(3.0))) * T(x)), lambda v: v * math.log(3) * v),
])
def test_elementwise_cases(spark, case, build, expect):
    x = input1(spark)
    got = to_dict(elementwise(build(x)))
    assert len(got) == 8
    for (i, k), val in got.items():
        assert val == pytest.approx(expect(v_of(i, k)), rel=1e-9), case
    if case == 9:
        assert {int(v) for v in got.values()} == {int(expect(v_of(i, k))) for (i, k) in got}


def test_scalar_scalar_stays_column(spark):
    c = elementwise(S(3) * 4)
    assert spark.range(1).select(c.alias("v")).first()["v"] == 12.0


def test_repeated_updates_keep_plans_short(spark):
    # the original soak test repeated v^-1 ∘ v; here each step feeds the next
    # and is checkpointed, so the plan never grows
    x = input1(spark)
    t = x
    for _ in range(12):
        t = elementwise(T(t).pow(-1) * T(x) * T(t)).checkpoint()
    plan = t.df._jdf.queryExecution().analyzed().toString()
    assert len(plan.splitlines()) <= 3
    assert to_dict(t) == to_dict(x)
