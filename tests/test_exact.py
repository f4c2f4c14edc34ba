"""Sums that agree in every bit, whatever the order of their terms."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import from_rows, to_dict
from tessera import coalesce_cells, contract, from_table
from tessera.functions import exact_sum

EDGES = [5e-324, -5e-324, 2.0**-1022, 1e308, -1e308, 1.7976931348623157e308, 2.0**-32, -(2.0**32), 2.0**64, 1 - 2.0**-53,
         2.0**32 - 2.0**-21, 0.1, -0.1, 1e16, 1.0, -1e16, 3.0, 0.0, -0.0]


def _sum(spark, xs):
    return exact_sum(spark.createDataFrame([(x,) for x in xs], "v DOUBLE"), [], "v").first()["v"]




def test_single_values_come_back_in_every_bit(spark):
    rng = random.Random(1)
    xs = EDGES + [math.ldexp(rng.uniform(-1, 1), e) for e in range(-1074, 1025, 3)]
    xs += [math.ldexp(1.0, e) for e in range(-1074, 1024)]
    df = spark.createDataFrame(list(enumerate(xs)), "k INT, v DOUBLE")
    got = {r["k"]: r["v"] for r in exact_sum(df, ["k"], "v").collect()}
    assert [got[k] for k in range(len(xs))] == xs


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e300, 1e300), st.sampled_from(EDGES[:3] + EDGES[6:])), min_size=1, max_size=60))
def test_equals_fsum(spark, xs):
    assert _sum(spark, xs) == math.fsum(xs)


def test_same_bits_on_any_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randrange(-60, 60))) for _ in range(6000)]
    want = {k: math.fsum(v for q, v in rows if q == k) for k in range(3)}
    df = spark.createDataFrame(rows, "a INT, q DOUBLE")
    for order in (df.repartition(1), df.repartition(7), df.orderBy("q").repartition(40, "q")):
        assert {r["a"]: r["q"] for r in exact_sum(order, ["a"], "q").collect()} == want
        assert to_dict(from_table(order, {"i": "a"}, "q", exact=True)) == {(k,): v for k, v in want.items()}


def test_odd_terms(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("null", None), ("some", None), ("some", 1.5), ("zero", 0.0), ("zero", -0.0), ("inf", inf), ("inf", 2.0),
            ("minf", -inf), ("both", inf), ("both", -inf), ("nan", nan), ("nan", 1.0), ("over", 1.7e308), ("over", 1.7e308),
            ("back", 1.7e308), ("back", 1.7e308), ("back", -1.7e308), (None, 0.5), (None, 0.25)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r["k"]: r["v"] for r in exact_sum(df, ["k"], "v").collect()}
    assert math.isnan(got.pop("nan")) and math.isnan(got.pop("both"))
    assert got == {"null": None, "some": 1.5, "zero": 0.0, "inf": inf, "minf": -inf, "over": inf, "back": 1.7e308, None: 0.75}
    empty = df.where("false")
    assert exact_sum(empty, ["k"], "v").count() == 0
    assert exact_sum(empty, [], "v").first()["v"] is None


def test_contract_exact(spark):
    rng = random.Random(3)
    a = {(i, k): rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 12) for i in range(1, 4) for k in range(1, 60)}
    b = {(k,): rng.uniform(-1, 1) for k in range(1, 60)}
    ta = from_rows(spark, ["i", "k"], [(*c, v) for c, v in a.items()])
    tb = from_rows(spark, ["k"], [(*c, v) for c, v in b.items()])
    want = {(i,): math.fsum(a[i, k] * b[k,] for k in range(1, 60)) for i in range(1, 4)}
    for n in (1, 5):
        parted = ta.with_df(ta.df.repartition(n))
        assert to_dict(contract([parted, tb], ["i"], exact=True)) == want
    total = contract([ta], [], exact=True)
    assert to_dict(total) == {(): math.fsum(a.values())}
    assert to_dict(contract([ta.with_df(ta.df.where("false"))], [], exact=True)) == {(): 0.0}
    assert to_dict(coalesce_cells(from_rows(spark, ["i"], [(1, 1e16), (1, 1.0), (1, -1e16)]), exact=True)) == {(1,): 1.0}
    with pytest.raises(ValueError):
        contract([ta, tb], ["i"], exact=True, reduce=False)


def test_partial_sums_come_before_the_shuffle(spark):
    plan = exact_sum(spark.range(10).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v")), ["k"], "v")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text and "Window" not in text
