"""Tensor ingestion, files, index spaces and generators."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import from_rows, to_dict
from tessera import (
    Tensor,
    cardinalities,
    coalesce_cells,
    delinearize,
    density,
    from_table,
    index_space,
    random_tensor,
    read_tensor,
    write_tensor,
)


def test_from_table_sums_duplicates_and_drops_nulls(spark):
    df = spark.createDataFrame(
        [(1, 1, 2.0), (1, 1, 3.0), (2, 1, 1.0), (None, 1, 9.0), (2, 2, None)],
        "a INT, b INT, q DOUBLE")
    t = from_table(df, {"i": "a", "j": F.col("b")}, "q")
    assert to_dict(t) == {(1, 1): 5.0, (2, 1): 1.0}


def test_from_table_cards_restrict(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (3, 4.0)], "a INT, q DOUBLE")
    t = from_table(df, {"i": "a"}, "q", cards={"i": 2})
    assert to_dict(t) == {(1,): 2.0}
    assert t.numel() == 2


def test_coalesce_cells(spark):
    t = from_rows(spark, ["i"], [(1, 1.0), (1, 2.0)])
    assert to_dict(coalesce_cells(t)) == {(1,): 3.0}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_read_roundtrip(spark, tmp_path, fmt):
    t = from_rows(spark, ["i", "k"], [(1, 1, 0.5), (2, 3, 1.25), (2, 4, -3.0)])
    path = str(tmp_path / f"t.{fmt}")
    write_tensor(t, path, fmt=fmt)
    back = read_tensor(spark, path, ["i", "k"], fmt=fmt)
    assert to_dict(back) == to_dict(t)
    restricted = read_tensor(spark, path, ["i", "k"], fmt=fmt, cards={"k": 3})
    assert to_dict(restricted) == {(1, 1): 0.5, (2, 3): 1.25}


def test_csv_header_order(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("i,k,value\n1,2,3.5\n2,1,4.0\n")
    t = read_tensor(spark, str(p), ["i", "k"], fmt="csv")
    assert to_dict(t) == {(1, 2): 3.5, (2, 1): 4.0}


def test_index_space_first_index_fastest(spark):
    cards = {"i": 2, "j": 3, "k": 4}
    rows = index_space(spark, cards).collect()
    assert len(rows) == 24
    assert len({tuple(r) for r in rows}) == 24
    lin = spark.range(24).select("id", *delinearize("id", ["i", "j", "k"], cards)).collect()
    for r in lin:
        n = r["id"]
        assert (r["i"], r["j"], r["k"]) == (n % 2 + 1, (n // 2) % 3 + 1, (n // 6) % 4 + 1)


def test_delinearize_zero_based(spark):
    r = spark.range(7, 8).select(*delinearize("id", ["a", "b"], {"a": 3, "b": 5}, base=0)).first()
    assert (r["a"], r["b"]) == (1, 2)


def test_random_tensor_independent_of_partitioning(spark):
    cards = {"i": 5, "j": 7}
    a = to_dict(random_tensor(spark, ["i", "j"], cards, seed=3, num_partitions=1))
    b = to_dict(random_tensor(spark, ["i", "j"], cards, seed=3, num_partitions=6))
    c = to_dict(random_tensor(spark, ["i", "j"], cards, seed=4))
    assert a == b and len(a) == 35
    assert a != c
    assert all(0.0 <= v <= 1.0 and round(v, 5) == v for v in a.values())


def test_cardinalities_and_density(spark):
    t = from_rows(spark, ["i", "j"], [(1, 1, 1.0), (3, 2, 1.0), (2, 2, 1.0)])
    assert cardinalities(t) == {"i": 3, "j": 2}
    r = density(t, 6).first()
    assert (r["cells"], r["numel"]) == (3, 6) and math.isclose(r["density"], 0.5)
    with pytest.raises(ValueError):
        density(t)
    t2 = Tensor(t.df, t.indices, {"i": 3, "j": 2})
    assert density(t2).first()["numel"] == 6


def test_rename_and_validation(spark):
    t = from_rows(spark, ["i", "j"], [(1, 2, 1.0)], {"i": 4})
    r = t.rename({"i": "a"})
    assert r.indices == ("a", "j") and r.cards == {"a": 4}
    with pytest.raises(ValueError):
        Tensor(t.df, ("i", "i"))
    with pytest.raises(ValueError):
        Tensor(t.df, ("i", "zz"))


def test_repartition_and_persist(spark):
    t = from_rows(spark, ["i", "j"], [(1, 1, 1.0), (2, 1, 2.0), (3, 2, 3.0)], {"i": 3})
    r = t.repartition(4)
    assert r.df.rdd.getNumPartitions() == 4 and r.cards == {"i": 3}
    assert "hashpartitioning(i" in r.df._jdf.queryExecution().executedPlan().toString()
    p = t.persist()
    assert p.df.is_cached and to_dict(p) == to_dict(t)
    assert not p.unpersist().df.is_cached
