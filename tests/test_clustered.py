"""Tables in which a range on any index reads little more than its cells."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import from_rows, to_dict
from tessera import Tensor, read_tensor, write_tensor


def _rows_read(df) -> tuple[int, int]:
    """Rows that the scans of a plan gave on, and rows of its result."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(n).metrics().apply("numOutputRows").value() for n in range(leaves.size())), len(rows)


def _tensor(spark, n=400):
    df = spark.range(n * n).select((F.col("id") % n + 1).cast("int").alias("i"), (F.floor(F.col("id") / n) + 1).cast("int").alias("j"),
                                   F.rand(1).alias("value"))
    return Tensor(df, ("i", "j"))


@pytest.mark.parametrize("index", ["i", "j"])
def test_a_range_on_any_index_skips_most_rows(spark, tmp_path, index):
    t = _tensor(spark)
    path = str(tmp_path / "z")
    write_tensor(t, path, cluster=True, files=64)
    back = read_tensor(spark, path, ["i", "j"], coalesce=False, ranges={index: (101, 110)})
    read, found = _rows_read(back.df)
    assert found == 10 * 400
    assert read <= 0.375 * 160_000  # about an 8 x 8 grid of files, its edges sampled: at most three of eight strips
    plain = str(tmp_path / "plain")
    write_tensor(Tensor(t.df.orderBy("i", "j"), t.indices), plain)
    other = read_tensor(spark, plain, ["i", "j"], coalesce=False, ranges={"j": (101, 110)})
    assert _rows_read(other.df)[0] > read


def test_a_hot_coordinate_is_split(spark, tmp_path):
    """Half of all cells have i = 7: no file holds more than a few shares of the rows."""
    hot = spark.range(20_000).select(F.lit(7).alias("i"), (F.col("id") + 1).cast("int").alias("j"), F.lit(1.0).alias("value"))
    rest = spark.range(20_000).select((F.col("id") % 200 + 8).cast("int").alias("i"), (F.floor(F.col("id") / 200) + 1).cast("int").alias("j"),
                                      F.lit(2.0).alias("value"))
    path = str(tmp_path / "hot")
    write_tensor(Tensor(hot.unionByName(rest), ("i", "j")), path, cluster=True, files=16)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 3 * 40_000 / 16


def test_rows_survive_for_every_kind_of_index(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"Brand#{rng.randrange(50):02d}", date(2020, 1, 1 + k % 28), k / 7 - 3, k % 2 == 0, float(k)) for k in range(300)]
    rows += [(None, None, None, None, 1.0), ("", date(1970, 1, 1), float("nan"), True, 2.0), ("é", None, float("inf"), False, None)]
    df = spark.createDataFrame(rows, "s STRING, d DATE, x DOUBLE, b BOOLEAN, value DOUBLE")
    path = str(tmp_path / "k")
    write_tensor(Tensor(df, ("s", "d", "x", "b")), path, cluster=True)
    assert sorted(map(repr, spark.read.parquet(path).collect())) == sorted(map(repr, df.collect()))
    back = read_tensor(spark, path, ["s", "d"], index_type={"s": "STRING", "d": "DATE"}, coalesce=False,
                       ranges={"s": ("Brand#10", "Brand#19"), "d": (date(2020, 1, 5), None)})
    want = [r for r in rows if r[0] and "Brand#10" <= r[0] <= "Brand#19" and r[1] and r[1] >= date(2020, 1, 5)]
    assert back.df.count() == len(want) > 0


def test_empty_single_and_wrong(spark, tmp_path):
    empty = from_rows(spark, ["i", "j"], [])
    write_tensor(empty, str(tmp_path / "e"), cluster=True)
    assert to_dict(read_tensor(spark, str(tmp_path / "e"), ["i", "j"])) == {}
    one = from_rows(spark, ["i"], [(3, 1.0), (3, 2.0)], {"i": 5})
    write_tensor(one, str(tmp_path / "o"), cluster=True, files=2)
    assert to_dict(read_tensor(spark, str(tmp_path / "o"), ["i"], ranges={"i": (None, 3)})) == {(3,): 3.0}
    with pytest.raises(ValueError):
        write_tensor(one, str(tmp_path / "c"), fmt="csv", cluster=True)
    with pytest.raises(ValueError):
        read_tensor(spark, str(tmp_path / "o"), ["i"], ranges={"k": (1, 2)})
    with pytest.raises(ValueError):
        write_tensor(Tensor(spark.sql("SELECT array(1) AS i, 1.0D AS value"), ("i",)), str(tmp_path / "a"), cluster=True)
