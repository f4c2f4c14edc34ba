"""Index spaces, linear positions and generated tensors.

Nothing here materializes a file or passes through the driver: an index
space is ``spark.range`` over the linear positions, de-linearized with
integer column arithmetic, so each task produces its own slice of cells.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import VALUE, Tensor

# Random values are drawn from the low 53 bits of a 64-bit hash of (seed, position).


def delinearize(
    lin: str, indices: Sequence[str], cards: Mapping[str, int], base: int = 1
) -> list[Column]:
    """Coordinates of a linear position, first index fastest (column-major).

    ``coord_n = (lin div stride_n) % card_n + base`` with
    ``stride_n = Π_{m<n} card_m``; ``base=1`` gives 1-based coordinates.
    ``lin`` names a non-negative integral column; ``div`` is exact integer
    division on longs.
    """
    out, stride = [], 1
    for name in indices:
        card = cards[name]
        quotient = F.expr(f"CAST(`{lin}` AS BIGINT) div {stride}")
        out.append((F.pmod(quotient, F.lit(card)) + F.lit(base)).cast("int").alias(name))
        stride *= card
    return out


def _space(
    spark: SparkSession,
    indices: Sequence[str],
    cards: Mapping[str, int],
    num_partitions: int | None,
) -> DataFrame:
    total = math.prod(cards[i] for i in indices)
    return spark.range(0, total, 1, num_partitions)


def index_space(
    spark: SparkSession,
    cards: Mapping[str, int],
    indices: Sequence[str] | None = None,
    num_partitions: int | None = None,
    base: int = 1,
) -> DataFrame:
    """Every coordinate of the given cardinalities, one row per cell."""
    indices = list(indices or cards)
    return _space(spark, indices, cards, num_partitions).select(
        *delinearize("id", indices, cards, base)
    )


def random_tensor(
    spark: SparkSession,
    indices: Sequence[str],
    cards: Mapping[str, int],
    seed: int = 0,
    num_partitions: int | None = None,
    base: int = 1,
) -> Tensor:
    """A dense tensor with uniform [0, 1) values rounded to 5 decimals.

    Each value is the first 13 hexadecimal digits of the MD5 of
    ``seed:linear position``, so the result does not depend on how the range
    is partitioned (``F.rand`` would), and any engine can compute it.
    """
    indices = list(indices)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    unit = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16 ** 13))
    df = _space(spark, indices, cards, num_partitions).select(
        *delinearize("id", indices, cards, base), F.round(unit, 5).alias(VALUE)
    )
    return Tensor(df, tuple(indices), {i: cards[i] for i in indices} if base == 1 else {})


def formula_tensor(
    spark: SparkSession,
    indices: Sequence[str],
    cards: Mapping[str, int],
    fn,
    num_partitions: int | None = None,
) -> Tensor:
    """A dense tensor whose value is ``fn(*index Columns)`` at each cell."""
    indices = list(indices)
    coords = delinearize("id", indices, cards)
    base = _space(spark, indices, cards, num_partitions).select(*coords)
    df = base.select(*indices, fn(*[F.col(i) for i in indices]).cast("double").alias(VALUE))
    return Tensor(df, tuple(indices), {i: cards[i] for i in indices})


def cardinalities(t: Tensor) -> dict[str, int]:
    """Cardinalities inferred as the largest stored coordinate of each index.

    One aggregate job returning one row; only for integer 1-based indices.
    """
    row = t.df.agg(*[F.max(i).alias(i) for i in t.indices]).first()
    return {i: int(row[i] or 0) for i in t.indices}


def density(t: Tensor, numel: int | None = None) -> DataFrame:
    """Stored cells over the size of the index space, as a one-row DataFrame."""
    numel = numel if numel is not None else t.numel()
    if numel is None:
        raise ValueError("density needs cardinalities for every index or an explicit numel")
    return t.df.agg(
        F.count(F.lit(1)).alias("cells"),
        F.lit(numel).cast("long").alias("numel"),
        (F.count(F.lit(1)) / F.lit(float(numel))).alias("density"),
    )
