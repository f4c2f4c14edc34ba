"""Sums of doubles that don't depend on the order of their terms.

A finite double is a whole number of some power of two.  It is cut into parts
at fixed exponents, multiples of ``BIN`` bits, and every part is a small
integer, so the sums per (key, exponent) are integer sums: exact, and the same
however Spark splits, merges or reruns them.  Only the last step, from the few
integers of a key to one double, rounds, and it rounds once, to the nearest
double, as ``math.fsum`` does.

Each integer is kept as two halves of 16 bits, so that a key may have
2^45 terms before a 64-bit sum could overflow (Spark would raise then).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BIN = 32
#: The lowest bin holds the last bit of the smallest double, 2^-1074.
LOWEST = -34
#: Bins that count terms which are no numbers.
PLUS, MINUS, NAN = 1000, 1001, 1002


def parts(value: Column) -> Column:
    """``array<struct<bin, hi, lo>>``: the parts of one double (NULL: empty)."""
    size = F.abs(value)
    # log2 may err by one near a power of two; 3 bins hold 53 bits either way.
    top = F.floor(F.log2(size) / BIN).cast("int")
    half = F.pow(F.lit(2.0), (-BIN // 2) * top)
    out, rest = [], value * half * half  # two factors, as 2^(32 * 34) alone is out of range
    for k in range(3):
        whole = F.when(rest < 0, F.ceil(rest)).otherwise(F.floor(rest)).cast("long")
        out.append(F.struct((top - k).alias("bin"), F.shiftright(whole, 16).alias("hi"),
                            whole.bitwiseAND(F.lit(0xFFFF).cast("long")).alias("lo")))
        rest = (rest - whole.cast("double")) * float(1 << BIN)

    def single(where: int, count: int) -> Column:
        return F.array(F.struct(F.lit(where).alias("bin"), F.lit(0).cast("long").alias("hi"),
                                F.lit(count).cast("long").alias("lo")))

    inf = float("inf")
    return (F.when(value.isNull(), F.lit(None)).when(F.isnan(value), single(NAN, 1)).when(value == inf, single(PLUS, 1))
            .when(value == -inf, single(MINUS, 1)).when(value == 0, single(0, 0))
            .otherwise(F.filter(F.array(*out), lambda p: (p["hi"] != 0) | (p["lo"] != 0))))


def rounded_sum(bins: Sequence[int], his: Sequence[int], los: Sequence[int]) -> float | None:
    """The double nearest to Σ (hi·2^16 + lo)·2^(32·bin); None without terms."""
    if not len(bins):
        return None
    total, odd = 0, set()
    for b, hi, lo in zip(map(int, bins), map(int, his), map(int, los)):
        if b >= PLUS:
            odd.add(b)
        else:
            total += ((hi << 16) + lo) << (BIN * (b - LOWEST))
    if NAN in odd or len(odd) > 1:
        return float("nan")
    if odd:
        return float("inf") if PLUS in odd else float("-inf")
    try:
        return total / (1 << (-BIN * LOWEST))  # division of integers rounds correctly
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


@F.arrow_udf(DoubleType())
def _rounded(bins: pa.Array, his: pa.Array, los: pa.Array) -> pa.Array:
    rows = zip(bins.to_pylist(), his.to_pylist(), los.to_pylist())
    return pa.array([rounded_sum(*row) for row in rows], pa.float64())


def exact_sum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys`` and the exact sum of ``value``, rounded once, under its own name.

    Terms become up to three rows each, which are summed in the tasks before
    the shuffle: a (key, exponent) is a row per map task, however hot the key.
    NULLs are left out, a key of NULLs only has the sum NULL; NaN, or both
    infinities, give NaN.  Without keys: one row, NULL for an empty table.
    """
    rows = df.select(*keys, F.explode_outer(parts(F.col(value).cast("double"))).alias("__p"))
    sums = rows.groupBy(*keys, F.col("__p.bin").alias("__bin")).agg(
        F.sum("__p.hi").alias("__hi"), F.sum("__p.lo").alias("__lo"))
    found = F.collect_list(F.when(F.col("__bin").isNotNull(), F.struct("__bin", "__hi", "__lo")))
    few = sums.groupBy(*keys).agg(found.alias("__f"))
    total = _rounded(F.col("__f.__bin"), F.col("__f.__hi"), F.col("__f.__lo"))
    return few.select(*keys, total.alias(value))
