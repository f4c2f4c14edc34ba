"""Order in which the cells of a stored tensor make a range on any index cheap.

Cells are sorted by their coordinates' bits in turn (the highest bit of every
index, then the next one, and so on), so that near cells lie near each other
in every index at once.  Parquet's minima and maxima of files, row groups and
pages are then narrow for all indices, not just for the first one of a plain
sort, and a pushed-down range on any of them skips most of the table.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tensor import Tensor

_ORDERED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_BYTES = (T.StringType, T.BinaryType)
#: Bytes of a string index that order it, after those which all its values share.
_LEAD = 6


def _number(c: Column, kind: T.DataType, skip: int) -> Column:
    """An order-preserving double for one coordinate."""
    if isinstance(kind, _BYTES):
        lead = F.hex(F.substring(c.cast("binary"), skip + 1, _LEAD))
        return F.conv(F.rpad(lead, 2 * _LEAD, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def _shared_prefix(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Number of leading bytes that all values of each string index share."""
    if not names:
        return {}
    ends = df.agg(*[f(F.col(n).cast("binary")).alias(f"{k}{n}") for n in names for k, f in (("<", F.min), (">", F.max))])
    row = ends.first()
    return {n: len(os.path.commonprefix([bytes(row[f"<{n}"] or b""), bytes(row[f">{n}"] or b"")])) for n in names}


def interleaved(t: Tensor, cards: Mapping[str, int] | None = None) -> Column:
    """A long per cell: the leading bits of all coordinates in turn.

    Indices of known cardinality need no pass over the cells; the least and
    greatest coordinate of the others come from one aggregate.  Indices are
    numbers, dates, times, booleans, strings or binary.
    """
    kinds = {f.name: f.dataType for f in t.df.schema.fields if f.name in t.indices}
    for i, kind in kinds.items():
        if not isinstance(kind, (*_ORDERED, *_BYTES)):
            raise ValueError(f"index {i!r} of type {kind.simpleString()} has no order to store by")
    known = {**t.cards, **(cards or {})}
    skip = _shared_prefix(t.df, [i for i in t.indices if isinstance(kinds[i], _BYTES)])
    at = {i: _number(F.col(i), kinds[i], skip.get(i, 0)) for i in t.indices}
    at = {i: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for i, c in at.items()}
    open_ = [i for i in t.indices if i not in known]
    ends: dict[str, tuple[float, float]] = {i: (1.0, float(known[i])) for i in t.indices if i in known}
    if open_:
        row = t.df.agg(*[f(at[i]).alias(f"{k}{i}") for i in open_ for k, f in (("<", F.min), (">", F.max))]).first()
        ends |= {i: (row[f"<{i}"] or 0.0, row[f">{i}"] or 0.0) for i in open_}
    bits = min(20, 62 // max(1, len(t.indices)))
    steps = []
    for i in t.indices:
        low, high = ends[i]
        share = (at[i] - low) / (high - low) if high > low else F.lit(0.0)
        steps.append(F.least(F.greatest(F.floor(share * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long"))
    key = F.lit(0).cast("long")
    for b in range(bits):
        for n, step in enumerate(steps):
            bit = F.coalesce(F.shiftright(step, b), F.lit(0).cast("long")).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bit, b * len(steps) + len(steps) - 1 - n))
    return key


def clustered(t: Tensor, files: int | None = None) -> DataFrame:
    """The cells, range-partitioned and sorted by their interleaved bits.

    Equal keys are told apart by the coordinates themselves, so a partition
    never has to hold all cells of one coordinate, however hot.  Spark samples
    the cells to find the ranges: checkpoint a tensor first whose plan is dear.
    Without ``files`` adaptive execution chooses the number of partitions.
    """
    order = ["__z", *t.indices]
    rows = t.cells().withColumn("__z", interleaved(t))
    spread = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order).drop("__z")
