"""Data checks on tensor values, computed as one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import Tensor, value_counts


def validate(t: Tensor) -> DataFrame:
    """Counts of stored, NULL, NaN and infinite values (one row).

    A checkpointed tensor was counted while it was written: no job is needed."""
    if t.counts:
        return t.df.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(k) for k, n in t.counts.items()])
    return t.df.agg(*value_counts())


def describe_counts(counts: dict[str, int]) -> str:
    return f"{counts['cells']} cells, {counts['nulls']} NULL, {counts['nans']} NaN, {counts['infs']} infinite"


def check(t: Tensor, allow_inf: bool = True, what: str | None = None) -> dict[str, int]:
    """Raise ``ValueError`` with the counts if any value is NULL or NaN; return them.

    Only the one-row aggregate reaches the driver, and no job runs for a
    checkpointed tensor.
    """
    counts = dict(t.counts or t.df.agg(*value_counts()).first().asDict())
    if counts["nulls"] + counts["nans"] + (0 if allow_inf else counts["infs"]):
        raise ValueError(f"invalid values in {what or f'tensor {t.indices}'}: {describe_counts(counts)}")
    return counts
