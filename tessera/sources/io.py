"""Reading and writing tensors (CSV with a header, or parquet)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..tensor import VALUE, Tensor, coalesce_cells
from .layout import clustered

#: Bytes per row group of a clustered table.
ROW_GROUP = 16 << 20


def tensor_ddl(indices: Sequence[str], index_type: str = "INT") -> str:
    """Schema of a stored tensor: one column per index in order, then the value."""
    return ", ".join([*(f"{i} {index_type}" for i in indices), f"{VALUE} DOUBLE"])


def read_tensor(
    spark: SparkSession,
    path: str,
    indices: Sequence[str],
    fmt: str = "parquet",
    cards: Mapping[str, int] | None = None,
    index_type: str | Mapping[str, str] = "INT",
    coalesce: bool = True,
    value: str = VALUE,
    ranges: Mapping[str, tuple] | None = None,
) -> Tensor:
    """Read a tensor with a declared schema (never inferred).

    CSV files must carry a header; their columns are the indices in order,
    then ``value``.  Parquet files are read by column name, so only the
    index and value columns are scanned.  With ``coalesce`` (the default),
    duplicate coordinates are summed so each cell is stored once; pass
    ``coalesce=False`` only for files known to be unique per cell.  Known
    ``cards`` turn into a range filter on the stored columns, before any
    cast, so that it is pushed down to the scan.  ``index_type`` is one type
    or one per index; ``value`` is the column that holds the values.

    ``ranges`` gives the least and greatest coordinate wanted of any index (None:
    open), as a filter on the stored column too: in a table that ``write_tensor``
    clustered, a range on any index skips the files, row groups and pages outside.
    """
    kinds = {i: index_type if isinstance(index_type, str) else index_type[i] for i in indices}
    if fmt == "csv":
        ddl = ", ".join([*(f"{i} {kinds[i]}" for i in indices), f"{value} DOUBLE"])
        df = spark.read.schema(ddl).option("header", True).csv(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}; use 'csv' or 'parquet'")
    for i in cards or {}:
        df = df.where(F.col(i).between(1, cards[i]))
    for i, (low, high) in (ranges or {}).items():
        if i not in indices:
            raise ValueError(f"range on {i!r}, which is no index of the tensor")
        if low is not None:
            df = df.where(F.col(i) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(i) <= F.lit(high))
    df = df.select(*[F.col(i).cast(kinds[i]).alias(i) for i in indices], F.col(value).cast("double").alias(VALUE))
    t = Tensor(df, tuple(indices))
    if coalesce:
        t = coalesce_cells(t)
    return t.restrict(cards) if cards else t


def write_tensor(t: Tensor, path: str, fmt: str = "parquet", mode: str = "error", cluster: bool = False,
                 files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Write the cells of a tensor: parquet, or CSV with a header line.

    With ``cluster``, parquet cells are laid out so that a range on any index
    (``read_tensor(..., ranges=...)``) reads little more than its cells (see
    ``layout``): range-partitioned into ``files`` (by default as many as
    adaptive execution finds right) with row groups of ``row_group`` bytes.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}; use 'csv' or 'parquet'")
    if cluster and fmt != "parquet":
        raise ValueError("only parquet files keep the statistics that make clustering pay")
    writer = (clustered(t, files) if cluster else t.cells()).write.mode(mode)
    if cluster:
        writer = writer.option("parquet.block.size", row_group)
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)
