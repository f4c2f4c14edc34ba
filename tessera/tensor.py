"""The tensor data model: a DataFrame with one row per stored cell.

A ``Tensor`` is a DataFrame with one column per index (any type Spark can
equi-join on) and a ``value`` DOUBLE column, plus a little driver-side
metadata: the ordered index names and, optionally, the cardinality of each
index.  Known cardinalities promise that every coordinate lies in
``1..card``; that promise is what lets an operator prove an upper bound on
the number of cells (``Π card``) before it decides to broadcast a tensor.

Absent cells are zeros for contraction and *missing* for element-wise
operators.  At most one row is stored per cell; ``from_table`` enforces it by
summing duplicates with a (map-side combined) ``groupBy``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.exact import exact_sum

VALUE = "value"

# Rough in-memory width of one stored cell: 8 bytes per column plus row overhead.
_ROW_OVERHEAD_BYTES = 16
_COLUMN_BYTES = 8


@dataclass(frozen=True)
class Tensor:
    """A sparse (coordinate-format) tensor backed by a DataFrame."""

    df: DataFrame
    indices: tuple[str, ...]
    cards: Mapping[str, int] = field(default_factory=dict)
    # True when ``df`` reads a reliable checkpoint (a materialized copy).
    materialized: bool = False
    # A table of several tensors over the same cells, and this tensor's column in it.
    wide: DataFrame | None = field(default=None, compare=False, repr=False)
    column: str | None = None
    # Counts of values (see ``value_counts``), taken while the cells were materialized.
    counts: Mapping[str, int] | None = field(default=None, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "indices", tuple(self.indices))
        object.__setattr__(self, "cards", dict(self.cards))
        if len(set(self.indices)) != len(self.indices):
            raise ValueError(f"repeated index name in {self.indices}")
        if VALUE in self.indices:
            raise ValueError(f"'{VALUE}' is reserved for the cell value")
        missing = [c for c in (*self.indices, VALUE) if c not in self.df.columns]
        if missing:
            raise ValueError(f"columns {missing} not in DataFrame {self.df.columns}")
        unknown = set(self.cards) - set(self.indices)
        if unknown:
            object.__setattr__(
                self, "cards", {k: v for k, v in self.cards.items() if k in self.indices}
            )

    # ------------------------------------------------------------------ shape
    @property
    def order(self) -> int:
        return len(self.indices)

    def numel(self) -> int | None:
        """Size of the index space (``Π card``), when every card is known."""
        if any(i not in self.cards for i in self.indices):
            return None
        return math.prod(self.cards[i] for i in self.indices)

    def bound_bytes(self) -> int | None:
        """Proven upper bound on the stored size, from the cardinalities."""
        n = self.numel()
        if n is None:
            return None
        return n * (_ROW_OVERHEAD_BYTES + _COLUMN_BYTES * (self.order + 1))

    # ---------------------------------------------------------- projections
    def cells(self) -> DataFrame:
        """The canonical projection: index columns then ``value``."""
        return self.df.select(*self.indices, VALUE)

    def with_df(self, df: DataFrame) -> Tensor:
        return Tensor(df, self.indices, self.cards)

    def rename(self, mapping: Mapping[str, str]) -> Tensor:
        """Let the tensor enter an expression under other index names."""
        new = tuple(mapping.get(i, i) for i in self.indices)
        df = self.df.select(*[F.col(i).alias(mapping.get(i, i)) for i in self.indices], VALUE)
        cards = {mapping.get(k, k): v for k, v in self.cards.items()}
        return Tensor(df, new, cards)

    def with_cards(self, cards: Mapping[str, int]) -> Tensor:
        """Attach cardinalities known to hold (e.g. from ``cardinalities``)."""
        return Tensor(self.df, self.indices, {**self.cards, **cards}, self.materialized, self.wide, self.column,
                      self.counts)

    def restrict(self, cards: Mapping[str, int]) -> Tensor:
        """Keep coordinates inside ``1..card`` for each given index.

        The filter lands directly above the scan, so for tensors read from
        parquet it becomes a pushed-down range predicate.
        """
        conds = [F.col(i).between(1, c) for i, c in cards.items() if i in self.indices]
        df = self.df if not conds else self.df.filter(reduce(lambda a, b: a & b, conds))
        merged = dict(self.cards)
        for i, c in cards.items():
            if i in self.indices:
                merged[i] = min(c, merged.get(i, c))
        return Tensor(df, self.indices, merged)

    def map_values(self, fn) -> Tensor:
        """Apply a ``Column -> Column`` function to the values."""
        return self.with_df(self.df.select(*self.indices, fn(F.col(VALUE)).alias(VALUE)))

    # ------------------------------------------------------------ lifecycle
    def repartition(self, num_partitions: int | None = None) -> Tensor:
        """Hash-partition the cells by the tensor's indices.

        Useful before several joins on the full index set; otherwise leave
        partitioning to adaptive execution.
        """
        df = (self.df.repartition(num_partitions, *self.indices) if num_partitions
              else self.df.repartition(*self.indices))
        return Tensor(df, self.indices, self.cards, self.materialized)

    def persist(self, level=None) -> Tensor:
        """Keep the cells in executor memory/disk (``MEMORY_AND_DISK`` by default).

        A cache is lost with its executor; use ``checkpoint`` to cut lineage
        across iterations.
        """
        from pyspark import StorageLevel

        self.df.persist(level or StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> Tensor:
        self.df.unpersist()
        return self

    def checkpoint(self) -> Tensor:
        """Cut the lineage with a reliable checkpoint (see ``plans.lineage``).

        The job that writes the cells also counts them: ``validate`` and
        ``check`` of the result need no further job."""
        from .plans.lineage import cut_and_count

        df, counts = cut_and_count(self.cells(), value_counts())
        return Tensor(df, self.indices, self.cards, True, counts=counts)


def from_table(
    df: DataFrame,
    index_exprs: Mapping[str, Column | str],
    value_expr: Column | str,
    cards: Mapping[str, int] | None = None,
    exact: bool = False,
) -> Tensor:
    """Build a tensor from any DataFrame: one row per cell, duplicates summed.

    ``index_exprs`` maps each index name to a column expression; rows whose
    value or any coordinate is NULL are dropped (NULL never matches in a join,
    so such a row could never take part in an operation).  The aggregation is
    a hash aggregate with map-side partial sums, so a hot coordinate costs one
    row per map task in the shuffle, not one row per input record.  ``exact``
    sums agree in every bit on any partitions (see ``functions.exact``).
    """
    names = list(index_exprs)
    cols = [(F.col(e) if isinstance(e, str) else e).alias(n) for n, e in index_exprs.items()]
    val = (F.col(value_expr) if isinstance(value_expr, str) else value_expr).cast("double")
    projected = df.select(*cols, val.alias(VALUE))
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*names, VALUE)])
    t = coalesce_cells(Tensor(projected.filter(not_null), tuple(names)), exact)
    return t.restrict(cards) if cards else t


def tensors_from_table(
    df: DataFrame, index_exprs: Mapping[str, Column | str], value_exprs: Mapping[str, Column | str]
) -> dict[str, Tensor]:
    """Several tensors over one index set from a single pass over ``df``.

    Each is the tensor that ``from_table`` builds for its value; all of them
    share one aggregate with a sum each.  Element-wise expressions over
    tensors of one call read that aggregate once and need no join.
    """
    names, values = list(index_exprs), list(value_exprs)
    if clash := {*names, VALUE} & set(values):
        raise ValueError(f"{sorted(clash)} name both an index and a value")
    cols = [(F.col(e) if isinstance(e, str) else e).alias(n) for n, e in index_exprs.items()]
    vals = [(F.col(e) if isinstance(e, str) else e).cast("double").alias(n) for n, e in value_exprs.items()]
    projected = df.select(*cols, *vals)
    stored = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in values])
    # A sum over NULLs only is NULL: the cell is not stored in that tensor.
    wide = projected.filter(stored & some).groupBy(*names).agg(*[F.sum(v).alias(v) for v in values])
    return {v: Tensor(wide.filter(F.col(v).isNotNull()).select(*names, F.col(v).alias(VALUE)), tuple(names), {}, False,
                      wide, v) for v in values}


def value_counts() -> list[Column]:
    """Aggregates that count stored, NULL, NaN and infinite values."""
    v = F.col(VALUE)
    return [F.count(F.lit(1)).alias("cells"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"),
            F.count_if(v.isin(float("inf"), float("-inf"))).alias("infs")]


def coalesce_cells(t: Tensor, exact: bool = False) -> Tensor:
    """Sum duplicate rows of a tensor so that each cell is stored once."""
    if exact:
        return Tensor(exact_sum(t.df, t.indices, VALUE), t.indices, t.cards)
    return Tensor(t.df.groupBy(*t.indices).agg(F.sum(VALUE).alias(VALUE)), t.indices, t.cards)


def align(tensors: Iterable[Tensor]) -> tuple[str, ...]:
    """Common index order for tensors that must share one index set."""
    ts = list(tensors)
    first = ts[0].indices
    for t in ts[1:]:
        if set(t.indices) != set(first):
            raise ValueError(f"index sets differ: {first} vs {t.indices}")
    return first
