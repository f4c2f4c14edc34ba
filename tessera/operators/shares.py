"""Contraction of cyclic operands in one round of exchanges.

``A(i,j) · B(j,k) · C(i,k)`` joined two at a time makes, and shuffles, every
path of A and B, however few of them C closes.  Here every index gets a share
of a grid: index ``i`` is hashed to ``p_i`` values, ``Π p_i`` grid cells in all.
A tensor's cell goes to the grid cells that agree with the hashes of its own
indices, once for each hash of the indices it lacks.  All cells of one product
meet in exactly one grid cell, so each operand is exchanged once, by grid cell,
and all joins and the map side of the sum run where the rows then lie; the
two-way product is never exchanged.

Spark joins rows where they lie by a part of the join key only with
``spark.sql.requireAllClusterKeysForCoPartition`` off.  In a session that has
it off the result is an ordinary lazy plan; elsewhere it is computed at once
under that setting, into the checkpoint folder.

Shares are powers of two with the least rows in a grid cell for the measured
sizes.  A hot coordinate of one index is still dealt by the other indices'
hashes.  Acyclic operands are better off with ``contract``, which sums out early.

The operand joined last closes the cycle.  Where the products that meet it are
many, its cells are hashed and the products streamed past them, so that they are
never sorted or spilled.  Its largest grid cell is counted first and must fit into
``HASHED`` rows; shares are chosen for that, with more grid cells than asked for
where it takes them.  Where a hot coordinate defeats that, products are sorted.

The copies of a grid grow faster than the operands: cells of bounded size are the
more, the larger the operands are, and each operand is sent to more of them.  So
where the copies would be more rows than the operands (and ``FEW``), one index is
not dealt but gone through: its coordinates are hashed to classes, and one pass
after the other joins the cells of one class.  Operands without that index are
dealt once and kept on the executors' disks for all passes; of the others a pass
deals only its class, and its exchanges are dropped before the next.  So the rows
on disk at a time are in proportion to the operands.  Every product belongs to
exactly one pass.
"""

from __future__ import annotations

import contextlib
import itertools
import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_dir
from ..tensor import VALUE, Tensor, coalesce_cells
from .contract import _joined, _Operand, _sum_out, measure_sizes

_GRID, _RIGHT, _CODE = "__grid", "__r", "__code"
#: Rows of a grid cell that a task may hash (about 130 bytes each), and products from which that is done.
HASHED, MANY = 2_000_000, 1_000_000
#: Rows dealt at a time, below which there are no passes; else the rows of the operands.
FEW = 10_000_000
#: Passes at most, as a power of two.
_PASS_BITS = 12
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_DROP_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def grid_shares(indices: Sequence[Sequence[str]], rows: Sequence[float], parts: int, hashed: int | None = None) -> dict[str, int]:
    """Power-of-two shares, ``parts`` grid cells at most, with the least rows per
    grid cell, then the least rows sent.  Shares that leave ``HASHED`` rows or
    fewer of the operand ``hashed`` in a grid cell come first; where there are none,
    grid cells are doubled."""
    if hashed is not None:
        while (1 << int(math.log2(max(1, parts)))) * HASHED < rows[hashed]:
            parts = 2 * max(1, parts)
    names = sorted({i for own in indices for i in own})
    bits = max(0, int(math.log2(max(1, parts))))
    best = None
    for powers in itertools.product(range(bits + 1), repeat=len(names)):
        if sum(powers) > bits:
            continue
        shares = {i: 1 << p for i, p in zip(names, powers)}
        load = sum(n / math.prod(shares[i] for i in own) for own, n in zip(indices, rows))
        sent = sum(n * math.prod(s for i, s in shares.items() if i not in own) for own, n in zip(indices, rows))
        over = hashed is not None and rows[hashed] > HASHED * math.prod(shares[i] for i in indices[hashed])
        if best is None or (over, load, sent) < best[0]:
            best = ((over, load, sent), shares)
    return best[1]


def rows_sent(indices: Sequence[Sequence[str]], rows: Sequence[float], shares: Mapping[str, int]) -> float:
    """Rows that the operands are dealt to."""
    return sum(n * math.prod(s for i, s in shares.items() if i not in own) for own, n in zip(indices, rows))


@dataclass
class _Passes:
    index: str  # the index that is gone through
    count: int
    shares: dict[str, int]  # of the grid of every pass; 1 for ``index``

    @property
    def cells(self) -> int:
        return math.prod(self.shares.values())


def pass_shares(indices: Sequence[Sequence[str]], rows: Sequence[float], parts: int, tasks: int, hashed: int,
                crowded: int = 1) -> _Passes:
    """The index to go through, in how many passes, and the shares in each, a power
    of two all: grid cells of bounded size first, at most two thirds of the operands'
    rows dealt at a time next, then the least rows sent and read.

    A pass has ``tasks`` grid cells or more.  A task hashes ``HASHED`` rows at most
    (on average that over ``crowded``), sorts twice as many in every pass, and eight
    times as many once."""
    names = sorted({i for own in indices for i in own})
    least = math.ceil(math.log2(max(1, tasks)))
    most = max(least, math.ceil(math.log2(max(1, parts))))
    best = None
    for index in names:
        others = [i for i in names if i != index]
        for powers in itertools.product(range(most + 1), repeat=len(others)):
            if not least <= sum(powers) <= most:
                continue
            shares = {index: 1, **{i: 1 << p for i, p in zip(others, powers)}}
            for bits in range(_PASS_BITS + 1):
                count, over, once, moved = 1 << bits, 0.0, 0.0, 0.0
                for n, (own, size) in enumerate(zip(indices, rows)):
                    split = index in own
                    copied = size * math.prod(s for i, s in shares.items() if i not in own)
                    in_cell = size / math.prod(shares[i] for i in own) / (count if split else 1)
                    limit = HASHED / crowded if n == hashed else HASHED * (2 if split else 8)
                    over += max(0.0, in_cell - limit)
                    once += copied / (count if split else 1)
                    # Reading a row again costs about this share of sending it: the first operand's, others', hashed ones'.
                    moved += copied + count * size * (0.1 if split else 1.2 if n == hashed else 0.8 if n == 0 else 0.9)
                rank = (over, once > max(FEW, sum(rows) * 2 / 3), moved)
                if best is None or rank < best[0]:
                    best = (rank, _Passes(index, count, dict(sorted(shares.items()))))
    return best[1]


def _strides(shares: Mapping[str, int]) -> dict[str, int]:
    strides, at = {}, 1
    for i, share in shares.items():
        strides[i] = at
        at *= share
    return strides


def _kinds(ops: Sequence[_Operand]) -> dict[str, str]:
    """What an index is cast to before it is hashed, so that the types it has in
    different operands hash alike: whole numbers to the largest, others to text."""
    found: dict[str, set[str]] = {}
    for o in ops:
        for i, kind in o.df.select(*o.indices).dtypes:
            found.setdefault(i, set()).add(kind)
    return {i: "bigint" if kinds <= _WHOLE else "string" for i, kinds in found.items()}


def _hashed_to(index: str, n: int, kinds: Mapping[str, str], what: str = "") -> Column:
    return F.pmod(F.xxhash64(F.lit(what + index), F.col(index).cast(kinds.get(index, "string"))), F.lit(n))


def _own(op: _Operand, shares: Mapping[str, int], kinds: Mapping[str, str]) -> Column:
    """The number of the grid cell by the operand's own indices."""
    strides, own = _strides(shares), F.lit(0)
    for i in op.indices:
        own = own + _hashed_to(i, shares[i], kinds) * strides[i]
    return own.cast("int")


def _dealt(op: _Operand, shares: Mapping[str, int], parts: int, kinds: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """The operand's cells, once for every grid cell they belong to."""
    strides = _strides(shares)
    absent = [[n * strides[i] for n in range(share)] for i, share in shares.items() if i not in op.indices]
    offsets = [sum(x) for x in itertools.product(*absent)]
    rows = op.df.withColumn("__own", _own(op, shares, kinds))
    rows = rows.withColumn("__to", F.explode(F.array(*[F.lit(x) for x in offsets])))
    rows = rows.select((F.col("__own") + F.col("__to")).alias(_GRID), *op.indices, VALUE)
    # A grid cell to a partition: by hash, several would meet in some.
    return rows.repartitionById(max(parts, math.prod(shares.values())), _GRID)


def _in_turn(ops: Sequence[_Operand]) -> list[int]:
    """The operands in the order in which they are joined."""
    turn, have, left = [0], set(ops[0].indices), list(range(1, len(ops)))
    while left:
        n = max(left, key=lambda n: len(set(ops[n].indices) & have))
        if not set(ops[n].indices) & have:
            raise ValueError("operands without a common index: use contract")
        left.remove(n)
        turn.append(n)
        have |= set(ops[n].indices)
    return turn


def _shared(ops: Sequence[_Operand], turn: Sequence[int], n: int) -> list[str]:
    """The indices by which operand ``n`` is joined when its turn comes."""
    at = turn.index(n)
    if at == 0:
        return [i for i in ops[n].indices if len(turn) > 1 and i in ops[turn[1]].indices]
    have = [i for m in turn[:at] for i in ops[m].indices]
    return [i for i in dict.fromkeys(have) if i in ops[n].indices]


def _met(ops: Sequence[_Operand], dealt: Sequence[DataFrame], turn: Sequence[int], last: int | None,
         kinds: Mapping[str, str]) -> _Operand:
    """The products of the dealt cells, joined in turn where they lie."""
    cur, have = dealt[turn[0]], list(ops[turn[0]].indices)
    for n in turn[1:]:
        shared = _shared(ops, turn, n)
        new = [i for i in ops[n].indices if i not in have]
        have += new
        values = [_GRID, *have, (F.col(VALUE) * F.col(_RIGHT)).alias(VALUE)]
        if n == last and all(kinds[i] == "bigint" for i in shared):
            # Joined by one number of 64 bits, which Spark finds several times faster than a row: the grid cell and a
            # hash.  Rows that agree in the hash only are dropped; as an equality the test would be part of the key.
            code = F.hash(*[F.col(i).cast("bigint") for i in shared]).alias(_CODE)
            named = [f"__key{m}" for m in range(len(shared))]
            other = dealt[n].select(_GRID, code, *[F.col(i).alias(x) for i, x in zip(shared, named)], *new,
                                    F.col(VALUE).alias(_RIGHT))
            same = [(F.col(i) <= F.col(x)) & (F.col(i) >= F.col(x)) for i, x in zip(shared, named)]
            cur = cur.withColumn(_CODE, code).join(other.hint("shuffle_hash"), [_GRID, _CODE]).where(
                reduce(lambda a, b: a & b, same)).select(*values)
        else:
            # The grid cell is part of the key: both sides already lie by it.  Last, as it is one in a task's rows.
            other = dealt[n].withColumnRenamed(VALUE, _RIGHT)
            cur = cur.join(other.hint("shuffle_hash" if n == last else "merge"), [*shared, _GRID]).select(*values)
    return _Operand(cur.select(*have, VALUE), have, {i: c for o in ops for i, c in o.cards.items()})


@contextlib.contextmanager
def _set(conf, **values: str) -> Iterator[None]:
    before = {k: conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _written(op: _Operand, path: str) -> _Operand:
    """The operand's cells from Parquet files, smaller than a checkpoint's."""
    # Any names will do as indices, but not as columns of files.
    plain = op.df.select(*op.indices, VALUE).toDF(*[f"c{n}" for n in range(len(op.indices) + 1)])
    plain.write.mode("append").parquet(path)
    df = plain.sparkSession.read.schema(plain.schema).parquet(path).toDF(*op.indices, VALUE)
    return _Operand(df, op.indices, op.cards)


def _removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _rows(ops: Sequence[_Operand]) -> list[float]:
    """Stored cells of every operand, from one job."""
    counts = [o.df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("n"), "rows") for n, o in enumerate(ops)]
    found = {r["n"]: r["rows"] for r in reduce(DataFrame.unionByName, counts).collect()}  # a row per operand
    return [float(found[n]) for n in range(len(ops))]


def _fullest(op: _Operand, shares: Mapping[str, int], kinds: Mapping[str, str], through: _Passes | None) -> int:
    """Rows of the operand in its fullest grid cell, of any pass."""
    keys = [_own(op, shares, kinds).alias(_GRID)]
    if through and through.index in op.indices:
        keys.append(_hashed_to(through.index, through.count, kinds, "pass ").alias("__pass"))
    cells = op.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.max("n")).first()[0] or 0


def _gone_through(ops: Sequence[_Operand], output: Sequence[str], turn: Sequence[int], last: int | None,
                  kinds: Mapping[str, str], through: _Passes, folder: str) -> _Operand:
    """The contraction pass by pass, each one's sums written before the next begins."""
    sums, kept = None, {}
    try:
        for n, o in enumerate(ops):
            if through.index not in o.indices:
                rows = _dealt(o, through.shares, through.cells, kinds)
                if n != last:
                    rows = rows.sortWithinPartitions(*_shared(ops, turn, n), _GRID)
                kept[n] = rows.persist(StorageLevel.DISK_ONLY)
                # Only a relation that is there already tells Spark how its rows lie.
                kept[n].count()
        for at in range(through.count):
            of_class = _hashed_to(through.index, through.count, kinds, "pass ") == at
            dealt = [kept[n] if n in kept else _dealt(_Operand(o.df.where(of_class), o.indices, o.cards), through.shares,
                                                      through.cells, kinds) for n, o in enumerate(ops)]
            sums = _written(_sum_out(_met(ops, dealt, turn, last, kinds), output), f"{folder}/sums")
    finally:
        for rows in kept.values():
            rows.unpersist()
    if through.index in output:
        return sums
    # A cell has a sum from every pass.
    if not sums.indices:
        return _Operand(sums.df.agg(F.coalesce(F.sum(VALUE), F.lit(0.0)).alias(VALUE)), [], {})
    return _Operand(coalesce_cells(Tensor(sums.df, tuple(sums.indices), sums.cards)).df, sums.indices, sums.cards)


def contract_one_round(tensors: Sequence[Tensor], output: Sequence[str], parts: int | None = None,
                       shares: Mapping[str, int] | None = None) -> Tensor:
    """The contraction of ``contract(tensors, output)`` with one exchange for each
    operand and one for the sum; of large operands, in passes over one index.

    ``parts`` is the number of grid cells aimed at (``spark.sql.shuffle.partitions``
    by default); ``shares`` sets them by hand, without passes.  Every index of the
    output must occur in some operand, and the operands must be linked by common
    indices.
    """
    output = list(output)
    used = {i for t in tensors for i in t.indices}
    if missing := [i for i in output if i not in used]:
        raise ValueError(f"output indices {missing} are in no operand")
    ops = [_Operand(t.cells(), list(t.indices), dict(t.cards)) for t in tensors]
    # Sum out what only one operand has.
    ops = [_sum_out(o, set(output).union(*[set(x.indices) for x in ops if x is not o])) for o in ops]
    spark = ops[0].df.sparkSession
    if parts is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.conf.get(_ALL_KEYS, "true").lower() == "false":
        return _contracted(ops, output, parts, shares, None)
    folder = f"{checkpoint_dir(spark)}/one-round-{uuid.uuid4().hex}"
    try:
        # The exchanges of a job that has written its rows are of no more use.
        with _set(spark.conf, **{_ALL_KEYS: "false", _DROP_FILES: "true"}):
            # Written once: they are counted, and read again for the joins.
            ops = [_written(o, f"{folder}/operand-{n}") for n, o in enumerate(ops)]
            return _contracted(ops, output, parts, shares, folder).checkpoint()
    finally:
        _removed(spark, folder)


def _contracted(ops: Sequence[_Operand], output: Sequence[str], parts: int, shares: Mapping[str, int] | None,
                folder: str | None) -> Tensor:
    """The contraction; in passes only where there is a ``folder`` for their sums."""
    turn, kinds, indices = _in_turn(ops), _kinds(ops), [o.indices for o in ops]
    last = through = None
    # Written operands are counted from the files' ends; others are run for it, once.
    sizes = None if folder else measure_sizes(ops)
    rows = [s.rows for s in sizes] if sizes else _rows(ops)
    if len(ops) > 2:
        many = min(rows[n] for n in turn[:-1]) > MANY
        if not many:
            sizes = sizes or measure_sizes(ops)
            many = reduce(_joined, [sizes[n] for n in turn[:-1]]).rows > MANY
        last = turn[-1] if many else None
    in_passes = False
    if shares is None:
        shares = grid_shares(indices, rows, parts, last)
        in_passes = bool(folder) and last is not None and rows_sent(indices, rows, shares) > max(FEW, sum(rows))
    shares = {i: int(shares.get(i, 1)) for i in sorted({i for o in ops for i in o.indices})}
    if in_passes:
        tasks = min(parts, 2 * ops[0].df.sparkSession.sparkContext.defaultParallelism)
        through = pass_shares(indices, rows, parts, tasks, last)
        shares = through.shares
    if last is not None:
        full, crowded = _fullest(ops[last], shares, kinds, through), 1
        while through and full > 2 * HASHED and crowded < 64:
            # A hot coordinate: more passes or grid cells may part its rows.
            crowded *= 4
            through = pass_shares(indices, rows, parts, tasks, last, crowded)
            shares = through.shares
            full = _fullest(ops[last], shares, kinds, through)
        last = last if full <= 2 * HASHED else None
    if through:
        out = _gone_through(ops, output, turn, last, kinds, through, folder)
    else:
        out = _sum_out(_met(ops, [_dealt(o, shares, parts, kinds) for o in ops], turn, last, kinds), output)
    return Tensor(out.df.select(*output, VALUE), tuple(output), out.cards)
