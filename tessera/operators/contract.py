"""Tensor contraction (generalized tensor product, einsum over DataFrames).

``contract([A, B, ...], output)`` computes

    out[o] = Σ_{indices not in o}  Π_n  T_n[idx_n]

over the stored cells (an absent cell is zero).  The plan is a sequence of
binary equi-joins, each followed by an aggregate that sums out every index
no later operand and not the output needs ("early sum-out").  Catalyst does
not push a sum below a join by itself, so without this the intermediate of
an N-way contraction is the join of all inputs.

Join order.  Three and more operands are ordered by size: one aggregate counts
the stored cells and the distinct coordinates of every operand, and dynamic
programming over subsets of operands finds the tree of joins with the fewest
intermediate rows, whatever order the operands are given in (operands of
different components meet last).  ``order="given"`` takes no counts: the plan
starts from the first operand and joins the others one at a time, always
picking one that shares an index with what has been built so far,
preferring the one that leaves the fewest indices after summing out.

Physical strategy.  A side is hinted for broadcast only when its size has a
proven bound: every index has a known cardinality and ``Π card`` rows fit
under ``spark.sql.autoBroadcastJoinThreshold``.  Otherwise the join is left
to Catalyst and adaptive execution, which broadcast a side whose measured
shuffle output is small and split skewed partitions.  ``salt=n`` spreads
the larger side of every shuffled join over ``n`` sub-partitions (hash of its
other indices) and replicates the smaller side ``n`` times, for keys hot
enough to dominate a task even after adaptive splitting.  Copies are never
broadcast: Spark's estimate does not count them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..tensor import VALUE, Tensor

_LEFT, _RIGHT, _SALT = "__l", "__r", "__salt"


@dataclass
class _Operand:
    df: DataFrame  # index columns + VALUE, one row per cell
    indices: list[str]
    cards: dict[str, int]

    def bound_bytes(self) -> int | None:
        if any(i not in self.cards for i in self.indices):
            return None
        rows = math.prod(self.cards[i] for i in self.indices)
        return rows * (16 + 8 * (len(self.indices) + 1))


def broadcast_threshold(df: DataFrame) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` of the session, in bytes."""
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    return _parse_bytes(raw)


def _parse_bytes(raw: str) -> int:
    s = str(raw).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
             "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}
    for suffix in sorted(units, key=len, reverse=True):
        if s.endswith(suffix) and s[: -len(suffix)].strip().lstrip("-").isdigit():
            return int(s[: -len(suffix)]) * units[suffix]
    return int(s)


def _small(op: _Operand, threshold: int) -> bool:
    b = op.bound_bytes()
    return b is not None and threshold > 0 and b <= threshold


def _sum_out(op: _Operand, keep: Sequence[str], exact: bool = False) -> _Operand:
    keep = [i for i in op.indices if i in keep]
    if len(keep) == len(op.indices):
        return op
    if exact:
        df = exact_sum(op.df, keep, VALUE).select(*keep, (F.col(VALUE) if keep else F.coalesce(VALUE, F.lit(0.0))).alias(VALUE))
    elif keep:
        df = op.df.groupBy(*keep).agg(F.sum(VALUE).alias(VALUE))
    else:
        df = op.df.agg(F.coalesce(F.sum(VALUE), F.lit(0.0)).alias(VALUE))  # an empty total is 0
    return _Operand(df, keep, {i: op.cards[i] for i in keep if i in op.cards})


def _join(a: _Operand, b: _Operand, salt: int | None, threshold: int, skew: float | None = None) -> _Operand:
    shared = [i for i in a.indices if i in b.indices]
    left = a.df.select(*a.indices, F.col(VALUE).alias(_LEFT))
    right = b.df.select(*b.indices, F.col(VALUE).alias(_RIGHT))
    indices = a.indices + [i for i in b.indices if i not in a.indices]
    cards = {**a.cards, **b.cards}
    product = (F.col(_LEFT) * F.col(_RIGHT)).alias(VALUE)

    if not shared:
        # Operands without a common index make an outer product, which the
        # output asks for.  A one-row total or a side with a proven small bound
        # is broadcast, so the product is formed where the other side's rows
        # already are; without such a side Spark pairs the partitions.
        if a.indices and b.indices and not (_small(a, threshold) or _small(b, threshold)):
            joined = left.crossJoin(right)
            return _Operand(joined.select(*indices, product), indices, cards)
        swap = not a.indices or (b.indices and _small(a, threshold) and not _small(b, threshold))
        if swap:
            left, right = right, left
        joined = left.crossJoin(F.broadcast(right))
        return _Operand(joined.select(*indices, product), indices, cards)

    if _small(b, threshold):
        right = F.broadcast(right)
    elif _small(a, threshold):
        left = F.broadcast(left)
    elif skew:
        joined = _split_join(a, b, left, right, shared, skew)
        return _Operand(joined.select(*indices, product), indices, cards)
    elif salt and salt > 1:
        left, right = _salted(a, b, left, right, shared, salt)
        if _SALT in left.columns:
            shared = shared + [_SALT]
    joined = left.join(right, shared, "inner")
    return _Operand(joined.select(*indices, product), indices, cards)


def _salted(a, b, left, right, shared, n):
    """Spread the larger side's rows of each key over ``n`` buckets."""
    big_is_left = not (a.bound_bytes() is not None and b.bound_bytes() is None)
    big, small = (a, b) if big_is_left else (b, a)
    spread = [i for i in big.indices if i not in shared]
    if not spread:  # one row per key on the big side: nothing to split
        return left, right
    bucket = F.pmod(F.xxhash64(*[F.col(i) for i in spread]), F.lit(n)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    big_df, small_df = (left, right) if big_is_left else (right, left)
    big_df = big_df.withColumn(_SALT, bucket)
    # Spark estimates the copies as if there were one of each row, and would broadcast them through the driver.
    small_df = small_df.withColumn(_SALT, copies).hint("merge")
    return (big_df, small_df) if big_is_left else (small_df, big_df)


@dataclass
class _Size:
    """Estimated rows, and distinct coordinates per index."""

    rows: float
    distinct: dict[str, float]


def measure_sizes(ops: Sequence[_Operand]) -> list[_Size]:
    """Stored cells and distinct coordinates of every operand, from one job."""
    rows = None
    for n, op in enumerate(ops):
        counts = F.array(*[F.approx_count_distinct(i).cast("double") for i in op.indices]) if op.indices else F.array(
            F.lit(1.0))
        one = op.df.agg(F.count(F.lit(1)).cast("double").alias("rows"), counts.alias("distinct")).select(
            F.lit(n).alias("n"), "rows", "distinct")
        rows = one if rows is None else rows.unionByName(one)
    found = {r["n"]: r for r in rows.collect()}  # a row per operand
    return [_Size(found[n]["rows"], {i: max(1.0, min(d, op.cards.get(i, math.inf)))
                                     for i, d in zip(op.indices, found[n]["distinct"])}) for n, op in enumerate(ops)]


def _joined(a: _Size, b: _Size) -> _Size:
    rows = a.rows * b.rows
    for i in a.distinct.keys() & b.distinct.keys():
        rows /= max(a.distinct[i], b.distinct[i])
    return _Size(rows, {i: min(a.distinct.get(i, math.inf), b.distinct.get(i, math.inf))
                        for i in {**a.distinct, **b.distinct}})


def _kept(size: _Size, keep: set[str]) -> _Size:
    distinct = {i: d for i, d in size.distinct.items() if i in keep}
    return _Size(min(size.rows, math.prod(distinct.values())), distinct)


def join_tree(indices: Sequence[Sequence[str]], sizes: Sequence[_Size], output: Sequence[str]):
    """The cheapest tree of joins: a nested pair of operand numbers.

    The cost of a join is the rows it makes before its aggregate.  Operands
    without a common index are only joined where nothing else is left."""
    order = sorted(range(len(sizes)), key=lambda n: (sorted(indices[n]), sizes[n].rows))
    full = (1 << len(order)) - 1
    used = [set(indices[n]) for n in order]

    def needed(subset: int) -> set[str]:
        return set(output).union(*[used[i] for i in range(len(order)) if not subset >> i & 1])

    best: dict[int, tuple[tuple[int, float], _Size, object]] = {}
    for i, n in enumerate(order):
        best[1 << i] = ((0, 0.0), _kept(sizes[n], needed(1 << i)), n)
    for subset in range(1, full + 1):
        if subset in best:
            continue
        half = subset
        while half := (half - 1) & subset:
            rest = subset ^ half
            if half < rest:
                continue
            (pa, ca), sa, ta = best[half]
            (pb, cb), sb, tb = best[rest]
            product = not (sa.distinct.keys() & sb.distinct.keys()) and bool(sa.distinct and sb.distinct)
            made = _joined(sa, sb)
            cost = (pa + pb + product, ca + cb + made.rows)
            if subset not in best or cost < best[subset][0]:
                best[subset] = (cost, _kept(made, needed(subset)), (ta, tb))
    return best[full][2]


def _leaves(node) -> list[int]:
    return [node] if isinstance(node, int) else [n for side in node for n in _leaves(side)]


def _in_given_order(ops: list[_Operand], output: Sequence[str], salt: int | None, threshold: int,
                    skew: float | None, exact: bool = False) -> _Operand:
    cur, rest = ops[0], ops[1:]
    while rest:
        linked = [o for o in rest if set(o.indices) & set(cur.indices)] or [
            o for o in rest if not o.indices or not cur.indices
        ] or rest

        def after(o: _Operand) -> tuple[int, float]:
            # fewest indices left after summing out, then the smallest proven
            # bound of that intermediate (unknown bounds rank last)
            keep = set(output).union(*[set(x.indices) for x in rest if x is not o])
            left = (set(cur.indices) | set(o.indices)) & keep
            known = {**cur.cards, **o.cards}
            bound = math.prod(known[i] for i in left) if all(i in known for i in left) else math.inf
            return len(left), bound

        nxt = min(linked, key=lambda o: (*after(o), rest.index(o)))
        rest = [o for o in rest if o is not nxt]
        cur = _join(cur, nxt, salt, threshold, skew)
        cur = _sum_out(cur, set(output).union(*[set(o.indices) for o in rest]), exact)
    return cur


def join_forest(indices: Sequence[Sequence[str]]) -> list[tuple[int, int]] | None:
    """(child, parent) edges of a join tree, children first; None if the operands
    are cyclic.  An operand is a leaf if what it shares with all the others
    lies in one of them."""
    left, edges = {n: set(i) for n, i in enumerate(indices)}, []
    while len(left) > 1:
        for n, mine in left.items():
            shared = mine & set().union(*[o for m, o in left.items() if m != n])
            parent = next((m for m, o in left.items() if m != n and shared <= o), None)
            if parent is not None:
                break
        else:
            return None
        if shared:
            edges.append((n, parent))
        del left[n]
    return edges


def drop_dangling(ops: list[_Operand]) -> list[_Operand]:
    """Keep the cells that take part in some product (acyclic operands only).

    Every operand is filtered by the keys of its children, leaves first, and
    then by those of its parent; after that no join makes a row that a later
    one drops.  A filter is a semi-join with distinct keys."""
    edges = join_forest([o.indices for o in ops])
    if edges is None:
        return ops
    ops = list(ops)

    def filtered(n: int, by: int) -> None:
        shared = [i for i in ops[n].indices if i in ops[by].indices]
        keys = ops[by].df.select(*shared).distinct()
        ops[n] = _Operand(ops[n].df.join(keys, shared, "left_semi"), ops[n].indices, ops[n].cards)

    for child, parent in edges:
        filtered(parent, child)
    for child, parent in reversed(edges):
        filtered(child, parent)
    return ops


def hot_keys(df: DataFrame, key, share: float) -> list[int]:
    """Hashes of the keys that may hold ``share`` of the rows or more: Spark's
    frequent-items sketch, of at most ``1 / share`` entries."""
    found = df.select(key.alias("__key")).stat.freqItems(["__key"], share).first()[0]
    return sorted(found or [])


def _split_join(a: _Operand, b: _Operand, left: DataFrame, right: DataFrame, shared: list[str], share: float) -> DataFrame:
    """A shuffled join whose hot keys are spread over all partitions: their
    cells by the hash of the other indices, the other side's copied to each."""
    key = F.xxhash64(*shared)
    sides = [(left, a, hot_keys(left, key, share)), (right, b, hot_keys(right, key, share))]
    hot = sides[0][2] if len(a.indices) > len(shared) else []
    big_is_left = bool(hot)
    if not hot:
        hot = sides[1][2] if len(b.indices) > len(shared) else []
    if not hot:
        return left.join(right, shared, "inner")
    # Several buckets per partition, so that their hashes fill partitions evenly.
    n = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    big, op, _ = sides[0 if big_is_left else 1]
    small = right if big_is_left else left
    is_hot = key.isin(hot)
    rest = [F.col(i) for i in op.indices if i not in shared]
    spread = big.where(is_hot).withColumn(_SALT, F.pmod(F.xxhash64(*rest), F.lit(n)).cast("int"))
    copies = small.where(is_hot).withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).hint("merge")
    columns = [*dict.fromkeys([*left.columns, *right.columns])]
    hot_rows = spread.join(copies, [*shared, _SALT], "inner").select(*columns)
    return big.where(~is_hot).join(small.where(~is_hot), shared, "inner").select(*columns).unionByName(hot_rows)


#: Operands up to which all trees are tried; 3^n steps.
MAX_ORDERED = 10


def contract(
    tensors: Sequence[Tensor],
    output: Sequence[str],
    index_space: Mapping[str, int] | None = None,
    salt: int | None = None,
    reduce: bool = True,
    order: str = "measured",
    skew: float | None = None,
    semi_join: bool = False,
    exact: bool = False,
) -> Tensor:
    """Contract tensors over every index not in ``output``.

    ``output=[]`` gives a one-row tensor holding the total.  With
    ``index_space={name: card}`` the contraction ranges over that space,
    as if every input were joined to the full grid of coordinates without
    building it: coordinates outside ``1..card`` are dropped, an index of
    the space used by no input and not in the output multiplies the result
    by its cardinality, and an output index used by no input is broadcast
    over ``1..card``.  Without ``index_space`` every output index must occur
    in some input.

    ``reduce=False`` skips the final aggregate: the result then holds
    partial products, several rows per output cell, for a caller that
    aggregates them together with other rows anyway (one shuffle instead
    of two).  It is not a tensor until grouped by its indices.

    ``skew=share`` looks for keys that hold that share of an operand's cells
    before every shuffled join (one pass with a sketch of bounded size) and
    spreads them over all partitions.  ``semi_join`` drops cells that take part
    in no product first, where the operands are acyclic; it pays where most
    cells of a large operand have no partner.

    ``exact`` makes every sum independent of the order of its terms (see
    ``functions.exact``): a rerun, on other partitions or after a lost executor,
    agrees in every bit.  Each summation rounds once, to the nearest double.  It
    needs ``reduce``.
    """
    if exact and not reduce:
        raise ValueError("exact sums need reduce=True")
    if not tensors:
        raise ValueError("contract needs at least one tensor")
    output = list(output)
    if len(set(output)) != len(output):
        raise ValueError(f"repeated output index in {output}")
    space = dict(index_space or {})
    if space:
        tensors = [t.restrict(space) for t in tensors]
    used = {i for t in tensors for i in t.indices}
    absent_out = [i for i in output if i not in used]
    for i in absent_out:
        if i not in space:
            raise ValueError(f"output index {i!r} is in no input and has no cardinality")
    multiplier = math.prod(c for i, c in space.items() if i not in used and i not in output)

    ops = [_Operand(t.cells(), list(t.indices), dict(t.cards)) for t in tensors]
    threshold = broadcast_threshold(ops[0].df)

    def needed(exclude: list[_Operand]) -> set[str]:
        return set(output).union(*[set(o.indices) for o in ops if not any(o is e for e in exclude)])

    if semi_join:
        ops = drop_dangling(ops)
    # Sum out indices private to one operand before any join.
    ops = [_sum_out(o, needed([o]), exact) for o in ops]

    if order not in ("measured", "given"):
        raise ValueError("order must be 'measured' or 'given'")
    if order == "measured" and 2 < len(ops) <= MAX_ORDERED:
        tree = join_tree([o.indices for o in ops], measure_sizes(ops), output)

        def build(node, outside: set[str]) -> _Operand:
            if isinstance(node, int):
                return ops[node]
            left, right = node
            below = [{i for n in _leaves(side) for i in ops[n].indices} for side in node]
            a, b = build(left, outside | below[1]), build(right, outside | below[0])
            return _sum_out(_join(a, b, salt, threshold, skew), outside, exact)

        cur = build(tree, set(output))
    else:
        cur = _in_given_order(ops, output, salt, threshold, skew, exact)

    if reduce:
        cur = _sum_out(cur, output, exact)
    else:
        cur = _Operand(cur.df.select(*output, VALUE), list(output),
                       {i: c for i, c in cur.cards.items() if i in output})
    value = F.col(VALUE) if multiplier == 1 else F.col(VALUE) * F.lit(float(multiplier))
    df = cur.df.select(*cur.indices, value.alias(VALUE))
    for i in absent_out:
        df = df.withColumn(i, F.explode(F.sequence(F.lit(1), F.lit(space[i]))))
    cards = {i: c for i, c in {**cur.cards, **space}.items() if i in output}
    return Tensor(df.select(*output, VALUE), tuple(output), cards)


def contract_full_space(
    tensors: Sequence[Tensor], output: Sequence[str], cards: Mapping[str, int]
) -> Tensor:
    """Contraction as a single join of every input to the full index grid.

    This is the plan shape of the original tensor-product operator: build
    every coordinate of the model, inner-join each input on its own
    indices, multiply, and aggregate once.  It is kept as the baseline
    that ``contract`` is measured against; it touches ``Π card`` rows.
    """
    from ..sources.space import index_space

    spark = tensors[0].df.sparkSession
    df = index_space(spark, cards)
    names = []
    for n, t in enumerate(tensors):
        name = f"__v{n}"
        df = df.join(t.cells().withColumnRenamed(VALUE, name), list(t.indices), "inner")
        names.append(name)
    product = F.col(names[0])
    for name in names[1:]:
        product = product * F.col(name)
    df = df.select(*cards, product.alias(VALUE))
    out = list(output)
    agg = df.groupBy(*out) if out else df
    return Tensor(agg.agg(F.sum(VALUE).alias(VALUE)), tuple(out), {i: cards[i] for i in out})
