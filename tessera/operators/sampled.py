"""Contraction evaluated only on the stored cells of an observed tensor.

``sampled_contract(x, factors, combine)`` gives, for every cell ``c`` that
``x`` stores, ``combine(x[c], x̂[c])`` where ``x̂ = contract(factors -> idx x)``.
The model is never built on the full grid of ``x``.

Rank-vector plan.  When every factor carries all of the *rank* indices (the
factor indices that ``x`` does not have) and its other indices belong to
``x`` — matrix and CP-style factorizations, coupled or not — each factor is
regrouped once into one row per key holding a dense vector over the rank
(``Π card`` of the rank indices, a bounded length).  Each cell of ``x`` is
then equi-joined to one vector per factor and ``x̂`` is the sum of their
element-wise product, computed by array functions inside the row.  There is
no fan-out by rank and no regrouping of ``x``: with factors small enough to
broadcast (checked from their cardinalities) the whole computation is a
map-only pass over ``x``; otherwise each factor join is one shuffle of
``x`` on that factor's key (optionally salted).  ``x`` keeps one row per
cell throughout.

``sampled_gradient`` reuses the same pass to emit the numerator and
denominator contributions of a multiplicative update.

The plan is the same for every rank: vectors are array columns, so neither
the plan nor the optimizer's work grows with the rank.  A rank coordinate
outside ``1..card`` raises inside the plan; it is never dropped.  A cell of ``x``
whose key a factor doesn't store has a model of 0; it is never dropped either.

Other shapes fall back to the join/aggregate contraction from the support
of ``x`` followed by a one-to-one join with ``x``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tensor import VALUE, Tensor
from .contract import broadcast_threshold, contract

_X, _HAT, _SALT, _BASE = "__x", "__xhat", "__salt", "__base"


def _rank_indices(x: Tensor, factors: Sequence[Tensor]) -> list[str] | None:
    rank: list[str] = []
    for f in factors:
        for i in f.indices:
            if i not in x.indices and i not in rank:
                rank.append(i)
    if not rank:
        return None
    for f in factors:
        if any(r not in f.indices for r in rank) or any(r not in f.cards for r in rank):
            return None
    return rank


def rank_vector_model(x: Tensor, factors: Sequence[Tensor]) -> list[str] | None:
    """Rank indices when ``x`` and ``factors`` fit the rank-vector plan, else None."""
    rank = _rank_indices(x, factors)
    if rank is None:
        return None
    if not all(all(i in x.indices for i in f.indices if i not in rank) for f in factors):
        return None
    return rank


def rank_vectors(f: Tensor, rank: Sequence[str], cards: dict[str, int]) -> DataFrame:
    """One row per key of ``f`` (its non-rank indices) with a dense rank vector.

    The group of a key holds at most ``Π card(rank)`` cells, a bound fixed by
    the model, so collecting it into one row is safe at any data size.
    """
    own = [i for i in f.indices if i not in rank]
    lin, stride = _rank_position(rank, cards)
    cells = F.sort_array(F.collect_list(F.struct(lin.alias("p"), F.col(VALUE).alias("v")))).alias("__c")
    grouped = f.df.groupBy(*own).agg(cells) if own else f.df.agg(cells)
    # All positions stored: the sorted values are the vector.  Else look them up.
    sparse = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(stride - 1).cast("long")),
        lambda p: F.coalesce(F.try_element_at(F.map_from_entries(F.col("__c")), p), F.lit(0.0)),
    )
    dense = F.when(F.size("__c") == stride, F.transform("__c", lambda c: c["v"])).otherwise(sparse)
    return grouped.select(*own, dense.alias("__vec"))


def _rank_position(rank: Sequence[str], cards: dict[str, int]) -> tuple[Column, int]:
    lin = F.lit(0).cast("long")
    stride = 1
    for r in rank:
        at = F.when(F.col(r).between(1, cards[r]), F.col(r).cast("long")).otherwise(
            F.raise_error(F.lit(f"coordinate of {r} outside 1..{cards[r]}")).cast("long"))
        lin = lin + (at - 1) * F.lit(stride)
        stride *= cards[r]
    return lin, stride


def _join_side(df: DataFrame, x: Tensor, v: DataFrame, own: list[str], small: bool,
               salt: int | None) -> DataFrame:
    if not own:
        return df.crossJoin(F.broadcast(v))  # one row: a rank-only factor
    # A key that the factor doesn't store is a row of zeros, so cells of ``x`` stay.
    if small:
        return df.join(F.broadcast(v), own, "left")
    if salt and salt > 1 and len(x.indices) > len(own):
        # Spread each key's cells of x over ``salt`` tasks; the factor row
        # of the key is copied to each of them.
        rest = [F.col(i) for i in x.indices if i not in own]
        df = df.withColumn(_SALT, F.pmod(F.xxhash64(*rest), F.lit(salt)).cast("int"))
        # Not broadcast: Spark's estimate does not count the copies.
        v = v.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
        return df.join(v, [*own, _SALT], "left").drop(_SALT)
    return df.join(v, own, "left")


def _join_factors(
    x: Tensor, factors: Sequence[Tensor], rank: list[str], salt: int | None, table
) -> tuple[DataFrame, dict[str, int]]:
    """``x`` (value as ``__x``) joined to ``table(factor, n, cards)`` of every factor.

    A factor's table has one row per key (its non-rank indices); it is
    broadcast when its size is proven small from the cardinalities.
    """
    cards = {r: next(f.cards[r] for f in factors if r in f.cards) for r in rank}
    length = math.prod(cards.values())
    threshold = broadcast_threshold(x.df)
    df = x.df.select(*x.indices, F.col(VALUE).alias(_X))
    for n, f in enumerate(factors):
        own = [i for i in f.indices if i not in rank]
        df = _join_side(df, x, table(f, n, cards), own, _small(f, own, length, threshold), salt)
    return df, cards


def _small(f: Tensor, own: list[str], length: int, threshold: int) -> bool:
    """Whether the vectors of ``f`` have a proven size within the broadcast threshold."""
    keys = math.prod(f.cards[i] for i in own) if all(i in f.cards for i in own) else None
    return keys is not None and threshold > 0 and keys * (16 + 8 * (len(own) + length)) <= threshold


def shuffles(x: Tensor, factors: Sequence[Tensor]) -> bool:
    """Whether ``x`` may be shuffled for some factor.

    Its rows then lie partitioned by that factor's key, and an aggregate on
    the key would run in the join's own stage, hot keys and all."""
    rank = rank_vector_model(x, factors)
    if rank is None:
        return True  # joined by the general contraction
    length = math.prod(next(f.cards[r] for f in factors if r in f.cards) for r in rank)
    threshold = broadcast_threshold(x.df)
    return not all(_small(f, [i for i in f.indices if i not in rank], length, threshold) for f in factors)


def _join_vectors(
    x: Tensor, factors: Sequence[Tensor], rank: list[str], salt: int | None
) -> tuple[DataFrame, list[Column], dict[str, int]]:
    """``x`` joined to the rank vector (an array column) of every factor."""
    df, cards = _join_factors(
        x, factors, rank, salt,
        lambda f, n, c: rank_vectors(f, rank, c).withColumnRenamed("__vec", f"__vec{n}"))
    zeros = F.array_repeat(F.lit(0.0), math.prod(cards.values()))
    return df, [F.coalesce(F.col(f"__vec{n}"), zeros) for n in range(len(factors))], cards


def _product(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = F.zip_with(out, c, lambda a, b: a * b)
    return out


def _dot(cols: Sequence[Column]) -> Column:
    return F.aggregate(_product(cols), F.lit(0.0), lambda acc, e: acc + e)


def sampled_contract(
    x: Tensor,
    factors: Sequence[Tensor],
    combine: Callable[[Column, Column], Column] | None = None,
    salt: int | None = None,
) -> Tensor:
    """``combine(x, x̂)`` on the support of ``x`` (default: ``x̂`` itself)."""
    combine = combine or (lambda xv, hat: hat)
    rank = rank_vector_model(x, factors)
    if rank is None:
        ones = Tensor(x.df.select(*x.indices, F.lit(1.0).alias(VALUE)), x.indices, x.cards)
        hat = contract([ones, *factors], x.indices, salt=salt, order="given")
        joined = x.df.select(*x.indices, F.col(VALUE).alias(_X)).join(
            hat.df.select(*x.indices, F.col(VALUE).alias(_HAT)), list(x.indices), "left"
        )
        model = F.coalesce(F.col(_HAT), F.lit(0.0))  # a cell that the model doesn't reach is 0 there
        df = joined.select(*x.indices, combine(F.col(_X), model).alias(VALUE))
        return Tensor(df, x.indices, x.cards)
    df, vecs, _ = _join_vectors(x, factors, rank, salt)
    rows = df.select(*x.indices, F.col(_X), _dot(vecs).alias(_HAT))
    out = rows.select(*x.indices, combine(F.col(_X), F.col(_HAT)).alias(VALUE))
    return Tensor(out, x.indices, x.cards)


def sampled_gradient(
    x: Tensor,
    factors: Sequence[Tensor],
    target: int,
    outputs: dict[str, Callable[[Column, Column], Column]],
    salt: int | None = None,
) -> DataFrame:
    """Per stored cell of ``x``, its contribution to factor-shaped sums.

    For ``Z_a = factors[target]`` and each ``name -> q(x, x̂)`` this emits
    rows ``(indices of Z_a, one column per name)`` whose sum per cell of
    ``Z_a`` is ``contract(q(x, x̂), Z_b for b ≠ a -> idx Z_a)`` — the
    numerator or denominator of a multiplicative update.  ``x̂`` and every
    ``q`` come from the single pass that joins each cell to the rank
    vectors, so no other join is needed.  The rank is unrolled with
    ``posexplode`` and the rows are left unreduced for the caller's
    aggregate, whose partial sums collapse them to at most one row per cell
    of ``Z_a`` and task (see ``shuffles`` for joins on the same keys).
    """
    rank = rank_vector_model(x, factors)
    if rank is None:
        raise ValueError("factors do not share a rank index covering the model")
    own_a = [i for i in factors[target].indices if i not in rank]
    names = list(outputs)
    df, vecs, cards = _join_vectors(x, factors, rank, salt)
    length = math.prod(cards.values())
    others = [v for n, v in enumerate(vecs) if n != target]
    base = _product(others) if others else F.array_repeat(F.lit(1.0), length)
    hats = df.select(*own_a, F.col(_X), _dot(vecs).alias(_HAT), base.alias(_BASE))
    # Each q is computed once per cell, below the generator, not once per rank position.
    rows = hats.select(*own_a, _BASE, *[outputs[n](F.col(_X), F.col(_HAT)).alias(n) for n in names])
    exploded = rows.select(*own_a, *names, F.posexplode(_BASE).alias("__pos", "__e"))
    exploded = exploded.select(*own_a, "__pos", *[(F.col("__e") * F.col(n)).alias(n) for n in names])
    return decode_rank(exploded, own_a, rank, cards, names)


def decode_rank(df: DataFrame, own: list[str], rank: Sequence[str], cards: dict[str, int],
                 names: list[str]) -> DataFrame:
    """Turn the rank position ``__pos`` back into 1-based rank coordinates."""
    coords, stride = [], 1
    for r in rank:
        quotient = F.expr(f"CAST(__pos AS BIGINT) div {stride}")
        coords.append((F.pmod(quotient, F.lit(cards[r])) + 1).cast("int").alias(r))
        stride *= cards[r]
    return df.select(*own, *coords, *names)
