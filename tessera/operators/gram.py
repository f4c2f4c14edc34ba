"""Sums over the whole grid of a Euclidean (p = 0) model, from Gram matrices.

When the factors of ``X̂ = Σ_k Π_b Z_b(own_b, k)`` have disjoint own indices, a
sum over the grid splits: with ``G_b(k, l) = Σ_own Z_b(own, k) Z_b(own, l)``

    Σ_grid X̂²                 = Σ_kl Π_b G_b(k, l)
    Σ_grid X̂ · Π_{b≠a} Z_b(k) = Σ_l Z_a(own_a, l) · Π_{b≠a} G_b(k, l)

so neither needs the grid.  A Gram matrix is one pass over a factor: every
task adds up the products of its rank vectors and passes on one small matrix,
rank by rank, whatever the number of keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import VALUE, Tensor
from .sampled import decode_rank, rank_vector_model, rank_vectors

_A, _B, _G = "__a", "__b", "__g"


def separable(x: Tensor, factors: Sequence[Tensor]) -> list[str] | None:
    """The rank indices, if the model is one of rank vectors and no index of
    ``x`` belongs to two factors; else None."""
    rank = rank_vector_model(x, factors)
    if rank is None:
        return None
    own = [i for f in factors for i in f.indices if i not in rank]
    return rank if len(own) == len(set(own)) else None


def gram(f: Tensor, rank: Sequence[str], cards: dict[str, int]) -> DataFrame:
    """``G(a, b)`` over pairs of rank positions; one matrix per task is shuffled."""
    length = math.prod(cards[r] for r in rank)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, length)
            total += v.T @ v
        a, b = np.indices((length, length))
        yield pa.record_batch([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(total.ravel())],
                              [_A, _B, _G])

    parts = rank_vectors(f, rank, cards).select("__vec").mapInArrow(products, f"{_A} int, {_B} int, {_G} double")
    return parts.groupBy(_A, _B).agg(F.sum(_G).alias(_G))


def gram_product(factors: Sequence[Tensor], rank: Sequence[str], cards: dict[str, int]) -> DataFrame | None:
    """The element-wise product of the factors' Gram matrices (None: no factor).

    One row per pair of rank positions: a size fixed by the model."""
    out = None
    for n, f in enumerate(factors):
        g = gram(f, rank, cards).withColumnRenamed(_G, f"{_G}{n}")
        out = g if out is None else out.join(g, [_A, _B])
    if out is None:
        return None
    product = F.col(f"{_G}0")
    for n in range(1, len(factors)):
        product = product * F.col(f"{_G}{n}")
    return out.select(_A, _B, product.alias(_G))


def gram_total(factors: Sequence[Tensor], rank: Sequence[str], cards: dict[str, int]) -> DataFrame:
    """``Σ_grid X̂²`` over the keys that the factors store (one row, ``value``)."""
    return gram_product(factors, rank, cards).agg(F.coalesce(F.sum(_G), F.lit(0.0)).alias(VALUE))


def gram_denominator(za: Tensor, others: Sequence[Tensor], rank: Sequence[str], cards: dict[str, int],
                     scale: float = 1.0) -> Tensor:
    """``Σ_grid X̂ · Π_{b≠a} Z_b`` over the indices of ``Z_a``, for every stored key."""
    own = [i for i in za.indices if i not in rank]
    length = math.prod(cards[r] for r in rank)
    vectors = rank_vectors(za, rank, cards)
    product = gram_product(others, rank, cards)
    if product is None:  # no other factor: all products are 1
        total = F.aggregate("__vec", F.lit(0.0), lambda s, e: s + e)
        rows = vectors.select(*own, F.array_repeat(total, length).alias("__d"))
    else:
        # The matrix as one row: its size is the squared rank, fixed by the model.
        flat = product.agg(F.transform(F.sort_array(F.collect_list(F.struct(_A, _B, _G))), lambda c: c[_G]).alias("__m"))
        row = lambda a: F.slice("__m", a * length + 1, F.lit(length))
        dot = lambda a: F.aggregate(F.zip_with(row(a), F.col("__vec"), lambda g, z: g * z),
                                    F.lit(0.0), lambda s, e: s + e)
        rows = vectors.crossJoin(F.broadcast(flat)).select(
            *own, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), dot).alias("__d"))
    cells = rows.select(*own, F.posexplode("__d").alias("__pos", VALUE)).withColumn(VALUE, F.col(VALUE) * F.lit(scale))
    return Tensor(decode_rank(cells, own, rank, cards, [VALUE]).select(*za.indices, VALUE), za.indices, za.cards)
