"""Blocked layout of an observed tensor, for factor updates without fan-out.

The keys of every factor are hashed into parts; a cell of ``X`` lies in the
block of its keys' parts.  ``X`` is written once, partitioned by block, and stays
there: a pass sends each block the rank vectors of its parts, and the block
gives back one vector per key it holds, so the rows out of a pass are at most
keys times blocks, whatever the rank and the number of cells.

Large factors are split into more parts than small ones.  A block that is
still too large, because one key holds a large share of ``X``, is dealt to
several pieces by the hash of the whole cell; its vectors go to each of them.
Blocks are small enough to hold in a task, and are worked through in
chunks of cells.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_dir
from ..tensor import VALUE, Tensor
from .contract import broadcast_threshold
from .sampled import decode_rank, rank_vector_model, rank_vectors

#: Cells per block, and numbers (cells times rank) worked on at once.
BLOCK_CELLS, CHUNK = 500_000, 1 << 20
_BLOCK, _X, _N, _PIECES = "__block", "__x", "__n", "__pieces"


@dataclass(frozen=True)
class BlockedTensor:
    """``X`` by block, the factors' own indices, and the blocks' parts and pieces."""

    cells: DataFrame  # __block, indices of X, __x; partitioned by block
    blocks: DataFrame  # __block (of the first piece), __part0.., __pieces
    owns: tuple[tuple[str, ...], ...]
    parts: tuple[int, ...]
    partitions: int


def _part(own: Sequence[str], parts: int):
    return F.pmod(F.xxhash64(*own), F.lit(parts)) if own and parts > 1 else F.lit(0).cast("long")


def split_parts(keys: Sequence[float], blocks: int) -> list[int]:
    """Parts per factor, ``blocks`` in all: always the largest parts are halved."""
    parts = [1] * len(keys)
    while math.prod(parts) < blocks:
        n = max(range(len(keys)), key=lambda i: keys[i] / parts[i])
        if keys[n] / parts[n] <= 1:
            break
        parts[n] *= 2
    return parts


def blocked(x: Tensor, factors: Sequence[Tensor], block_cells: int = BLOCK_CELLS) -> BlockedTensor:
    """Write ``x`` by block: a table in the folder for checkpoints, bucketed by
    block, so that no pass shuffles it.  One count of its cells, and one of its
    blocks, is taken first."""
    rank = rank_vector_model(x, factors)
    if rank is None:
        raise ValueError("factors do not share a rank index covering the model")
    owns = tuple(tuple(i for i in f.indices if i not in rank) for f in factors)
    spark = x.df.sparkSession
    total = x.df.count()
    wide = max(spark.sparkContext.defaultParallelism, -(-total // block_cells))
    keys = [math.prod(f.cards.get(i, total or 1) for i in own) if own else 1 for f, own in zip(factors, owns)]
    parts = split_parts(keys, wide)
    names = [f"__part{n}" for n in range(len(owns))]
    number = F.lit(0).cast("long")
    for name, k in zip(names, parts):
        number = number * k + F.col(name)
    rows = x.df.select(*x.indices, F.col(VALUE).alias(_X), *[_part(o, k).alias(n) for n, o, k in zip(names, owns, parts)])
    rows = rows.withColumn(_BLOCK, number)
    pieces = F.ceil(F.count(F.lit(1)) / block_cells).cast("long")
    blocks = rows.groupBy(_BLOCK, *names).agg(pieces.alias(_PIECES)).checkpoint()
    step = math.prod(parts)  # piece m of block b is block b + m * step
    piece = F.pmod(F.xxhash64(F.lit(17), *x.indices), F.col(_PIECES))
    dealt = rows.join(blocks.select(_BLOCK, _PIECES), _BLOCK).select(
        (F.col(_BLOCK) + piece * step).alias(_BLOCK), *x.indices, _X)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"tessera_blocks_{uuid.uuid4().hex}"
    (dealt.repartition(partitions, _BLOCK).write.option("path", f"{checkpoint_dir(spark)}/{name}")
     .bucketBy(partitions, _BLOCK).sortBy(_BLOCK).saveAsTable(name))
    return BlockedTensor(spark.table(name), blocks, owns, tuple(parts), partitions)


def vectors_by_block(layout: BlockedTensor, x: Tensor, factors: Sequence[Tensor], rank: Sequence[str],
                     cards: dict[str, int]) -> DataFrame:
    """The rank vectors that each block needs: its number, the factor's, the key, the vector."""
    types = {f.name: f.dataType for f in x.df.schema.fields}
    step = math.prod(layout.parts)
    out = None
    for n, (f, own, parts) in enumerate(zip(factors, layout.owns, layout.parts)):
        # Keys get the types that X has them in, as hashes depend on them.
        v = rank_vectors(f, rank, cards).withColumns({i: F.col(i).cast(types[i]) for i in own})
        v = v.withColumn(f"__part{n}", _part(own, parts))
        side = layout.blocks.select(_BLOCK, f"__part{n}", _PIECES)
        v = v.join(side, f"__part{n}").withColumn("__m", F.explode(F.sequence(F.lit(0).cast("long"), F.col(_PIECES) - 1)))
        v = v.select((F.col(_BLOCK) + F.col("__m") * step).alias(_BLOCK), F.lit(n).alias(_N),
                     *[(F.col(i) if i in own else F.lit(None)).cast(types[i]).alias(i) for i in x.indices], "__vec")
        out = v if out is None else out.unionByName(v)
    return out


def _match(cells: list, keys: list) -> np.ndarray:
    """The row of ``keys`` that each of ``cells`` equals, column by column; -1: none."""
    if not cells:
        return np.zeros(0, np.int64)
    at = key = None
    for c, k in zip(cells, keys):
        seen = pc.unique(k)
        a, b = (pc.fill_null(pc.index_in(v, value_set=seen), -1).to_numpy().astype(np.int64) for v in (c, k))
        n = max(1, len(seen))
        at, key = (a, b) if at is None else (np.where((at < 0) | (a < 0), -1, at * n + a), key * n + b)
    order = np.argsort(key, kind="stable")
    place = np.minimum(np.searchsorted(key[order], at), max(0, len(key) - 1))
    hit = order[place] if len(key) else np.zeros(len(at), np.int64)
    return np.where((at >= 0) & (key[hit] == at), hit, -1) if len(key) else np.full(len(at), -1)


def blocked_gradient(layout: BlockedTensor, x: Tensor, factors: Sequence[Tensor], target: int, p: float,
                     masked: bool, names: Sequence[str]) -> DataFrame:
    """Numerators (and, if ``masked``, denominators) of the update of
    ``factors[target]``: its indices and one column per name, partial sums of
    one block per row.  The same sums as ``sampled_gradient`` makes."""
    rank = rank_vector_model(x, factors)
    cards = {r: next(f.cards[r] for f in factors if r in f.cards) for r in rank}
    length = math.prod(cards.values())
    owns, indices = layout.owns, list(x.indices)
    own_a = list(owns[target])
    types = {f.name: f.dataType.simpleString() for f in x.df.schema.fields}
    n_out = 2 if masked else 1

    def update(cells: pa.Table, vectors: pa.Table) -> pa.Table:
        cells, vectors = cells.combine_chunks(), vectors.combine_chunks()
        number = vectors.column(_N).to_numpy()
        tables, rows, mine = [], [], None
        for n, own in enumerate(owns):
            part = vectors.filter(pa.array(number == n)).combine_chunks()
            flat = part.column("__vec").combine_chunks()
            flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
            # One more row, of zeros, for keys that the factor doesn't store.
            tables.append(np.vstack([flat.reshape(part.num_rows, length), np.zeros(length)]))
            at = _match([cells.column(i) for i in own], [part.column(i) for i in own])
            rows.append(at if own else np.zeros(cells.num_rows, np.int64) if part.num_rows else np.full(cells.num_rows, -1))
            mine = part if n == target else mine
        value = cells.column(_X).to_numpy()
        size = mine.num_rows
        sums = np.zeros((n_out, length, size + 1))
        step = max(1, CHUNK // length)
        for a in range(0, len(value), step):
            b = min(len(value), a + step)
            base = np.ones((b - a, length))
            for n, table in enumerate(tables):
                if n != target:
                    base *= table[rows[n][a:b]]
            where = np.where(rows[target][a:b] < 0, size, rows[target][a:b])
            hat = np.einsum("ij,ij->i", base, tables[target][where])
            with np.errstate(all="ignore"):
                weights = [np.where(hat == 0, 0.0, value[a:b] * hat ** -p)]
                if masked:
                    power = hat ** (1.0 - p)
                    weights.append(np.where(hat == 0, 0.0, power) if p > 1 else power)
            if not all(np.isfinite(w).all() for w in weights):
                raise ValueError("invalid value (NULL, NaN or infinite) in X / X̂^p")
            for o, w in enumerate(weights):
                for k in range(length):
                    sums[o, k] += np.bincount(where, base[:, k] * w, size + 1)
        met = np.unique(rows[target])
        met = met[met >= 0]
        out = {i: mine.column(i).take(pa.array(met)) for i in own_a}
        for o in range(n_out):
            flat = np.ascontiguousarray(sums[o][:, met].T).ravel()
            out[f"__v{o}"] = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * length, pa.int32()), pa.array(flat))
        return pa.table(out)

    schema = ", ".join([*[f"`{i}` {types[i]}" for i in own_a], *[f"__v{o} array<double>" for o in range(n_out)]])
    sent = vectors_by_block(layout, x, factors, rank, cards).repartition(layout.partitions, _BLOCK)
    found = layout.cells.groupBy(_BLOCK).cogroup(sent.groupBy(_BLOCK)).applyInArrow(update, schema)
    zipped = F.posexplode(F.arrays_zip(*[f"__v{o}" for o in range(n_out)])).alias("__pos", "__c")
    cells = found.select(*own_a, zipped).select(
        *own_a, "__pos", *[F.col(f"__c.__v{o}").alias(name) for o, name in zip(range(n_out), names)])
    return decode_rank(cells, own_a, rank, cards, list(names[:n_out]))


def worth_blocking(x: Tensor, factors: Sequence[Tensor]) -> bool:
    """Whether vectors may have to be shuffled to cells, or the rank is so large
    that a row per cell and rank position costs more than blocks do."""
    rank = rank_vector_model(x, factors)
    if rank is None:
        return False
    cards = {r: next(f.cards[r] for f in factors if r in f.cards) for r in rank}
    length = math.prod(cards.values())
    keys = [math.prod(f.cards[i] for i in f.indices if i not in rank) if all(i in f.cards for i in f.indices) else math.inf
            for f in factors]
    limit = broadcast_threshold(x.df)
    return length >= 16 or any(k * (24 + 8 * length) > limit for k in keys)
