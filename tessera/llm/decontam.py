"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are searched inside long documents.  Both are sets of
5-word shingles (64-bit hashes; ASCII lower case).  Items are partitioned by
the size of their set.  An item of n shingles has a bottom-k MinHash sketch
with k = n - ceil(t n) + 1: a document that contains a share t of the item
misses at most k - 1 of its shingles, so it holds at least one of any k, and
the search is exact.  A document probes with the part of its own shingles
that is small enough to be in a sketch: below the largest sketch value of the
partitions whose items it is large enough to contain.  Sketch hits are verified by exact containment.

The search is one pass without a shuffle: items are a query set and go
through in blocks of bounded size, each of which is small enough to
broadcast; a document's shingles never leave its task.  A block is two tables:
a row per sketch value, and each item's array once.  Items of more than
``LARGE_SHINGLES`` shingles are not broadcast: only documents that are large
enough to contain one are joined with them, shingle by shingle.  Only Spark's
own functions are used.

Defined results: an item of fewer than five words has its whole sequence as
its only shingle, so it matches only documents that are that sequence; items
without words match nothing; null and empty documents match nothing; repeated
items and documents give a row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, words

SHINGLE = 5
THRESHOLD = 0.75
#: Shingles of items per block, on average; a block's tables stay within some tens of MB.
BLOCK_SHINGLES = 400_000
#: Items with more shingles are joined instead of broadcast.
LARGE_SHINGLES = 50_000


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of the n-word shingles; of the whole sequence if it is shorter."""
    w = F.transform(words(ascii_lower(text)), lambda x: F.xxhash64(x))
    # The word hashes are evaluated once, as a lambda argument.
    def grams(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(1))),
                           lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(n)]))
        return F.when(F.size(h) >= n, F.array_distinct(many)).when(
            F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(w), grams)[0]


def sketches(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD,
             n: int = SHINGLE) -> DataFrame:
    """``id_col``, ``n_item``, ``size_band`` (the partition), ``sketch`` (the
    k smallest hashes) and ``item`` (all of them) per item with words."""
    src = items.select(F.col(id_col), F.sort_array(shingles(F.col(text_col), n)).alias("item"))
    src = src.withColumn("n_item", F.size("item")).where("n_item > 0")
    needed = F.ceil(F.col("n_item") * threshold - 1e-9)
    return src.withColumn("size_band", F.floor(F.log2("n_item")).cast("int")).withColumn(
        "sketch", F.expr("slice(item, 1, n_item + 1)") if threshold <= 0
        else F.slice("item", F.lit(1), (F.col("n_item") - needed + 1).cast("int")))


def find_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
               n: int = SHINGLE, keep: list[str] | None = None, block_shingles: int = BLOCK_SHINGLES,
               large_shingles: int = LARGE_SHINGLES) -> DataFrame:
    """Pairs (``id_col``, ``keep``, ``item_col``, size_band, n_item, n_shared,
    containment) whose containment of the item in the document reaches
    ``threshold``."""
    sketch = cut(sketches(items, id_col=item_col, text_col=item_text, threshold=threshold, n=n)
                 .withColumn("_item_key", F.monotonically_increasing_id()), "sketches")
    # One row per size band: its largest sketch value, its smallest item.
    parts = sketch.groupBy((F.col("n_item") > large_shingles).alias("large"), "size_band").agg(
        F.sum("n_item").alias("n"), F.min("n_item").alias("least"), F.max(F.element_at("sketch", -1)).alias("top")).collect()
    small = sketch.where(F.col("n_item") <= large_shingles)
    bands = [r for r in parts if not r["large"]]
    blocks = max(1, math.ceil(sum(r["n"] for r in bands) / block_shingles))
    # A document can only contain items of the bands it is large enough for, and
    # can only meet sketch values up to the largest one of those.
    limit = F.lit(-(1 << 63))
    for r in sorted(bands, key=lambda r: r["size_band"]):
        enough = F.size("_shingles") >= math.ceil(r["least"] * threshold - 1e-9)
        limit = F.when(enough, F.greatest(limit, F.lit(r["top"]))).otherwise(limit)
    kept = [F.col(c) for c in [id_col, *(keep or [])]]
    doc = docs.select(*kept, shingles(F.col(text_col), n).alias("_shingles"))
    probes = doc.withColumn("_limit", limit).select(
        *doc.columns, F.explode(F.filter("_shingles", lambda h: h <= F.col("_limit"))).alias("_h"))
    needed = F.ceil(F.col("n_item") * threshold - 1e-9)
    out = [id_col, *(keep or []), F.col("_item").alias(item_col), "size_band", "n_item", "n_shared",
           (F.col("n_shared") / F.col("n_item")).alias("containment")]
    found = None
    for b in range(blocks):
        block = small.where(F.pmod(F.xxhash64("_item_key"), F.lit(blocks)) == b)
        index = block.select("_item_key", "n_item", F.posexplode("sketch").alias("_pos", "_h"))
        whole = block.select("_item_key", F.col(item_col).alias("_item"), "size_band", F.col("item").alias("_members"))
        # One hit per pair stays: that of the smallest sketch value the document holds.
        first = (F.col("_pos") == 0) | ~F.arrays_overlap(F.slice("_members", F.lit(1), F.col("_pos")), "_shingles")
        hits = (probes.join(F.broadcast(index), "_h").where(F.size("_shingles") >= needed)
                .join(F.broadcast(whole), "_item_key").where(first)
                .withColumn("n_shared", F.size(F.array_intersect("_members", "_shingles")))
                .where(F.col("n_shared") >= needed).select(*out))
        found = hits if found is None else found.unionByName(hits)
    if any(r["large"] for r in parts):
        large = sketch.where(F.col("n_item") > large_shingles)
        least = math.ceil((large_shingles + 1) * threshold - 1e-9)
        wide = cut(doc.where(F.size("_shingles") >= least).withColumn("_doc", F.monotonically_increasing_id()), "wide")
        shared = (wide.select("_doc", F.explode("_shingles").alias("_h"))
                  .join(large.select("_item_key", F.explode("item").alias("_h")), "_h")
                  .groupBy("_doc", "_item_key").agg(F.count(F.lit(1)).cast("int").alias("n_shared")))
        names = large.select("_item_key", F.col(item_col).alias("_item"), "size_band", "n_item")
        found = found.unionByName(shared.join(names, "_item_key").where(F.col("n_shared") >= needed)
                                  .join(wide.drop("_shingles"), "_doc").select(*out))
    return found
