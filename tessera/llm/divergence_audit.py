"""Audit of how the sources of a language diverge, by dominance skybands.

Terms are counted per (language, source) group and per language; a language
keeps the terms that at least ``MIN_DOCS`` of its documents hold.  Smoothed
shares ``p`` are whole numbers in billionths, and the divergence of two shares
is ``f(p, q) = floor((p - q)^2 / (p + q))``; all arithmetic is exact.

* **Pairs of sources.**  The sum of f over all kept terms of the language.
  Terms that neither of two sources holds add the same amount each, so only
  the terms of either are summed: each task adds its terms' differences to
  what they would be for absent terms, for blocks of sources by blocks of sources.
* **Terms of a group.**  For p above the language's q, f rises with the group's
  count and falls with the language's.  A term is dominated by another one of
  no lower group count, no higher language count and earlier UTF-8; one that is
  dominated by k others can't be among the first k.  Every partition keeps
  the skyband of each group, the terms dominated by fewer than k others there;
  skybands are merged by shares of a group, and what is left is ranked exactly.

Counting is one pass over the texts.  A task sums its terms in a table of
bounded size and passes it on whenever it is full, so a frequent term or a hot
source is a few rows per task.  Groups and languages are never collected; the
driver sees nothing.

Defined results: null texts, languages and sources are empty strings; a group
without terms has counts of 0 throughout; a language without kept terms has
pairs of value 0 and no terms; repeated rows count as often as they occur; an
empty table gives no rows; a term's bytes that are no UTF-8 are kept as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

MIN_DOCS, TOP = 10, 10
#: Entries of a task's table of counts.
ENTRIES = 400_000
#: Bytes of a text split at once.
PIECE = 1 << 22
#: Sources per block of pairs, and terms compared at once.
BLOCK, TERMS = 64, 2048
#: Shares that the skybands of one group are merged in.
SHARES = 32

_FOLD = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER
              else b if b >= 0x80 or chr(b) in LOWER else 0x20 for b in range(256))


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data``, of about ``PIECE`` bytes at a time."""
    at = 0
    while at < len(data):
        stop = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def count_terms(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``d`` (documents),
    in parts to be summed; the null term has a row for every group."""
    blank = F.lit("")
    src = docs.select(F.coalesce(lang_col, blank).alias("lang"), F.coalesce(source_col, blank).alias("source"),
                      F.coalesce(text_col, blank).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                terms = list(n)
                yield pa.record_batch([
                    pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()),
                    pa.array([None, *terms], pa.binary()), pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(d.__getitem__, terms)], pa.int64())], ["lang", "source", "term", "n", "d"])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                n, d = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in pieces(text.as_py().translate(_FOLD)):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                size += len(n) - before + 1
                if size > ENTRIES:
                    yield from flush()
                    size = 0
        yield from flush()

    return src.mapInArrow(run, "lang string, source string, term binary, n long, d long")


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 * count / total)`` for ``count <= total < 9 * 10^15``, by
    long division in steps of a thousand, so that nothing overflows."""
    whole, rest = F.lit(0).cast("long"), count.cast("long")
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", rest, total), rest % total
    return whole + 1


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    whole, rest = np.zeros(len(count), np.int64), count.astype(np.int64)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def dominated(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Which rows k others dominate.  Rows come by ``n`` falling, then
    ``lang_n`` rising, then ``term`` rising: dominators come first."""
    out = np.zeros(len(n), bool)
    out[k:] = (n[k:] == n[:-k]) & (lang_n[k:] == lang_n[:-k])  # k rows of equal counts and earlier terms
    rows = np.flatnonzero(~out)
    held = np.zeros(0, np.int64)  # the skyband so far; whoever it leaves out has k dominators in it
    for a in range(0, len(rows), 512):
        part = rows[a:a + 512]
        before = np.r_[held, part]
        over = ((lang_n[before] <= lang_n[part][:, None]) & (term[before] < term[part][:, None])
                & (np.arange(len(before)) < (len(held) + np.arange(len(part)))[:, None]))
        out[part] = over.sum(axis=1) >= k
        held = np.r_[held, part[~out[part]]]
    return out


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition's rows (lang, source, term, n, lang_n), per group those
    that fewer than ``k`` others of the partition dominate."""

    def prune(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("source", "ascending"), ("n", "descending"),
                               ("lang_n", "ascending"), ("term", "ascending")])
        keys = [pc.rank(table.column(c), tiebreaker="dense").to_numpy() for c in ("lang", "source", "term")]
        n, lang_n = (table.column(c).to_numpy() for c in ("n", "lang_n"))
        new = np.flatnonzero(np.r_[True, (np.diff(keys[0].astype(np.int64)) != 0) | (np.diff(keys[1].astype(np.int64)) != 0)])
        keep = np.ones(len(n), bool)
        for a, b in zip(new, np.r_[new[1:], len(n)]):
            keep[a:b] = ~dominated(n[a:b], lang_n[a:b], keys[2][a:b], k)
        return table.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > ENTRIES // 2:
                table = prune(pa.Table.from_batches(held))
                held, size = table.to_batches(), table.num_rows
                if size > ENTRIES // 4:  # many groups: a skyband is only a filter, so it may be passed on early
                    yield from held
                    held, size = [], 0
        if size:
            yield from prune(pa.Table.from_batches(held)).to_batches()

    return rows.select("lang", "source", "term", "n", "lang_n").mapInArrow(
        run, "lang string, source string, term binary, n long, lang_n long")


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``a`` < ``b`` and ``value`` of all pairs of sources of a language.

    Sources are dealt to blocks and terms to chunks of about ``TERMS``, both by
    hash; a task compares two blocks over one chunk."""
    blocks = F.ceil(F.col("n_sources") / BLOCK).cast("int")
    dealt = groups.withColumn("b", F.pmod(F.xxhash64("source"), blocks).cast("int")).withColumn(
        "x", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("lang", "source", "b", "total", "v", F.least("b", "x").alias("bi"), F.greatest("b", "x").alias("bj"),
                         F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("int").alias("chunks"))
    none = F.lit(None).cast("long")
    heads = dealt.select("lang", "bi", "bj", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "b",
                         "source", none.alias("tid"), none.alias("n"), "total", "v")
    cells = kept.join(dealt, ["lang", "source"]).select(
        "lang", "bi", "bj", F.pmod(F.xxhash64("tid"), F.col("chunks")).cast("int").alias("chunk"), "b", "source", "tid", "n",
        none.alias("total"), none.alias("v"))

    def compare(block: pa.Table) -> pa.Table:
        head = block.filter(pc.is_null(block.column("tid"))).combine_chunks()
        cell = block.filter(pc.is_valid(block.column("tid"))).combine_chunks()
        names = head.column("source").to_pylist()
        at = {s: i for i, s in enumerate(names)}
        total, side = head.column("total").to_numpy(), head.column("b").to_numpy()
        chunk, v = head.column("chunk")[0].as_py(), head.column("v")[0].as_py()
        bi, bj = (block.column(c)[0].as_py() for c in ("bi", "bj"))
        absent = shares(np.full(len(names), 2), total) if v else np.ones(len(names), np.int64)
        ids, where = np.unique(cell.column("tid").to_numpy(), return_inverse=True)
        row = np.array([at[s] for s in cell.column("source").to_pylist()], np.int64)
        p = np.repeat(absent[:, None], len(ids), axis=1)
        if len(row):
            p[row, where] = shares(cell.column("n").to_numpy() + 2, total[row])
        left, right = np.flatnonzero(side == bi), np.flatnonzero(side == bj)
        out_a, out_b, out_v = [], [], []
        for i in left.tolist():
            others = right[right > i] if bi == bj else right
            if not len(others):
                continue
            base = divergence(absent[others], absent[i])
            value = divergence(p[others], p[i]).sum(axis=1) - base * len(ids) + (base * v if chunk == 0 else 0)
            out_a += [min(names[i], names[j]) for j in others.tolist()]
            out_b += [max(names[i], names[j]) for j in others.tolist()]
            out_v += value.tolist()
        lang = block.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(out_a), pa.string()), "a": pa.array(out_a, pa.string()),
                         "b": pa.array(out_b, pa.string()), "value": pa.array(out_v, pa.int64())})

    parts = heads.unionByName(cells).groupBy("lang", "bi", "bj", "chunk").applyInArrow(
        compare, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: every other
    source of the language (part ``pair``) and the first ``top`` terms that the
    group uses more than its language does (part ``term``)."""
    parts = count_terms(docs, text_col=text_col, lang_col=lang_col, source_col=source_col)
    counts = cut(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")
    vocab = cut(counts.where("term IS NOT NULL").groupBy("lang", "term")
                .agg(F.sum("n").alias("lang_n"), F.sum("d").alias("_d")).where(F.col("_d") >= min_docs)
                .select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("tid")), "vocabulary")
    kept = cut(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(vocab, ["lang", "term"]), "kept")
    langs = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    every = counts.where("term IS NULL").select("lang", "source")
    sizes = every.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    zero = F.lit(0).cast("long")
    groups = cut(every.join(sizes, "lang").join(langs, "lang", "left").join(own, ["lang", "source"], "left").select(
        "lang", "source", "n_sources", F.coalesce("v", zero).alias("v"),
        (F.coalesce("own_total", zero) + 2 * F.coalesce("v", zero)).alias("total"),
        (F.coalesce("lang_total", zero) + 2 * F.coalesce("v", zero)).alias("lang_total")), "groups")

    pairs = pair_values(kept, groups)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item",
                                                                  "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    first = skybands(kept, top).withColumn("_s", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(SHARES)))
    merged = skybands(first.repartition("lang", "source", "_s"), top)
    p, q = share(F.col("n") + 2, F.col("total")), share(F.col("lang_n") + 2, F.col("lang_total"))
    valued = merged.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
