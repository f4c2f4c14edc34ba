"""Trie of conversation prefixes by composable fingerprints.

Conversations are rebuilt: the first ``h`` turns of a base conversation (the
head) are followed by a conversation's own turns after its first ``h`` (the
suffix).  No rebuilt text is ever made.  A sequence of turns x1..xn has the
fingerprint (n, x1 B + x2 B^2 + ... + xn B^n) modulo a prime; fingerprints form a
monoid under (n, s)(m, t) = (n + m, s + B^n t).  Every stored turn keeps the
fingerprint of its conversation up to itself, so that of a rebuilt prefix
follows from three stored ones: the base's head times the own prefix without its
first ``h`` turns.  ``LANES`` primes side by side make collisions unlikely.

Nodes of the trie are groups of equal (depth, fingerprint).  Equality is then
proved by the stored turns that prefixes refer to: a turn's value stands for one
role and text among all of them, and the members of a group share their parent
group and the value of their last turn, so by induction over the depth they are
equal turn by turn.  If a value stands for two contents, or a group fails, all
is done again with another seed.

Subtrees need no walk.  A conversation is the smallest member of a chain of
nodes that ends where it ends; what a node adds to its ancestors is booked to
that conversation, and each node sums the bookings of its members.

Turns are numbered by a range-partitioned sort: a conversation of any length is
split over partitions, whose counts and sums are combined.  The digest of a
node's ends is fed from chunks of sorted ids; it is sequential by nature, but
only passes over those chunks, in bounded memory.

Defined results: null roles and texts are empty; null turns come first, equal
turns in order of role and text; rows without a conversation id belong to no
conversation; repeated rows are turns of their own; a conversation whose rebuilt
form has no turn is a member of the root only; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

GROUP, HEAD = 100, 6
LANES = 4
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525, 22695477, 134775813)
#: Tries with other seeds before giving up.
SEEDS = 8
#: Characters of sorted ids per chunk of a digest.
CHUNK = 1 << 20
#: Turns of a conversation per bucket of the suffix sums.
SPAN = 4096


def lanes(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(LANES)]


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("int")


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % GROUP


def weighted(rows: DataFrame) -> DataFrame:
    """Add ``t0..``: each turn's value times the base to its place."""
    names, n = rows.columns, LANES
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(names.index("pos")).to_numpy()
            out = []
            for i in range(n):
                prime = np.uint64(PRIMES[i])
                power, square, left = np.ones(len(place), np.uint64), np.uint64(BASES[i] % PRIMES[i]), place.copy()
                while left.any():
                    power = np.where(left & 1, power * square % prime, power)
                    square, left = square * square % prime, left >> 1
                value = batch.column(names.index(f"x{i}")).to_numpy().astype(np.uint64)
                out.append(pa.array((power * value % prime).astype(np.int64)))
            yield pa.record_batch([*batch.columns, *out], [*names, *[f"t{i}" for i in range(n)]])

    return rows.mapInArrow(run, f"{schema}, " + ", ".join(f"t{i} long" for i in range(n)))


def store_turns(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The stored turns (``role``, ``text`` and value ``x0..``), and of each, without its
    text, ``conv_id``, ``pos`` (from 1), ``chars``, ``x0..``, the weighted value
    ``t0..`` and the fingerprint ``f0..`` up to it."""
    turns = rows.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    values = [F.pmod(F.xxhash64(F.lit(seed * LANES + i), "role", "text"), F.lit(p)).alias(f"x{i}")
              for i, p in enumerate(PRIMES[:LANES])]
    order = ["conv_id", "turn", "role", "text"]
    # Row numbers rise with the order, partitions included.
    placed = cut(turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "role", "text", F.length("text").cast("long").alias("chars"), *values,
        F.monotonically_increasing_id().alias("row")).withColumn("part", F.shiftright("row", 33)), "turns")
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "part").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    pos = (F.col("row") - F.col("_first") + F.col("_before") + 1).alias("pos")
    numbered = cut(weighted(placed.drop("role", "text").join(parts.drop("_n"), ["conv_id", "part"]).select(
        "conv_id", "part", "chars", *lanes("x"), pos)), "weighted")
    # Running sums inside a partition, then the sums of the partitions before.
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = numbered.groupBy("conv_id", "part").agg(*[F.sum(t).alias(f"_{t}") for t in lanes("t")])
    sums = sums.select("conv_id", "part", *[F.coalesce(F.sum(f"_{t}").over(upto), F.lit(0)).alias(f"_{t}") for t in lanes("t")])
    running = numbered.select("*", *[F.sum(t).over(inside).alias(f"f{i}") for i, t in enumerate(lanes("t"))])
    return placed, cut(running.join(sums, ["conv_id", "part"]).select(
        "conv_id", "pos", "chars", *lanes("x"), *lanes("t"),
        *[((F.col(f"f{i}") + F.col(f"_t{i}")) % PRIMES[i]).alias(f"f{i}") for i in range(LANES)]), "fingerprints")


def ambiguous(stored: DataFrame) -> int:
    """Number of values that stand for several contents of stored turns."""
    return stored.select(*lanes("x"), "role", "text").distinct().groupBy(*lanes("x")).count().where("count > 1").count()


def rebuilt_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (``member``, ``length``), and a row for each of
    their prefixes: ``member``, ``depth``, the fingerprints ``f0..`` and, of the
    prefix one turn shorter, ``g0..``; the last turn's value ``x0..`` and
    ``chars``."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    # Up to HEAD - 1 turns of every conversation: what heads are made of.
    first = turns.where(F.col("pos") < HEAD).groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("pos", "chars", *lanes("x"), *lanes("t"), *lanes("f")))).alias("first"))
    own = lengths.join(first, "conv_id")
    plan = own.select(F.col("conv_id").alias("member"), "n", F.col("first").alias("own"),
                      head_length(F.col("conv_id")).alias("h"), base_of(F.col("conv_id")).alias("base"))
    plan = plan.join(own.select(F.col("conv_id").alias("base"), F.col("first").alias("head")), "base", "left")
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.array().cast(plan.schema["head"].dataType)), F.lit(1), F.col("h")))
    plan = plan.withColumn("taken", F.size("head"))

    def at(array: str, n: str, lane: str) -> Column:  # the fingerprint of the first n turns
        return F.coalesce(F.get(F.col(array), F.col(n) - 1)[lane], F.lit(0).cast("long"))

    plan = cut(plan.select(
        "member", "h", "taken", "head", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        *[at("head", "taken", f"f{i}").alias(f"a{i}") for i in range(LANES)],
        *[at("own", "h", f"f{i}").alias(f"b{i}") for i in range(LANES)]), "rebuilt")
    kept = ["x", "f", "g"]
    heads = plan.select("member", F.explode("head").alias("u")).select(
        "member", F.col("u.pos").alias("depth"), F.col("u.chars").alias("chars"), *[f"u.{c}" for c in lanes("x")],
        *[f"u.{c}" for c in lanes("f")],
        *[F.pmod(F.col(f"u.f{i}") - F.col(f"u.t{i}"), F.lit(PRIMES[i])).alias(f"g{i}") for i in range(LANES)])
    # A suffix moves from behind h turns to behind the head: a power of the base from -HEAD to 0.
    tail = turns.select(F.col("conv_id").alias("member"), "pos", "chars", *lanes("x"), *lanes("t"), *lanes("f")).join(
        plan.select("member", "h", "taken", *lanes("a"), *lanes("b")), "member").where("pos > h")

    def moved(i: int, end: Column) -> Column:
        prime = PRIMES[i]
        powers = F.array(*[F.lit(pow(BASES[i], -k, prime)).cast("long") for k in range(HEAD)])
        shift = F.get(powers, (F.col("h") - F.col("taken")).cast("int"))
        return (F.col(f"a{i}") + F.pmod(end - F.col(f"b{i}"), F.lit(prime)) * shift) % prime

    suffixes = tail.select(
        "member", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "chars", *lanes("x"),
        *[moved(i, F.col(f"f{i}")).alias(f"f{i}") for i in range(LANES)],
        *[moved(i, F.col(f"f{i}") - F.col(f"t{i}")).alias(f"g{i}") for i in range(LANES)])
    columns = ["member", F.col("depth").cast("long").alias("depth"), "chars", *[c for k in kept for c in lanes(k)]]
    return (plan.select("member", F.col("length").cast("long").alias("length")),
            heads.select(*columns).unionByName(suffixes.select(*columns)))


def digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``ends_sha256`` of the ascending, comma-joined members per key."""
    n = len(keys)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([k], pa.int64()) for k in now] + [pa.array([ids[0]], pa.int64()),
                                   pa.array([",".join(map(str, ids))])], [*keys, "first", "text"])

        for batch in batches:
            for *key, member in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now or size > CHUNK:
                    if ids:
                        yield out()
                    now, ids, size = key, [], 0
                ids.append(member)
                size += 12
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([k], pa.int64()) for k in now] + [pa.array([hashed.hexdigest()])],
                                   [*keys, "ends_sha256"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != now:
                    if now is not None:
                        yield out()
                    now, hashed = row[:n], hashlib.sha256(row[-1].encode())
                else:
                    hashed.update(b"," + row[-1].encode())
        if now is not None:
            yield out()

    types = ", ".join(f"{k} long" for k in keys)
    # Ranges split a node of many ends over partitions; only its chunks meet in one task.
    pieces = ends.select(*keys, "member").repartitionByRange(*keys, "member").sortWithinPartitions(*keys, "member")
    pieces = pieces.mapInArrow(chunks, f"{types}, first long, text string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{types}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: ``conv_id`` (its
    smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    for seed in range(SEEDS):
        stored, turns = store_turns(rows, seed)
        if ambiguous(stored):
            continue
        members, prefixes = rebuilt_prefixes(turns)
        prefixes = cut(prefixes, "prefixes")
        nodes = cut(group_nodes(members, prefixes), "nodes")
        if not nodes.where("NOT equal").limit(1).count():
            return describe_nodes(members, prefixes, nodes)
    raise RuntimeError(f"turns collide under {SEEDS} seeds; add lanes")


def group_nodes(members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The nodes: key (``depth``, ``f0..``), parent key, members, and whether
    all members have the parent and the last turn in common."""
    same = F.lit(True)
    for c in [*lanes("g"), *lanes("x")]:
        same &= F.min(c) == F.max(c)
    nodes = prefixes.groupBy("depth", *lanes("f")).agg(
        F.min("member").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        *[F.min(c).alias(c) for c in lanes("g")], same.alias("equal"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = members.agg(F.min("member").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), *[zero.alias(c) for c in lanes("f")], "conv_id", "n_convs", zero.alias("chars"),
        *[none.alias(c) for c in lanes("g")], F.lit(True).alias("equal"))
    return nodes.unionByName(root)


def describe_nodes(members: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    key = ["depth", *lanes("f")]
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(g).alias(f) for g, f in zip(lanes("g"), lanes("f"))]]
    children = nodes.where("depth > 0").select(*up).groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))),
                "children")

    # What a node saves is booked to its smallest member, whose nodes reach to its end.
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    booked = nodes.select("conv_id", "depth", saved, (F.col("n_children") == 0).cast("long").alias("leaf"),
                          F.expr(f"depth div {SPAN}").alias("span"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = booked.groupBy("conv_id", "span").agg(F.sum("saved").alias("_s")).select(
        "conv_id", "span", F.coalesce(F.sum("_s").over(down), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("conv_id", "span").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = booked.withColumn("_in", F.sum("saved").over(inside)).join(spans, ["conv_id", "span"]).select(
        "conv_id", "depth", (F.col("_in") + F.col("_below")).alias("own_saved"))
    totals = cut(booked.groupBy(F.col("conv_id").alias("member")).agg(
        F.sum("saved").alias("all_saved"), F.sum("leaf").alias("leaves")).where("all_saved > 0 OR leaves > 0"), "booked")

    # Every node sums the bookings of its members; its smallest one counts from the node on only.
    sums = prefixes.select("member", *key).join(totals, "member").groupBy(*key).agg(
        F.sum("all_saved").alias("all_saved"), F.sum("leaves").alias("n_leaves"))
    zero = F.lit(0).cast("long")
    root = totals.agg(F.sum("all_saved").alias("all_saved"), F.sum("leaves").alias("n_leaves")).select(
        zero.alias("depth"), *[zero.alias(c) for c in lanes("f")], "all_saved", "n_leaves")
    sums = sums.unionByName(root)
    mine = totals.select(F.col("member").alias("conv_id"), F.col("all_saved").alias("rep_saved"))

    ends = prefixes.join(members, "member").where("depth = length").select(*key, "member")
    ends = ends.unionByName(members.where("length = 0").select(
        zero.alias("depth"), *[zero.alias(c) for c in lanes("f")], "member"))
    parents = nodes.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("conv_id").alias("parent_conv_id"))
    is_parent = F.col("_depth") == F.col("depth") - 1
    for f, g in zip(lanes("f"), lanes("g")):
        is_parent &= F.col(f"_{f}") == F.col(g)
    out = (nodes.join(sums, key, "left").join(mine, "conv_id", "left").join(below, ["conv_id", "depth"])
           .join(digests(ends, key), key, "left").join(parents, is_parent, "left"))
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"),
        (F.coalesce("all_saved", zero) - F.coalesce("rep_saved", zero) + F.col("own_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
