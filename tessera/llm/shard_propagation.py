"""Sharding by balanced label propagation.

Linked documents are first gathered into clusters of at most a shard's size,
by propagation of cluster labels along links.  Clusters then move towards
their neighbours' shards under capacity quotas: every round, Spark joins sum
each cluster's links per shard, a cluster that would gain links proposes to
move, and only as many proposals per (from, to) pair of shards are accepted as
the quotas allow, until no cut links are gained.  At the end the shards are
made exactly even (row counts at most one apart): documents beyond a shard's
quota and documents without links fill the gaps.

The graph never leaves the executors; the driver sees one table of shard
pairs per round (shards squared rows at most) and the clusters over a sixteenth
of a shard (32 a shard at most).  No window runs over a whole
shard or a whole group: proposals are accepted by a hash threshold, and ranks
come from ``bucket_ranks``.  Links of equal texts are a star (every copy to
the first one), not all pairs; Spark splits the join partition of a star's
centre, and link counts are summed before they are shuffled.

Defined results: every row of the input is a document of its own, whatever
its id (null and repeated ids included); a null text has size 16 and no
links; empty texts are equal to each other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_ranks, cut, hash01

#: Rounds end when two in a row gain less than this share of the links.
LEAST_GAIN = 0.001
#: Clusters up to which a round's shards are sent to all tasks, a small table whatever the input.
FEW_CLUSTERS = 20_000
#: Rows up to which a round's tables are made by few tasks: with hundreds of shuffle
#: partitions, starting tasks and opening files would be most of a round.
FEW_ROWS, FEW_FILES = 100_000, 8
#: Rows per ranking bucket.
BUCKET_ROWS = 20_000


def few(df: DataFrame, at_most: int) -> DataFrame:
    """``df``, of ``at_most`` rows, in few tasks if these are few."""
    return df.coalesce(FEW_FILES) if at_most <= FEW_ROWS else df


def written(df: DataFrame, name: str, at_most: int) -> DataFrame:
    """``cut`` of a table of ``at_most`` rows."""
    return cut(few(df, at_most), name)


def copy_links(nodes: DataFrame, key: str) -> DataFrame:
    """Star links ``(a, b)`` between nodes of equal, non-null ``key``: every
    node ``a`` to the first node ``b`` of its key."""
    first = (nodes.where(F.col(key).isNotNull()).groupBy(key)
             .agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    return nodes.join(first, key).where("node <> b").select(F.col("node").alias("a"), "b")


def quotas(counts: dict[int, int], proposals: dict[tuple[int, int], int], capacity: int) -> dict[tuple[int, int], float]:
    """Share of the proposals of each (from, to) pair that may move, such that
    no shard is expected beyond ``capacity``.  Arrivals are cut back in
    proportion where they don't fit; what stays behind then takes room in the
    shard it stays in, so the cuts are repeated until they hold."""
    allowed = {k: float(v) for k, v in proposals.items()}
    shards = {s for pair in proposals for s in pair} | set(counts)
    for _ in range(4 * max(1, len(shards))):
        worst = 0.0
        for s in shards:
            arriving = sum(v for (_, to), v in allowed.items() if to == s)
            leaving = sum(v for (of, _), v in allowed.items() if of == s)
            over = counts.get(s, 0) - leaving + arriving - capacity
            if over > 0.5 and arriving > 0:
                keep = max(0.0, 1 - over / arriving)
                worst = max(worst, over)
                for k in allowed:
                    if k[1] == s:
                        allowed[k] *= keep
        if worst == 0.0:
            break
    return {k: allowed[k] / v for k, v in proposals.items() if v}


def coarsen(links: DataFrame, capacity: int, *, seed: int = 0) -> DataFrame:
    """``node`` and ``anchor`` of the linked nodes that join a cluster of another
    node; no cluster is expected to hold more than ``capacity`` nodes.

    Every cluster names the neighbour it shares most links with.  In odd rounds
    clusters join a neighbour that is the better linked one of two that name
    each other (a star is one cluster after a round); in even rounds those a
    coin makes movers join those it doesn't, so that long chains shrink by a
    constant share too.  The rounds go on until no two linked clusters fit into
    one; links of clusters that don't fit are left out on the way."""
    at_most = 2 * links.count()  # neither nodes nor links of clusters are more
    edges = written(links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .agg(F.count(F.lit(1)).alias("w")).where(F.lit(capacity >= 2))
                .select("a", "b", "w", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")), "edges-0", at_most)
    joined, r = [], 0
    while edges.take(1):
        r += 1
        both = edges.select(F.col("a").alias("c"), F.col("b").alias("o"), "w", F.col("na").alias("n")).unionByName(
            edges.select(F.col("b").alias("c"), F.col("a").alias("o"), "w", F.col("nb").alias("n")))
        tie = F.xxhash64(F.lit(seed + r), F.least("c", "o"), F.greatest("c", "o"))
        best = written(both.groupBy("c").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("deg"),
                                             F.max(F.struct("w", tie.alias("t"), "o")).getField("o").alias("p")), f"best-{r}", at_most)
        if r % 2:
            named = best.join(best.select(F.col("c").alias("p"), F.col("p").alias("pp"), F.col("deg").alias("pdeg")), "p")
            root = (F.col("pp") == F.col("c")) & (
                (F.col("deg") > F.col("pdeg")) | ((F.col("deg") == F.col("pdeg")) & (F.col("c") < F.col("p"))))
            named = named.withColumn("root", root)
            centres = named.where("root").select(F.col("c").alias("p"), F.col("n").alias("pn"))
            asks = named.where("NOT root").select("c", "n", "p").join(centres, "p")
        else:
            asks = (best.where((hash01(F.lit(seed + r), "c") < 0.5) & (hash01(F.lit(seed + r), "p") >= 0.5))
                    .select("c", "n", "p").join(best.select(F.col("c").alias("p"), F.col("n").alias("pn")), "p"))
        # Written, so that the joins before and behind end their stages and a hot centre's partition can be split.
        asks = written(asks, f"asks-{r}", at_most)
        load = asks.groupBy("p").agg(F.sum("n").alias("asked"))
        room = F.lit(capacity) - F.col("pn")
        moves = written(asks.join(load, "p").where(hash01(F.lit(~seed - r), "c") * F.col("asked") < room)
                    .select("c", "p", "n"), f"joins-{r}", at_most)
        joined.append(moves.select(F.col("c").alias("node"), F.col("p").alias("anchor")))
        grown = moves.groupBy(F.col("p").alias("to")).agg(F.sum("n").alias("more"))
        weight = best.select(F.col("c").alias("to"), "n").join(grown, "to", "left").select(
            "to", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        now = best.select("c").join(moves.select("c", "p"), "c", "left").select("c", F.coalesce("p", "c").alias("to"))
        now = written(now.join(weight, "to").select("c", F.struct("to", "n").alias("s")), f"clusters-{r}", at_most)
        ends = (edges.select("a", "b", "w").join(now.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
                .join(now.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
                .where((F.col("sa.to") != F.col("sb.to")) & (F.col("sa.n") + F.col("sb.n") <= capacity)))
        edges = written(ends.groupBy(F.least("sa", "sb").alias("l"), F.greatest("sa", "sb").alias("g"))
                    .agg(F.sum("w").alias("w"))
                    .select(F.col("l.to").alias("a"), F.col("g.to").alias("b"), "w",
                            F.col("l.n").alias("na"), F.col("g.n").alias("nb")), f"edges-{r}", at_most)
    if not joined:
        return links.select(F.col("a").alias("node"), F.col("b").alias("anchor")).where(F.lit(False))
    # Every cluster joins another once: a forest, as deep as there were rounds.
    forest, depth = joined[0], 1
    for moves in joined[1:]:
        forest = forest.unionByName(moves)
    while depth < r:
        up = forest.select(F.col("node").alias("anchor"), F.col("anchor").alias("above"))
        forest = written(forest.join(up, "anchor", "left").select("node", F.coalesce("above", "anchor").alias("anchor")), "forest", at_most)
        depth *= 2
    return forest


def place(clusters: DataFrame, shards: int, total: int, *, seed: int = 0) -> DataFrame:
    """``cluster``, ``n`` and a first ``shard``: clusters over a sixteenth of a
    shard, heaviest first, where most room is left (at most 32 for each shard,
    whatever the input), all others by hash in proportion to the room."""
    capacity = max(1, total // shards)
    room = [total / shards] * shards
    heavy = clusters.where(F.col("n") * 16 > capacity).select("cluster", "n").collect()
    at = []
    for c, n in sorted(heavy, key=lambda x: (-x[1], x[0])):
        s = max(range(shards), key=lambda s: room[s])
        room[s] -= n
        at.append((c, s))
    left = [max(0.0, x) for x in room]
    if not sum(left):
        left = [1.0] * shards
    ends, run = [], 0.0
    for x in left[:-1]:
        run += x
        ends.append(run / sum(left))
    u = hash01(F.lit(seed), "cluster")
    light = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= u)) if ends else F.lit(0)
    fixed = clusters.sparkSession.createDataFrame(at, "cluster long, at int")
    return clusters.join(F.broadcast(fixed), "cluster", "left").select(
        "cluster", "n", F.coalesce("at", light.cast("int")).alias("shard"))


def propagate(links: DataFrame, shards: int, total: int, *, seed: int = 0) -> DataFrame:
    """``node``, ``shard``, ``anchor`` (its cluster) and ``n`` (the cluster's
    nodes) of every linked node.

    Clusters of linked nodes (``coarsen``) move as one.  In a round a random
    half of them may move towards the shard they have most links with, so that
    two linked clusters don't swap for ever.  The rounds end when two in a row
    gain less than ``LEAST_GAIN`` of the links; the state with the fewest cut
    links is kept."""
    capacity = max(1, total // shards)
    total_links = links.count()
    at_most = 2 * total_links
    joined = coarsen(links, capacity, seed=seed)
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    member = written(nodes.join(joined, "node", "left").select("node", F.coalesce("anchor", "node").alias("cluster")),
                     "members", at_most)
    clusters = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    state = written(place(written(clusters, "sizes", at_most), shards, total, seed=seed), "shards-0", at_most)
    between = (links.join(member.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a")
               .join(member.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b").where("ca <> cb")
               .groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
               .agg(F.count(F.lit(1)).alias("w")))
    between = written(between, "between", at_most)
    if between.take(1):
        state = move_clusters(between, state, shards, capacity, total_links, seed=seed)
    return written(member.join(state, "cluster").select("node", F.col("cluster").alias("anchor"), "shard", "n"), "shards",
                   at_most)


def move_clusters(between: DataFrame, state: DataFrame, shards: int, capacity: int, total_links: int, *,
                  seed: int = 0) -> DataFrame:
    """``state`` (``cluster``, ``n``, ``shard``) after the rounds of moves."""
    # One direction is stored; both are read.
    both = between.select(F.col("a").alias("cluster"), F.col("b").alias("other"), "w").unionByName(
        between.select(F.col("b").alias("cluster"), F.col("a").alias("other"), "w"))
    # Clusters without links to others stay where they are and take no part in the rounds.
    ends = both.select("cluster").distinct().withColumn("linked", F.lit(True))
    start = written(state.join(ends, "cluster", "left"), "linked", 2 * total_links)
    alone = start.where("linked IS NULL").select("cluster", "n", "shard")
    state = start.where("linked").select("cluster", "n", "shard")
    # Shards squared rows at most, here and in every round.
    still, at_most = {}, 0
    for row in start.groupBy("shard").agg(F.sum(F.when(F.col("linked").isNull(), F.col("n"))).alias("n"),
                                          F.count("linked").alias("linked")).collect():
        still[row["shard"]] = row["n"] or 0
        at_most += row["linked"]
    side = F.broadcast if at_most <= FEW_CLUSTERS else lambda df: df
    at_most = max(at_most, 2 * total_links)  # a vote for every link and direction
    kept, fewest, idle, r = state, math.inf, 0, 0
    while True:
        r += 1
        votes = few(both.join(side(state.select(F.col("cluster").alias("other"), F.col("shard").alias("to"))), "other")
                    .groupBy("cluster", "to").agg(F.sum("w").alias("w")), at_most)
        # The best shard, the votes for the current one and all votes, in one aggregate.
        best = (votes.join(side(state), "cluster").groupBy("cluster", "n", "shard")
                .agg(F.max(F.struct("w", (-F.col("to")).alias("t"))).alias("best"), F.sum("w").alias("all"),
                     F.sum(F.when(F.col("to") == F.col("shard"), F.col("w")).otherwise(0)).alias("here")))
        wants = (hash01(F.lit(seed + r), "cluster") < 0.5) & (F.col("best.w") > F.col("here"))
        moved = written(best.select("cluster", "n", "shard", (F.col("all") - F.col("here")).alias("away"),
                                F.when(wants, -F.col("best.t")).otherwise(F.col("shard")).cast("int").alias("to")),
                        f"moves-{r}", at_most)
        table = few(moved.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.sum("away").alias("away")), at_most).collect()
        cut_links = sum(row["away"] for row in table) / 2
        idle = 0 if cut_links < fewest - LEAST_GAIN * total_links else idle + 1
        if cut_links < fewest:
            kept, fewest = state, cut_links
        if idle == 2 or not cut_links:
            return kept.unionByName(alone)
        counts: dict[int, int] = dict(still)
        proposals: dict[tuple[int, int], int] = {}
        for row in table:
            counts[row["shard"]] = counts.get(row["shard"], 0) + row["n"]
            if row["to"] != row["shard"]:
                proposals[row["shard"], row["to"]] = row["n"]
        share = quotas(counts, proposals, capacity)
        pairs = between.sparkSession.createDataFrame(
            [(a, b, float(v)) for (a, b), v in share.items()], "shard int, to int, share double")
        go = hash01(F.lit(~seed - r), "cluster") < F.coalesce("share", F.lit(0.0))
        # Read from the table of moves, by a broadcast join of shards squared rows at most.
        state = moved.join(F.broadcast(pairs), ["shard", "to"], "left").select(
            "cluster", "n", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard"))


def cut_links(links: DataFrame, placed: DataFrame, *, id_col: str = "node") -> DataFrame:
    """One row: ``links``, and ``cut``, those whose ends lie in different shards."""
    at = placed.select(F.col(id_col).alias("a"), F.col("shard").alias("sa"))
    other = placed.select(F.col(id_col).alias("b"), F.col("shard").alias("sb"))
    return links.join(at, "a").join(other, "b").agg(
        F.count(F.lit(1)).alias("links"), F.coalesce(F.sum((F.col("sa") != F.col("sb")).cast("long")), F.lit(0)).alias("cut"))


def even_out(nodes: DataFrame, placed: DataFrame, shards: int, total: int) -> DataFrame:
    """Exact shards: ``node``, ``shard``, ``slot`` for every row of ``nodes``.

    Shard s has room for total // shards rows, one more for the first
    total % shards shards.  Placed nodes keep their shard while there is room;
    all others fill the gaps in one global order (linked nodes first, nodes of
    one anchor next to each other)."""
    if not total:
        return nodes.select("node", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    room = [total // shards + (s < total % shards) for s in range(shards)]
    side = math.isqrt(total // BUCKET_ROWS) + 1  # side * side buckets

    def by_anchor():  # anchors over side ranges, every anchor of many nodes over side buckets
        part = F.when(F.col("n") > BUCKET_ROWS, F.col("node")).otherwise(F.col("anchor"))
        return F.pmod(F.xxhash64(F.lit("a"), "anchor"), F.lit(side)) * side + F.pmod(
            F.xxhash64(F.lit("n"), part), F.lit(side))

    rooms = F.array(*[F.lit(x) for x in room])
    if placed is not None:
        fits = bucket_ranks(placed.withColumn("_b", by_anchor()), ["shard"], "_b", ["anchor", "node"], "slot")
        fits = cut(fits.select("node", "anchor", "n", "shard", "slot",
                               (F.col("slot") < F.get(rooms, F.col("shard"))).alias("fits")), "placed")
        kept = {r["shard"]: r["count"] for r in fits.where("fits").groupBy("shard").count().collect()}
        free = nodes.join(fits.select("node"), "node", "left_anti")
    else:
        kept, free = {}, nodes
    rest = free.select("node", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("long").alias("n"))
    if placed is not None:
        rest = rest.unionByName(fits.where("not fits").select("node", "anchor", "n"))
    bucket = F.when(F.col("anchor").isNotNull(), by_anchor()).otherwise(
        F.lit(side * side) + F.pmod(F.xxhash64(F.lit("n"), "node"), F.lit(side * side)))
    rest = cut(rest.withColumn("_b", bucket), "rest").withColumn("_all", F.lit(0))
    ranked = bucket_ranks(rest, ["_all"], "_b", ["anchor", "node"], "_rank")
    starts, at = [], 0
    for s in range(shards):
        starts.append(at)
        at += room[s] - kept.get(s, 0)
    begin = F.array(*[F.lit(x).cast("long") for x in starts])
    held = F.array(*[F.lit(kept.get(s, 0)).cast("long") for s in range(shards)])
    # The last shard whose gap starts at or before the rank; shards without a gap come before it.
    shard = (F.size(F.filter(begin, lambda b: b <= F.col("_rank"))) - 1).cast("int")
    filled = (ranked.withColumn("shard", shard)
              .select("node", "shard",
                      (F.col("_rank") - F.get(begin, F.col("shard")) + F.get(held, F.col("shard"))).alias("slot")))
    if placed is None:
        return filled
    return filled.unionByName(fits.where("fits").select("node", "shard", "slot"))


def shard_documents(docs: DataFrame, shards: int, *, text_col: str = "text", keep: list[str] | None = None,
                    links: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``keep`` columns, ``size`` (UTF-8 bytes + 16), ``text_crc32``,
    ``linked`` , ``shard`` and ``slot`` for every row of ``docs``.

    ``links(a, b)`` are links between values of the first ``keep`` column; by
    default equal texts are linked."""
    text = F.col(text_col)
    kept = [F.col(c).alias(f"k_{c}") for c in keep or []]
    base = cut(docs.select(*kept, (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                           F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                           F.md5(text.cast("binary")).alias("_key"),
                           F.monotonically_increasing_id().alias("node")), "documents")
    nodes = base.select("node", "_key")
    if links is None:
        edges = copy_links(nodes, "_key")
    else:
        ids = base.select(F.col(f"k_{keep[0]}").alias("_id"), "node")
        edges = (links.select("a", "b").where("a <> b")
                 .join(ids.select(F.col("_id").alias("a"), F.col("node").alias("na")), "a")
                 .join(ids.select(F.col("_id").alias("b"), F.col("node").alias("nb")), "b")
                 .where("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    edges = cut(edges, "links")
    total = base.count()
    some = bool(edges.take(1))
    placed = propagate(edges, shards, total, seed=seed) if some else None
    out = base.join(even_out(nodes, placed, shards, total), "node")
    linked = out.join(placed.select("node", F.lit(True).alias("linked")), "node", "left") if some else out.withColumn(
        "linked", F.lit(False))
    return linked.select(*[F.col(f"k_{c}").alias(c) for c in keep or []], "size", "text_crc32",
                         F.coalesce("linked", F.lit(False)).alias("linked"), "shard", "slot")
