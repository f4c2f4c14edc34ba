"""Mixing sources to target weights by min-cost flow.

Sources overlap: a document belongs to any set of sources.  Documents are
aggregated by membership pattern; each pattern offers its tokens up to
``MAX_REPEATS`` times, the second and third time at convexly rising cost; each
source asks for its quota.  A min-cost flow routes pattern capacity to source
quotas.  A pattern then takes whole rounds of all its documents plus a seeded
part of them in a last round.

The flow is found on the driver, in a graph of one node per pattern and
source and never one per document: shortest path costs first, then a blocking
flow over all paths of the cheapest cost at once, and so on; there are only a
few different costs.

The last round takes documents in a seeded order until the pattern's rest is
used up.  Orders are never sorted as a whole: hash buckets of about
``BUCKET_ROWS`` documents are cumulated, and only the bucket where the rest
runs out is walked document by document (those that fit are taken).  The room
this leaves goes to the buckets behind it in the same way, without the
documents larger than the room, until no document fits any more.

Defined results: a null source is a source of its own, ordered last; null
texts have size 0 and are taken 0 words; a document of several sources counts
its size towards each; rows with the same id, source and text are
interchangeable; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash01, words

MAX_REPEATS = 3
COSTS = (0, 1, 3)  # of a token's first, second and third use
EPS = 1e-6
WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 1_000
#: Sources and patterns live on the driver; more of them than this is an error.
MAX_NODES = 200_000
#: Tables with a row per pattern are broadcast up to this many patterns.
FEW_PATTERNS = 20_000


def water_fill(sizes: list[int], weights: list[float], total: float, most: int = MAX_REPEATS) -> list[float]:
    """Targets in proportion to ``weights``, none above ``most`` times its
    size; what a full source can't take is shared again by weight."""
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return target


def push_level(res: dict, cheap: Callable) -> bool:
    """A blocking flow from "S" to "T" over the cheap arcs that lead one level
    further from "S"; whether anything was moved."""
    level, todo = {"S": 0}, ["S"]
    for u in todo:
        for v, cap in res[u].items():
            if cap > EPS and v not in level and cheap(u, v):
                level[v] = level[u] + 1
                todo.append(v)
    if "T" not in level:
        return False
    ahead = {u: [v for v in res[u] if level.get(v) == level[u] + 1 and cheap(u, v)] for u in level}
    path = ["S"]
    while path:
        u = path[-1]
        if u == "T":
            arcs = list(zip(path, path[1:]))
            push = min(res[a][b] for a, b in arcs)
            for a, b in arcs:
                res[a][b] -= push
                res[b][a] += push
            # Back to where the first arc is full.
            full = next(n for n, (a, b) in enumerate(arcs) if res[a][b] <= EPS)
            del path[full + 1:]
            continue
        while ahead[u] and res[u][ahead[u][-1]] <= EPS:
            ahead[u].pop()
        if ahead[u]:
            path.append(ahead[u][-1])
        else:
            path.pop()
            if path:
                ahead[path[-1]].pop()
    return True


def min_cost_flow(capacity: dict[tuple, float], quota: dict[str, float], repeats: int = MAX_REPEATS,
                  costs: tuple[int, ...] = COSTS) -> dict[tuple[tuple, str], float]:
    """Tokens routed from each pattern (a tuple of sources) to each of its
    sources: as much of every quota as can be met, at least total cost."""
    flow: dict[tuple[tuple, str], float] = {}
    shared = sorted(capacity, key=repr)
    if not shared:
        return flow
    # Residual graph: "S" -> (pattern, round) -> pattern -> source -> "T".
    res: dict = defaultdict(dict)
    cost: dict = {}

    def arc(u, v, cap, c):
        if cap > 0:
            res[u][v] = res[u].get(v, 0.0) + cap
            res[v].setdefault(u, 0.0)
            cost[u, v], cost[v, u] = c, -c

    for p in shared:
        for k in range(repeats):
            arc("S", ("r", p, k), capacity[p], 0)
            arc(("r", p, k), ("p", p), capacity[p], costs[k])
        for s in p:
            arc(("p", p), ("s", s), repeats * capacity[p], 0)
    for s in {s for p in shared for s in p}:
        arc(("s", s), "T", quota.get(s, 0.0), 0)
    potential: dict = defaultdict(int)
    while True:
        dist, heap, n = {"S": 0}, [(0, 0, "S")], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for v, cap in res[u].items():
                if cap > EPS:
                    nd = d + cost[u, v] + potential[u] - potential[v]
                    if v not in dist or nd < dist[v]:
                        dist[v], n = nd, n + 1
                        heapq.heappush(heap, (nd, n, v))
        if "T" not in dist:
            break
        far = max(dist.values())
        for v in list(res):
            potential[v] += dist.get(v, far)
        # All paths of this cost at once.
        while push_level(res, lambda u, v: cost[u, v] + potential[u] == potential[v]):
            pass
    for p in shared:
        for s in p:
            if (moved := res[("s", s)].get(("p", p), 0.0)) > 1e-9:
                flow[p, s] = moved
    return flow


def first_fit(sizes, room: float) -> tuple[list[int], float]:
    """1 for every size that fits into what the ones before it left, and the room left."""
    extra = []
    for size in sizes:
        extra.append(int(size <= room))
        room -= size if size <= room else 0
    return extra, room


def take_rest(dealt: DataFrame, rests: list[tuple[int, float, int]],
              small: Callable[[DataFrame], DataFrame]) -> dict[int, list[tuple[int, float, float]]]:
    """How each pattern of ``rests`` (pid, rest, buckets) uses up its rest.

    Per pattern, a list of passes (edge, fits, room): behind the edge of the
    pass before, documents of at most ``fits`` words are taken, up to the
    bucket ``edge``, where they are walked with ``room`` words left.  A pass
    whose edge is the number of buckets reaches the end.  The driver sees one
    row per pattern and pass."""
    spark = dealt.sparkSession
    buckets = {pid: n for pid, _, n in rests}
    passes: dict = {pid: [] for pid in buckets}
    now = [(pid, -1, rest) for pid, rest, _ in rests]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "size"], kind="stable")
        left = first_fit(pdf["size"], float(pdf["room"].iloc[0]))[1]
        return pdf[["pid", "edge", "room"]].head(1).assign(left=left)

    while now:
        state = small(spark.createDataFrame(now, "pid int, done long, fits double"))
        sums = (dealt.join(state, "pid").where("bucket > done AND size <= fits").groupBy("pid", "bucket")
                .agg(F.sum("size").alias("_size"), F.first("fits").alias("fits")))
        upto = F.sum("_size").over(Window.partitionBy("pid").orderBy("bucket")
                                   .rowsBetween(Window.unboundedPreceding, 0))
        # The bucket in which the rest runs out; buckets before it are taken whole.
        edge = (sums.withColumn("_upto", upto).where(F.col("_upto") > F.col("fits")).groupBy("pid")
                .agg(F.min("bucket").alias("edge"),
                     F.min_by(F.col("fits") - F.col("_upto") + F.col("_size"), "bucket").alias("room")))
        inside = dealt.join(small(edge), "pid").where("bucket = edge").select("pid", "edge", "room", "u", "size")
        ends = {r["pid"]: r for r in inside.groupBy("pid").applyInPandas(
            walk, "pid int, edge long, room double, left double").collect()}
        after = []
        for pid, _, fits in now:
            if pid not in ends:
                passes[pid].append((buckets[pid], fits, fits))
                continue
            end = ends[pid]
            passes[pid].append((end["edge"], fits, end["room"]))
            if end["left"] >= 1 and end["edge"] + 1 < buckets[pid]:
                after.append((pid, end["edge"], end["left"]))
        now = after
    return passes


class Mix:
    """The mix of ``docs`` (see ``mix``).

    ``picked`` has the documents (``k_`` and the name of each ``keep`` column,
    ``pattern``, ``size``, ``taken``) and ``guess``: how often it is taken unless
    it has no words or doesn't fit into the rest.  ``sources`` is the table of
    sources."""

    def __init__(self, docs: DataFrame, *, members: str, text_col: str = "text", keep: list[str], weights=WEIGHTS,
                 seed: int = 0):
        spark = docs.sparkSession
        self.measures = [*[F.col(c).alias(f"k_{c}") for c in keep],
                         F.array_sort(F.array_distinct(members)).alias("pattern"),
                         F.size(words(F.col(text_col))).cast("long").alias("size"),
                         hash01(F.lit(seed), *keep, text_col).alias("u")]
        base = cut(docs.select(*self.measures), "sizes")
        # Both tables have a row per source or pattern, never per document.
        per = base.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(
            MAX_NODES + 1).collect()
        if len(per) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} membership patterns")
        size_of: dict = defaultdict(int)
        for r in per:
            for s in r["pattern"]:
                size_of[s] += r["size"]
        names = sorted((s for s in size_of if s is not None)) + [None] * (None in size_of)
        weight = [weights[i % len(weights)] for i in range(len(names))]
        total = sum(r["size"] for r in per)
        target = dict(zip(names, water_fill([size_of[s] for s in names], weight, total)))
        capacity = {tuple(r["pattern"]): float(r["size"]) for r in per if r["size"] > 0}
        flow: dict = defaultdict(float)
        for (p, _), x in sorted(min_cost_flow(capacity, target).items(), key=repr):
            flow[p] += x
        plan = []
        for pid, r in enumerate(per):
            p = tuple(r["pattern"])
            full = min(MAX_REPEATS, int(flow[p] // r["size"])) if r["size"] else 0
            rest = flow[p] - full * r["size"] if full < MAX_REPEATS else 0.0
            plan.append((pid, list(p), full, float(rest), max(1, r["n"] // BUCKET_ROWS)))
        self.plans = spark.createDataFrame([(i, p, full, b) for i, p, full, _, b in plan],
                                           "pid int, pattern array<string>, full int, buckets long")

        def small(df: DataFrame) -> DataFrame:  # a large source would fill one shuffle partition
            return F.broadcast(df) if len(plan) <= FEW_PATTERNS else df

        dealt = cut(self.deal(base, small), "dealt")
        passes = take_rest(dealt, [(i, rest, b) for i, _, _, rest, b in plan if rest >= 1], small)
        self.steps = spark.createDataFrame(list(passes.items()),
                                           "pid int, steps array<struct<edge: bigint, fits: double, room: double>>")
        marked = self.mark(dealt, small)
        out_cols = [*[f"k_{c}" for c in keep], "pattern", "size", "full", "guess"]
        at_edge = F.coalesce(F.col("step.edge") == F.col("bucket"), F.lit(False))
        outside = marked.where(~at_edge).select(
            *out_cols, F.coalesce(F.col("size") <= F.col("step.fits"), F.lit(False)).cast("int").alias("extra"))
        inside = marked.where(at_edge).withColumn("room", F.col("step.room"))

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:  # one bucket: about BUCKET_ROWS documents
            pdf = pdf.sort_values(["u", "size"], kind="stable")
            return pdf[out_cols].assign(extra=first_fit(pdf["size"], float(pdf["room"].iloc[0]))[0])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inside.select(*out_cols).schema)
        filled = inside.groupBy("pid", "bucket").applyInPandas(fill, schema + ", extra int")
        self.picked = outside.unionByName(filled).select(
            *[F.col(f"k_{c}").alias(c) for c in keep], "pattern", "size",
            (F.col("size") * (F.col("full") + F.col("extra"))).cast("long").alias("taken"), "guess")
        self.sources = spark.createDataFrame([(s, size_of[s], float(target[s])) for s in names],
                                             "source string, source_size long, target double")

    def deal(self, base: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return base.join(small(self.plans), "pattern").withColumn(
            "bucket", F.floor(F.col("u") * F.col("buckets")).cast("long"))

    def mark(self, dealt: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
        # The pass that decides on a document is the first whose edge isn't before its bucket.
        marked = dealt.join(small(self.steps), "pid", "left").withColumn(
            "step", F.get(F.filter("steps", lambda s: s["edge"] >= F.col("bucket")), F.lit(0)))
        # The first pass takes nearly all it meets; for those behind it little room is left.
        first = F.get("steps", F.lit(0))["edge"] >= F.col("bucket")
        return marked.withColumn("guess", F.col("full") + F.coalesce(first, F.lit(False)).cast("int"))

    def in_place(self, docs: DataFrame, out: str) -> DataFrame:
        """``docs``, as given to the mix, with ``out``: the ``guess`` of each document.
        Nothing is shuffled; the tables of plans and steps have at most
        ``MAX_NODES`` rows.  No column of ``docs`` may have the name of one of the
        mix's own."""
        marked = self.mark(self.deal(docs.select(*docs.columns, *self.measures), F.broadcast), F.broadcast)
        return marked.select(*docs.columns, F.col("guess").alias(out))


def mix(docs: DataFrame, *, members: str, text_col: str = "text", keep: list[str], weights=WEIGHTS,
        seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Select documents so that every source comes near its target.

    ``members`` is an array column: the sources of a document.  Returns the
    documents (``keep``, ``members``, ``size``, ``taken``) and the sources
    (``source``, ``source_size``, ``target``).  Sources are ordered by code
    point, null last, and weigh ``weights`` in turn."""
    mixed = Mix(docs, members=members, text_col=text_col, keep=keep, weights=weights, seed=seed)
    picked = mixed.picked.select(*keep, F.col("pattern").alias(members), "size", "taken")
    return picked, mixed.sources
