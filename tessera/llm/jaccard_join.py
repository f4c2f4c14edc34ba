"""N-gram Jaccard join by partitioning the universe of shingles.

A document is its set of distinct word n-grams (64-bit hashes).  Two sets of
sizes a and b have Jaccard similarity num/den or more exactly if they differ
in at most H = (a + b)(den - num) / (den + num) shingles.

* **Segments.**  Sizes fall into bands, so that similar sets lie in one band
  or in two adjacent ones.  Per band, the hash range of shingles is cut into
  m segments; a set's signature in a segment is the hash of its shingles
  there.  A set indexes its non-empty segments in its own band and probes its
  own band and, where a larger partner may lie there, the next one.
* **Pigeonhole.**  The smaller set of a pair may use *any* H + 1 of its
  non-empty segments: at least one of them is equal in the larger set.
* **Cost-based allocation.**  Signatures are counted over the whole corpus
  first.  A segment nobody else shares costs nothing; of the others a set
  skips as many of the most crowded ones as it has to spare.  Sets with no
  segment left have no partner, which settles almost all documents.
* **One-deletion neighbourhoods.**  A small set whose shingles fall into fewer
  than H + 1 segments allows one difference in some of them: such a segment
  matches neighbourhoods of one deleted shingle on either side.  Sets for which
  even that isn't enough are compared with all sets of fitting size.
* **Exact verification.**  First every probing set is compared with a few
  central sets of its buckets.  Verified links form components; whatever bucket
  still holds several of them goes on.  Sets in crowded buckets must then have
  enough shingles in common with the others there at all (a set that has more
  than its allowed share of shingles to itself is out).  What is left is all
  compared: as pairs in small buckets, block by block in crowded ones.

Copies share one signature set: the nodes of the join are distinct sets,
identified by a 64-bit hash and their size; equal texts never meet as pairs.
Signatures are shuffled as arrays (four bytes each, and a number for each set) and
counted with numpy, a bounded number per part; only shared ones become rows.

Defined results: null, empty and blank texts have no shingles and link with
nothing, their component is their own id; repeated rows and rows without id
take part as rows, and an id that is null never names a component that has
another id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, hash01, map_batches, sieve
from .components import connected_components

SHINGLE = 5
NUM, DEN = 75, 100
#: Bands up to this size index one-deletion neighbourhoods.
SMALL = 32
#: Signatures per part, the unit that is sorted in memory, and signatures sent at once.
PART, FLUSH = 1_000_000, 250_000
#: Bytes of text hashed at once.
SLICE = 1 << 19
#: Sets per bucket from which the check for shingles of one's own is worth its cost.
CROWD = 24

#: Sets and shingles per block of a crowded family.
BLOCK_SETS, BLOCK_TOKENS = 1024, 400_000
#: Hubs named by a bucket, and hubs tried by a set, before all else.
HUBS, TRIES = 6, 4

INDEX, PROBE_OWN, PROBE_NEXT = 1, 2, 4

U = np.uint64
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64))
_STEPS = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


def wrap(x: int) -> np.uint64:
    return U(x & 0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ wrap(salt * 0x9E3779B97F4A7C15)
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def changes(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` (UTF-8 of several texts, which begin at
    ``starts``) and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    space = _SPACE[data]
    first = ~space
    edge = np.zeros(len(data), bool)
    edge[starts[starts < len(data)]] = True
    first[1:] &= space[:-1] | edge[1:]
    at = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(at, np.r_[starts, len(data)]))
    if not len(at):
        return np.zeros(0, np.uint64), counts
    lens = np.diff(np.r_[at, len(data)])
    lead = at[0]
    place = np.arange(lead, len(data)) - np.repeat(at, lens)
    terms = _TABLE[_FOLD[data[lead:]]] * _POWERS[place & 4095]
    if len(place) and lens.max() > 4096:
        terms *= (place >> 12).astype(np.uint64) * U(2) + U(1)
    terms[space[lead:]] = 0
    sums = np.add.reduceat(terms, at - lead)
    sizes = np.add.reduceat((~space[lead:]).astype(np.int64), at - lead)
    return mix(sums + sizes.astype(np.uint64) * U(0xD6E8FEB86659FD93)), counts


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text that has words."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        stop = min(stop, len(column))
        hashes, counts = word_hashes(data[offsets[row]:offsets[stop]], offsets[row:stop] - offsets[row])
        many = np.zeros(0, np.uint64)
        if len(hashes) >= n:
            many = np.zeros(len(hashes) - n + 1, np.uint64)
            for k in range(n):
                many += hashes[k:len(hashes) - n + 1 + k] * _STEPS[k]
            many = mix(many)
        at = 0
        for i, c in enumerate(counts.tolist()):
            if c and valid[row + i]:
                if c >= n:
                    s = np.sort(many[at:at + c - n + 1])
                    yield row + i, s[changes(s)]
                else:
                    few = (hashes[at:at + c] * _STEPS[:c]).sum(dtype=np.uint64, keepdims=True)
                    yield row + i, mix(few + wrap(c * int(_STEPS[63])))
            at += c
        row = stop


class Bands:
    """Size bands, segments per band, and allowed differences."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * den // num + 1))
        self.bounds = np.array(self.low)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def high(self, band: int) -> int:
        return self.low[band + 1] - 1

    def segments(self, band: int) -> int:
        top = self.high(band)
        if top <= SMALL:
            return 4 * top
        loose = (self.den - self.num) / (self.den + self.num) * 2  # share of differences in two large sets
        return max(2, int(top * min(1.0, loose * 1.4)) + 1) if top >= 150 else top

    def differences(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def needs(self, size: int) -> tuple[int, int]:
        """Segments that a probe of its own and of the next band must use; 0: no probe."""
        band = self.of(size)
        most = size * self.den // self.num
        own = self.differences(size, min(most, self.high(band)))
        following = self.differences(size, min(most, self.high(band + 1))) if most >= self.low[band + 1] else 0
        return (own + 1 if own else 0), (following + 1 if following else 0)


def node_of(s: np.ndarray) -> int:
    h = mix(mix(s, 11).sum(dtype=np.uint64, keepdims=True) + wrap(len(s) * 0x9E3779B97F4A7C15), 12)
    return int(h.astype(np.int64)[0])


def cut_segments(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the non-empty segments in the sorted set, and their numbers."""
    seg = ((s >> U(32)) * U(m)) >> U(32)  # rises with the hash, so a segment is a run
    starts = np.flatnonzero(changes(seg))
    return starts, seg[starts]


def signatures(s: np.ndarray, bands: Bands) -> tuple[list[tuple[np.ndarray, int]], list[int], bool]:
    """Signatures with their roles, what each probe has to spare (own band,
    next band; -1: no probe), and whether the set must be compared directly."""
    size = len(s)
    own_band = bands.of(size)
    parts = mix(s, 13)
    out: list[tuple[np.ndarray, int]] = []
    spare, direct = [-1, -1], False
    for which, need in enumerate(bands.needs(size)):
        band = own_band + which
        if not need and (which or bands.high(band) < 4):
            continue
        starts, seg = cut_segments(s, bands.segments(band))
        # Sums of mixed hashes are uniform themselves; the salts keep segments, bands and kinds apart.
        sums = np.add.reduceat(parts, starts)
        sums += seg * U(0xA24BAED4963EE407)
        full = sums + wrap((band + 1) * 0x9FB21C651E98DF25)
        role = PROBE_NEXT if which else INDEX | (PROBE_OWN if need else 0)
        out.append((full, role))
        small = bands.high(band) <= SMALL
        if small and not which:  # what deficient sets look for
            lens = np.diff(starts, append=size)
            out.append((mix(full, 3), INDEX))
            for i in np.flatnonzero(lens >= 2):
                run = parts[starts[i]:starts[i] + lens[i]]
                out.append((mix(full[i] - run, 2), INDEX))
        if need:
            low = np.sort(full.astype(np.uint32))  # what is left of a signature in the shuffle
            have = int(changes(low).sum())
            missing = need - have
            if missing > 0:
                lens = np.diff(starts, append=size)
                wide = np.argsort(lens, kind="stable")[::-1][:missing]
                wide = wide[lens[wide] >= 2]
                if small and len(wide) == missing:
                    role = PROBE_NEXT if which else PROBE_OWN
                    for i in wide:
                        run = parts[starts[i]:starts[i] + lens[i]]
                        out.append((mix(full[i:i + 1], 2), role))
                        out.append((mix(full[i] - run, 3), role))
                else:
                    direct = True
            spare[which] = max(0, have - need)
    return out, spare, direct


def describe(docs: DataFrame, id_col: str, text_col: str, n: int, bands: Bands) -> DataFrame:
    """Per row: id, size and node of its set, spare segments, and a key that
    finds one row of the node again."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        size, node = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        own, after, direct = np.full(rows, -1), np.full(rows, -1), np.zeros(rows, bool)
        for i, s in shingle_sets(batch.column(2), n):
            size[i], node[i] = len(s), node_of(s)
            _, (own[i], after[i]), direct[i] = signatures(s, bands)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(size), pa.array(node, mask=size == 0),
                                pa.array(own), pa.array(after), pa.array(direct)],
                               ["id", "rk", "size", "node", "spare_own", "spare_next", "direct"])

    return map_batches(src, run, f"id {kind}, rk long, size long, node long, spare_own long, spare_next long, "
                                 "direct boolean")


def shared_signatures(docs: DataFrame, text_col: str, n: int, bands: Bands, parts: int) -> DataFrame:
    """``sig``, ``node``, ``role`` and ``n_index`` (indexing sets in the
    bucket) of all signatures that an indexing set shares with another set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sigs, docs_, roles = [], [], [], []
            seen: set[int] = set()
            size = 0

            def flush():
                sig = np.concatenate(sigs)
                doc = np.concatenate(docs_)
                role = np.concatenate(roles)
                node = np.array(nodes, np.int64)
                part = ((sig >> U(32)) * U(parts) >> U(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, low, doc, role = part[order], (sig[order] & U(0xFFFFFFFF)).astype(np.uint32), doc[order], role[order]
                ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1
                a, rows = 0, []
                for b in ends.tolist():
                    first = np.flatnonzero(changes(doc[a:b]))  # documents rise, so each one is a run
                    runs = np.diff(first, append=b - a)
                    runs = runs.astype(np.uint8 if runs.max() < 256 else np.uint32)
                    rows.append((int(part[a]), node[doc[a:b][first]].tobytes(), runs.itemsize, runs.tobytes(),
                                 low[a:b].tobytes(), role[a:b].tobytes()))
                    a = b
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.binary(), pa.int32(), pa.binary(),
                                                                 pa.binary(), pa.binary()])],
                    ["part", "nodes", "width", "runs", "sigs", "roles"])

            for _, s in shingle_sets(batch.column(0), n):
                if (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                for sig, role in signatures(s, bands)[0]:
                    sigs.append(sig)
                    docs_.append(np.full(len(sig), len(nodes), np.uint32))
                    roles.append(np.full(len(sig), role, np.uint8))
                    size += len(sig)
                nodes.append(node)
                if size > FLUSH:
                    yield flush()
                    nodes, sigs, docs_, roles, size = [], [], [], [], 0
            if size:
                yield flush()
                nodes, sigs, docs_, roles = [], [], [], []
        batch = None
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def settle():
            node, sig, role = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(sig, kind="stable")
            s = sig[order]
            same = np.r_[False, s[1:] == s[:-1]]
            shared = same | np.r_[same[1:], False]
            order = order[shared]
            order = order[np.lexsort((node[order], sig[order]))]
            s, d, r = sig[order], node[order], role[order]
            if not len(s):
                return None
            begin = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])])  # a set once per bucket
            s, d, r = s[begin], d[begin], np.bitwise_or.reduceat(r, begin)
            bucket = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            sizes = np.diff(np.r_[bucket, len(s)])
            index = np.add.reduceat((r & INDEX).astype(np.int64), bucket)
            keep = np.repeat((sizes > 1) & (index > 0), sizes)
            key = (s.astype(np.int64) | (current << 32))[keep]
            return pa.record_batch([pa.array(key), pa.array(d[keep]), pa.array(r[keep].astype(np.int32)),
                                    pa.array(np.repeat(index, sizes)[keep])], ["sig", "node", "role", "n_index"])

        for batch in batches:
            for part, nodes, width, runs, sigs, roles in zip(*(c.to_pylist() for c in batch.columns)):
                if part != current:
                    if held and (out := settle()) is not None:
                        yield out
                    current, held = part, []
                runs = np.frombuffer(runs, np.uint8 if width == 1 else np.uint32)
                held.append((np.repeat(np.frombuffer(nodes, np.int64), runs), np.frombuffer(sigs, np.uint32),
                             np.frombuffer(roles, np.uint8)))
        if held and (out := settle()) is not None:
            yield out
        held, batch, out = [], None, None
        give_back()

    chunks = docs.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(
        emit, "part long, nodes binary, width int, runs binary, sigs binary, roles binary")
    return chunks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        count, "sig long, node long, role int, n_index long")


def allocate(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """``sig`` and ``node`` of the probes that have to be looked at: of each
    set's shared segments, all but the most crowded ones it can spare."""
    sides = shared.where(F.col("role").bitwiseAND(PROBE_OWN | PROBE_NEXT) != 0).select(
        "sig", "node", (F.col("n_index") - F.col("role").bitwiseAND(INDEX)).alias("cost"),
        F.explode(F.filter(F.array(F.when(F.col("role").bitwiseAND(PROBE_OWN) != 0, 0),
                                   F.when(F.col("role").bitwiseAND(PROBE_NEXT) != 0, 1)),
                           lambda x: x.isNotNull())).alias("which")).where("cost > 0")
    # One array per set and band; its length is bounded by the set's own size.
    lists = sides.groupBy("node", "which").agg(F.sort_array(F.collect_list(F.struct("cost", "sig"))).alias("l"))
    spared = lists.join(classes.select("node", "spare_own", "spare_next"), "node").withColumn(
        "n", F.size("l") - F.when(F.col("which") == 0, F.col("spare_own")).otherwise(F.col("spare_next")))
    return (spared.where("n > 0").select("node", F.explode(F.slice("l", F.lit(1), F.col("n").cast("int"))).alias("x"))
            .select("node", F.col("x.sig").alias("sig")).distinct())


def fitting(a, b, bands: Bands):
    """Whether sets of sizes ``a`` and ``b`` may be similar at all."""
    return F.least(a, b) * bands.den >= F.greatest(a, b) * bands.num


def verify(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that are similar.  Sets of no pair aren't shuffled."""
    shared = F.size(F.array_intersect("sa", "sb"))
    both = F.size("sa") + F.size("sb")
    sides = [sieve(sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")), x, pairs).where("_maybe")
             .drop("_maybe") for x in ("a", "b")]
    return (pairs.join(sides[0], "a").join(sides[1], "b")
            .where(bands.den * shared.cast("long") >= bands.num * (both - shared).cast("long")).select("a", "b"))


def fetch_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, n: int) -> DataFrame:
    """``node`` and ``shingles`` of the wanted nodes, from one row of each.  Texts
    are cut into shingles where they are; only shingles are shuffled."""
    rows = sieve(docs.select(F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("t")), "rk",
                 wanted).where("_maybe").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, flat, ends = [], [], [0]

        def out() -> pa.RecordBatch:
            values = pa.array(np.concatenate(flat))
            return pa.record_batch([pa.array(nodes, pa.int64()),
                                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["node", "shingles"])

        batch = None
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), n):
                nodes.append(node_of(s))
                flat.append(s.astype(np.int64))
                ends.append(ends[-1] + len(s))
                if ends[-1] > FLUSH:
                    yield out()
                    nodes, flat, ends = [], [], [0]
        if nodes:
            yield out()
        nodes, flat, batch = [], [], None
        give_back()

    made = rows.mapInArrow(run, "node long, shingles array<bigint>").dropDuplicates(["node"])
    return cut(made.join(wanted.select("node"), "node", "left_semi"), "sets")


def similar_links(docs: DataFrame, meta: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int,
                  bands: Bands) -> DataFrame | None:
    """Links that connect all similar nodes (not all of them within a component)."""
    total = meta.agg(F.sum("size")).first()[0] or 0
    if not total:
        return None
    shuffles = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffles, int(total) // PART + 1)  # a set has about as many signatures as shingles
    shared = cut(shared_signatures(docs, text_col, n, bands, parts), "shared")
    probes = cut(allocate(shared, classes), "probes")
    sizes = classes.select("node", F.col("size"))
    index = shared.where(F.col("role").bitwiseAND(INDEX) != 0).select("sig", F.col("node").alias("s"))
    index = cut(index.join(probes.select("sig").distinct(), "sig", "left_semi"), "index")
    # Sets that no allocation covers meet every set of a fitting size; there are next to none.
    odd = classes.where("direct").select(F.col("node").alias("r"), F.col("size").alias("rs"),
                                         F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    direct = (odd.join(classes.select(F.col("node").alias("s"), F.col("size").alias("ss"), "band"), "band")
              .where((F.col("r") != F.col("s")) & (F.col("ss") >= F.col("rs")) & fitting(F.col("rs"), F.col("ss"), bands))
              .select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct())
    wanted = cut(probes.select("node").union(index.select("s")).union(direct.select("a")).union(direct.select("b"))
                 .distinct().join(classes.select("node", "rk"), "node"), "wanted")
    sets = fetch_sets(docs, id_col, text_col, wanted, n)

    members = probes.select("sig", "node", F.lit(True).alias("probe")).unionByName(
        index.select("sig", F.col("s").alias("node"), F.lit(False).alias("probe"))).join(sizes, "node")
    # How much a set shares with all others: high for sets in the middle of a group of near copies.
    central = shared.where(F.col("role").bitwiseAND(INDEX) != 0).groupBy("node").agg(F.sum("n_index").alias("score"))
    members = members.join(central, "node", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    members = cut(members.withColumn("root", F.col("node")), "members-0")
    tried = cut(hub_pairs(members, HUBS, TRIES).union(direct).distinct(), "tried")
    links = cut(verify(tried, sets, bands), "links")
    members = cut(still_open(members, links), "members-1")
    members = cut(drop_loners(members, sets, bands), "members-2")

    # Buckets of few sets: their pairs.  Crowded ones: block by block.
    few = members.where(F.col("crowd") <= CROWD)
    left = few.where("probe").select("sig", F.col("node").alias("r"), F.col("root").alias("rr"),
                                     F.col("size").alias("rs"))
    right = few.where("not probe").select("sig", F.col("node").alias("s"), F.col("root").alias("sr"),
                                          F.col("size").alias("ss"))
    rest = (left.join(right, "sig").where((F.col("rr") != F.col("sr")) & (F.col("rs") <= F.col("ss"))
                                          & fitting(F.col("rs"), F.col("ss"), bands))
            .select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct())
    more = verify(cut(rest.join(tried, ["a", "b"], "left_anti"), "rest"), sets, bands)
    many = crowd_links(members.where(F.col("crowd") > CROWD), sets, bands)
    return cut(links.union(more).union(many), "all-links")


def crowd_links(members: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Links between different components inside crowded buckets.

    Buckets with the same most central set form a family; its probing sets are
    compared with its indexing sets in blocks of bounded size, so neither a
    pair nor a whole family is ever a row or a task.  Only links come out."""
    top = members.where("not probe").groupBy("sig").agg(F.max_by("node", F.struct("score", "node")).alias("family"))
    sides = members.join(top, "sig").select("family", "probe", "node", "root", "size").distinct()
    sides = cut(sides, "families")
    # Families without a probing set or with one component have nothing to compare.
    counts = sides.groupBy("family").agg(
        F.count(F.when(F.col("probe"), 1)).alias("nr"), F.count(F.when(~F.col("probe"), 1)).alias("ns"),
        F.sum("size").alias("tokens"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    block = F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, (F.col("nr") + F.col("ns")) / BLOCK_SETS)).cast("int")
    counts = counts.where("nr > 0 AND ns > 0 AND _a <> _b").select("family", block.alias("blocks"))
    placed = cut(sides.join(counts, "family").withColumn(
        "at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = placed.select("family", "probe", "node", "root", "at", F.explode(every).alias("other")).select(
        "family", "probe", "node", "root",
        F.when(F.col("probe"), F.col("at")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("probe"), F.col("other")).otherwise(F.col("at")).alias("j"))
    full = dealt.join(sieve(sets, "node", placed).where("_maybe").drop("_maybe"), "node")
    num, den = bands.num, bands.den

    def compare(block: pa.Table) -> pa.Table:
        probe = block.column("probe").to_numpy(zero_copy_only=False)
        node, root = (block.column(c).to_numpy() for c in ("node", "root"))
        lists = block.column("shingles").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(ends)
        index = np.flatnonzero(~probe)
        where = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in index]) if len(index) else np.zeros(0, int)
        owner = np.repeat(np.arange(len(index)), size[index])
        order = np.argsort(flat[where], kind="stable")
        token, owner = flat[where][order], owner[order]
        out_a, out_b = [], []
        for i in np.flatnonzero(probe):
            mine = flat[ends[i]:ends[i + 1]]
            lo, hi = np.searchsorted(token, mine), np.searchsorted(token, mine, "right")
            n = hi - lo
            skip = np.repeat(lo - (np.cumsum(n) - n), n)
            shared = np.bincount(owner[skip + np.arange(len(skip))], minlength=len(index))
            ok = (den * shared >= num * (size[index] + size[i] - shared)) & (root[index] != root[i])
            near = index[ok]
            near = near[np.unique(root[near], return_index=True)[1]]  # one link to a component is enough
            out_a += [int(node[i])] * len(near)
            out_b += node[near].tolist()
        a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return full.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def hub_pairs(members: DataFrame, hubs: int, tries: int) -> DataFrame:
    """Pairs to try first: every bucket names up to ``hubs`` of its indexing
    sets, those that share most with all others (the first one strictly so, the
    next ones with ever more chance), and every probing set takes the ``tries``
    hubs of other components that it meets in most buckets."""

    def worth(k: int):
        return F.col("score") * (1 + (2.0 ** k - 1) * 0.2 * hash01(F.lit(k), "node"))

    order = [F.max(F.struct(worth(k).alias("h"), "node", "root")).alias(f"h{k}") for k in range(hubs)]
    named = members.where("not probe").groupBy("sig").agg(*order).select(
        "sig", F.explode(F.array_distinct(F.array(*[F.struct(f"h{k}.node", f"h{k}.root") for k in range(hubs)])))
        .alias("hub"))
    met = (members.where("probe").join(named, "sig").where("root <> hub.root")
           .groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("n")))
    best = Window.partitionBy("node").orderBy(F.desc("n"), "hub")
    return (met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= tries)
            .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())


def still_open(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with their components' roots, of buckets with more than one."""
    if links.take(1):
        roots = connected_components(links)
        members = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = (members.groupBy("sig").agg(F.min("root").alias("_a"), F.max("root").alias("_b"),
                                        F.count(F.lit(1)).alias("crowd")).where("_a <> _b").select("sig", "crowd"))
    return members.drop("crowd").join(open_, "sig")


def drop_loners(members: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Drop sets from crowded buckets that share too little with all sets of
    the crowded buckets together.

    The smaller set of a similar pair has at most ``size - ceil(num (2 size) / (num + den))``
    shingles that the larger one lacks, the larger one at most
    ``size (1 - num / den)``.  Shingles that no other set here has are such
    shingles, whatever the partner."""
    crowded = members.where(F.col("crowd") > CROWD)
    if not crowded.take(1):
        return members
    nodes = cut(crowded.select("node", "size").distinct(), "crowded")
    tokens = sieve(sets, "node", nodes).where("_maybe").join(nodes, "node").select("node", "size", F.explode("shingles").alias("h"))
    alone = (tokens.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("node").alias("node")).where("n = 1")
             .groupBy("node").agg(F.count(F.lit(1)).alias("alone")))
    alone = cut(alone, "alone")
    marked = members.join(alone, "node", "left")
    own = F.coalesce("alone", F.lit(0))
    as_small = F.col("size") - F.ceil(2 * bands.num * F.col("size") / (bands.num + bands.den) - 1e-9)
    as_large = F.floor(F.col("size") * (bands.den - bands.num) / bands.den + 1e-9)
    ok = (F.col("crowd") <= CROWD) | (F.col("probe") & (own <= as_small)) | (~F.col("probe") & (own <= as_large))
    return marked.where(ok).drop("alone")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE,
                       num: int = NUM, den: int = DEN) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (the smallest id reachable
    by links), ``component`` (a key of the component; null without shingles)
    and ``row_key`` (hash of id and text) of every row of ``docs``."""
    bands = Bands(num, den)
    meta = cut(describe(docs, id_col, text_col, n, bands), "described")
    band = F.lit(-1)
    for low in bands.low:
        band = band + (F.col("size") >= low).cast("int")
    classes = cut(meta.where("size > 0").groupBy("node").agg(
        F.min("size").alias("size"), F.min("id").alias("first"), F.min("rk").alias("rk"),
        F.min("spare_own").alias("spare_own"), F.min("spare_next").alias("spare_next"),
        F.max("direct").alias("direct")).withColumn("band", band), "classes")
    links = similar_links(docs, meta, classes, id_col, text_col, n, bands)
    if links is not None and links.take(1):
        roots = connected_components(links)
        names = roots.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("name"))
        linked = roots.join(names, "root")
        known = classes.select("node", "first").join(linked, "node", "left").select(
            "node", F.coalesce("name", "first").alias("component_id"), F.coalesce("root", "node").alias("component"))
    else:
        known = classes.select("node", F.col("first").alias("component_id"), F.col("node").alias("component"))
    return meta.join(known, "node", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        "component", F.col("rk").alias("row_key"))
