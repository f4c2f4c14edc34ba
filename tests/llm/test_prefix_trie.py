"""The prefix trie against brute force over rebuilt turns, and odd input."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x0 int"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
    return sorted((cs[0], len(k), members[k[:-1]][0] if k else None, len(cs), kids.get(k, 0), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in cs if len(built[c]) == len(k)).encode()).hexdigest())
                  for k, cs in members.items())


def found(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def sample(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 60), *range(101, 140), *range(300, 330), 777]:  # conversation 100 is absent
        for t in range(rng.integers(1, 14)):
            text = ["a", "b", "日本", "", None][rng.integers(5)] if rng.random() < 0.9 else "long " * 9
            turn = None if t == 0 and rng.random() < 0.3 else int(rng.integers(0, 6)) if rng.random() < 0.2 else t
            rows.append((c, turn, [None, "", "user"][rng.integers(3)], text, 1, 2))
    rows += [(c, t, "user", "same", 1, 2) for c in range(400, 430) for t in range(9)]  # copies
    return rows + [(None, 0, "user", "no conversation", 1, 2), rows[3], rows[3]]


@pytest.mark.parametrize("span", [4096, 3])
def test_trie_matches_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(trie, "SPAN", span)
    monkeypatch.setattr(trie, "CHUNK", 20 if span == 3 else 1 << 20)
    rows = sample(span)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.prefix_trie(df.repartition(7))) == brute(rows)


def test_long_conversation_is_split_over_partitions(spark):
    rows = [(500, t, "user", f"t{t % 7}", 1, 2) for t in range(3000)] + [(501, t, "user", f"t{t % 7}", 1, 2) for t in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored, turns = trie.store_turns(spark.createDataFrame(rows, SCHEMA), 0)
        assert stored.select("part").distinct().count() > 3
        at = {(r["conv_id"], r["pos"]) for r in turns.collect()}
        assert at == {(c, t + 1) for c, t, *_ in rows}
        # The same turns make the same fingerprints, wherever they lie.
        prints = defaultdict(set)
        for r in turns.collect():
            prints[r["pos"]].add(tuple(r[f] for f in trie.lanes("f")))
        assert all(len(prints[p]) == 1 for p in range(1, 41))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_collisions_are_found_and_raise(spark, monkeypatch):
    monkeypatch.setattr(trie, "LANES", 1)
    monkeypatch.setattr(trie, "PRIMES", (7,))
    monkeypatch.setattr(trie, "SEEDS", 2)
    df = spark.createDataFrame([(c, t, "user", f"{c} {t}", 1, 2) for c in range(5) for t in range(3)], SCHEMA)
    with pytest.raises(RuntimeError, match="collide"):
        trie.prefix_trie(df)


def test_another_seed_after_a_collision(spark, monkeypatch):
    tried = []
    real = trie.ambiguous
    monkeypatch.setattr(trie, "ambiguous", lambda stored: tried.append(1) or len(tried) == 1 or real(stored))
    rows = sample(9)[:60]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert len(tried) == 2


def test_trie_on_odd_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(none).count() == 0
    short = [(2, 0, "user", "x", 1, 2)]  # shorter than its head, whose base is absent: no turn is left
    assert zlib.crc32(b"2") % 6 > 0
    assert found(trie.prefix_trie(spark.createDataFrame(short, SCHEMA))) == brute(short)
    small = spark.createDataFrame([(3, "a"), (4, "a")], "conv_id int, text string").selectExpr(
        "conv_id", "CAST(NULL AS INT) AS turn", "'user' AS role", "repeat(text, 200000) AS text")
    rows = [(r["conv_id"], None, "user", "a" * 200000) for r in small.collect()]
    assert found(trie.prefix_trie(small)) == brute(rows)
