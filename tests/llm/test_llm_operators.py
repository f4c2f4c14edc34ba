"""Operators against brute force, and their defined results on odd input."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format as chat
from tessera.llm import decontam, fertility, jaccard_join, lang_id, mixing, pii, quality_rank, shard_propagation
from tessera.llm import url_rules as urls
from tessera.llm.common import give_back, table, vocabulary
from tessera.llm.components import connected_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = (text or "").translate(UPPER).encode().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


# ------------------------------------------------------------ quality
def test_pairwise_quality_separates_held_out_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality_rank.fit_quality(docs, labels, train)
    got = quality_rank.score_quality(docs, model).join(labels, "doc_id").where(~train).collect()
    good = [r["score"] for r in got if r["quality"] == 1]
    bad = [r["score"] for r in got if r["quality"] == 0]
    assert good and all(0 <= x <= 1 for x in good + bad)
    assert np.mean([g > b for g in good for b in bad] or [1]) > 0.9


def test_quality_on_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (5, 0), (99, 1), (None, 0)], "doc_id long, quality int")
    model = quality_rank.fit_quality(odd, labels, F.lit(True))
    rows = quality_rank.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["score"])
    assert by[1] == by[2]  # null like empty
    empty = quality_rank.fit_quality(none, labels.limit(0), F.lit(True))
    assert quality_rank.score_quality(none, empty).count() == 0
    assert empty.score(np.zeros((1, quality_rank.N_FEATURES)))[0] == pytest.approx(0.5)


# ------------------------------------------------------------ language
def test_language_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = lang_id.fit_languages(docs, train, docs_per_lang=60)
    got = lang_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(~train).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.9


def test_language_on_odd_input_and_pieces(odd, none, monkeypatch):
    letters = lang_id.letter_table()
    model = lang_id.fit_texts(["the cat and the dog"] * 10 + ["der hund und die katze"] * 10, ["en"] * 10 + ["de"] * 10)
    names, score, ok = model.predict([None, "", "12 34!", "the dog", "der hund"], letters)
    assert names == ["und", "und", "und", "en", "de"] and score[:3].tolist() == [0, 0, 0] and not ok[:3].any()
    long = "der hund und die katze " * 200
    whole = model.predict([long, "the cat"], letters)[1]
    monkeypatch.setattr(lang_id, "PIECE", 64)
    assert np.allclose(model.predict([long, "the cat"], letters)[1], whole)
    assert lang_id.identify(odd, model).count() == odd.count()
    assert lang_id.identify(none, lang_id.fit_languages(none, F.lit(True))).count() == 0


def test_give_back_returns_the_memory_of_freed_arrays():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    arrays = [np.ones(12_000) for _ in range(2_000)]  # 96 KB each: not mapped one by one
    pinned, full = np.ones(12_000), held()
    del arrays
    give_back()
    assert full - held() > 100e6 and pinned.all()


# ------------------------------------------------------------ sharding
def test_shards_are_even_and_keep_copies_together(spark):
    rows = [(i, f"text {i % 40}" if i < 120 else f"single {i}") for i in range(403)] + [(None, None), (5, "text 5")]
    out = shard_propagation.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10,
                                            keep=["doc_id"]).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 10 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    homes = defaultdict(set)
    for r in out:
        if r["linked"]:
            homes[r["text_crc32"]].add(r["shard"])
    assert len(homes) == 40 and np.mean([len(v) == 1 for v in homes.values()]) > 0.8


def test_shards_of_one_large_group_and_of_nothing(spark, odd, none):
    same = spark.createDataFrame([(i, "same") for i in range(100)], "doc_id long, text string")
    sizes = Counter(r["shard"] for r in shard_propagation.shard_documents(same, 7, keep=["doc_id"]).collect())
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    rows = shard_propagation.shard_documents(odd, 4, keep=["doc_id"]).collect()
    assert len(rows) == odd.count()
    assert [r["size"] for r in rows if r["doc_id"] == 1] == [16]
    assert shard_propagation.shard_documents(none, 4, keep=["doc_id"]).count() == 0


def _cut_share(spark, links, n, shards):
    ids = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    edges = spark.createDataFrame(links, "a long, b long")
    out = shard_propagation.shard_documents(ids, shards, keep=["doc_id"], links=edges).cache()
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(sizes) == n and len(sizes) == min(n, shards) and max(sizes) - min(sizes) <= 1
    found = shard_propagation.cut_links(edges, out, id_col="doc_id").first()
    shard = {r["doc_id"]: r["shard"] for r in out.collect()}
    assert found["links"] == len(links) and found["cut"] == sum(shard[a] != shard[b] for a, b in links)
    return found["cut"] / found["links"]


def test_paths_that_fit_a_shard_are_rarely_cut(spark):
    order = np.random.default_rng(3).permutation(4000)
    paths = [(int(order[i]), int(order[i + 1])) for i in range(3999) if i % 8 != 7]
    assert _cut_share(spark, paths, 4000, 40) < 0.1


def test_one_long_chain_is_cut_about_once_a_shard(spark):
    order = np.random.default_rng(4).permutation(1000)
    assert _cut_share(spark, [(int(order[i]), int(order[i + 1])) for i in range(999)], 1000, 5) < 0.1


def test_linked_clusters_stay_whole_beside_stray_links(spark):
    # 40 dense groups of 20 documents and a stray link from each to the next.
    rng = np.random.default_rng(5)
    links = [(20 * g + int(a), 20 * g + int(b)) for g in range(40) for a, b in rng.integers(0, 20, (60, 2)) if a != b]
    links += [(20 * g, 20 * g + 20) for g in range(39)]
    assert _cut_share(spark, links, 800, 8) < 0.12


def test_rounds_on_few_links_take_few_tasks(spark, monkeypatch):
    tables, write = {}, shard_propagation.cut
    monkeypatch.setattr(shard_propagation, "cut", lambda df, name: tables.setdefault(name, write(df, name)))
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        # One group larger than a shard: its rest moves round by round.
        rows = [(i, "same" if i < 60 else f"single {i}") for i in range(120)]
        out = shard_propagation.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6, keep=["doc_id"])
        assert out.count() == 120
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rounds = [df for name, df in tables.items() if name.split("-")[0] in ("edges", "best", "asks", "joins", "clusters", "moves")]
    assert "moves-2" in tables and max(len(df.inputFiles()) for df in rounds) <= shard_propagation.FEW_FILES


def test_quotas_hold_capacity():
    share = shard_propagation.quotas({0: 10, 1: 10, 2: 10}, {(0, 1): 10, (2, 1): 10, (1, 0): 2}, 12)
    counts = {0: 10 - 10 * share[0, 1] + 2 * share[1, 0], 1: 10 + 10 * share[0, 1] + 10 * share[2, 1] - 2 * share[1, 0]}
    assert counts[0] <= 12.6 and counts[1] <= 12.6


# ------------------------------------------------------------ URLs
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_url_rules_match_brute_force(spark):
    rng = np.random.default_rng(0)
    pages = []
    for i in range(600):
        site = ["spam", "news", "shop"][rng.integers(3)]
        pages.append((i, f"HTTP://{site}.Example.org/{['en', 'de'][rng.integers(2)]}/{i}?k={i}", site == "spam"))
    df = spark.createDataFrame(pages, "page_id long, url string, bad boolean")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    labelled = df.where("page_id < 400").select(urls.url_tokens(F.col("url"), host, path).alias("tokens"), "bad")
    rules = urls.mine_rules(labelled)
    found = {tuple(sorted(r["tokens"])): (r["n"], round(r["confidence"], 9)) for r in rules.collect()}
    lists = [(set(r["tokens"]), r["bad"]) for r in labelled.collect()]
    from itertools import combinations
    every = {}
    for k in range(1, max(len(t) for t, _ in lists) + 1):
        seen, bad = Counter(), Counter()
        for t, b in lists:
            for c in combinations(sorted(t), k):
                seen[c] += 1
                bad[c] += b
        every |= {c: (n, bad[c] / n) for c, n in seen.items() if n >= 20 and bad[c] / n >= 0.6}
    minimal = {c: v for c, v in every.items()
               if not any(set(o) < set(c) and every[o][1] >= v[1] for o in every)}
    assert found == {c: (n, round(x, 9)) for c, (n, x) in minimal.items()} and found
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, rules, RULES).collect()}
    assert all((v == "block") == pages[i][2] for i, v in got.items())


def mined(spark, rows):
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    return {tuple(r["tokens"]): (r["n"], r["confidence"]) for r in urls.mine_rules(df.repartition(4)).collect()}


def test_rules_of_many_tokens_and_of_a_small_share_are_mined(spark):
    four = [(list("abcd"), True)] * 30
    for drop in "abcd":  # every smaller combination is mostly good
        four += [([t for t in "abcd" if t != drop], False)] * 60
    assert mined(spark, four) == {tuple("abcd"): (30, 1.0)}
    rare = [(["x", "y"], True)] * 30 + [([f"t{i % 97}", "y"], False) for i in range(20_000)]
    assert mined(spark, rare) == {("x",): (30, 1.0)}
    wide = [([f"t{i:02}" for i in range(30)], True)] * 30  # one item, not 2^30 sets
    assert mined(spark, wide) == {tuple(f"t{i:02}" for i in range(30)): (30, 1.0)}
    assert mined(spark, [(["a"], True)] * 19) == {} == mined(spark, [(["a"], True)] * 19 + [(["a"], False)] * 13)
    assert mined(spark, [([], True), (["a"], None)]) == {}


def test_url_parts_and_fixed_rules(spark):
    cases = [(1, "http://A.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
             (2, "x://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
             (3, "http://example.com", "example.com", "", None, "allow"),
             (4, "http://b.net/es/1#f", "b.net", "/es/1", "net/es/", "block"),
             (5, None, "", "", None, "allow"), (6, "no scheme", "", "", None, "allow"),
             (7, "http://bexample.com/en/", "bexample.com", "/en/", "com/", "allow"),
             (8, "a://b\n.com/x://y", "b\n.com", "/x://y", "com/", "allow")]
    df = spark.createDataFrame([(c[0], c[1], 1) for c in cases], "page_id long, url string, host int")
    rules = urls.mine_rules(spark.createDataFrame([], "tokens array<string>, bad boolean"))
    got = {r["page_id"]: r for r in urls.judge_urls(df, rules, RULES).collect()}
    for i, _, host, path, rule, verdict in cases:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)
    assert urls.judge_urls(df.limit(0), rules, RULES).count() == 0


# ------------------------------------------------------------ Jaccard join
def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("crowd", [24, 2])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    rng = np.random.default_rng(crowd)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    for size in [1, 3, 5, 6, 7, 8, 9, 10, 12, 14, 20, 35, 60, 120, 260, 500] * 3:
        base = list(rng.choice(vocabulary, size))
        for edits in [0, 0, 1, 1, 2, 3, 5, 8]:
            words = list(base)
            for _ in range(edits):
                if words:
                    k = rng.integers(len(words))
                    words[k:k + 1] = [] if rng.random() < 0.3 else [str(rng.choice(vocabulary))]
            rows.append((i, (" ".join(words)).upper() if edits == 1 else "\n ".join(words)))
            i += 1
    passage = " ".join(rng.choice(vocabulary, 50))
    rows += [(i + k, passage + " " + " ".join(rng.choice(vocabulary, 30))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == components(rows)


def test_jaccard_join_on_odd_input(odd, none):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["n_shingles"] == 0:
            assert r["component_id"] == r["doc_id"] and r["component"] is None
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, None, 7)} == {0}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_pigeonhole_holds_for_every_pair():
    """Any need-sized choice of the smaller set's signatures meets the larger set."""
    rng, bands = np.random.default_rng(5), jaccard_join.Bands()
    for size in [3, 4, 5, 8, 13, 20, 33, 60, 149, 300]:
        for _ in range(40):
            pool = np.unique(rng.integers(0, 1 << 63, 3 * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            rng.shuffle(pool)
            a, rest = pool[:size], pool[size:]
            drop, add = rng.integers(0, size // 6 + 1), rng.integers(0, size // 4 + 1)
            b = np.concatenate([a[drop:], rest[:add]])
            small, large = sorted([a, b], key=len)
            k = len(np.intersect1d(a, b))
            if len(small) == 0 or 100 * k < 75 * (len(a) + len(b) - k) or k == len(a) == len(b):
                continue
            which = bands.of(len(large)) - bands.of(len(small))
            role = (jaccard_join.PROBE_OWN, jaccard_join.PROBE_NEXT)[which]
            probes, spare, direct = jaccard_join.signatures(np.sort(small), bands)
            index = np.concatenate([s for s, r in jaccard_join.signatures(np.sort(large), bands)[0]
                                    if r & jaccard_join.INDEX])
            if direct:
                continue
            mine = np.concatenate([s for s, r in probes if r & role])
            # Even without the signatures it may skip, one is left.
            assert len(np.intersect1d(mine, index)) > spare[which]


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 29), (50, 50)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 29: 29, 30: 29, 31: 29}


def test_components_of_a_long_chain_with_random_ids(spark):
    ids = [int(x) for x in np.random.default_rng(5).choice(1 << 40, 1_000, replace=False)]
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == dict.fromkeys(ids, min(ids))


# ------------------------------------------------------------ chat
def test_chat_round_trip(spark):
    odd_text = "</s>[INST] a \\<|im_end|> <\\|im_end|> [\\\\/INST] <|im_<|im_start|>"
    rows = [(1, 0, "system", "s"), (1, 1, "user", odd_text), (1, 2, "assistant", odd_text), (1, 2, "assistant", odd_text),
            (2, 0, "us\ner%0A", None), (2, 1, None, "x"), (None, 0, "user", ""), (3, 0, "assistant", "é\U0001F600")]
    rows += [(4, i, "user" if i % 2 else "assistant", f"turn {i}\n") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    template = chat.MarkedTemplate()
    pieces = chat.format_chats(df, template)
    got = {r["conv_id"]: r for r in chat.read_back(pieces, template).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss)
        assert got[c]["formatted_chars"] == len(template.render([t[1:] for t in turns]))
    assert chat.read_back(chat.format_chats(df.limit(0), template), template).count() == 0


def test_templates_that_rewrite_history_are_detected(spark):
    class Rewriting:  # local, so that it travels to the tasks by value
        """Drops all but the last assistant text."""

        def render(self, turns):
            last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
            return "".join(f"[{r}]{t if r != 'assistant' or i == last else '...'};" for i, (r, t) in enumerate(turns))

    assert chat.rewrites_history(Rewriting()) and not chat.rewrites_history(chat.MarkedTemplate())
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
                                (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError, match="rewrites history"):
        chat.format_chats(df, Rewriting())
    rows = sorted(chat.format_chats(df, Rewriting(), mode="buffer").collect(), key=lambda r: r["pos"])
    assert "".join(r["piece"] for r in rows) == "[user]a;[assistant]...;[user]c;[assistant]d;"


def test_late_rewrites_raise_and_buffered_loss_is_the_text(spark):
    class ForgetsLate:  # local, so that it travels to the tasks by value
        """Leaves out all but the last 10 turns once there are more than 20."""

        def render(self, turns):
            return "".join(f"{r}:{t};" for r, t in (turns if len(turns) <= 20 else turns[-10:]))

    rows = [(1, i, "assistant" if i % 2 else "user", "a" if i % 2 else "hi") for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="rewrites history"):
        chat.format_chats(df, ForgetsLate()).collect()
    assert chat.format_chats(df.where("turn < 20"), ForgetsLate()).count() == 20
    got = {r["pos"]: r for r in chat.format_chats(df, ForgetsLate(), mode="buffer").collect()}
    final = ForgetsLate().render([(r, t) for _, _, r, t in rows])
    for k in range(1, 30, 2):
        assert (got[k]["loss_start"] is None) == (k < 20)
        if k >= 20:
            a = got[k]["loss_start"]
            assert final[a - 10:a + 2] == "assistant:a;" and got[k]["loss_stop"] == a + 1


# ------------------------------------------------------------ PII
def test_base_spans():
    text = "a@b.co x@y 1.2.3.255 1.2.3.256 4111 1111 1111 1111 4111111111111112 +1 (555) 123-4567 +12"
    kinds = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)]
    assert kinds == [("email", "a@b.co"), ("ip", "1.2.3.255"), ("card", "4111 1111 1111 1111"),
                     ("phone", "+1 (555) 123-4567")] or ("card", "4111111111111112") not in kinds
    for kind, regex in (("email", pii.EMAIL), ("ip", pii.IP)):
        assert all(re.fullmatch(regex, s) for k, s in kinds if k == kind)


def test_base_spans_equal_the_patterns_and_stay_linear():
    rng = np.random.default_rng(11)
    alphabet = list("a1.@-_+ (5")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, 40))
        assert pii.email_spans(text) == [m.span() for m in pii.EMAIL.finditer(text)]
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in ip.finditer(text)]
    assert pii.email_spans("a@b.co_x@y.com@z.org") == [m.span() for m in pii.EMAIL.finditer("a@b.co_x@y.com@z.org")]
    # Quadratic time would take hours here.
    long = "a" * 1_000_000 + " " + "1" * 1_000_000 + " x@y.de"
    assert pii.base_spans(long) == [(0, len(long) - 6, len(long))]


def test_free_spans_match_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(2000):
        ends = np.sort(rng.choice(40, 8, replace=False)).tolist()
        spans = list(zip(ends[::2], ends[1::2]))
        a = int(rng.integers(0, 39))
        b = int(rng.integers(a + 1, 41))
        assert pii.is_free(spans, a, b) == all(b <= x or a >= y for x, y in spans)


def test_pii_adds_spans_and_leaves_clean_text(spark, sf_dir, odd, none):
    docs = table(spark, sf_dir, "documents")
    model = pii.fit_pii(docs)
    rows = pii.find_pii(docs, model).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        spans = [(pii.KINDS.index(s["kind"]), s["start"], s["stop"]) for s in r["base"]]
        assert spans == pii.base_spans(texts[r["doc_id"]] or "")
        if not r["base"] and not r["added"]:
            assert r["redacted"] == (texts[r["doc_id"]] or "")
    found = pii.find_pii(odd, model).collect()
    assert len(found) == odd.count() and not any(r["base"] or r["added"] for r in found)
    assert pii.find_pii(none, pii.fit_pii(none)).count() == 0
    assert pii.redact("mail a@b.co now", [(0, 5, 11)]) == "mail [EMAIL] now"


def test_pii_adds_disguised_emails_and_phones(spark):
    rng = np.random.default_rng(3)
    d = lambda n: "".join(map(str, rng.integers(1, 10, n)))
    texts = [t for i in range(60) for t in (f"the hall of la {chr(97 + i % 26)}on.{d(2)}@box{i}.example.com and so",
                                            f"some are in +1 ({d(3)}) {d(3)}-{d(4)} on the way", f"order {d(16)} of the list",
                                            f"part {d(3)}-{d(3)}-{d(4)} is in the box")]
    model = pii.fit_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {"please write to jane.doe (at) host (dot) com today": ("email", "jane.doe (at) host (dot) com"),
            "or to jo[at]some[dot]host[dot]org. Then go": ("email", "jo[at]some[dot]host[dot]org"),
            "call 555-123-4567 now": ("phone", "555-123-4567"), "his phone is 555/123-4567 at work": ("phone", "555/123-4567"),
            "lot 555-123-4567 was sold": None, "number 2123465659789240 of the list": None}
    rows = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    for r in pii.find_pii(rows, model).collect():
        text = list(want)[r["doc_id"]]
        got = [(s["kind"], text[s["start"]:s["stop"]]) for s in r["added"]]
        assert got == ([want[text]] if want[text] else []) and not r["base"]


# ------------------------------------------------------------ mixing
def test_water_fill_shares_the_excess():
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 210) == pytest.approx([30, 120, 60])
    assert mixing.water_fill([0, 0], [5, 2], 0) == [0, 0]


def test_min_cost_flow_of_overlapping_sources():
    flow = mixing.min_cost_flow({("a",): 10.0, ("a", "b"): 10.0, ("b",): 2.0}, {"a": 12.0, "b": 9.0})
    into = defaultdict(float)
    used = defaultdict(float)
    for (p, s), x in flow.items():
        into[s] += x
        used[p] += x
    assert into["a"] == pytest.approx(12) and into["b"] == pytest.approx(9)
    assert used["a",] <= 10 + 1e-9 and used["a", "b"] + used["b",] == pytest.approx(21 - used["a",])
    assert sum(max(0, used[p] - c) for p, c in {("a",): 10, ("a", "b"): 10, ("b",): 2}.items()) == pytest.approx(0)


def cheapest(capacity, quota):
    """Amount and cost of the best flow, path by path with Bellman-Ford."""
    arcs = []

    def arc(u, v, cap, c):
        arcs.extend([[u, v, cap, c], [v, u, 0.0, -c]])

    for p, cap in capacity.items():
        for k, c in enumerate(mixing.COSTS):
            arc("S", ("p", p), cap, c)
        for s in p:
            arc(("p", p), ("s", s), 3 * cap, 0)
    for s, q in quota.items():
        arc(("s", s), "T", q, 0)
    amount = cost = 0.0
    while True:
        dist, back = {"S": 0}, {}
        for _ in range(60):
            for i, (u, v, cap, c) in enumerate(arcs):
                if cap > 1e-9 and u in dist and dist[u] + c < dist.get(v, 1e9):
                    dist[v], back[v] = dist[u] + c, i
        if "T" not in dist:
            return amount, cost
        path, v = [], "T"
        while v != "S":
            path.append(back[v])
            v = arcs[back[v]][0]
        push = min(arcs[i][2] for i in path)
        for i in path:
            arcs[i][2] -= push
            arcs[i ^ 1][2] += push
        amount, cost = amount + push, cost + push * dist["T"]


def test_flow_is_cheapest_and_fast():
    rng = np.random.default_rng(6)
    for _ in range(25):
        names = list("abcd")
        capacity = {tuple(sorted(rng.choice(names, rng.integers(1, 4), replace=False))): float(rng.integers(1, 20)) for _ in range(5)}
        quota = {s: float(rng.integers(0, 50)) for s in names}
        flow = mixing.min_cost_flow(capacity, quota)
        used, into = defaultdict(float), defaultdict(float)
        for (p, s), x in flow.items():
            assert s in p
            used[p] += x
            into[s] += x
        assert all(into[s] <= quota[s] + 1e-6 for s in names)
        cost = sum(c * min(max(used[p] - k * cap, 0), cap) for p, cap in capacity.items() for k, c in enumerate(mixing.COSTS))
        amount, least = cheapest(capacity, quota)
        assert sum(into.values()) == pytest.approx(amount) and cost == pytest.approx(least)
    names = [f"s{i}" for i in range(40)]
    large = {tuple(sorted(rng.choice(names, 3, replace=False))): float(rng.integers(1, 900)) for _ in range(1000)}
    total = sum(large.values())
    begin = time.process_time()
    flow = mixing.min_cost_flow(large, {s: total / 40 * (1 + i % 3) for i, s in enumerate(names)})
    assert time.process_time() - begin < 5 and sum(flow.values()) > total


def test_mix_of_overlapping_sources_comes_near_its_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), [["a"], ["a", "b"], ["b", "c"], ["c"]][i % 4]) for i in range(2000)]
    picked, sources = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, of array<string>"), members="of",
                                 keep=["doc_id"])
    rows = picked.collect()
    assert len(rows) == 2000 and all(r["taken"] <= 3 * r["size"] for r in rows)
    # What the sources ask for in all is taken, from documents of each.
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["target"] for r in sources.collect()), rel=0.02)


def test_mix_comes_near_targets_and_repeats(spark, odd, none):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 200)), f"s{i % 5}" if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.array("source"))
    picked, sources = mixing.mix(df, members="m", keep=["doc_id"])
    got = picked.collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.mix(df, members="m", keep=["doc_id"])[0].collect())
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["m"][0]] += r["taken"]
    for s in sources.collect():
        assert taken[s["source"]] == pytest.approx(s["target"], rel=0.02)
    odd = odd.withColumn("m", F.array("source"))
    assert mixing.mix(odd, members="m", keep=["doc_id"])[0].count() == odd.count()
    assert mixing.mix(odd.limit(0), members="m", keep=["doc_id"])[0].count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix_uses_the_room_behind_the_edge_bucket(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    sizes = np.random.default_rng(seed).integers(10, 50, 1_000).tolist() + [20_000]
    rows = [(i, ["a"], "w " * n) for i, n in enumerate(sizes)] + [(-1 - i, ["b"], "w " * 50) for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, s array<string>, text string")
    picked, sources = mixing.mix(docs, members="s", keep=["doc_id"], weights=(1, 3), seed=seed)
    taken = {r["s"][0]: r["n"] for r in picked.groupBy("s").agg(F.sum("taken").alias("n")).collect()}
    for r in sources.collect():
        assert r["target"] - 50 < taken[r["source"]] <= r["target"]
    assert picked.count() == len(rows)


# ------------------------------------------------------------ fertility
def test_base_counts_match_brute_force(spark, sf_dir, odd, none):
    space = "[\x20\x09-\x0d]+"
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in fertility.measure(docs, ["doc_id"]).collect()}
    for d in docs.collect():
        text, r = d["text"] or "", got[d["doc_id"]]
        ws = [w for w in re.split(space, text) if w]
        windows = list(zip(ws, ws[1:], ws[2:]))
        seen, inside = Counter(windows), set()
        for i, w in enumerate(windows):
            if seen[w] > 1:
                inside |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if re.sub(space, "", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
    rows = fertility.measure(odd, ["doc_id", "lang"]).collect()
    assert len(rows) == odd.count()
    stats = fertility.measure(none, ["doc_id", "lang"])
    assert fertility.judge(stats, fertility.bands(stats, F.col("lang")), F.col("lang")).count() == 0


def test_tokens_of_words_equal_the_tokens_of_the_text(monkeypatch):
    import sentencepiece

    paths = [vocabulary(v) for v in (*fertility.VOCABULARIES, "piece_bpe_32k.model")]
    text = "der Straße über naïve 日本語 zebra zebra \U00013000"
    pieces = sentencepiece.SentencePieceProcessor(model_file=paths[2])
    for cache in (1 << 20, 500):
        monkeypatch.setattr(fertility, "CACHE", cache)
        t = fertility.WordTokens(paths)
        for ws in (text.encode().split(), b"zebra zoo".split(), text.encode().split()):
            t.learn(set(ws))
            ids, others = t.encode(ws)
            whole = b" ".join(ws).decode()
            assert ids.tolist() == t.coders[0].encoder.encode_ordinary(" " + whole)
            other = t.coders[1].encoder.encode_ordinary(" " + whole)
            assert others[0].tolist() == [len(other), int(t.coders[1].partial[other].sum())]
            split = pieces.encode(whole)
            assert others[1].tolist() == [len(split), sum(pieces.is_byte(i) for i in split)]


def test_bands_reject_outliers_only(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = fertility.measure(docs, ["doc_id", "lang"])
    group = F.coalesce("lang", "script")
    rows = fertility.judge(stats, fertility.bands(stats, group), group).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.97 and np.mean([r["kept"] for r in bad] or [0]) < 0.6


def test_bands_reject_most_junk_that_passes_the_base_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = fertility.measure(docs, ["doc_id", "lang"])
    group = F.coalesce("lang", "script")
    rows = fertility.judge(stats, fertility.bands(stats, group), group).join(labels, "doc_id").where(
        "not base_failed").collect()
    kept = {q: [r["kept"] for r in rows if r["quality"] == q] for q in (0, 1)}
    assert kept[0] and np.mean(kept[0]) < 0.2 and np.mean(kept[1]) > 0.99


# ------------------------------------------------------------ decontamination
@pytest.mark.parametrize("block", [400_000, 60])
def test_containment_matches_brute_force(spark, sf_dir, block):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one two"), (-4, "one two")], "item_id long, text string")
    more = spark.createDataFrame([(-1, "One  two"), (-2, None), (-3, "")], "doc_id long, text string")
    items, docs = items.unionByName(extra), docs.select("doc_id", "text").unionByName(more)
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"])
           for r in decontam.find_items(docs.withColumn("item", F.lit(1)), items, block_shingles=block).collect()}
    d = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    want = {}
    for i in items.collect():
        s = shingles(i["text"])
        for doc_id, t in d:
            if s and 4 * len(s & t) >= 3 * len(s):
                want[doc_id, i["item_id"]] = (len(s & t), len(s))
    assert got == want and (-1, -3) in got
    assert decontam.find_items(docs.limit(0), items).count() == 0
    assert decontam.find_items(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("large", [50_000, 1_000])
def test_containment_of_long_items(spark, large):
    """Copying an item's array to each of its sketch rows would make this a table of a gigabyte."""
    text = [f"w{i}" for i in range(20_000)]
    items = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:10])), (3, " ".join(text)),
                                   (None, " ".join(text[:5_000]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(["x", *text[2_000:]])), (2, " ".join(text[:10_000])),
                                  (2, " ".join(text[:10_000])), (3, "w0")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0, r["n_shared"], r["n_item"])
                 for r in decontam.find_items(docs, items, large_shingles=large).collect())
    assert got == [(1, 1, 17_996, 19_996), (1, 3, 17_996, 19_996), *[(2, 0, 4_996, 4_996)] * 2, *[(2, 2, 6, 6)] * 2]


def test_bands_have_limits_of_their_own(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(4000)]
    items = [(0, "one two three four five"), (1, " ".join(words[:60])), (2, " ".join(words[100:700])), (3, "tiny")]
    docs = [(0, "x one two three four five y"), (1, " ".join(words[5:60]) + " z"), (2, "one two three four five"),
            (3, " ".join(words[90:690])), (4, "tiny"), (5, "tiny one"), (None, " ".join(words[:60])), (6, " ".join(words))]
    docs += [(100 + i, " ".join(rng.choice(words, 300))) for i in range(20)]
    found = decontam.find_items(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = shingles(item), shingles(text)
            if 4 * len(a & b) >= 3 * len(a):
                want.add((d, i, len(a & b)))
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in found} == want and len(want) >= 8
