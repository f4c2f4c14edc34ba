"""The source audit against brute force: counts, skybands, pairs, odd input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence_audit as audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(FOLD))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        whole = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        q, ps = shares(whole), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(ps[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and ps[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)}
    return out


def rows_of(df):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("entries", [400_000, 40])
def test_audit_matches_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(audit, "ENTRIES", entries)
    monkeypatch.setattr(audit, "PIECE", 64)
    monkeypatch.setattr(audit, "BLOCK", 2)
    monkeypatch.setattr(audit, "TERMS", 7)
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abAéßzñ" for b in ["x", "Y", "日", "q"]]
    rows = []
    for i in range(260):
        source = [None, "", "s1", "s2", "s3", "hot", "hot", "hot"][rng.integers(8)]
        weight = np.arange(1, len(words) + 1) ** (0.5 + (source == "hot"))
        text = " ".join(rng.choice(words, rng.integers(0, 40), p=weight / weight.sum())) + "_9-Foo"
        rows.append((None if i % 50 == 0 else text, [None, "en", "de"][rng.integers(3)], source))
    rows += [("nothing kept here", "fr", s) for s in ("a", "b")] + [(None, "it", "only"), ("", "xx", "a"), ("", "xx", "b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, text string, lang string, source string")
    assert rows_of(audit.audit_sources(df.repartition(5), min_docs=4, top=3)) == brute(rows, 4, 3)


def test_skyband_holds_whatever_few_rows_dominate():
    rng = np.random.default_rng(5)
    for size in (1, 5, 300, 1500):
        n, lang_n, term = rng.integers(1, 9, size), rng.integers(1, 30, size), rng.permutation(size)
        order = np.lexsort((term, lang_n, -n))
        n, lang_n, term = n[order], lang_n[order], term[order]
        got = audit.dominated(n, lang_n, term, 3)
        over = (n[None] >= n[:, None]) & (lang_n[None] <= lang_n[:, None]) & (term[None] < term[:, None])
        assert (got == (over.sum(axis=1) >= 3)).all()


def test_shares_are_exact_for_large_counts():
    count, total = np.array([2, 10**14 + 7, 9 * 10**15 - 1, 5]), np.array([3, 9 * 10**15 - 1, 9 * 10**15 - 1, 5])
    assert audit.shares(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist())]


def test_audit_on_odd_input(odd, none):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert rows_of(audit.audit_sources(odd.withColumnsRenamed({"size": "term", "node": "tid"}))) == brute(rows, 10, 10)
    assert rows_of(audit.audit_sources(odd, min_docs=1)) == brute(rows, 1, 10)
    assert audit.audit_sources(none).count() == 0
