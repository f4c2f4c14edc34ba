"""Joins of texts with decisions: only the rows that they are about are shuffled."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, jaccard_join, mixing, stages


@pytest.fixture
def no_broadcast(spark):
    """What large tables do: no join is broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(plan, column: str) -> int:
    """Rows with ``column`` that an executed plan shuffled."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan(), column)
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan(), column)
    kids = plan.children()
    found = sum(shuffled(kids.apply(i), column) for i in range(kids.size()))
    if kind == "ShuffleExchangeExec" and re.search(rf"\b{column}#", plan.output().toString()):
        found += plan.metrics().apply("shuffleRecordsWritten").value()
    return found


def rows_of(df, column: str):
    rows = df.collect()
    return rows, shuffled(df._jdf.queryExecution().executedPlan(), column)


def corpus(n: int, seed: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 20 + i % 30)), "en", "ab"[i % 2]) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("most", [common.SIEVE_BITS, 1 << 15])
def test_a_sieve_loses_no_key_and_stops_most_others(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIEVE_BITS", most)
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 8_000).tolist()
    wanted = spark.createDataFrame([(k,) for k in keys[:3_000]], "k long").repartition(5)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [(None, -1)], "k long, i int")
    got = common.sieve(rows, "k", wanted).collect()
    assert len(got) == 8_001 and got[0].asDict().keys() == {"k", "i", "_maybe"}
    assert all(r["_maybe"] for r in got if 0 <= r["i"] < 3_000)
    assert sum(r["_maybe"] for r in got if r["i"] >= 3_000) < (0.06 if most > 1 << 15 else 0.12) * 5_000
    assert not any(r["_maybe"] for r in common.sieve(rows, "k", wanted.limit(0)).collect())
    null = spark.createDataFrame([(None,)], "k long")
    assert [r["i"] for r in common.sieve(rows, "k", null).where("_maybe").collect()].count(-1) == 1


def test_near_duplicates_leaves_texts_without_a_decision(spark, no_broadcast, monkeypatch):
    rows = corpus(1_500)
    rows += [(10_000 + i, rows[i][1] + " more", "en", "a") for i in range(30)] + rows[50:60]  # near copies, same rows
    seen = []

    def spy(df, name):
        if name == "sets":
            seen.append(rows_of(df, "t")[1])
        return common.cut(df, name)

    monkeypatch.setattr(jaccard_join, "cut", spy)
    docs = common.cut(spark.createDataFrame(rows, SCHEMA), "texts-stay")
    got, moved = rows_of(stages.near_duplicates(spark, docs, ""), "c1")
    assert sorted(r["doc_id"] for r in got) == list(range(1_500))
    assert moved < 400  # 1,540 before: all
    assert seen == [0]  # 1,540 before


def test_mixture_leaves_texts_that_know_their_share(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = corpus(2_000)
    twice = [*rows[100:110], *[(i, t, lang, "c") for i, t, lang, _ in rows[200:220]]]  # in one and in two sources
    odd = [(-1, "", "en", "a"), (-2, None, None, None), (None, "one two", None, None), (None, "one two", "de", "c")]
    docs = common.cut(spark.createDataFrame(rows + twice + odd, SCHEMA), "texts-stay")
    got, moved = rows_of(stages.mixture(spark, docs, ""), "c1")
    assert moved < 300  # 2,034 before: all
    d = stages.Numbered(docs)
    picked, _ = mixing.mix(d.rows.withColumn("m", F.array(d.source)), members="m", text_col=d.text, keep=["_key"])
    wanted = Counter()
    for r in picked.where("size > 0").collect():
        wanted[r["_key"]] += r["taken"] // r["size"]
    key = dict(d.rows.select(F.struct(d.id, d.text), "_key").collect())
    assert Counter(key[r["doc_id"], r["text"]] for r in got) == +wanted
    assert 0 < sum(wanted.values()) and len({*wanted.values()}) > 1
    assert stages.mixture(spark, docs.limit(0), "").count() == 0


def test_signatures_of_long_texts_are_sent_whole(spark):
    words = [f"v{x}" for x in np.random.default_rng(2).integers(0, 10**6, 12_000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:6_000], "other", *words[6_001:]])), (3, " ".join(words[::-1]))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3}
