"""The registered queries and the pipeline over the small tables."""

import re

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from pyspark.sql import functions as F
from tessera.llm import queries as Q
from tessera.llm.common import cut

TABLES = "documents pages benchmark labels conversations".split()
OPS = sorted(Q.queries())


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in OPS) == list(range(1, 14))
    assert set(OPS) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = Q.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    res = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in cols) for r in res.fetchall())))
    assert got == want


@pytest.mark.parametrize("name", sorted(set(OPS) - set(Q.oracle_sql()) - {"op2_language"}))
def test_query_covers_its_table(spark, sf_dir, name):
    whole = spark.read.parquet(f"{sf_dir}/{'pages' if 'url' in name else 'documents'}.parquet").count()
    assert Q.queries()[name](spark, sf_dir).count() == whole


def test_pipeline_stages(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        after = docs.count()
        if name == "sharding":
            assert {"doc_id", "shard", "slot"} <= set(docs.columns) and after == before
        else:
            assert docs.columns == columns
            assert 0 < after and (after <= before or name == "mixture")
        before = after
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
    once = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd, sf_dir)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in once.collect()) == [(False, i) for i in range(6)]


CLASHES = ["rows", "loses", "_key", "_n", "_times", "_members", "_rows", "n_words", "k_doc_id", "component", "c0", "node"]


def test_pipeline_carries_columns_of_any_name(spark, sf_dir):
    """Columns named like a stage's own keep their values; map columns and many copies pass."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHES],
                       F.create_map(F.lit("id"), "doc_id").alias("a_map"))
    wide = cut(wide.unionByName(wide.limit(5)), "wide")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and {r["doc_id"] for r in rows} <= ids
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHES)
        assert all(r["a_map"] == {"id": r["doc_id"]} for r in rows)
        if name == "near_duplicates":
            assert len(rows) == len({r["doc_id"] for r in rows})
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf_dir).count() == wide.count()
