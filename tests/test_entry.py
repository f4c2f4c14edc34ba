"""The driver contract: every registered query against its DuckDB oracle."""

import math
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


# The corpus operators have tests of their own.
TENSOR = sorted(q for q in E.queries() if not re.match(r"op\d+_|pipeline$", q))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda n: names[n])
    out = []
    for r in rows:
        out.append(tuple("nan" if isinstance(r[n], float) and math.isnan(r[n]) else r[n] for n in order))
    return sorted(out, key=repr)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["n", "brand", "value"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(TENSOR) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", TENSOR)
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = E.queries()[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    res = duck.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = _rows(cols, res.fetchall())
    assert got == want


def test_queries_load_without_the_corpus_folders(tmp_path):
    """The tensor queries don't need the corpus operators, nor their pipeline module."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    for name in ("__spark_entry__.py", "workload.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as E; print(*sorted(E.queries()), *sorted(E.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert set(out.stdout.split()) == set(TENSOR)
