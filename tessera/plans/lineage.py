"""Cutting the lineage of iterated plans with reliable checkpoints.

Checkpoints go to the shared folder the cluster names in
``spark.checkpoint.dir`` (read from the session), so a lost executor never
takes a materialized intermediate with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; ``RuntimeError`` if none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        raise RuntimeError(
            "no checkpoint folder: set spark.checkpoint.dir to a folder on shared storage"
        )
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` into the checkpoint folder and return the short plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame, measures: Sequence[Column]) -> tuple[DataFrame, dict[str, int]]:
    """``cut_lineage``, and aggregates over the rows taken by the job that writes them."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, *measures))
    return out, seen.get
