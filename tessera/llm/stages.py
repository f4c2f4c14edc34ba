"""The stages of the corpus pipeline, each one an operator of this subpackage.

Every stage takes the documents its predecessor kept, as a table, and returns
the documents that stay (the last one: their shards).  Rows are told apart by
a hash of id and text.  Inside a stage columns are numbered, so that no
column of the input can clash with one of the stage's own.

Defined results: rows without words are rejected by the quality rules, and an
empty table passes through all stages; repeated rows of one id and text are
one group of the join; null ids and extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fertility, jaccard_join, mixing, shard_propagation
from .common import cut, sieve, table

SHARDS = 40


class Numbered:
    """Documents under numbered column names, with ``_key`` for id and text."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.columns = [f"c{i}" for i in range(len(self.names))]
        self.id, self.text, self.lang, self.source = (
            self.columns[self.names.index(c)] for c in ("doc_id", "text", "lang", "source"))
        self.rows = docs.toDF(*self.columns).withColumn("_key", F.xxhash64(self.id, self.text))

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns).toDF(*self.names)

    def one_per_key(self, rows: DataFrame, *extra: str) -> DataFrame:
        """One row of each ``_key``, the same in every run; summed up in the tasks
        first, so that a key of very many rows is a row per task."""
        hashable = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
        best = F.min_by(F.struct(*self.columns, *extra), F.xxhash64(*[c for c in hashable if c in self.columns]))
        return rows.groupBy("_key").agg(best.alias("_row")).select("_key", "_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands."""
    d = Numbered(docs)
    stats = cut(fertility.measure(d.rows, d.columns, text_col=d.text), "measured")
    group = F.coalesce(d.lang, "script")
    # Of known size, so that Spark can broadcast the limits and leave the texts where they are.
    limits = cut(fertility.bands(stats, group), "bands")
    return d.named(fertility.judge(stats, limits, group).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the 5-word Jaccard join: the smallest id."""
    d = Numbered(docs)
    found = jaccard_join.jaccard_components(d.rows, id_col=d.id, text_col=d.text)
    rows = cut(found.select(F.col(d.id).alias("id"), "component", F.col("row_key").alias("_key"))
               .where("component IS NOT NULL"), "components")
    best = rows.groupBy("component").agg(F.min(F.struct(F.isnull("id").alias("n"), "id", "_key")).alias("best"))
    out = rows.join(best, "component").groupBy("_key").agg(
        F.min(F.col("best._key") != F.col("_key")).alias("_loses"), F.count(F.lit(1)).alias("_rows"))
    out = cut(out.where("_loses OR _rows > 1"), "decisions")
    # Texts without a decision stay where they are.
    rows = sieve(d.rows, "_key", out)
    kept = rows.where("_maybe").join(out, "_key", "left").where("_loses IS NULL OR NOT _loses")
    kept = cut(kept.select("_key", *d.columns, "_rows"), "kept")
    once = d.one_per_key(kept.where("_rows > 1"))
    every = rows.where("NOT _maybe").select(*d.columns).unionByName(
        kept.where("_rows IS NULL OR _rows = 1").select(*d.columns)).unionByName(once.select(*d.columns))
    return d.named(every)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't contain a benchmark item."""
    d = Numbered(docs)
    found = decontam.find_items(d.rows, table(spark, sf_dir, "benchmark"), id_col="_key", text_col=d.text)
    leaks = cut(found.select("_key").distinct(), "leaks")
    rows = sieve(d.rows, "_key", leaks)
    return d.named(rows.where("NOT _maybe").unionByName(rows.where("_maybe").join(leaks, "_key", "left_anti")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (not at all to three times)."""
    d = Numbered(docs)
    docs = d.rows.withColumn("_members", F.array(d.source))
    mix = mixing.Mix(docs, members="_members", text_col=d.text, keep=["_key"])
    times = mix.picked.groupBy("_key").agg(
        F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("int").alias("_times"),
        F.count(F.lit(1)).alias("_rows"), F.max("guess").alias("_guess"))
    # All others tell from their source and hash alone how often they are taken: they stay where they are.
    times = cut(times.where("_rows > 1 OR _times <> _guess").select("_key", "_times", "_rows"), "times")
    rows = sieve(mix.in_place(docs, "_own"), "_key", times)
    out = cut(rows.where("_maybe").join(times, "_key", "left").select("_key", *d.columns, "_own", "_times", "_rows"),
              "known")
    one = out.where("_rows IS NULL OR _rows = 1").withColumn("_times", F.coalesce("_times", "_own"))
    # Rows of one key are equal in id and text; one of them stands for all.
    many = d.one_per_key(out.where("_rows > 1"), "_times")
    every = rows.where("NOT _maybe").select(*d.columns, F.col("_own").alias("_times")).unionByName(
        one.select(*d.columns, "_times")).unionByName(many.select(*d.columns, "_times"))
    return d.named(every.where("_times > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times")))))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return shard_propagation.shard_documents(docs, SHARDS, keep=["doc_id"])


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixture", mixture), ("sharding", sharding)]

#: The tokenisers, the join's components and label propagation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
