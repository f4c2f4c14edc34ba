"""Helpers shared by the corpus operators: tables, shared scratch, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Bits of a sieve: so many per key, and never more than these (8 MB), so that
#: what is broadcast stays small however many keys there are.
SIEVE_SHARE, SIEVE_BITS = 32, 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the
    context's checkpoint folder.  Only a local session without either gets a
    folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    named = named or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-llm-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table.

    Ends the lineage like a reliable checkpoint, but keeps column pruning and
    size statistics for the plans that follow."""
    path = f"{shared_dir(df.sparkSession)}/tessera-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``key`` is surely no value of
    ``wanted``'s column of that name (3 % of the others are true as well).

    Rows without it needn't take part in a join with ``wanted``, so they are not
    shuffled for it.  Only a bit map of the keys' hashes is broadcast.
    ``wanted`` must give the same rows on every read (see ``cut``)."""
    bits = min(SIEVE_BITS, max(1 << 15, SIEVE_SHARE * wanted.count()))
    at = F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))
    # Bit maps of 4096 bytes count from 1; every row gets a copy of what it meets, so they are cut into pieces of 64.
    maps = wanted.select((at + 1).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_map")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    pieces = maps.select("_map", "_bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_i")).select(
        ((F.col("_map") - 1) * 64 + F.col("_i")).alias("_piece"),
        F.substring(F.col("_bits"), F.col("_i") * 64 + 1, F.lit(64)).alias("_bits"))
    byte = F.substring(F.col("_bits"), F.shiftright(F.col("_at"), 3).bitwiseAND(63).cast("int") + 1, F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.col("_at").bitwiseAND(7).cast("int")) == 1
    return (rows.withColumn("_at", at).withColumn("_piece", F.shiftright("_at", 9))
            .join(F.broadcast(pieces), "_piece", "left")
            .select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("_maybe")))


def vocabulary(name: str) -> str:
    """The place of a public tokeniser's file on this machine."""
    try:
        import public_tokenizers
    except ModuleNotFoundError as e:
        raise FileNotFoundError(f"no vocabulary named: pass the path of a copy of {name}") from e
    return public_tokenizers.path(name)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of words of ``text`` (null or blank text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that turn one batch into at most one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = out = None
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
        del batch, out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return unused memory, Arrow's and that of freed arrays, to the system at the
    end of a task: Python workers live on idle, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(col: Column, m: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % m


def hash01(*cols) -> Column:
    """Uniform double in [0, 1) from a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def bucket_ranks(df: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of each row in its group, in the order
    (``bucket``, ``order``).

    ``bucket`` splits every group into small parts, so that no task sorts a
    whole group: rows are ranked inside (group, bucket), and each bucket's
    start comes from the cumulated bucket sizes.  ``df`` must be a table that
    gives the same rows on every read (see ``cut``)."""
    keys = [*group, bucket]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(starts, keys).withColumn(out, F.col("_start") + F.col("_in")).drop("_start", "_in")
