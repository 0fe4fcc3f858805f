"""Shared helpers: the shared folder, lineage cuts, and the word definition of the contracts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 class of the white space that separates words: space, tab, \n, \v, \f, \r.
WS = r"[ \t\n\x0B\f\r]"
NOT_WS = r"[^ \t\n\x0B\f\r]"
#: Keys of so many rows may be broadcast instead of dealt.
HUB = 200


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a local one (tests); any other fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hapframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor never replays its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, small: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``small``, a written frame with one row a key and in ``n`` how many rows have it.

    Keys of more than a ten-thousandth of all ``total`` rows, and of more than ``HUB``, are 10,000 at most: these are broadcast, so that their rows stay where they are.
    """
    hub = F.col("n") > max(HUB, total // 10_000)
    hubs = cut(small.where(hub), "hubs")
    rest = small.where(~hub).drop("n")
    if hubs.isEmpty():
        return rows.join(rest, keys)
    known = F.broadcast(hubs.drop("n"))
    return rows.join(known, keys).unionByName(rows.join(F.broadcast(hubs.select(*keys)), keys, "left_anti").join(rest, keys))


def forget(spark: SparkSession) -> None:
    """Lets go of shuffle files that no frame needs any more; the driver's JVM finds them when it collects garbage, which may be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(frame: DataFrame) -> DataFrame:
    """The same rows. Later filters and projections would be merged with those below and compute each expression many times; a generator stops that."""
    return frame.select(F.inline(F.array(F.struct(*frame.columns))))


def release() -> None:
    """Gives freed memory of a Python worker back to the system; workers outlive their tasks, and their pools would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the maximal runs of non-white-space; null text gives an empty array. Time is linear in the text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_WS}+")), F.lit(0)).cast("long")


#: What word_count() counts, in DuckDB SQL over a column ``text``.
WORD_COUNT_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"
