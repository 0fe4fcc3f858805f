"""A stream of alleles into a block archive, and running counts of its sites.

All alleles of a site come in one micro-batch. Each micro-batch is encoded as blocks of its own and written to a directory of its own, which a repeated
micro-batch replaces, so the archive holds every site once whatever fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hapframe.operators import route
from hapframe.schema import BLOCK_SITES
from hapframe.sources import archive

#: Blocks of one micro-batch.
BATCH_BLOCKS = 1 << 12


def store_stream(alleles: DataFrame, path: str, checkpoint: str, *, block_size: int = BLOCK_SITES, use_pbwt: bool = True, codec: str = "zstd", **trigger) -> StreamingQuery:
    """Starts a query that stores ``site_id, hap, ploidy, n_allele, allele``; ``trigger`` goes to ``DataStreamWriter.trigger``."""

    def put(batch: DataFrame, number: int) -> None:
        sites = route.site_vectors(batch, block_size)
        own = F.floor(F.col("site_id") / block_size) % BATCH_BLOCKS + number * BATCH_BLOCKS
        archive.write(archive.encode_sites(sites.withColumn("block_id", own.cast("int")), use_pbwt=use_pbwt), f"{path}/batch={number}", codec=codec, mode="overwrite")

    return alleles.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def stored_stream(spark: SparkSession, path: str) -> DataFrame:
    """What is stored so far, for ``archive.decode``."""
    return spark.read.parquet(path).drop("batch")


def running_counts(alleles: DataFrame) -> DataFrame:
    """``site_id, n, ac`` of a stream, for the update or complete mode. State is one row a site."""
    return alleles.groupBy("site_id").agg(F.count("*").alias("n"), F.sum((F.col("allele") == 1).cast("int")).alias("ac"))
