"""Blocks, groups and archetypes of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapframe.operators.vectors import gathered
from hapframe.schema import BLOCK_SITES, EOV, MAX_GROUPS, MISSING, RARE


def blocks(frame: DataFrame, size: int = BLOCK_SITES) -> DataFrame:
    return frame.withColumn("block_id", F.floor(F.col("site_id") / size).cast("int"))


def site_stats(alleles: DataFrame) -> DataFrame:
    """One row a site: length, allele counts and the archetype. One shuffle, combined before it."""
    is_ = lambda x: F.sum((F.col("allele") == x).cast("int")).cast("long")
    return alleles.groupBy("site_id").agg(
        F.max("ploidy").alias("ploidy"), F.max("n_allele").alias("n_allele"), F.count("*").alias("n"),
        is_(1).alias("ac"), is_(MISSING).alias("n_missing"), is_(EOV).alias("n_eov"),
        (F.max("allele") + 1).cast("int").alias("observed"),
    ).withColumn("archetype", F.when((F.col("n_allele") <= 2) & (F.col("n_missing") == 0) & (F.col("n_eov") == 0), "2mc").otherwise("nm"))


def group_table(lengths: DataFrame) -> DataFrame:
    """``n, ploidy, group_id`` from ``site_id, n, ploidy``: the pairs in the order of their first site. There are ``MAX_GROUPS`` at most, else it fails."""
    first = lengths.groupBy("n", "ploidy").agg(F.min("site_id").alias("first")).limit(MAX_GROUPS + 1).collect()
    if len(first) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} pairs of length and ploidy")
    rows = [(int(r.n), int(r.ploidy), k) for k, r in enumerate(sorted(first, key=lambda r: r.first))]
    return lengths.sparkSession.createDataFrame(rows, "n long, ploidy int, group_id int")


def groups(stats: DataFrame) -> DataFrame:
    """Adds ``group_id``. The table of groups is broadcast, since nearly all sites share one pair."""
    return stats.join(F.broadcast(group_table(stats)), ["n", "ploidy"])


def routed(stats: DataFrame, block_size: int = BLOCK_SITES) -> DataFrame:
    """Adds group, block, and whether a site is so rare that it doesn't move the order."""
    return blocks(groups(stats), block_size).withColumn("rare", (F.col("archetype") == "2mc") & (F.col("ac") < RARE))


def valid(stats: DataFrame) -> DataFrame:
    """Sites whose length is a multiple of their ploidy."""
    return stats.where(F.col("n") % F.col("ploidy") == 0)


def placed(sites: DataFrame, lengths: DataFrame, block_size: int = BLOCK_SITES) -> DataFrame:
    """Adds group, block and rareness to vectors; ``lengths`` has ``site_id, n, ploidy`` of the same sites."""
    named = sites.join(F.broadcast(group_table(lengths)), ["n", "ploidy"])
    return blocks(named, block_size).withColumn("rare", (F.col("archetype") == "2mc") & (F.col("ac") < RARE))


def site_vectors(alleles: DataFrame, block_size: int = BLOCK_SITES) -> DataFrame:
    """One row a site with its route and its alleles as bytes in the order of haplotypes."""
    return placed(gathered(alleles), alleles.groupBy("site_id").agg(F.count("*").alias("n"), F.max("ploidy").alias("ploidy")), block_size)
