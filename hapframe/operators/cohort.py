"""Merging cohorts and the haplotype-major view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Shared sites that every task may hold, some tens of bytes each. If there are more, sites and alleles are dealt by site.
SENT_SITES = 1 << 18


def shared_sites(left: DataFrame, right: DataFrame) -> DataFrame:
    """``site_id, shift``: the sites of both cohorts, with the left one's number of rows.

    They are counted at once, since Spark takes their table for as large as the alleles it comes from, and would deal and sort all alleles to join it.
    """
    rows = left.select("site_id", F.lit(1).alias("own")).union(right.select("site_id", F.lit(0).alias("own")))
    counts = rows.where("site_id IS NOT NULL").groupBy("site_id").agg(F.sum("own").cast("int").alias("shift"), F.count("*").alias("n"))
    shared = counts.where("shift > 0 AND n > shift").select("site_id", "shift")
    found = shared.limit(SENT_SITES + 1).toArrow()
    if found.num_rows > SENT_SITES:
        return shared.hint("shuffle_hash")
    return F.broadcast(left.sparkSession.createDataFrame(found, shared.schema))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sites of both cohorts, the haplotypes of the right one behind those of the left one. Sites meet by id; no task sorts alleles."""
    shared = shared_sites(left, right)
    moved = right.join(shared, "site_id").withColumn("hap", F.col("hap") + F.col("shift"))
    columns = ["site_id", "hap", "ploidy", "n_allele", "allele"]
    return left.join(shared, "site_id", "left_semi").select(columns).union(moved.select(columns))


def bitmaps(alleles: DataFrame) -> DataFrame:
    """``hap, word_idx, word``: for each haplotype a bit for each site at which it isn't REF."""
    bit = (F.col("allele") != 0).cast("long") * F.pow(F.lit(2.0), F.col("site_id") % 32).cast("long")
    return alleles.groupBy("hap", F.floor(F.col("site_id") / 32).cast("int").alias("word_idx")).agg(F.bit_or(bit).alias("word"))


def bitmap_of(bitmaps: DataFrame, hap: int) -> DataFrame:
    """The words of one haplotype."""
    return bitmaps.where(F.col("hap") == hap)
