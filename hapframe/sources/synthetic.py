"""Random sites of any size, from a hash of the site, so that every run and engine gives the same ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.operators import route
from hapframe.operators.vectors import DESCRIBED, SITES, as_batch, described
from hapframe.schema import BLOCK_SITES, RARE


def _draw(*parts: Column) -> Column:
    """A number below 2**32."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def random_sites(spark: SparkSession, n_sites: int, n_haps: int, *, most: int = 1000, seed: int = 1) -> DataFrame:
    """``site_id, hap, ploidy, n_allele, allele`` of the alleles that aren't REF: up to ``most`` draws a site, evenly distributed in number and place."""
    site = spark.range(n_sites).select(F.col("id").cast("int").alias("site_id"))
    draws = site.withColumn("n", _draw(F.lit(seed), F.col("site_id"), F.lit("n")) % (most + 1)).where("n > 0").select("site_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    hap = (_draw(F.lit(seed), F.col("site_id"), F.col("k")) % n_haps).cast("int")
    return draws.select("site_id", hap.alias("hap")).distinct().select("site_id", "hap", F.lit(2).alias("ploidy"), F.lit(2).alias("n_allele"), F.lit(1).alias("allele"))


def random_vectors(spark: SparkSession, n_sites: int, n_haps: int, *, most: int = 1000, seed: int = 1, block_size: int = BLOCK_SITES) -> DataFrame:
    """As ``route.site_vectors``, of the same sites with their REF alleles; these never become rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for site, haps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gt = np.zeros(n_haps, np.int64)
                gt[haps] = 1
                rows.append((site, 2, 2, *described(gt, 2)))
            yield as_batch(rows, {"site_id": pa.int32(), "ploidy": pa.int32(), "n_allele": pa.int32()} | DESCRIBED)

    drawn = random_sites(spark, n_sites, n_haps, most=most, seed=seed).groupBy("site_id").agg(F.collect_list("hap").alias("haps"))
    whole = spark.range(n_sites).select(F.col("id").cast("int").alias("site_id")).join(drawn, "site_id", "left").select("site_id", F.coalesce("haps", F.array().cast("array<int>")).alias("haps"))
    vectors = whole.mapInArrow(run, SITES).withColumn("group_id", F.lit(0))
    return route.blocks(vectors, block_size).withColumn("rare", F.col("ac") < RARE)


def duckdb_text(n_sites: int, n_haps: int, *, most: int = 1000, seed: int = 1) -> str:
    draw = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
    return f"""WITH s AS (SELECT CAST(range AS INT) AS site_id FROM range({n_sites})),
d AS (SELECT site_id, unnest(range(1, {draw.format(f"'{seed}-' || site_id || '-n'")} % {most + 1} + 1)) AS k FROM s)
SELECT DISTINCT site_id, CAST({draw.format(f"'{seed}-' || site_id || '-' || k")} % {n_haps} AS INT) AS hap, 1 AS allele FROM d"""
