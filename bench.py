"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

The matrices are derived from the tables and written once, before the clock runs; a query is timed on its stored matrix, after one untimed query has warmed
the session. Besides seconds it gives alleles a second, stored bytes an allele, and the ratio to a byte an allele.
"""

import json
import os
import subprocess
import time

from pyspark.sql import SparkSession

from hapframe import registry
from hapframe.operators import route
from hapframe.sources import archive, coded
from hapframe.sources.fixtures import matrix
from hapframe.sources.scratch import scratch

NAMES = ["scan_bytes", "site_ac_an", "group_route", "pbwt_order_2mc", "pbwt_order_nm", "ewah_2mc", "ewah_nm", "ewah_popcount", "archive_roundtrip", "decode_raw", "model_archive_roundtrip", "to_vcf", "archive_to_vcf", "hap_bitmap"]


def run(frame) -> float:
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def stored_bytes(path: str) -> int:
    return int(subprocess.run(["du", "-sb", path.removeprefix("file:")], capture_output=True, text=True, check=True).stdout.split()[0])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    stored, alleles = {}, {}
    for fixture in sorted({registry.MAKES[n][0] for n in NAMES}):
        path = scratch(spark, fixture)
        matrix(spark, sf_dir, fixture).write.parquet(path)
        stored[fixture] = spark.read.parquet(path)
        alleles[fixture] = stored[fixture].count()
    run(registry.MAKES["pbwt_mixed"][1](stored["g4"]))
    took, rate = {}, {}
    for name in NAMES:
        fixture, make = registry.MAKES[name]
        began = time.perf_counter()
        run(make(stored[fixture]))
        took[name] = round(time.perf_counter() - began, 3)
        rate[name] = round(alleles[fixture] / (time.perf_counter() - began))
    sizes = {}
    for name, fixture in (("g1", "g1"), ("g3", "g3")):
        sites, plain = route.site_vectors(stored[fixture]), alleles[fixture]
        for kind, put in (("archive", lambda p, s=sites: archive.write(archive.encode_sites(s), p, codec="zstd", level=19)), ("model", lambda p, s=sites: coded.write(coded.encode_sites(s), p))):
            path = scratch(spark, kind)
            put(path)
            n = stored_bytes(path)
            sizes[f"{name}_{kind}"] = {"bytes_per_allele": round(n / plain, 4), "ratio_to_bytes": round(plain / n, 2)}
    out = {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "alleles_per_second": rate, "sizes": sizes}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
