"""Command line: ``python -m hapframe.cli -c|-d|-b -i INPUT [-o OUTPUT]``.

``-c`` stores a VCF or BCF as a block archive, ``-d`` writes an archive's genotype rows as text, ``-b`` times a scan of the archive, of its
stored form and of its decoded alleles.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.schema import BLOCK_SITES
from hapframe.sources import archive, bcf, coded, vcf

MODEL = "model"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="hapframe", description=__doc__.split("\n")[0])
    what = out.add_mutually_exclusive_group(required=True)
    what.add_argument("-c", "--compress", action="store_true", help="VCF or BCF to archive")
    what.add_argument("-d", "--decompress", action="store_true", help="archive to genotype rows")
    what.add_argument("-b", "--benchmark", action="store_true", help="time the ways to read an archive")
    out.add_argument("-i", "--input", required=True)
    out.add_argument("-o", "--output")
    codec = out.add_mutually_exclusive_group()
    codec.add_argument("-z", "--zstd", dest="codec", action="store_const", const="zstd")
    codec.add_argument("-l", "--lz4", dest="codec", action="store_const", const="lz4_raw")
    codec.add_argument("-m", "--model", dest="codec", action="store_const", const=MODEL, help="adaptive context model: smallest, slowest")
    order = out.add_mutually_exclusive_group()
    order.add_argument("-p", "--permute", dest="permute", action="store_true", default=True)
    order.add_argument("-P", "--no-permute", dest="permute", action="store_false")
    out.add_argument("--level", type=int, default=3, help="level of zstd")
    out.add_argument("--block-sites", type=int, default=BLOCK_SITES)
    out.set_defaults(codec="lz4_raw")
    return out


def load(spark: SparkSession, path: str, block_size: int) -> DataFrame:
    """Vectors of a VCF's or BCF's sites, numbered from 0 in the order of the input."""
    return (bcf if path.endswith(".bcf") else vcf).read_sites(spark, path, block_size)


def stored_order(frame: DataFrame) -> bool:
    """Whether the archive is permuted; every row of it tells."""
    first = frame.select("use_pbwt").first()
    return bool(first and first[0])


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.compress:
        if not args.output:
            raise SystemExit("-c needs -o")
        if args.codec == MODEL:
            coded.write(coded.encode_sites(load(spark, args.input, args.block_sites), use_pbwt=args.permute), args.output)
            return
        archive.write(archive.encode_sites(load(spark, args.input, args.block_sites), use_pbwt=args.permute), args.output, codec=args.codec, level=args.level)
        return
    stored = archive.read(spark, args.input)
    permuted, by_model = stored_order(stored), "payload" in stored.columns
    form = coded if by_model else archive
    if args.decompress:
        lines = vcf.vectors_to_vcf(form.decode_vectors(stored, use_pbwt=permuted))
        if args.output:
            vcf.write_vcf(lines, args.output)
        else:
            for row in lines.orderBy("site_id").toLocalIterator():
                print(row.line)
        return
    ways = {"scan": stored.agg(F.count("*"), F.sum("n_bytes" if by_model else "n")), "raw": form.stored_vectors(stored), "decode": form.decode(stored, use_pbwt=permuted), "vcf": vcf.vectors_to_vcf(form.decode_vectors(stored, use_pbwt=permuted))}
    took = {}
    for name, frame in ways.items():
        began = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps(took))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    main()
