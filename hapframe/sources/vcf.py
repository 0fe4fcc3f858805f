"""VCF text: reading (plain or gzip) into alleles, and writing genotype rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.functions.alleles import vcf_allele, vcf_symbol
from hapframe.operators import route
from hapframe.operators.vectors import DESCRIBED, VECTOR_BYTES, as_batch, cells, described, of_sites
from hapframe.schema import BLOCK_SITES, EOV, MAX_ALLELE, MISSING
from hapframe.sources.scratch import scratch


def read_header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(header lines, samples) of the first file; it must begin with its format and have a line of columns. Nothing else is read."""
    found: list[str] = []
    for row in spark.read.text(path).where(F.col("value").startswith("#")).toLocalIterator():  # one task after another, as far as needed
        found.append(row.value)
        if row.value.startswith("#CHROM"):
            break
    if not found or not found[0].startswith("##fileformat=VCF") or not found[-1].startswith("#CHROM"):
        raise ValueError(f"{path} has no whole VCF header")
    return found, found[-1].split("\t")[9:]


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``sample, name``."""
    return spark.createDataFrame(list(enumerate(read_header(spark, path)[1])), "sample int, name string")


def parse(lines: DataFrame) -> DataFrame:
    """Full records. Sites without GT are left out; haploid and longer genotypes keep their own length."""
    fields = F.split("line", "\t")
    record = lines.select(
        fields[0].alias("contig"), fields[1].cast("long").alias("pos"), (F.size(F.split(fields[4], ",")) + 1).alias("n_allele"),
        F.array_position(F.split(fields[8], ":"), "GT").alias("at"), F.slice(fields, 10, F.greatest(F.size(fields) - 9, F.lit(0))).alias("samples"),
    ).where("at > 0")
    one = record.select("contig", "pos", "n_allele", "at", F.posexplode("samples").alias("sample", "value"))
    return one.select("contig", "pos", "n_allele", "sample", F.posexplode(F.split(F.split("value", ":")[F.col("at") - 1], r"[|/]")).alias("slot", "symbol")).select(
        "contig", "pos", "n_allele", "sample", "slot", vcf_allele(F.col("symbol")).alias("allele"),
    )


def number_sites(sites: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``site_id``, dense from 0 along ``order``: places inside sorted ranges, and a running sum over one row a range."""
    from pyspark.sql import Window

    # Numbers of a task start at task << 33, so the high bits name the range; a written table fixes them for both readers.
    placed = sites.sort(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    path = scratch(sites.sparkSession, "numbers")
    placed.write.parquet(path)  # written, so that no lost executor numbers them anew
    placed = sites.sparkSession.read.schema(placed.schema).parquet(path)
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_range", "_start")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")
    return placed.join(starts, "_range").select(*sites.columns, place.cast("int").alias("site_id"))


def read_alleles(spark: SparkSession, path: str) -> DataFrame:
    """``site_id, hap, ploidy, n_allele, allele`` of every record with a GT field, sites numbered in the order of the files' lines."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return matrix_of(lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))


def matrix_of(lines: DataFrame) -> DataFrame:
    """Alleles of full records with ``file, block, at`` as their order. A site's ploidy is its longest genotype's; shorter ones are padded with the end of vector.

    Lines become vectors first, so that a line is split once; a site without samples has a number but no row."""
    sites = number_sites(_vectors(lines, True), ["file", "block", "at"]).select("site_id", "ploidy", "n_allele", "gt")
    return cells(sites.repartition("site_id"), "hap").select("site_id", "hap", "ploidy", "n_allele", "allele")


def genotype_vector(form: str, samples: str) -> tuple[int, np.ndarray] | None:
    """(ploidy, alleles) of a record's FORMAT and its samples; None without GT. Shorter genotypes are padded with the end of vector."""
    fields = form.split(":")
    if "GT" not in fields:
        return None
    raw = np.frombuffer(samples.encode() + b"\t", np.uint8)
    if form == "GT" and len(raw) % 2 == 0:  # nothing but genotypes of one-letter alleles
        symbol, mark = raw[::2], raw[1::2]
        missing, last = symbol == ord("."), mark == 9
        if (last | (mark == ord("|")) | (mark == ord("/"))).all() and (missing | ((symbol >= 48) & (symbol <= 57))).all():
            size = np.diff(np.flatnonzero(last), prepend=-1)
            gt = np.full((len(size), int(size.max())), EOV, np.uint8)
            gt[np.arange(gt.shape[1]) < size[:, None]] = np.where(missing, MISSING, symbol - 48)
            return gt.shape[1], gt.ravel()
    at, own = fields.index("GT"), []
    for sample in samples.split("\t"):
        symbols = sample.split(":")[at].replace("/", "|").split("|")
        if not all(x == "." or x.strip().lstrip("+").isdecimal() for x in symbols):
            raise ValueError(f"no allele, or one beyond {MAX_ALLELE}: {sample[:40]}")
        own.append([MISSING if x == "." else int(x) for x in symbols])
        if max((x for x, y in zip(own[-1], symbols, strict=True) if y != "."), default=0) > MAX_ALLELE:
            raise ValueError(f"allele beyond {MAX_ALLELE}")
    ploidy = max(map(len, own))
    return ploidy, np.array([x for g in own for x in g + [EOV] * (ploidy - len(g))], np.int64)


def _vectors(lines: DataFrame, empty: bool) -> DataFrame:
    """``file, block, at, ploidy, n_allele`` and ``DESCRIBED`` of full records with a GT field; ``empty`` keeps those without samples."""
    names = {"file": pa.string(), "block": pa.int64(), "at": pa.int64(), "ploidy": pa.int32(), "n_allele": pa.int32()} | DESCRIBED

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            heads = [c.to_pylist() for c in batch.columns[1:]]
            for line, *place in zip(batch.column(0), *heads, strict=True):
                fields = line.as_py().split("\t", 9)
                if len(fields) == 9 and empty:
                    found = (0, np.zeros(0, np.uint8)) if "GT" in fields[8].split(":") else None
                else:
                    found = genotype_vector(fields[8], fields[9]) if len(fields) > 9 else None
                if found:
                    n_allele = fields[4].count(",") + 2
                    rows.append((*place, found[0], n_allele, *described(found[1], n_allele)))
                    size += len(found[1])
                if size >= VECTOR_BYTES:
                    yield as_batch(rows, names)
                    rows, size = [], 0
            yield as_batch(rows, names)

    return lines.select("line", "file", "block", "at").mapInArrow(run, "file string, block long, at long, ploidy int, n_allele int, n long, ac long, n_missing long, n_eov long, observed int, archetype string, gt binary")


def read_sites(spark: SparkSession, path: str, block_size: int = BLOCK_SITES) -> DataFrame:
    """As ``route.site_vectors``, of every record with a GT field, in the order of the files' lines. No row of a single allele is made."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    told = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sites = number_sites(_vectors(told, False), ["file", "block", "at"]).drop("file", "block", "at")
    return route.placed(sites, sites.select("site_id", "n", "ploidy"), block_size)


def _individuals(alleles: DataFrame, phasing: str) -> DataFrame:
    own = alleles.withColumn("sample", F.floor(F.col("hap") / F.col("ploidy")).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("hap", vcf_symbol(F.col("allele")).alias("s"))))
    return own.groupBy("site_id", "sample").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), phasing).alias("gt"))


def to_vcf(alleles: DataFrame, phasing: str = "|", trailing: str = "") -> DataFrame:
    """``site_id, line``: genotypes of all individuals, tab-separated. Missing is ``.``, end of vector is left out."""
    ordered = F.array_sort(F.collect_list(F.struct("sample", "gt")))
    return _individuals(alleles, phasing).groupBy("site_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["gt"]), "\t"), F.lit(trailing)).alias("line"))


def vector_text(gt: np.ndarray, ploidy: int, phasing: str = "|") -> str:
    """The genotypes of one vector, tab-separated."""
    if len(gt) and len(phasing) == 1 and ((gt <= 9) | (gt == MISSING)).all():  # a letter each
        cells = np.empty((len(gt) // ploidy, 2 * ploidy), np.uint8)
        cells[:, ::2] = np.where(gt == MISSING, ord("."), gt + 48).reshape(-1, ploidy)
        cells[:, 1::2] = ord(phasing)
        cells[:, -1] = 9
        return cells.tobytes()[:-1].decode("latin-1")
    symbol = lambda x: "." if x == MISSING else str(x)
    return "\t".join(phasing.join(symbol(x) for x in gt[a : a + ploidy].tolist() if x != EOV) for a in range(0, len(gt), ploidy))


def vectors_to_vcf(sites: DataFrame, phasing: str = "|", trailing: str = "") -> DataFrame:
    """As ``to_vcf``, of ``site_id, ploidy, gt``; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [vector_text(np.frombuffer(gt, np.uint8), ploidy, phasing) + trailing for ploidy, gt in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["site_id", "line"])

    return sites.select("site_id", "ploidy", "gt").mapInArrow(run, "site_id int, line string")


def to_vcf_debug(alleles: DataFrame) -> DataFrame:
    """As ``to_vcf`` with a tab after the last individual."""
    return to_vcf(alleles, trailing="\t")


def from_lines(lines: DataFrame) -> DataFrame:
    """``site_id, sample, slot, allele`` of genotype rows as ``to_vcf`` writes them."""
    one = lines.select("site_id", F.posexplode(F.split("line", "\t")).alias("sample", "gt"))
    return one.where("gt <> ''").select("site_id", "sample", F.posexplode(F.split("gt", r"[|/]")).alias("slot", "s")).select("site_id", "sample", "slot", vcf_allele(F.col("s")).alias("allele"))


def write_vcf(lines: DataFrame, path: str) -> None:
    """Writes ``site_id, line`` in the order of sites."""
    lines.orderBy("site_id").select("line").write.text(path)


def record(contig: str, site: int, ploidy: int, n_allele: int, haps: np.ndarray, gt: np.ndarray) -> str:
    """A whole record of the alleles of some haplotypes, in their order."""
    alts = ",".join(f"<A{k}>" for k in range(1, n_allele or 1)) or "."
    sample, there = haps // ploidy, gt != EOV
    new, kept = np.flatnonzero(np.diff(sample, prepend=-1)), gt[there]
    last = np.append(np.diff(sample[there]) != 0, True)[: len(kept)]
    if len(kept) and last.sum() == len(new) and ((kept < 10) | (kept == MISSING)).all():  # a letter each, and no genotype is empty
        text = np.empty((len(kept), 2), np.uint8)
        text[:, 0], text[:, 1] = np.where(kept == MISSING, ord("."), kept + 48), np.where(last, 9, ord("|"))
        line = text.tobytes()[:-1].decode("latin-1")
    else:
        line = "\t".join("|".join("." if x == MISSING else str(x) for x in g.tolist() if x != EOV) for g in np.split(gt, new[1:]))
    return "\t".join((contig, str(site + 1), ".", "A", alts, ".", ".", ".", "GT", line))


def records(alleles: DataFrame, contig: str = "1") -> DataFrame:
    """``site_id, line``: whole records, a site's position being its id and one."""
    make = lambda site, ploidy, n_allele, haps, gt: (site, record(contig, site, ploidy, n_allele, haps, gt))
    return of_sites(alleles.where("site_id IS NOT NULL"), make, {"site_id": pa.int32(), "line": pa.string()}, "site_id int, line string")


def write_records(alleles: DataFrame, path: str) -> None:
    """VCF text with a header, in files that follow one another; the header is the first line of all, in a file before them."""
    spark = alleles.sparkSession
    most = alleles.select(F.floor(F.col("hap") / F.col("ploidy")).cast("int").alias("s")).agg(F.max("s")).first()[0]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"s{k}" for k in range((-1 if most is None else most) + 1))]
    header = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(columns)]
    spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.text(f"{path}/part=0")
    records(alleles).sort("site_id").select("line").write.text(f"{path}/part=1")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """``site_id, pos``: positions by the numbers that ``read_alleles`` gives; records without GT have none."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    numbered = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    fields = F.split("line", "\t")
    sites = numbered.select("file", "block", "at", fields[1].cast("long").alias("pos"), F.array_position(F.split(fields[8], ":"), "GT").alias("gt")).where("gt > 0")
    return number_sites(sites.select("file", "block", "at", "pos"), ["file", "block", "at"]).select("site_id", "pos")


def renumbered(alleles: DataFrame, positions: DataFrame) -> DataFrame:
    """Alleles with their position less one as site."""
    return alleles.join(positions, "site_id").select((F.col("pos") - 1).cast("int").alias("site_id"), "hap", "ploidy", "n_allele", "allele")
