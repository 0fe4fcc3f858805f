"""BCF 2 as a source: genotypes of plain or block-compressed files, one task a file.

A file's bytes come through Spark's own reader, so any store that Spark knows will do; a row of it holds at most 2 GB. The bytes are
inflated and parsed piece by piece, and leave as Arrow batches of about ``BATCH`` alleles, so the inflated file is never held whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.operators import route
from hapframe.operators.vectors import DESCRIBED, as_batch, described
from hapframe.schema import BLOCK_SITES, EOV, MAX_ALLELE, MISSING
from hapframe.sources import vcf

SCHEMA = "path string, record long, contig string, pos long, ploidy int, n_allele int, hap int, allele int"
BATCH, PIECE = 1 << 16, 1 << 20
#: Fixed values of the format: its magic, and the types of vectors by their code.
MAGIC = b"BCF\2"
TYPES = {1: "<i1", 2: "<i2", 3: "<i4", 5: "<f4", 7: "S1"}


def inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of the content; as it is where it isn't compressed. Every member of the gzip stream is read."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, machine = 0, zlib.decompressobj(31)
    while at < len(data) or machine.unconsumed_tail:
        some = machine.unconsumed_tail or data[at : at + PIECE]
        if not machine.unconsumed_tail:
            at += len(some)
        yield machine.decompress(some, PIECE)
        if machine.eof:
            at -= len(machine.unused_data)
            machine = zlib.decompressobj(31)


class Pieces:
    """``take(n)`` bytes from an iterator of pieces; fewer at its end."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def take(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.pieces, None)) is not None:
            self.held += more
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def dictionaries(header: str) -> tuple[dict[int, str], dict[int, str]]:
    """Names of contigs and of the strings (filters, infos, formats) by number, which is a line's IDX or else its place."""
    contigs, strings, numbers = {}, {0: "PASS"}, {"PASS": 0}
    for kind, body in re.findall(r"^##(contig|FILTER|INFO|FORMAT)=<(.*)>", header, re.M):
        name, idx = re.search(r"(?:^|,)ID=([^,]+)", body)[1], re.search(r"(?:^|,)IDX=(\d+)", body)
        if kind == "contig":
            contigs[int(idx[1]) if idx else len(contigs)] = name
        elif name not in numbers:
            numbers[name] = int(idx[1]) if idx else len(numbers)
            strings[numbers[name]] = name
    return contigs, strings


def typed(data: bytes, at: int) -> tuple[int, str | None, int]:
    """(length, type, place of the values) of the descriptor at ``at``."""
    n, kind, at = data[at] >> 4, TYPES.get(data[at] & 15), at + 1
    if n == 15:
        _, inner, at = typed(data, at)
        n, at = int(np.frombuffer(data, inner, 1, at)[0]), at + np.dtype(inner).itemsize
    return n, kind, at


def recoded(values: np.ndarray) -> np.ndarray:
    """Alleles of genotype codes of any width: (allele + 1) << 1 | phase, 0 missing, the least value but one end of vector."""
    code = values.astype(np.int64) >> 1
    allele = np.where(code == 0, MISSING, code - 1)
    real = values != np.iinfo(values.dtype).min + 1
    if (real & (code > MAX_ALLELE + 1)).any():
        raise ValueError(f"allele beyond {MAX_ALLELE}")
    return np.where(real, allele, EOV).astype(np.int32)


def genotypes(data: bytes) -> Iterator[tuple[int, str, int, int, int, np.ndarray]]:
    """(record, contig, pos, ploidy, n_allele, alleles) of every record with genotypes."""
    source = Pieces(inflated(data))
    if source.take(5)[:4] != MAGIC:
        raise ValueError("no BCF 2 file")
    contigs, strings = dictionaries(source.take(struct.unpack("<I", source.take(4))[0]).decode())
    record = 0
    while head := source.take(8):
        if len(head) < 8:
            raise ValueError("the file ends inside a record")
        n_shared, n_own = struct.unpack("<II", head)
        shared, own = source.take(n_shared), source.take(n_own)
        if len(shared) + len(own) < n_shared + n_own:
            raise ValueError("the file ends inside a record")
        chrom, pos, _, _, alleles, samples = struct.unpack_from("<iiifII", shared)
        at, n_samples = 0, samples & 0xFFFFFF
        for _ in range(samples >> 24):
            _, key_type, at = typed(own, at)
            key = int(np.frombuffer(own, key_type, 1, at)[0])
            n, kind, at = typed(own, at + np.dtype(key_type).itemsize)
            size = n * np.dtype(kind).itemsize if kind else 0
            if strings.get(key) == "GT" and n:
                yield record, contigs.get(chrom, str(chrom)), pos + 1, n, alleles >> 16, recoded(np.frombuffer(own, kind, n * n_samples, at))
            at += n_samples * size
        record += 1


def read_bcf(spark: SparkSession, path: str) -> DataFrame:
    """One row an allele: ``path, record, contig, pos, ploidy, n_allele, hap, allele``. ``record`` numbers a file's records from 0.

    Records without genotypes give no row; shorter genotypes are padded with the end of vector, as they are stored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(name: str, rows: list[tuple]) -> pa.RecordBatch:
            sizes = [len(r[5]) for r in rows]
            spread = [np.repeat([r[k] for r in rows], sizes) for k in (0, 2, 3, 4)]
            contig = pa.array([r[1] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), sizes)))
            hap, allele = (np.concatenate(x).astype(np.int32) for x in ([np.arange(n) for n in sizes], [r[5] for r in rows]))
            columns = [pa.array([name] * len(hap), pa.string()), pa.array(spread[0], pa.int64()), contig, pa.array(spread[1], pa.int64()), *(pa.array(x.astype(np.int32)) for x in (spread[2], spread[3], hap, allele))]
            return pa.RecordBatch.from_arrays(columns, ["path", "record", "contig", "pos", "ploidy", "n_allele", "hap", "allele"])

        for files in batches:
            for name, data in zip(files.column(0), files.column(1), strict=True):
                rows, n = [], 0
                for row in genotypes(data.as_py()):
                    rows.append(row)
                    n += len(row[5])
                    if n >= BATCH:
                        yield batch(name.as_py(), rows)
                        rows, n = [], 0
                if rows:
                    yield batch(name.as_py(), rows)

    return spark.read.format("binaryFile").load(path).select("path", F.col("content")).mapInArrow(run, SCHEMA)


def read_sites(spark: SparkSession, path: str, block_size: int = BLOCK_SITES) -> DataFrame:
    """As ``route.site_vectors``, of every record with genotypes, in the order of files and records."""
    names = {"path": pa.string(), "record": pa.int64(), "ploidy": pa.int32(), "n_allele": pa.int32()} | DESCRIBED

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, data in zip(files.column(0).to_pylist(), files.column(1), strict=True):
                rows, n = [], 0
                for record, _, _, ploidy, n_allele, alleles in genotypes(data.as_py()):
                    rows.append((name, record, ploidy, n_allele, *described(alleles.astype(np.int64), n_allele)))
                    n += len(alleles)
                    if n >= BATCH:
                        yield as_batch(rows, names)
                        rows, n = [], 0
                yield as_batch(rows, names)

    schema = "path string, record long, ploidy int, n_allele int, n long, ac long, n_missing long, n_eov long, observed int, archetype string, gt binary"
    vectors = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    sites = vcf.number_sites(vectors, ["path", "record"]).drop("path", "record")
    return route.placed(sites, sites.select("site_id", "n", "ploidy"), block_size)


def bcf_file(contig: str, n_samples: int, records: Iterable[tuple[int, int, int, np.ndarray]]) -> bytes:
    """A plain BCF 2 file of (pos, n_allele, ploidy, alleles) records of one contig; alleles get ``(allele + 1) << 1 | 1``."""
    names = "\t".join(f"s{k}" for k in range(n_samples))
    header = f'##fileformat=VCFv4.2\n##contig=<ID={contig}>\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{names}\n'.encode() + b"\0"
    out = [MAGIC, b"\2", struct.pack("<I", len(header)), header]
    for pos, n_allele, ploidy, alleles in records:
        codes = (alleles.astype(np.int64) + 1) << 1 | 1
        codes = np.where(alleles == MISSING, 0, np.where(alleles == EOV, 0x81, codes)).astype(np.uint8)
        shared = struct.pack("<iiifII", 0, pos - 1, 1, 0.0, n_allele << 16, 1 << 24 | len(alleles) // ploidy) + b"\x07" + b"\x17A" + b"\x17C" * (n_allele - 1) + b"\x00"
        own = bytes([0x11, 1, ploidy << 4 | 1]) + codes.tobytes()
        out.append(struct.pack("<II", len(shared), len(own)) + shared + own)
    return b"".join(out)


def write_bcf(sites: DataFrame, directory: str, contig: str = "1") -> None:
    """Vectors (``route.site_vectors``) as one file a block and group, sites in order, positions being their ids and one. Files are moved into place when whole."""
    from pyarrow import fs as pafs
    from pyspark import TaskContext

    keys = ["block_id", "group_id"]
    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)

    def put(key: tuple, rows: list[dict]) -> None:
        out, path = pafs.FileSystem.from_uri(directory)
        ploidy, n = rows[0]["ploidy"], rows[0]["n"]
        data = bcf_file(contig, n // ploidy, ((r["site_id"] + 1, r["n_allele"], ploidy, np.frombuffer(r["gt"], np.uint8)) for r in rows))
        name = f"block-{key[0]:06d}-{key[1]}.bcf"
        with out.open_output_stream(f"{path}/_{name}.{TaskContext.get().taskAttemptId()}") as file:
            file.write(data)
        out.move(f"{path}/_{name}.{TaskContext.get().taskAttemptId()}", f"{path}/{name}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now and held:
                    put(now, held)
                    held, n = [], n + 1
                now = key
                held.append(row)
        if held:
            put(now, held)
        yield pa.RecordBatch.from_pydict({"files": pa.array([n + bool(held)], pa.int64())})

    dealt = sites.select(*keys, "site_id", "ploidy", "n_allele", "n", "gt").repartition(*keys).sortWithinPartitions(*keys, "site_id")
    dealt.mapInArrow(run, "files long").agg(F.sum("files")).collect()
