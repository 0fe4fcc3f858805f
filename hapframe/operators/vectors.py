"""Vectors of alleles as bytes, one a site: from rows of one allele each, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapframe.schema import EOV, MISSING

#: Alleles in one Arrow batch of rows.
CELLS = 1 << 18
SITES = "site_id int, ploidy int, n_allele int, n long, ac long, n_missing long, n_eov long, observed int, archetype string, gt binary"


def archetype(n_allele: int, n_missing: int, n_eov: int) -> str:
    return "2mc" if n_allele <= 2 and not n_missing and not n_eov else "nm"


def described(gt: np.ndarray, n_allele: int) -> tuple:
    """``n, ac, n_missing, n_eov, observed, archetype, gt`` of one vector."""
    count = np.bincount(gt, minlength=16)
    missing, eov = int(count[MISSING]), int(count[EOV])
    return len(gt), int(count[1]), missing, eov, int(np.flatnonzero(count)[-1]) + 1 if len(gt) else 0, archetype(n_allele, missing, eov), gt.astype(np.uint8).tobytes()


#: Of a vector's columns after ploidy and n_allele.
DESCRIBED = {"n": pa.int64(), "ac": pa.int64(), "n_missing": pa.int64(), "n_eov": pa.int64(), "observed": pa.int32(), "archetype": pa.string(), "gt": pa.binary()}


def as_batch(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(names.values())], list(names))


#: Rows that are packed at once before they are dealt, and bytes of vectors in one batch of them.
ROWS, VECTOR_BYTES = 1 << 18, 1 << 22


def packed(rows: pa.Table) -> pa.RecordBatch:
    """Rows of ``site_id, ploidy, n_allele, hap, allele`` as one row a site: the haplotypes and alleles that aren't null, as bytes."""
    sites = rows.column(0).combine_chunks().dictionary_encode("encode")
    code = sites.indices.to_numpy()
    order = np.argsort(code.astype(np.uint16) if len(sites.dictionary) < 1 << 16 else code, kind="stable")
    start = np.append(np.searchsorted(code[order], np.arange(len(sites.dictionary))), len(code))
    most = [np.maximum.reduceat(pc.fill_null(rows.column(k), -1).to_numpy()[order], start[:-1]) for k in (1, 2)]
    there = pc.and_(rows.column(3).is_valid(), rows.column(4).is_valid()).to_numpy()[order]
    hap, allele = (pc.fill_null(rows.column(k), 0).to_numpy()[order][there].astype(t).tobytes() for k, t in ((3, "<i4"), (4, np.uint8)))
    ends = np.append(0, np.cumsum(there))[start].tolist()
    cut = lambda data, width: pa.array([data[width * x : width * y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([sites.dictionary, *map(pa.array, most), cut(hap, 4), cut(allele, 1)], ["site_id", "ploidy", "n_allele", "haps", "alleles"])


def of_sites(alleles: DataFrame, make: Callable[[int, int, int, np.ndarray, np.ndarray], tuple], names: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``make(site_id, ploidy, n_allele, haps, alleles)`` of each site, its alleles in the order of haplotypes; the last value is its vector.

    Rows are packed before the one shuffle, and a site's pieces are merged in a stream, so a worker holds the pieces of a batch and of one site.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    def merged(site: int, pieces: list[tuple]) -> tuple:
        ploidy, n_allele = (max(p[k] for p in pieces) for k in (0, 1))
        cell = np.concatenate([np.frombuffer(p[2], "<i4") for p in pieces]).astype(np.int64) << 8
        cell |= np.concatenate([np.frombuffer(p[3], np.uint8) for p in pieces])
        cell.sort()
        return make(site, None if ploidy < 0 else ploidy, None if n_allele < 0 else n_allele, cell >> 8, (cell & 255).astype(np.uint8))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, pieces, made, size = None, [], [], 0
        for batch in batches:
            heads = [c.to_pylist() for c in batch.columns[:3]]
            for own, ploidy, n_allele, haps, gt in zip(*heads, batch.column(3), batch.column(4), strict=True):
                if pieces and own != site:
                    made.append(merged(site, pieces))
                    pieces, size = [], size + len(made[-1][-1]) + 64
                    if size >= VECTOR_BYTES:
                        yield as_batch(made, names)
                        made, size = [], 0
                site = own
                pieces.append((ploidy, n_allele, haps.as_buffer(), gt.as_buffer()))
        if pieces:
            made.append(merged(site, pieces))
        if made:
            yield as_batch(made, names)

    rows = alleles.select(*(F.col(c).cast("int").alias(c) for c in ("site_id", "ploidy", "n_allele", "hap", "allele")))
    pieces = rows.mapInArrow(pack, "site_id int, ploidy int, n_allele int, haps binary, alleles binary")
    return pieces.repartition("site_id").sortWithinPartitions("site_id").mapInArrow(merge, schema)


def gathered(alleles: DataFrame) -> DataFrame:
    """One row a site (``SITES``): alleles in the order of haplotypes, and the counts of them. One shuffle; a site is one row."""
    names = {"site_id": pa.int32(), "ploidy": pa.int32(), "n_allele": pa.int32()} | DESCRIBED
    return of_sites(alleles, lambda site, ploidy, n_allele, haps, gt: (site, ploidy, n_allele, *described(gt, n_allele)), names, SITES)


def spread(vectors: Iterable[np.ndarray], others: list[pa.Array], names: list[str], position: str) -> Iterator[pa.RecordBatch]:
    """Rows of one allele each, with the vectors' other columns, in batches of ``CELLS`` at most; long vectors are cut."""
    held, n = [], 0  # (row, first place, alleles)

    def batch() -> pa.RecordBatch:
        size = [len(x) for _, _, x in held]
        at = pa.array(np.repeat(np.array([k for k, _, _ in held], np.int32), size))
        place = np.concatenate([np.arange(a, a + len(x), dtype=np.int32) for _, a, x in held])
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in others), pa.array(place), pa.array(np.concatenate([x for _, _, x in held]).astype(np.int32))], [*names, position, "allele"])

    for k, gt in enumerate(vectors):
        a = 0
        while a < len(gt):
            b = min(len(gt), a + CELLS - n)
            held.append((k, a, gt[a:b]))
            a, n = b, n + b - a
            if n == CELLS:
                yield batch()
                held, n = [], 0
    if n:
        yield batch()


def byte_views(column: pa.Array) -> Iterator[np.ndarray]:
    """The binaries of a column, not copied."""
    return (np.frombuffer(x.as_buffer(), np.uint8) for x in column)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``VECTOR_BYTES`` of ``gt``, not copied; what is made of one is given away before the next."""
    part = np.cumsum(pc.binary_length(batch.column("gt")).to_numpy(zero_copy_only=False).astype(np.int64)) // VECTOR_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows] if batch.num_rows else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def cells(sites: DataFrame, position: str) -> DataFrame:
    """One row an allele, with the other columns of ``sites``; no shuffle."""
    names = [c for c in sites.columns if c != "gt"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from spread(byte_views(batch.column(len(names))), batch.columns[:-1], names, position)

    kinds = ", ".join(f"{c} {sites.schema[c].dataType.simpleString()}" for c in names)
    return sites.select(*names, "gt").mapInArrow(run, f"{kinds}, {position} int, allele int")
