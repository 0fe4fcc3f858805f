"""The context-model archive: entropy-coded segments of permuted words, in parts of a (block, group, archetype), as Parquet by block.

Smaller than the block archive and slower. Parts are decoded in parallel, a block is read alone, and a row holds one part and the heads of its sites.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapframe.operators import entropy, ewah, pbwt, route
from hapframe.schema import BLOCK_SITES

KEYS = ["block_id", "group_id", "archetype"]
SITE = pa.struct([("site_id", pa.int32()), ("ploidy", pa.int32()), ("n", pa.int64()), ("observed", pa.int32())])
CODED = "block_id int, group_id int, archetype string, part int, use_pbwt boolean, sites array<struct<site_id: int, ploidy: int, n: bigint, observed: int>>, n_sites long, n_bytes long, payload binary"


def encode_sites(sites: DataFrame, *, use_pbwt: bool = True, part_bytes: int = entropy.PART) -> DataFrame:
    """As ``encode``, of ``route.site_vectors``."""
    schema = pa.schema([("block_id", pa.int32()), ("group_id", pa.int32()), ("archetype", pa.string()), ("part", pa.int32()), ("use_pbwt", pa.bool_()), ("sites", pa.list_(SITE)), ("n_sites", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = pbwt.Orders()
        for key, number, rows, ends, data in entropy.parts(batches, KEYS, part_bytes):
            coder, model = entropy.Writer(), entropy.SegmentCoder(key[2])
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                gt = np.frombuffer(data, np.uint8)[a:b]
                words = ewah.vector_words(orders.step(key, key[2], gt) if use_pbwt else gt, ewah.BITS[key[2]])
                model.site(coder, len(words), words)
            row = dict(zip(KEYS, key, strict=True)) | {"part": number, "use_pbwt": use_pbwt, "sites": [{f.name: r[f.name] for f in SITE} for r in rows], "n_sites": len(rows), "n_bytes": len(data), "payload": coder.close()}
            yield pa.RecordBatch.from_pylist([row], schema)

    return pbwt.dealt(sites, KEYS).select(*KEYS, *(f.name for f in SITE), "gt").mapInArrow(run, CODED)


def encode(alleles: DataFrame, *, block_size: int = BLOCK_SITES, use_pbwt: bool = True, part_bytes: int = entropy.PART) -> DataFrame:
    """``block_id, group_id, archetype, part, use_pbwt, sites, n_sites, n_bytes, payload``; n_bytes is a byte an allele."""
    return encode_sites(route.site_vectors(alleles, block_size), use_pbwt=use_pbwt, part_bytes=part_bytes)


def write(encoded: DataFrame, path: str) -> None:
    """Payloads are coded already; Parquet's own codec serves the heads."""
    encoded.write.partitionBy("block_id").parquet(path, compression="zstd")


def _vectors(coded: DataFrame) -> DataFrame:
    """``block_id, group_id, archetype, site_id, ploidy, n, observed, gt`` as stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind, out = row["archetype"], []
                coder, model = entropy.Reader(row["payload"]), entropy.SegmentCoder(kind)
                for s in row["sites"]:
                    words = model.site(coder, -(-s["n"] // ewah.per_word(ewah.BITS[kind])))
                    out.append({k: row[k] for k in KEYS} | s | {"gt": ewah.words_vector(words, ewah.BITS[kind], s["n"]).tobytes()})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("block_id", pa.int32()), ("group_id", pa.int32()), ("archetype", pa.string()), *SITE, ("gt", pa.binary())]))

    return coded.select(*KEYS, "sites", "payload").mapInArrow(run, "block_id int, group_id int, archetype string, site_id int, ploidy int, n long, observed int, gt binary")


def stored_vectors(coded: DataFrame) -> DataFrame:
    """``site_id, pos, allele`` as stored: permuted if the archive is."""
    return pbwt.explode_vectors(_vectors(coded).select("site_id", "gt"), "pos")


def decode_vectors(coded: DataFrame, *, use_pbwt: bool = True) -> DataFrame:
    """``site_id, ploidy, gt`` in the original order, a site a row."""
    vectors = _vectors(coded)
    return (pbwt.restore(vectors) if use_pbwt else vectors).select("site_id", "ploidy", "gt")


def decode(coded: DataFrame, *, use_pbwt: bool = True) -> DataFrame:
    """``site_id, hap, ploidy, allele`` in the original order."""
    return pbwt.explode_vectors(decode_vectors(coded, use_pbwt=use_pbwt)).select("site_id", "hap", "ploidy", "allele")


def folds(coded: DataFrame) -> DataFrame:
    """Bytes in and out of each stream, and their ratio."""
    return coded.groupBy(*KEYS).agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.length("payload")).alias("n_coded")).withColumn("fold", F.col("n_bytes") / F.col("n_coded"))
