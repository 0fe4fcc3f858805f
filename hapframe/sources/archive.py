"""The block archive: encoded sites as Parquet, one directory a block, so that a block or site is read alone.

Encoding permutes, packs and marks a site's vector, and decoding undoes it, inside one Arrow pass: sites are dealt once by block, group and archetype, and no
row of a single allele is made before the caller asks for one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hapframe.operators import ewah, pbwt, route
from hapframe.operators.vectors import spread
from hapframe.schema import BLOCK_SITES

CODECS = ("zstd", "lz4_raw", "snappy", "uncompressed")
HEAD = ["site_id", "block_id", "group_id", "archetype", "ploidy", "n", "observed"]
ENCODED = "site_id int, block_id int, group_id int, archetype string, ploidy int, n long, observed int, use_pbwt boolean, reset boolean, markers array<struct<marker_idx: int, ref: int, clean: int, dirty: int, words: array<bigint>>>"


def _listed(found: list[tuple[np.ndarray, ...]]) -> pa.Array:
    """Markers of many sites as one column."""
    sizes = [len(f[0]) for f in found]
    ref, clean, dirty, words = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    index = np.concatenate([np.arange(n) for n in sizes]) if found else np.zeros(0, np.int64)
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    fields = [*(pa.array(x.astype(np.int32)) for x in (index, ref, clean, dirty)), pa.ListArray.from_arrays(ends(dirty), pa.array(words.astype(np.int64)))]
    return pa.ListArray.from_arrays(ends(sizes), pa.StructArray.from_arrays(fields, ["marker_idx", "ref", "clean", "dirty", "words"]))


def _vectors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The vectors of a batch of encoded sites, as stored."""
    marks = batch.column("markers")
    fields, starts = marks.values, marks.offsets.to_numpy()
    ref, clean, dirty = (fields.field(c).to_numpy() for c in ("ref", "clean", "dirty"))
    words, ends = fields.field("words").values.to_numpy(), fields.field("words").offsets.to_numpy()
    for kind, n, a, b in zip(batch.column("archetype").to_pylist(), batch.column("n").to_pylist(), starts[:-1], starts[1:], strict=True):
        bits = ewah.BITS[kind]
        yield ewah.words_vector(ewah.marker_words(ref[a:b], clean[a:b].astype(np.int64), dirty[a:b].astype(np.int64), words[ends[a] : ends[b]], bits), bits, n)


def encode_sites(sites: DataFrame, *, use_pbwt: bool = True, reset: bool = True) -> DataFrame:
    """As ``encode``, of ``route.site_vectors``."""
    by = pbwt.keys(reset)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = pbwt.Orders()
        for batch in batches:
            found = []
            for (key, kind), data in zip(pbwt.keyed(batch, by), batch.column("gt").to_pylist(), strict=True):
                gt, bits = np.frombuffer(data, np.uint8), ewah.BITS[kind]
                found.append(ewah.word_markers(ewah.vector_words(orders.step(key, kind, gt) if use_pbwt else gt, bits), bits))
            told = [pa.array([x] * batch.num_rows, pa.bool_()) for x in (use_pbwt, reset)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in HEAD), *told, _listed(found)], [*HEAD, "use_pbwt", "reset", "markers"])

    return (pbwt.dealt(sites, by) if use_pbwt else sites).select(*HEAD, "gt").mapInArrow(run, ENCODED)


def encode(alleles: DataFrame, *, block_size: int = BLOCK_SITES, use_pbwt: bool = True, reset: bool = True) -> DataFrame:
    """``site_id, block_id, group_id, archetype, ploidy, n, use_pbwt, reset`` and the markers of each site."""
    return encode_sites(route.site_vectors(alleles, block_size), use_pbwt=use_pbwt, reset=reset)


def write(encoded: DataFrame, path: str, *, codec: str = "zstd", level: int = 3, mode: str = "errorifexists") -> None:
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    encoded.repartition("block_id").sortWithinPartitions("block_id", "group_id", "archetype", "site_id").write.option(
        "parquet.compression.codec.zstd.level", level
    ).partitionBy("block_id").parquet(path, mode=mode, compression=codec)


def read(spark: SparkSession, path: str, *, block: int | None = None, site: int | None = None) -> DataFrame:
    """The archive, or one block (a directory) or site (row groups by their statistics) of it."""
    frame = spark.read.parquet(path)
    if block is not None:
        frame = frame.where(F.col("block_id") == block)
    return frame if site is None else frame.where(F.col("site_id") == site)


def stored_vectors(encoded: DataFrame) -> DataFrame:
    """``site_id, pos, allele`` as stored: permuted if the archive is. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from spread(list(_vectors(batch)), [batch.column("site_id")], ["site_id"], "pos")

    return encoded.select("site_id", "archetype", "n", "markers").mapInArrow(run, "site_id int, pos int, allele int")


def _unpermuted(batches: Iterable[pa.RecordBatch], by: list[str] | None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch with its vectors in the original order; without ``by`` they are stored so."""
    orders = pbwt.Orders()
    for batch in batches:
        stored = _vectors(batch)
        yield batch, list(stored) if by is None else [orders.step(key, kind, gt, True) for (key, kind), gt in zip(pbwt.keyed(batch, by), stored, strict=True)]


def decode(encoded: DataFrame, *, use_pbwt: bool = True, reset: bool = True) -> DataFrame:
    """``site_id, hap, allele`` in the original order."""
    if not use_pbwt:
        return stored_vectors(encoded).withColumnRenamed("pos", "hap")
    by = pbwt.keys(reset)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _unpermuted(batches, by):
            yield from spread(vectors, [batch.column("site_id")], ["site_id"], "hap")

    return pbwt.dealt(encoded, by).select("site_id", *by, "n", "markers").mapInArrow(run, "site_id int, hap int, allele int")


def decode_vectors(encoded: DataFrame, *, use_pbwt: bool = True, reset: bool = True) -> DataFrame:
    """``site_id, ploidy, gt`` in the original order, a site a row."""
    by = pbwt.keys(reset)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _unpermuted(batches, by if use_pbwt else None):
            yield pa.RecordBatch.from_arrays([batch.column("site_id"), batch.column("ploidy"), pa.array([v.astype(np.uint8).tobytes() for v in vectors], pa.binary())], ["site_id", "ploidy", "gt"])

    ready = pbwt.dealt(encoded, by) if use_pbwt else encoded
    return ready.select("site_id", "ploidy", *by, "n", "markers").mapInArrow(run, "site_id int, ploidy int, gt binary")


def flat(encoded: DataFrame) -> DataFrame:
    """``site_id, stream``: the site's markers and dirty words as bytes, little-endian: 8 of a marker (ref 4 bits, clean 30, dirty 30), then 4 of each of its words."""
    marker = lambda m: F.format_string("%016x", m["ref"].cast("long") + F.shiftleft(m["clean"].cast("long"), 4) + F.shiftleft(m["dirty"].cast("long"), 34))
    turned = lambda text: F.array_join(F.reverse(F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))), "")
    words = lambda m: F.array_join(F.transform(m["words"], lambda w: turned(F.format_string("%08x", w))), "")
    return encoded.select("site_id", F.unhex(F.array_join(F.transform("markers", lambda m: F.concat(turned(marker(m)), words(m))), "")).alias("stream"))


def _bytes() -> Column:
    return (8 * F.size("markers") + 4 * F.aggregate("markers", F.lit(0), lambda a, m: a + m["dirty"])).cast("long")


def folds(encoded: DataFrame) -> DataFrame:
    """``block_id, n_in, n_out, fold``: bytes of the plain vectors, of the encoded form before the codec, and their ratio."""
    return encoded.groupBy("block_id").agg(F.sum("n").alias("n_in"), F.sum(_bytes()).alias("n_out")).withColumn("fold", F.col("n_in") / F.col("n_out"))


def sizes(encoded: DataFrame) -> DataFrame:
    """``site_id, n_bytes, in_flight``: bytes before the codec, and their running sum inside the block."""
    own = encoded.select("site_id", "block_id", _bytes().alias("n_bytes"))
    return own.select("site_id", "n_bytes", F.sum("n_bytes").over(Window.partitionBy("block_id").orderBy("site_id")).alias("in_flight"))
