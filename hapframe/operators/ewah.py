"""Bit packing, word-aligned run-length markers, and statistics on them.

A word holds 32 symbols of one bit (2mc) or 8 of four bits (nm). A word is clean if all its symbols are equal. A marker is a run of
equal clean words, then the dirty words up to the next clean one. The same is here twice: on rows, in the JVM, and on whole vectors inside an Arrow
batch, for the archive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL = 0xFFFFFFFF
NIBBLES = 0x11111111


def per_word(bits: int) -> int:
    return 32 // bits


def pack(alleles: DataFrame, bits: int, position: str = "hap") -> DataFrame:
    """``site_id, word_idx, word``; bits or-ed together, combined before the shuffle."""
    n = per_word(bits)
    symbol = (F.col("allele") != 0).cast("long") if bits == 1 else F.col("allele").cast("long")
    shifted = symbol * F.pow(F.lit(2.0), (F.col(position) % n) * bits).cast("long")
    return alleles.groupBy("site_id", F.floor(F.col(position) / n).cast("int").alias("word_idx")).agg(F.bit_or(shifted).alias("word"))


def clean_symbol(word: Column, bits: int) -> Column:
    """The symbol that fills the word, null if it is dirty."""
    if bits == 1:
        return F.when(word == 0, 0).when(word == FULL, 1)
    return F.when(word == (word % 16) * NIBBLES, (word % 16).cast("int"))


def markers(words: DataFrame, bits: int) -> DataFrame:
    """``site_id, marker_idx, ref, clean, dirty, words``."""
    by = Window.partitionBy("site_id").orderBy("word_idx")
    own = words.withColumn("c", clean_symbol(F.col("word"), bits)).withColumn("p", F.lag("c").over(by))
    starts = F.col("c").isNotNull() & (F.col("word_idx") > 0) & (F.col("p").isNull() | (F.col("p") != F.col("c")))
    marked = own.withColumn("marker_idx", F.sum(starts.cast("int")).over(by).cast("int"))
    dirty = F.col("c").isNull()
    return marked.groupBy("site_id", "marker_idx").agg(
        F.coalesce(F.max("c"), F.lit(0)).alias("ref"), F.count("c").cast("int").alias("clean"), F.sum(dirty.cast("int")).cast("int").alias("dirty"),
        F.transform(F.array_sort(F.collect_list(F.when(dirty, F.struct("word_idx", "word")))), lambda x: x["word"]).alias("words"),
    )


def segments(words: DataFrame, bits: int) -> DataFrame:
    """``site_id, segment_idx, kind, ref, n_words``: runs for the context coder. In 2mc a lone clean word is a literal."""
    by = Window.partitionBy("site_id").orderBy("word_idx")
    c = F.coalesce(clean_symbol(F.col("word"), bits), F.lit(-1))
    runs = words.withColumn("c", c).withColumn("new", (F.lag("c").over(by).isNull() | (F.lag("c").over(by) != F.col("c"))).cast("int")).withColumn("run", F.sum("new").over(by))
    sized = runs.withColumn("n", F.count("*").over(Window.partitionBy("site_id", "run")))
    least = 2 if bits == 1 else 1
    kind = sized.withColumn("k", F.when((F.col("c") >= 0) & (F.col("n") >= least), F.col("c")).otherwise(-1))
    cut = kind.withColumn("new", (F.lag("k").over(by).isNull() | (F.lag("k").over(by) != F.col("k"))).cast("int")).withColumn("segment_idx", (F.sum("new").over(by) - 1).cast("int"))
    return cut.groupBy("site_id", "segment_idx").agg(
        F.when(F.max("k") >= 0, "run").otherwise("literal").alias("kind"), F.when(F.max("k") >= 0, F.max("k")).alias("ref"), F.count("*").cast("int").alias("n_words"),
    )


def unpack(marked: DataFrame, bits: int, sizes: DataFrame) -> DataFrame:
    """``site_id, pos, allele`` from markers; ``sizes`` (site_id, n) gives the number of symbols without padding."""
    n = per_word(bits)
    word = F.col("ref").cast("long") * (FULL if bits == 1 else NIBBLES)
    expanded = marked.select("site_id", "marker_idx", F.concat(F.array_repeat(word, F.col("clean")), F.col("words")).alias("w"))
    whole = expanded.groupBy("site_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("marker_idx", "w"))), lambda x: x["w"])).alias("w"))
    words = whole.join(sizes.select("site_id", "n"), "site_id").select("site_id", "n", F.posexplode("w").alias("i", "word"))
    symbols = words.select("site_id", "n", "i", "word", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).withColumn("pos", F.col("i") * n + F.col("k"))
    value = F.floor(F.col("word") / F.pow(F.lit(2.0), F.col("k") * bits)).cast("long") % (1 << bits)
    return symbols.where(F.col("pos") < F.col("n")).select("site_id", "pos", value.cast("int").alias("allele"))


def ones(marked: DataFrame) -> DataFrame:
    """Allele count of 2mc sites from the compressed form: population counts and clean runs, nothing unpacked."""
    dirty = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))
    return marked.groupBy("site_id").agg(F.sum(dirty + 32 * F.col("clean") * F.col("ref")).alias("ac"), (32 * F.sum(F.col("clean") + F.col("dirty"))).cast("long").alias("n_padded"))


def histogram_nm(marked: DataFrame) -> DataFrame:
    """``site_id, allele, n`` of nm sites from the compressed form; n counts the padding as symbol 0."""
    clean = marked.where("clean > 0").select("site_id", F.col("ref").alias("allele"), (F.col("clean") * 8).cast("long").alias("n"))
    nibbles = marked.select("site_id", F.explode("words").alias("w")).select("site_id", "w", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    dirty = nibbles.select("site_id", (F.floor(F.col("w") / F.pow(F.lit(16.0), F.col("k"))).cast("long") % 16).cast("int").alias("allele"), F.lit(1).cast("long").alias("n"))
    return clean.union(dirty).groupBy("site_id", "allele").agg(F.sum("n").alias("n"))


def coverage(marked: DataFrame, bits: int) -> DataFrame:
    return marked.groupBy("site_id").agg(((F.sum(F.col("clean") + F.col("dirty"))) * per_word(bits)).cast("long").alias("n_covered"), F.count("*").alias("n_markers"))


def encoded_bytes(marked: DataFrame) -> DataFrame:
    """Bytes of a site's markers (8 each) and dirty words (4 each), before any codec."""
    return marked.groupBy("site_id").agg((8 * F.count("*") + 4 * F.sum("dirty")).cast("long").alias("n_bytes"))


BITS = {"2mc": 1, "nm": 4}


def vector_words(gt: np.ndarray, bits: int) -> np.ndarray:
    """Words of a vector, filled up with symbol 0."""
    n = -(-len(gt) // per_word(bits))
    out = np.zeros(4 * n, np.uint8)
    if bits == 1:
        packed = np.packbits(gt != 0, bitorder="little")
    else:
        packed = gt[0::2].copy()
        packed[: len(gt) // 2] |= gt[1::2] << 4
    out[: len(packed)] = packed
    return out.view("<u4")


def words_vector(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` symbols of words."""
    raw = words.astype("<u4").view(np.uint8)
    if bits == 1:
        return np.unpackbits(raw, bitorder="little")[:n]
    out = np.empty(2 * len(raw), np.uint8)
    out[0::2], out[1::2] = raw & 15, raw >> 4
    return out[:n]


def clean_symbols(words: np.ndarray, bits: int) -> np.ndarray:
    """The symbol that fills each word, -1 where it is dirty."""
    if bits == 1:
        return np.where(words == 0, 0, np.where(words == FULL, 1, -1))
    symbol = (words & 15).astype(np.int64)
    return np.where(words == symbol * NIBBLES, symbol, -1)


def word_markers(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ref, clean, dirty) of each marker, and the dirty words of all."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3 + (words,)
    c = clean_symbols(words, bits)
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] >= 0) & (c[1:] != c[:-1])
    start = np.flatnonzero(new)
    clean = np.add.reduceat((c >= 0).astype(np.int64), start)
    return np.maximum(c[start], 0), clean, np.diff(np.append(start, len(c))) - clean, words[c < 0]


def marker_words(ref: np.ndarray, clean: np.ndarray, dirty: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``word_markers``."""
    size = clean + dirty
    out = np.repeat(ref.astype(np.int64) * (FULL if bits == 1 else NIBBLES), size)
    at = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
    out[at >= np.repeat(clean, size)] = words
    return out.astype("<u4")


def word_segments(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ref or -1 for literals, number of words) of the context coder's segments."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 2
    c = clean_symbols(words, bits)
    start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(start, len(c)))
    kind = np.where((c[start] >= 0) & (size >= (2 if bits == 1 else 1)), c[start], -1)
    lead = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1])))
    return kind[lead], np.add.reduceat(size, lead)
