"""Adaptive entropy coding: of bytes, and of the segments of packed words by a context model.

A binary arithmetic coder with a 32-bit interval codes every decision under an adaptive probability. Bytes and lengths are coded bit by bit, each bit
in the context of those before it (``BitModel``); symbols of small alphabets by halving the alphabet under counts that grow and are halved
(``FrequencyModel``), many of which are chosen by what came before (``ContextModel``). The context coder knows a site as runs of equal clean words and as literal
words: runs cost a symbol and a length, literals their four bytes.

Streams are cut into parts of about ``PART`` bytes of input, each coded from fresh models, so that a worker never holds more of a block. Parts
are coded in parallel where keys differ, and decoded all in parallel. The bytes are of this library's own format; decoding gives back the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hapframe.operators import ewah
from hapframe.operators.vectors import byte_views

TOP, MASK = 1 << 24, 0xFFFFFFFF
PART = 1 << 18


class Writer:
    """Takes decisions with the probability of a one in 1/65536."""

    def __init__(self) -> None:
        self.low, self.high, self.out = 0, MASK, bytearray()

    def bit(self, p: int, value: int) -> int:
        low, high = self.low, self.high
        middle = low + ((high - low) * p >> 16)
        low, high = (low, middle) if value else (middle + 1, high)
        while (low ^ high) < TOP:
            self.out.append(high >> 24)
            low, high = low << 8 & MASK, high << 8 & MASK | 255
        self.low, self.high = low, high
        return value

    def close(self) -> bytes:
        return bytes(self.out) + self.low.to_bytes(4, "big")


class Reader:
    """Gives the decisions back; what it is told as their value doesn't count."""

    def __init__(self, data: bytes) -> None:
        self.low, self.high, self.data, self.at = 0, MASK, data, 4
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def bit(self, p: int, value: int = 0) -> int:
        low, high = self.low, self.high
        middle = low + ((high - low) * p >> 16)
        value = int(self.code <= middle)
        low, high = (low, middle) if value else (middle + 1, high)
        while (low ^ high) < TOP:
            low, high = low << 8 & MASK, high << 8 & MASK | 255
            self.code = self.code << 8 & MASK | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
        self.low, self.high = low, high
        return value


class BitModel:
    """Probabilities of a one bit, in 1/65536, by context. A context learns fast at first, and by ``1 / limit`` once it is old."""

    def __init__(self, limit: int = 60) -> None:
        self.seen, self.limit = {}, limit

    def bit(self, coder: Writer | Reader, context, value: int) -> int:
        p, n = self.seen.get(context, (32768, 2))
        value = coder.bit(p, value)
        p += ((65536 if value else 0) - p) // n
        self.seen[context] = (min(65472, max(64, p)), n + 1 if n < self.limit else n)
        return value

    def bits(self, coder: Writer | Reader, context, value: int, n: int) -> int:
        """A number of ``n`` bits, the highest first, each in the context of those before it."""
        node = 1
        for k in range(n - 1, -1, -1):
            node = node << 1 | self.bit(coder, (context, node), value >> k & 1)
        return node - (1 << n)


class FrequencyModel:
    """Counts of the symbols of an alphabet; they grow by ``step``, and are halved beyond ``most`` in all."""

    def __init__(self, size: int, step: int = 24, most: int = 1 << 13) -> None:
        self.counts, self.total, self.step, self.most = [1] * size, size, step, most

    def probability(self, symbol: int) -> float:
        return self.counts[symbol] / self.total

    def code(self, coder: Writer | Reader, symbol: int) -> int:
        low, high, all_ = 0, len(self.counts), self.total
        while high - low > 1:
            middle = (low + high) // 2
            lower = sum(self.counts[low:middle])
            if coder.bit(min(65472, max(64, (lower << 16) // all_)), int(symbol < middle)):
                high, all_ = middle, lower
            else:
                low, all_ = middle, all_ - lower
        self.counts[low] += self.step
        self.total += self.step
        if self.total > self.most:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            self.total = sum(self.counts)
        return low


class ContextModel:
    """Frequency models of one alphabet, by context; the caller holds the context."""

    def __init__(self, size: int, step: int = 24, most: int = 1 << 13) -> None:
        self.of, self.make = {}, lambda: FrequencyModel(size, step, most)

    def code(self, coder: Writer | Reader, context, symbol: int) -> int:
        model = self.of.get(context)
        if model is None:
            model = self.of[context] = self.make()
        return model.code(coder, symbol)

    def probability(self, context, symbol: int) -> float:
        return (self.of.get(context) or self.make()).probability(symbol)


#: By archetype: symbols of a run, and step and limit of the counts.
MODELS = {"2mc": {"refs": 2, "step": 24, "most": 1 << 13}, "nm": {"refs": 16, "step": 16, "most": 1 << 12}}


class SegmentCoder:
    """Codes the words of sites in turn; the same calls, told nothing, read them back."""

    def __init__(self, archetype: str) -> None:
        of = MODELS[archetype]
        counts = {k: of[k] for k in ("step", "most")}
        self.bits, self.kinds, self.refs, self.sizes = ewah.BITS[archetype], ContextModel(2, **counts), ContextModel(of["refs"], **counts), ContextModel(33, **counts)
        self.low, self.literals = BitModel(), BitModel()
        self.ref, self.log = 0, 0

    def _size(self, coder: Writer | Reader, run: int, n: int) -> int:
        """A length by its number of bits, then the bits below the first."""
        log = self.sizes.code(coder, (run, self.ref if run else -1, min(self.log, 12)), n.bit_length())
        self.log = log
        return (1 << (log - 1)) + self.low.bits(coder, (run, log), n - (1 << (n.bit_length() - 1)) if n else 0, log - 1)

    def site(self, coder: Writer | Reader, n_words: int, words: np.ndarray | None = None) -> np.ndarray:
        """Words of one site: given to a Writer, made by a Reader."""
        out = np.empty(n_words, "<u4") if words is None else words
        segments = iter(()) if words is None else zip(*(x.tolist() for x in ewah.word_segments(words, self.bits)), strict=True)
        at, before = 0, 2
        while at < n_words:
            ref, size = next(segments, (-1, 0))
            run = before = self.kinds.code(coder, before, int(ref >= 0))
            if run:
                self.ref = self.refs.code(coder, self.ref, max(ref, 0))
            size = self._size(coder, run, size)
            if run and words is None:
                out[at : at + size] = self.ref * (ewah.FULL if self.bits == 1 else ewah.NIBBLES)
            elif not run:
                for k in range(at, at + size):
                    word, made, ones = int(out[k]) if words is not None else 0, 0, 0
                    for j in range(4):  # lowest byte first, in the context of how many bits are set so far
                        byte = self.literals.bits(coder, (j, ones), word >> 8 * j & 255, 8)
                        made |= byte << 8 * j
                        ones = min(made.bit_count(), 5) if self.bits == 1 else byte
                    out[k] = made
            at += size
        return out


def encode(data: bytes) -> bytes:
    """Bytes, each in the context of the one before."""
    coder, model, before = Writer(), BitModel(), 0
    for byte in data:
        before = model.bits(coder, before, byte, 8)
    return coder.close()


def decode(data: bytes, n: int) -> bytes:
    coder, model, out, before = Reader(data), BitModel(), bytearray(), 0
    for _ in range(n):
        before = model.bits(coder, before, 0, 8)
        out.append(before)
    return bytes(out)


def parts(batches: Iterable[pa.RecordBatch], keys: list[str], size: int) -> Iterator[tuple[tuple, int, list[dict], list[int], bytes]]:
    """(key, number of the part, rows without their ``gt``, where each one's ends, the bytes of all) of sorted rows, in parts of about ``size`` bytes of one key.
    Beside a part only one batch is held, as it came."""
    key, number, rows, ends, data = None, 0, [], [], bytearray()

    def part() -> tuple[tuple, int, list[dict], list[int], bytes]:
        nonlocal rows, ends, data
        out = key, number, rows, ends, bytes(data)
        rows, ends, data = [], [], bytearray()
        return out

    for batch in batches:
        heads = batch.select([c for c in batch.schema.names if c != "gt"]).to_pylist()
        for row, gt in zip(heads, byte_views(batch.column("gt")), strict=True):
            own = tuple(row[k] for k in keys)
            if rows and (own != key or len(data) >= size):
                yield part()
                number += 1
            number, key = (number, key) if own == key else (0, own)
            rows.append(row)
            data += gt.data
            ends.append(len(data))
    if rows:
        yield part()


def _kinds(frame: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)


def code_streams(vectors: DataFrame, keys: list[str], code: Callable[[bytes], bytes] = encode, size: int = PART) -> DataFrame:
    """``keys, part, site_ids, n_bytes, payload``: the vectors of each key (rows with ``site_id, gt``) as coded streams."""
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(vectors.schema)
    schema = pa.schema([*(types.field(k) for k in keys), ("part", pa.int32()), ("site_ids", pa.list_(pa.int32())), ("n_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, number, rows, _, data in parts(batches, keys, size):
            row = dict(zip(keys, key, strict=True)) | {"part": number, "site_ids": [r["site_id"] for r in rows], "n_bytes": len(data), "payload": code(data)}
            yield pa.RecordBatch.from_pylist([row], schema)

    dealt = vectors.select(*keys, "site_id", "gt").repartition(*keys).sortWithinPartitions(*keys, "site_id")
    return dealt.mapInArrow(run, f"{_kinds(vectors, keys)}, part int, site_ids array<int>, n_bytes long, payload binary")


def decode_streams(coded: DataFrame, keys: list[str], read: Callable[[bytes, int], bytes] = decode) -> DataFrame:
    """``keys, site_id, gt`` of what ``code_streams`` made. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (sites, n, payload) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("site_ids", "n_bytes", "payload")), strict=True)):
                data, width = read(payload, n), n // max(len(sites), 1)
                own = [batch.column(c).take(pa.array([k] * len(sites))) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sites, pa.int32()), pa.array([data[i * width : (i + 1) * width] for i in range(len(sites))], pa.binary())], [*keys, "site_id", "gt"])

    return coded.select(*keys, "site_ids", "n_bytes", "payload").mapInArrow(run, f"{_kinds(coded, keys)}, site_id int, gt binary")


def general_codec(name: str, level: int | None = None) -> tuple[Callable[[bytes], bytes], Callable[[bytes, int], bytes]]:
    """(compress, decompress) of zstd or lz4; lz4 compresses harder from level 3 on."""
    make = lambda: pa.Codec(name, level) if level is not None else pa.Codec(name)
    return lambda data: make().compress(data, asbytes=True), lambda data, n: pa.Codec(name).decompress(data, n, asbytes=True)


def codec_streams(vectors: DataFrame, keys: list[str], codec: str = "zstd", level: int | None = 19, size: int = PART) -> DataFrame:
    """``keys, part, n_sites, n_bytes, n_coded, equal``: streams under a general codec, and whether they come back as they were."""
    compress, decompress = general_codec(codec, level)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, number, rows, _, data in parts(batches, keys, size):
            coded = compress(data)
            row = dict(zip(keys, key, strict=True)) | {"part": number, "n_sites": len(rows), "n_bytes": len(data), "n_coded": len(coded), "equal": decompress(coded, len(data)) == data}
            yield pa.RecordBatch.from_pylist([row], schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(vectors.schema)
    schema = pa.schema([*(types.field(k) for k in keys), ("part", pa.int32()), ("n_sites", pa.int64()), ("n_bytes", pa.int64()), ("n_coded", pa.int64()), ("equal", pa.bool_())])
    dealt = vectors.select(*keys, "site_id", "gt").repartition(*keys).sortWithinPartitions(*keys, "site_id")
    return dealt.mapInArrow(run, f"{_kinds(vectors, keys)}, part int, n_sites long, n_bytes long, n_coded long, equal boolean")
