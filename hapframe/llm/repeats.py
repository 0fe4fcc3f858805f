"""Removal of byte strings that an earlier document has, by run-length indexes and matching statistics.

A byte goes if it lies in a ``width``-byte string that also starts in a document with a smaller id. A string's first copy may lie in any document,
so an index of some documents would have to meet all others. The text is dealt by content instead, and every shard's index holds all
that can match there:

1. Documents are packed into chunks of about ``CHUNK`` bytes, which are written out, compressed.
2. Of the 20-byte strings inside a ``width``-byte string the one with the least hash (the last of equal ones) is its anchor, so equal strings have equal
   anchors at equal places. Neighbouring strings with one anchor make up a segment. Shards are hash ranges of anchors. First only the anchors'
   hashes travel, once a chunk, to find those that two documents have; of these the segments travel, once a chunk however many documents of it have them.
3. A shard's run-length index (``run_index``) holds the segments that some later document could have; those that some earlier document could have
   stream their matching statistics over it. Where a match is ``width`` long, the index tells the least document of the string.
4. The answers return to their chunks, where every document marks the strings whose least document is smaller than its own. Marks are united there.

Segments are compared by their bytes. Hashes only bring them together: a false meeting costs work alone. A shard is taken in ``PARTS`` parts, one at a
time. A segment of which a third of all documents have copies travels once a chunk. An anchor with more than ``hot`` occurrences may stand between very
many different bytes: its strings are dealt each by its own hash instead, so that none of its shards holds more than equal strings.

Defined results: null and empty texts and those shorter than ``width`` lose nothing; documents with equal ids are not earlier than each other, each row
gets its own result; a row with a null id is neither earlier nor later than any; ids of any type that has an order will do; a text of any length
is one chunk at least; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hapframe.llm.common import cut, forget, release, table
from hapframe.llm.run_index import GRAM, RunIndex, starts_of
from hapframe.llm.tokens import bounded_batches, mix64

WIDTH = 50
CHUNK, PARTS, HOT = 4 << 20, 4, 1 << 14
#: Positions at once while anchors are looked for, so that the arrays stay in the cache.
STEP = 1 << 16
#: Text to a task, at least so many tasks are made.
TASK_BYTES = 64 << 20
PLACE = np.uint64((1 << 31) - 1)
MARKS = np.dtype([("segment", "<u4"), ("first", "u1"), ("n", "u1"), ("least", "<i8")])


def slide(x: np.ndarray, n: int) -> np.ndarray:
    """least of x[i:i + n] for every i with n values left."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def gram_hashes(data: bytes, n: int) -> np.ndarray:
    """Of the GRAM bytes from each of the first ``n`` positions on."""
    x = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = x[:n] * np.uint64(0x9E3779B97F4A7C15) + x[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + x[12 : n + 12] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


def segments(data: bytes, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, anchor, anchor's hash) of the segments of texts that follow one another in ``data``."""
    span, found = width - GRAM + 1, []
    inside = np.zeros(len(data) + 2, np.int8)
    real = sizes >= width
    inside[starts[real]] += 1
    inside[(starts + sizes - width + 1)[real]] -= 1
    for a in range(0, len(data) - width + 1, STEP):
        n = min(STEP, len(data) - width + 1 - a)
        piece = data[a : a + n + width - 1]
        h = gram_hashes(piece, len(piece) - GRAM + 1)
        low = slide((h & ~PLACE) | (PLACE - np.arange(a, a + len(h), dtype=np.uint64)), span)
        at = (PLACE - (low & PLACE)).astype(np.int64)
        change = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        found.append((change + a, at[change], h[at[change] - a]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    first, at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # Cut at the ends of texts too, and leave out what crosses them.
    ends = np.cumsum(inside[: len(data)], dtype=np.int8)
    borders = np.flatnonzero(np.diff(ends, prepend=0))
    borders = borders[borders < len(data) - width + 1]
    where = np.searchsorted(first, borders, side="right") - 1
    first, at, h = np.concatenate([first, borders]), np.concatenate([at, at[where]]), np.concatenate([h, h[where]])
    order = np.argsort(first, kind="stable")
    first, at, h = first[order], at[order], h[order]
    n = np.diff(np.append(first, max(len(data) - width + 1, 0)))
    keep = (n > 0) & (ends[np.minimum(first, len(data) - 1)] > 0)
    first, at, h, n = first[keep], at[keep], h[keep], n[keep]
    joined = np.flatnonzero((at[1:] == at[:-1]) & (first[1:] == first[:-1] + n[:-1])) + 1  # pieces of one
    lead = np.ones(len(at), bool)
    lead[joined] = False
    lead = np.flatnonzero(lead)
    return first[lead], np.add.reduceat(n, lead) if len(lead) else n, at[lead], h[lead]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths and types."""
    return len(arrays).to_bytes(8, "little") + b"".join(a.dtype.str.encode().ljust(8) + len(a).to_bytes(8, "little") for a in arrays) + b"".join(a.tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    n, out = int.from_bytes(data[:8], "little"), []
    at = 8 + 16 * n
    for k in range(n):
        kind, size = np.dtype(data[8 + 16 * k : 16 + 16 * k].strip().decode()), int.from_bytes(data[16 + 16 * k : 24 + 16 * k], "little")
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def loosened(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers as a base and differences of as few bytes as they need."""
    base = x.min() if len(x) else 0
    rest = x - base  # where they span more than an integer holds this wraps, and wraps back
    few = not len(x) or (rest.min() >= 0 and rest.max() < 1 << 32)
    return np.array([base], np.int64), rest.astype("<u4" if few else "<i8")


def of_rows(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.values())], list(schema))


RECORD = {"bucket": pa.int64(), "chunk": pa.int64(), "data": pa.binary()}
RECORD_DDL = "bucket long, chunk long, data binary"


class Chunk:
    """Documents of one chunk: bytes, starts, sizes and ranks; ``known`` tells which have an id. Of the others the complement of the size is stored."""

    def __init__(self, data: bytes, sizes: bytes, ranks: bytes):
        self.data, told, self.ranks = loosened(data), np.frombuffer(sizes, "<i8"), np.frombuffer(ranks, "<i8")
        self.known, self.sizes = told >= 0, np.where(told < 0, ~told, told)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def segments(self, width: int) -> tuple[np.ndarray, ...]:
        """As ``segments``, of documents with an id, and each one's document."""
        first, n, at, h = segments(self.data, self.starts, np.where(self.known, self.sizes, 0), width)
        real = np.flatnonzero(self.sizes)  # empty ones share their start with the next
        return first, n, at, h, real[np.searchsorted(self.starts[real], first, side="right") - 1]


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``chunk, n_bytes, ids, data, sizes, ranks``: documents packed, ids as they are and as ranks in their order."""
    kind, ids = docs.schema[id_col].dataType, F.col(f"`{id_col}`")
    narrow = docs.select(ids.alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    if isinstance(kind, IntegralType):
        ranked = narrow.withColumn("rank", F.col("id").cast("long"))
    else:  # numbers of a sorted frame rise with it; written out, so that no task gives others
        ranks = cut(narrow.where("id IS NOT NULL").select("id").distinct().sort("id").withColumn("rank", F.monotonically_increasing_id()), "ranks")
        ranked = narrow.join(ranks, "id", "left").select("id", "text", "rank")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, n
            ids = pa.concat_arrays([h[0] for h in held])
            raw = [x for h in held for x in h[1]]
            ranks, known = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            sizes = np.fromiter(map(len, raw), "<i8", len(raw))
            number, n = number + 1, 0
            held.clear()
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sizes.sum()], pa.int64()), lists, pa.array([squeezed(b"".join(raw))], pa.binary()), pa.array([np.where(known, sizes, ~sizes).tobytes()], pa.binary()), pa.array([ranks.astype("<i8").tobytes()], pa.binary())], ["chunk", "n_bytes", "ids", "data", "sizes", "ranks"])

        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            ranks, known = batch.column(2).fill_null(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            a = 0
            for b, text in enumerate(texts, 1):
                n += len(text) + 64
                if n >= size or b == len(texts):
                    held.append((batch.column(0).slice(a, b - a), texts[a:b], ranks[a:b], known[a:b]))
                    a = b
                    if n >= size:
                        yield out()
        if held:
            yield out()
        release()

    return cut(ranked.mapInArrow(run, f"chunk long, n_bytes long, ids array<{kind.simpleString()}>, data binary, sizes binary, ranks binary"), "chunks")


def spans(*keys: np.ndarray) -> Iterable[tuple[int, int]]:
    """(first, end) of the runs of equal keys."""
    cuts = starts_of(*keys).tolist()
    return zip(cuts, [*cuts[1:], len(keys[0])], strict=True) if cuts else ()


def by_value(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its places) of small integers."""
    order = np.argsort(x, kind="stable")
    for a, b in spans(x[order]):
        yield int(x[order[a]]), order[a:b]


def parts(batches: Iterable[pa.RecordBatch], read=unpack) -> Iterator[tuple[int, list[int], list[list[np.ndarray]]]]:
    """(bucket, chunks, arrays of each record) of a partition that is sorted by buckets."""
    now, numbers, found = None, [], []
    for batch in batches:
        for bucket, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and numbers:
                yield now, numbers, found
                numbers, found = [], []
            now = bucket
            numbers.append(number)
            found.append(read(data))
    if numbers:
        yield now, numbers, found


def dealt(records: DataFrame, n: int) -> DataFrame:
    """Buckets in turn to ``n`` tasks, so that each gets as many."""
    return records.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")


def keys_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket and 32 further bits of hashes, in one number."""
    return ((h >> np.uint64(32)) % np.uint64(n)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def shared_anchors(packed: DataFrame, width: int, n: int, hot: int) -> DataFrame:
    """``chunk, shared``: bucket, number of hot ones, and the bits of the chunk's anchors that two documents have, the hot ones first."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, sizes, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk = Chunk(data, sizes, ranks)
                *_, h, doc = chunk.segments(width)
                if not len(h):
                    continue
                key, rank = keys_of(h, n * PARTS), chunk.ranks[doc]
                order = np.argsort(key)
                key, rank = key[order], rank[order]
                at = starts_of(key)
                count = np.diff(np.append(at, len(key)))
                several = np.minimum.reduceat(rank, at) != np.maximum.reduceat(rank, at)
                told = (np.minimum(count, 32767) * 2 + several).astype("<u2")
                bucket, rest = (key[at] >> np.uint64(32)).astype(np.int64), (key[at] & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield of_rows(RECORD, [(int(bucket[a]), number, pack(rest[a:b], told[a:b])) for a, b in spans(bucket)])
        release()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, numbers, found in parts(batches):
            rest, told = (np.concatenate(x) for x in zip(*found, strict=True))
            of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            order = np.argsort(rest)
            rest, told, of = rest[order], told[order], of[order]
            at = starts_of(rest)
            size = np.diff(np.append(at, len(rest)))
            shared = (size > 1) | (np.maximum.reduceat(told & 1, at) > 0)
            many = np.repeat(np.add.reduceat(told.astype(np.int64) >> 1, at) > hot, size)
            keep = np.flatnonzero(np.repeat(shared, size))
            rows = []
            for k, places in by_value(of[keep]):
                some = keep[places]
                some = some[np.argsort(~many[some], kind="stable")]
                rows.append((bucket, numbers[k], pack(np.array([bucket, many[some].sum()], "<u8"), rest[some])))
            yield of_rows(RECORD, rows)
        release()

    sent = packed.select("chunk", "data", "sizes", "ranks").mapInArrow(send, RECORD_DDL)
    return dealt(sent, n).mapInArrow(meet, RECORD_DDL).groupBy("chunk").agg(F.collect_list("data").alias("shared"))


def around(data: bytes, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, side: int) -> np.ndarray:
    """Rows of ``side`` bytes, the anchor and ``side`` bytes; zeros where the segment doesn't reach."""
    padded = np.frombuffer(b"".join((bytes(side), data, bytes(side))), np.uint8)
    at = np.arange(GRAM + 2 * side)
    rows = np.lib.stride_tricks.sliding_window_view(padded, GRAM + 2 * side)[anchor]
    rows[(at < side - left[:, None].astype(np.int64)) | (at >= side + GRAM + right[:, None].astype(np.int64))] = 0
    return rows


def row_hashes(rows: np.ndarray, seed: np.ndarray) -> np.ndarray:
    n = rows.shape[1] // 8 * 8
    words, h = np.ascontiguousarray(rows[:, :n]).view("<u8"), mix64(seed.astype(np.uint64), 1)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    for k in range(n, rows.shape[1]):
        h = (h ^ rows[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
    return h


def distinct(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct segment, number of its segment for each row)."""
    if not len(rows):
        return (np.zeros(0, np.int64),) * 2
    lengths = left.astype(np.int64) << 8 | right
    h = row_hashes(rows, lengths)
    order = np.argsort(h)
    new = np.zeros(len(order), bool)
    new[starts_of(h[order])] = True
    number = np.cumsum(new) - 1
    lead = order[new][number]
    if (rows[lead] != rows[order]).any() or (lengths[lead] != lengths[order]).any():  # unequal segments of one hash
        whole = np.concatenate([rows, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
        _, one, of = np.unique(whole, axis=0, return_index=True, return_inverse=True)
        return one, of.ravel()
    of = np.empty(len(order), np.int64)
    of[order] = number
    return order[new], of


def bounds(of: np.ndarray, least: np.ndarray, most: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of ``least`` and largest of ``most`` by number."""
    ends = np.iinfo(np.int64)
    low, high = np.full(n, ends.max), np.full(n, ends.min)
    np.minimum.at(low, of, least)
    np.maximum.at(high, of, most)
    return low, high


def known(records: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a chunk's shared anchors, sorted, and whether each is hot."""
    keys, hot = [], []
    for (bucket, n_hot), rest in map(unpack, records):
        keys.append(bucket << np.uint64(32) | rest.astype(np.uint64))
        hot.append(np.arange(len(rest)) < int(n_hot))
    keys, hot = np.concatenate(keys), np.concatenate(hot)
    order = np.argsort(keys)
    return keys[order], hot[order]


class Segments:
    """A chunk's distinct segments of shared anchors, and the places where it has them: segment, document, first string."""

    def __init__(self, chunk: Chunk, told: list[bytes], width: int, n: int):
        (keys, hot), side = known(told), width - GRAM
        first, count, anchor, h, doc = chunk.segments(width)
        own = keys_of(h, n * PARTS)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        pick = np.flatnonzero(keys[at] == own)
        apart = hot[at[pick]]
        bucket = (own[pick] >> np.uint64(32)).astype(np.int64)
        first, count, anchor, doc = first[pick], count[pick], anchor[pick], doc[pick]
        if apart.any():
            many = np.where(apart, count, 1)
            add = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            first, anchor, doc, bucket, apart = np.repeat(first, many) + add, np.repeat(anchor, many), np.repeat(doc, many), np.repeat(bucket, many), np.repeat(apart, many)
            count = np.where(apart, 1, np.repeat(count, many))
        left, right = anchor - first, first + count - 1 + width - anchor - GRAM
        rows = around(chunk.data, anchor, left, right, side)
        if apart.any():
            bucket[apart] = ((row_hashes(rows[apart], left[apart]) >> np.uint64(32)) % np.uint64(n * PARTS)).astype(np.int64)
        one, of = distinct(rows, left, right)
        self.rows, self.left, self.right, self.bucket = rows[one], left[one], right[one], bucket[one]
        self.least, self.most = bounds(of, chunk.ranks[doc], chunk.ranks[doc], len(one))
        order = np.argsort(of, kind="stable")
        self.segment, self.doc, self.first = of[order], doc[order], first[order]


def shared_segments(met: DataFrame, width: int, n: int) -> DataFrame:
    """Records of the chunks' segments by bucket."""
    side = width - GRAM

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.arange(GRAM + 2 * side)
        for batch in batches:
            for number, data, sizes, ranks, told in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                if not told:
                    continue
                own, out = Segments(Chunk(data, sizes, ranks), told, width, n), []
                for b, some in by_value(own.bucket):
                    left, right = own.left[some], own.right[some]
                    flat = own.rows[some][(mask >= side - left[:, None]) & (mask < side + GRAM + right[:, None])]
                    out.append((b, number, squeezed(pack(left.astype("u1"), right.astype("u1"), some.astype("<u4"), *small(own.least[some]), *small(own.most[some]), flat))))
                yield of_rows(RECORD, out)
        release()

    # The ids aren't used here, but with them both users of ``met`` read the same columns, so the texts are dealt once.
    return met.select("chunk", "ids", "data", "sizes", "ranks", "shared").mapInArrow(send, RECORD_DDL)


def matched(left: np.ndarray, right: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first string, number of strings, least document) of what an earlier document has of a segment."""
    gram = row_hashes(rows[:, side : side + GRAM], np.zeros(len(rows), np.int64))
    order = np.argsort(gram)
    at = starts_of(gram[order])
    of = np.empty(len(gram), np.int64)
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(gram))))
    earliest, latest = bounds(of, least, most, len(at))
    source, query = np.flatnonzero(least < latest[of]), np.flatnonzero(most > earliest[of])
    index = RunIndex(rows[source], left[source], right[source], least[source], side)
    which, d, found = index.long_matches(rows[query], left[query], right[query])
    which = query[which]
    earlier = found < most[which]
    which, first, found = which[earlier], (left[which] - d)[earlier], found[earlier]
    order = np.lexsort((first, which))
    which, first, found = which[order], first[order], found[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (first[1:] != first[:-1] + 1) | (found[1:] != found[:-1])
    lead = np.flatnonzero(new)
    return which[lead], first[lead], np.diff(np.append(lead, len(which))), found[lead]


def answers(records: DataFrame, width: int, n: int) -> DataFrame:
    """``chunk, data``: MARKS for the chunk's segments."""
    side = width - GRAM
    span = GRAM + 2 * side

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, numbers, found in parts(batches, lambda data: unpack(loosened(data))):
            sizes = np.array([len(f[0]) for f in found])
            left, right, segment = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))
            least, most = (np.concatenate([f[k + 1] + f[k] for f in found]) for k in (3, 5))
            length, flat = left + GRAM + right, np.concatenate([f[7] for f in found])
            rows = np.zeros((len(left), span), np.uint8)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            rows.ravel()[np.repeat(np.arange(len(left)) * span + side - left, length) + inside] = flat
            one, of = distinct(rows, left, right)
            low, high = bounds(of, least, most, len(one))
            which, first, count, doc = matched(left[one], right[one], rows[one], low, high, side)
            begin = np.searchsorted(which, of)
            times = np.searchsorted(which, of, side="right") - begin
            record = np.repeat(np.arange(len(of)), times)
            run_ = np.repeat(begin, times) + np.arange(len(record)) - np.repeat(np.cumsum(times) - times, times)
            keep = doc[run_] < most[record]
            record, run_ = record[keep], run_[keep]
            marks = np.empty(len(record), MARKS)
            marks["segment"], marks["first"], marks["n"], marks["least"] = segment[record], first[run_], count[run_], doc[run_]
            chunk = np.repeat(np.arange(len(sizes)), sizes)[record]
            yield of_rows(RECORD, [(0, numbers[int(chunk[a])], marks[a:b].tobytes()) for a, b in spans(chunk)])
        release()

    return dealt(records, n).mapInArrow(run, RECORD_DDL).select("chunk", "data")


def covered(size: int, own: Segments, ranks: np.ndarray, marks: list[bytes], width: int) -> np.ndarray:
    """Which bytes of a chunk go."""
    found = np.frombuffer(b"".join(marks), MARKS)
    low = np.searchsorted(own.segment, found["segment"])
    times = np.searchsorted(own.segment, found["segment"], side="right") - low
    of = np.repeat(np.arange(len(found)), times)
    at = np.repeat(low, times) + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    earlier = found["least"][of] < ranks[own.doc[at]]
    of, at = of[earlier], at[earlier]
    start = own.first[at] + found["first"][of]
    depth = np.bincount(start, minlength=size + 1) - np.bincount(start + found["n"][of] + width - 1, minlength=size + 1)
    return np.cumsum(depth[:size]) > 0


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, chunk_bytes: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` with one row a document; ``kept`` are the bytes that stay."""
    if not GRAM + 8 <= width <= 100:
        raise ValueError(f"width must be from {GRAM + 8} to 100")
    spark = docs.sparkSession
    bounded_batches(spark)
    packed = chunks(docs, id_col, text_col, chunk_bytes)
    size = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, -(-int(size) // TASK_BYTES))
    shared = cut(shared_anchors(packed, width, n, hot), "shared")
    forget(spark)
    met = packed.drop("n_bytes").join(shared.hint("merge"), "chunk", "left")
    told = answers(shared_segments(met, width, n), width, n).groupBy("chunk").agg(F.collect_list("data").alias("marks"))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (data, sizes, ranks, told, marks) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                chunk = Chunk(data, sizes, ranks)
                gone = covered(len(chunk.data), Segments(chunk, told, width, n), chunk.ranks, marks, width) if marks else np.zeros(len(chunk.data), bool)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                real = np.flatnonzero(chunk.sizes)
                begins[chunk.starts[real]] = gone[chunk.starts[real]]
                n_spans, n_removed = np.zeros((2, len(chunk.sizes)), np.int64)
                if len(real):
                    n_spans[real] = np.add.reduceat(begins, chunk.starts[real], dtype=np.int64)
                    n_removed[real] = np.add.reduceat(gone, chunk.starts[real], dtype=np.int64)
                left = np.frombuffer(chunk.data, np.uint8)[~gone].tobytes()
                ends = np.cumsum(chunk.sizes - n_removed).tolist()
                kept = [left[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[k].values, pa.array(chunk.sizes), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()),
                ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        release()

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return met.join(told.hint("merge"), "chunk", "left").select("ids", "data", "sizes", "ranks", "shared", "marks").mapInArrow(apply, schema)


def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
