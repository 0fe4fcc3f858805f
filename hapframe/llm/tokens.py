"""Token ids in binary shards with a minimal perfect hash index.

Documents are dealt by ranges of their key, sorted and encoded; every range becomes one shard file:

    ids of all documents, one after another, in 2 or 4 bytes (by the size of the vocabulary)
    starts     u64[n + 1]   first id of each document, in ids
    keys       Arrow IPC    the documents' keys, ascending (null keys first)
    bits       u64[]        the levels of the hash function, one bitmap after another
    ranks      u64[]        set bits before every ``RANK_WORDS`` words of them
    slots      (fingerprint u32, ordinal u32, run u32)[distinct keys]
    footer     JSON with the places of the sections, its length u32, magic

The hash function is built level by level: keys that meet no other in a bitmap of a level set its bit, the rest go to
the next level. The number of set bits below a key's bit is its slot, so the function is minimal and perfect over the shard's keys,
and a key costs one probe a level (1.6 on average at two bits a key). A lookup reads a few words of the bitmaps, one rank, one slot and two starts by their
places, however large the shard is. The slot's fingerprint turns away strangers; the ordinal
leads to the document, ``run`` tells how many documents share the key. A shard is found by its key range in the
manifest, which the driver writes last, so a directory without one is an unfinished write. Files are written under another
name and moved, and encoding is deterministic, so tasks can run again.

Shards are as many as ``spark.sql.shuffle.partitions`` says, or more if one would get more than ``SHARD_BYTES`` of text. Rows of one key may lie in several shards.

Defined results: null text is the empty text (only the end id); null keys come first and aren't in the index; repeated keys
keep all their documents, in an order that their texts give; a text of any length is encoded whole; an empty table gives no shard and no row; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.llm.common import new_path, release, table

MAGIC, END_ID, TOKENIZER = b"HFTOK2\n\0", 1, "word_bpe_49k.json"
RANK_WORDS, SHARD_BYTES = 8, 64 << 20
#: Words kept with their ids in each generation of a Python worker, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 200_000, 40
#: Stands between words encoded in one call, and the number of these.
BETWEEN, JOINED = "\x01", 1000
#: What a tokenizer does before its model if words may be encoded apart.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: A text with one of these is encoded whole: the strings of special tokens, and marks that may compose across a change.
WHOLE = r"<\||\pM"
#: Letters of the Latin, Greek and Cyrillic blocks that neither normalising nor lowering turns into a letter and a mark.
SPLIT_AFTER = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{3B1}-\x{3C9}\x{400}-\x{481}\x{48A}-\x{52F}])([!-/:-@\[-`{-~])"
#: A word of a-z alone; words on which the model must agree with the whole tokenizer.
PLAIN, PROBES = re.compile("[a-z]+").fullmatch, ["a", "of", "the", "together", "qzxjv", "eronenthaor"]
CHUNK_CHARS = 4_000_000
SLOT = np.dtype([("fingerprint", "<u4"), ("ordinal", "<u4"), ("run", "<u4")])
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes too, so that long texts don't make large ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes many texts at once, through their distinct words where the tokenizer is one of those that ``APART`` describes, else whole.

    Such a tokenizer's pieces never cross white space, nor the border between a letter and an ASCII sign after it, so a text's
    ids are those of its words in turn; each distinct word is encoded once and kept. A new word of a-z alone is one piece, so the
    tokenizer's model takes it as it is; other new words are encoded many in one call, with a control character between them whose
    id no other text gives.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.wide = self.model.get_vocab_size() > 65536
        told = json.loads(self.model.to_str())
        self.apart = all(told[k] == v for k, v in APART.items()) and not told["post_processor"] and not told["model"].get("dropout") and not told["truncation"]
        between = self.model.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.pieces = self.model.model
        self.plain = [self._piece(w) for w in PROBES] == self._direct(PROBES)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, word: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.pieces.tokenize(word)])

    def _fresh(self, words: list[str]) -> list[bytes]:
        if not self.plain:
            return self._joined(words)
        other = iter(self._joined([w for w in words if not PLAIN(w)]))
        return [self._piece(w) if PLAIN(w) else next(other) for w in words]

    def _joined(self, words: list[str]) -> list[bytes]:
        if self.between is None:
            return self._direct(words)
        out: list[bytes] = []
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            joined = f" {BETWEEN} ".join(some)
            if joined.count(BETWEEN) != len(some) - 1:
                out += self._direct(some)
                continue
            ids = np.asarray(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends, data = (np.append(np.flatnonzero(ids == self.between), len(ids)) * 4).tolist(), ids.tobytes()
            if len(ends) != len(some):
                raise ValueError("the tokenizer lost a border between words")
            out += [data[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Words seen lately are kept in two generations: when the younger is full, it becomes the older, which is forgotten."""
        out = [self.known.get(w) for w in words]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = self.older.get(words[i])
        fresh = [i for i in missing if out[i] is None]
        for i, ids in zip(fresh, self._fresh([words[i] for i in fresh]), strict=True):
            out[i] = ids
        for i in missing:
            if len(self.known) >= CACHE_WORDS:
                self.known, self.older = {}, self.known
            if len(words[i]) <= CACHE_CHARS:
                self.known[words[i]] = out[i]
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.apart:
            return [np.frombuffer(x, "<u4") for x in self._direct(texts.to_pylist())]
        whole = pc.match_substring_regex(texts, WHOLE)
        plain = pc.if_else(whole, "", texts)
        plain = pc.replace_substring_regex(pc.ascii_lower(plain), SPLIT_AFTER, r"\1 \2")
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        pieces = self._words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        pool, first = np.frombuffer(b"".join(pieces), "<u4"), np.concatenate([[0], np.cumsum(sizes)])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[:-1][codes] - ends[:-1], n) + np.arange(ends[-1])] if len(pool) else np.empty(0, "<u4")
        docs = ends[split.offsets.to_numpy()]
        out = [ids[a:b] for a, b in zip(docs[:-1], docs[1:], strict=True)]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = np.frombuffer(self._direct([texts[i].as_py()])[0], "<u4")
        return out


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over unsigned keys."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(keys: pa.Array, seed: int) -> np.ndarray:
    if pa.types.is_integer(keys.type):
        return mix64(keys.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64), seed)
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(str(k), seed) for k in keys.to_pylist()), np.uint64, len(keys))


class PerfectHash:
    """Minimal perfect hash function over distinct 64-bit key hashes."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.base = np.concatenate([[0], np.cumsum([m // 64 for m in levels])]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, maps, left = [], [], hashes
        while len(left):
            m = (2 * len(left) + 63) // 64 * 64
            at = (mix64(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            maps.append(np.packbits(alone, bitorder="little").view("<u8"))
            levels.append(m)
            left = left[~alone[at]]
        return cls(levels, np.concatenate(maps) if maps else np.empty(0, "<u8"))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that aren't in the set (the others get any slot)."""
        out, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, m in enumerate(self.levels):
            at = (mix64(hashes[todo], level) % np.uint64(m)).astype(np.int64)
            word, bit = self.base[level] + at // 64, (at % 64).astype(np.uint64)
            value = self.bits[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.rank[word] + below)[hit]
            todo = todo[~hit]
        return out


def _ipc(keys: pa.Array) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as writer:
        writer.write_batch(pa.record_batch([keys], ["key"]))
    return sink.getvalue()


class ShardWriter:
    def __init__(self, directory: str, name: str, wide: bool):
        self.fs, self.dir = pafs.FileSystem.from_uri(directory)
        self.name, self.wide = name, wide
        self.tmp = f"{self.dir}/_{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.out, self.sizes, self.keys = self.fs.open_output_stream(self.tmp), [np.zeros(1, np.int64)], []

    def add(self, keys: pa.Array, docs: list[np.ndarray]) -> None:
        self.out.write(np.concatenate([*docs, np.empty(0, "<u4")]).astype("<u4" if self.wide else "<u2").tobytes())
        self.sizes.append(np.fromiter(map(len, docs), np.int64, len(docs)))
        self.keys.append(keys)

    def close(self) -> dict:
        starts = np.cumsum(np.concatenate(self.sizes)).astype("<u8")
        keys = pa.concat_arrays(self.keys)
        n_null = keys.null_count
        known = keys.slice(n_null)
        first = np.flatnonzero(np.concatenate([[True], pc.not_equal(known.slice(1), known.slice(0, len(known) - 1)).to_numpy(zero_copy_only=False)])) if len(known) else np.empty(0, np.int64)
        distinct, seed = known.take(pa.array(first)), 0
        while len(np.unique(hashes := key_hashes(distinct, seed))) < len(hashes):
            seed += 1
        function = PerfectHash.build(hashes)
        slots = np.zeros(len(hashes), SLOT)
        at = function.slots(hashes)
        slots["fingerprint"][at] = mix64(hashes, 999).astype(np.uint32)
        slots["ordinal"][at], slots["run"][at] = first + n_null, np.diff(np.append(first, len(known)))
        place, sections = int(starts[-1]) * (4 if self.wide else 2), {}
        for name, data in (("starts", starts.tobytes()), ("keys", _ipc(keys)), ("bits", function.bits.tobytes()), ("ranks", function.rank[::RANK_WORDS].astype("<u8").tobytes()), ("slots", slots.tobytes())):
            self.out.write(data)
            sections[name] = [place, len(data)]
            place += len(data)
        footer = json.dumps({"wide": self.wide, "n_docs": len(keys), "n_null": n_null, "levels": function.levels, "seed": seed, "sections": sections}).encode()
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()
        self.fs.move(self.tmp, f"{self.dir}/{self.name}")
        return {"name": self.name, "n_docs": len(keys), "n_ids": int(starts[-1]), "first": known[0].as_py() if len(known) else None, "last": known[-1].as_py() if len(known) else None}


class ShardReader:
    """Opens a shard by its footer. ``get`` reads a bounded number of bytes by place; ``find`` takes many keys and reads the index once."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no shard, or not a whole one")
        n = struct.unpack("<I", tail[:4])[0]
        self.meta = json.loads(self.file.read_at(n, size - 12 - n))
        self.type = "<u4" if self.meta["wide"] else "<u2"

    def _section(self, name: str) -> bytes:
        at, n = self.meta["sections"][name]
        return self.file.read_at(n, at)

    def _some(self, name: str, kind, first: int, n: int = 1) -> np.ndarray:
        """Values ``first`` to ``first + n`` of a section, or as many as it has."""
        at, size = self.meta["sections"][name]
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(min(n * width, size - first * width), at + first * width), kind)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self._section("starts"), "<u8").astype(np.int64)

    @cached_property
    def function(self) -> PerfectHash:
        return PerfectHash(self.meta["levels"], np.frombuffer(self._section("bits"), "<u8"))

    @cached_property
    def slots(self) -> np.ndarray:
        return np.frombuffer(self._section("slots"), SLOT)

    def keys(self) -> pa.Array:
        return pa.ipc.open_stream(self._section("keys")).read_all().column(0).combine_chunks()

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First ordinal and number of documents of each key; 0 documents for keys that aren't here."""
        hashes = key_hashes(keys, self.meta["seed"])
        at = self.function.slots(hashes)
        hit = at >= 0
        slot = self.slots[np.where(hit, at, 0)] if len(self.slots) else np.zeros(len(at), SLOT)
        hit &= slot["fingerprint"] == mix64(hashes, 999).astype(np.uint32)
        return np.where(hit, slot["ordinal"], 0).astype(np.int64), np.where(hit, slot["run"], 0).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of the documents with ordinals first..last-1, widened."""
        return self._ids(self.starts[first], self.starts[last])

    def _ids(self, a: int, b: int) -> np.ndarray:
        width = np.dtype(self.type).itemsize
        return np.frombuffer(self.file.read_at(int(b - a) * width, int(a) * width), self.type).astype("<u4")

    def get(self, key) -> list[np.ndarray]:
        """Ids of every document with this key: a few words, a rank and a slot of the index, and the documents' own starts and ids."""
        h, base = key_hashes(pa.array([key]), self.meta["seed"]), 0
        for level, m in enumerate(self.meta["levels"]):
            word, bit = divmod(int(mix64(h, level)[0] % np.uint64(m)), 64)
            word += base
            block = word // RANK_WORDS * RANK_WORDS
            words = self._some("bits", "<u8", block, word - block + 1)
            if int(words[-1]) >> bit & 1:
                slot = int(self._some("ranks", "<u8", block // RANK_WORDS)[0]) + int(np.bitwise_count(words[:-1]).sum()) + (int(words[-1]) & (1 << bit) - 1).bit_count()
                found = self._some("slots", SLOT, slot)[0]
                if found["fingerprint"] != mix64(h, 999).astype(np.uint32)[0]:
                    return []
                starts = self._some("starts", "<u8", int(found["ordinal"]), int(found["run"]) + 1)
                return [self._ids(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            base += m // 64
        return []


def write_shards(docs: DataFrame, directory: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> dict:
    """Encode and write; returns the manifest, which is also written. Holds one row a shard on the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer or vocabulary_path()
    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = Encoder(path)
                writer = ShardWriter(directory, f"shard-{TaskContext.get().partitionId():06d}", encoder.wide)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // CHUNK_CHARS)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                end = np.array([end_id], "<u4")
                writer.add(part.column(0), [np.concatenate([x, end]) for x in encoder.encode(part.column(1))])
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"shard": [json.dumps(writer.close())]})
            del encoder, writer
        release()

    text = F.col(f"`{text_col}`")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // shard_bytes))
    # Rows of one key and text are told apart too, so that none of them must all go to one shard.
    named = docs.select(F.col(f"`{id_col}`").alias("key"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = named.repartitionByRange(n, "key", "tie", "row").sortWithinPartitions("key", "tie", "row").select("key", "text")
    shards = sorted((json.loads(r[0]) for r in dealt.mapInArrow(encode, "shard string").collect()), key=lambda s: s["name"])
    start = 0
    for shard in shards:
        shard["start"] = start
        start += shard["n_ids"]
    manifest = {"shards": shards, "n_ids": start, "end_id": end_id}
    with fs.open_output_stream(f"{root}/_manifest") as out:
        out.write(json.dumps(manifest).encode())
    fs.move(f"{root}/_manifest", f"{root}/manifest.json")
    return manifest


def read_shards(spark: SparkSession, directory: str, key_type: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, each found through the index of its shard."""
    fs, root = pafs.FileSystem.from_uri(directory)
    with fs.open_input_stream(f"{root}/manifest.json") as file:
        shards = json.loads(file.read())["shards"]
    schema = f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    places = [(f"{directory}/{s['name']}", s["start"]) for s in shards]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (i for batch in batches for i in batch.column(0).to_pylist()):
            uri, start = places[k]
            shard = ShardReader(uri)
            keys, n_null = shard.keys(), shard.meta["n_null"]
            known = keys.slice(n_null)
            ordinal, run = shard.find(known)
            if not run.all():
                raise ValueError(f"{uri} lacks keys in its index")
            order = np.arange(len(known))  # repeated keys stand together, so the k-th of a run is k documents on
            ordinal = ordinal + order - np.searchsorted(ordinal, ordinal)
            ordinal = np.concatenate([np.arange(n_null), ordinal])
            for a in range(0, len(keys), 2048):
                some = ordinal[a : a + 2048]
                low, high = int(some.min()), int(some.max()) + 1
                ids, at = shard.ids(low, high), shard.starts[some]
                sizes = shard.starts[some + 1] - at
                offsets = at - shard.starts[low]
                sums = [zlib.crc32(ids[o : o + n].tobytes()) for o, n in zip(offsets, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(a, 2048), pa.array(at + start), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(places), 1, len(places)).mapInArrow(read, schema)


class TokenStore:
    """Keyed access to written shards: the manifest is read once, a shard is found by its key range."""

    def __init__(self, directory: str):
        fs, root = pafs.FileSystem.from_uri(directory)
        with fs.open_input_stream(f"{root}/manifest.json") as file:
            self.shards = [s for s in json.loads(file.read())["shards"] if s["first"] is not None]
        self.directory, self.lasts = directory, [s["last"] for s in self.shards]

    def get(self, key) -> list[np.ndarray]:
        """Ids of every document with this key."""
        out = []
        for s in self.shards[bisect_left(self.lasts, key) :]:
            if s["first"] > key:
                break
            out += ShardReader(f"{self.directory}/{s['name']}").get(key)
        return out


def lookup(directory: str, key) -> list[np.ndarray]:
    return TokenStore(directory).get(key)


def token_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    directory = new_path(spark, "tokens")
    write_shards(docs, directory, id_col=id_col, text_col=text_col)
    return read_shards(spark, directory, docs.schema[id_col].dataType.simpleString())


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
