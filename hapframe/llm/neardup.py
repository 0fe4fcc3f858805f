"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

1. Every document becomes the set of its word shingles (64-bit hashes). Documents with equal sets are one node, named by a
   128-bit digest of the set, so thousands of copies cost no more than one. Documents of one node are listed together batch by batch, so a node
   that a third of all documents share is a row a batch wherever rows are dealt by node.
2. A node's MinHash samples give its bands, and folded into a parity bitmap its odd sketch: sample j toggles
   bit hash(j, sample), so equal samples cancel in the XOR of two sketches and the population count tells how many differ.
3. Nodes that share a band meet in a bucket. There a pivot's sketch is XORed with all others at once and those estimated to be
   near join the pivot, until the bucket is one tree or every node has been pivot: a spanning forest, never all pairs. The number of bands and their
   width follow from the similarity, so that a link is missed by all bands with a chance of ``MISS`` at most. Buckets of more than ``most_met``
   nodes first lose nodes in distributed rounds, as in 4, with the population count as the distance.
4. Connected components of these trees are candidate groups. Inside each one the full sets are compared, again by pivots: a pivot's exact
   similarity to all others that aren't linked to it yet. Every pair not yet joined by confirmed links is compared, so
   the components are those of all links. Groups of more than ``TOGETHER`` nodes are cut into blocks, and each two blocks are compared in a task of their
   own. Groups of more than ``most`` nodes or ``MOST_BYTES`` of sets first lose, in distributed rounds, the nodes whose links a pivot
   settles, as long as a round settles a good part: with Jaccard distance, a metric, a node at distance d from the pivot can only link to nodes whose distance lies within
   1 - similarity of d, so of the nodes linked to the pivot only those near an unlinked one's distance must go on.

Defined results: null and word-less texts have no shingles and link with nothing; a text of fewer words than a shingle is one shingle
of its own length; repeated rows and ids give one row each; a null id is never a component's name while another is there; of a
component of null ids alone one row is kept, and every word-less row with a null id; texts of any length give their whole set; an empty table gives an
empty result; other columns, whatever their names, are ignored by ``near_duplicates`` and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.llm.arrow import fixed, groups, word_codes
from hapframe.llm.common import cut, joined, release, table
from hapframe.llm.tokens import bounded_batches, mix64

#: MinHash samples, most of them a band, bits of the odd sketch, and the chance that a link shares no band.
SAMPLES, ROWS, BITS, MISS = 160, 5, 512, 1e-5
#: How far below the threshold an estimate may lie, in its standard deviations.
DEVIATIONS = 5
#: Nodes of a bucket, nodes and bytes of a candidate group beyond which pivots settle what they can in rounds. Keys and bytes that are broadcast.
MOST_MET, MOST, MOST_BYTES = 20_000, 20_000, 64 << 20
#: Nodes of a group that are compared in one task, and of a block of a larger group, whose blocks are compared two by two.
TOGETHER, BLOCK = 1000, 250
FEW_KEYS, FEW_BYTES = 10_000, 32 << 20
CHUNK = 1 << 17


def banding(similarity: float, samples: int = SAMPLES) -> tuple[int, int]:
    """(bands, samples a band): the widest bands that miss a link with a chance of at most MISS."""
    for rows in range(ROWS, 0, -1):
        bands = samples // rows
        if (1 - similarity**rows) ** bands <= MISS:
            return bands, rows
    return samples, 1


def slack(similarity: float, samples: int, bits: int = BITS) -> float:
    """DEVIATIONS of an estimated similarity: those of the samples, and of the sketch by the variance of its population count."""
    differ = 2 * samples * (1 - similarity)
    x = 2 * differ / bits
    spread = max(bits / 4 * (1 - math.exp(-2 * x)) - differ * math.exp(-2 * x), 0.0)
    return DEVIATIONS * math.sqrt(similarity * (1 - similarity) / samples + spread * (math.exp(x) / (2 * samples)) ** 2)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    import xxhash

    codes, offsets, dictionary = word_codes(texts)
    values = np.fromiter((xxhash.xxh64_intdigest(w) for w in dictionary), np.uint64, len(dictionary))[codes] if len(codes) else np.empty(0, np.uint64)
    rolled = mix64(values, width)
    for k in range(1, width):
        rolled = mix64(rolled[: len(values) - k] + values[k:], k) if len(values) > k else rolled[:0]
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = mix64(values[a : a + 1], 1000 + int(b - a))
            for k in range(a + 1, b):
                short = mix64(short + values[k], 1)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(2 * n, dtype=np.uint64), 77)
    return x[:n] | np.uint64(1), x[n:]


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Matrix of the n MinHash samples of each non-empty set."""
    times, plus = _salts(n)
    out = np.empty((len(sets), n), np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    part = np.cumsum(sizes) // CHUNK
    for lo, hi in zip(*(lambda at: (at, np.append(at[1:], len(sets))))(np.flatnonzero(np.diff(part, prepend=-1))), strict=True):
        flat, starts = np.concatenate(sets[lo:hi]), np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]])
        for j in range(n):
            out[lo:hi, j] = np.minimum.reduceat(flat * times[j] + plus[j], starts)
    return out


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    n, k = samples.shape
    at = (mix64(samples + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5) % np.uint64(bits)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * bits + at).ravel(), minlength=n * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little")


def farthest(similarity: float, samples: int, bits: int = BITS) -> int:
    """The largest population count of a XOR that still estimates ``similarity``."""
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity))))


def sketch(docs: DataFrame, width: int, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """``node, n_shingles, bands, odd, members``: the documents of one node in one batch; node, bands and odd are null for empty sets.

    Members are (doc_id, row, key). Where the id is null, ``row`` tells the rows apart and ``key`` finds their text again; else they are null.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"node binary, n_shingles long, bands array<long>, odd binary, members array<struct<doc_id: {kind}, row: bigint, key: string>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(batch.column(1), width)
                names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets]
                order = sorted(range(len(sets)), key=names.__getitem__)
                first = [k for k, i in enumerate(order) if not k or names[i] != names[order[k - 1]]]
                own = [sets[order[k]] for k in first]
                full = [k for k, s in enumerate(own) if len(s)]
                node, keys, odd = ([None] * len(own) for _ in range(3))
                if full:
                    samples = minhashes([own[k] for k in full], bands * rows)
                    banded = np.zeros((len(full), bands), np.uint64)
                    for r in range(rows):
                        banded = mix64(banded + samples[:, r::rows], r)
                    banded = mix64(banded + np.arange(bands, dtype=np.uint64), rows).view(np.int64)
                    for k, b, o in zip(full, banded, odd_sketches(samples), strict=True):
                        node[k], keys[k], odd[k] = names[order[first[k]]], b, o.tobytes()
                members = pa.StructArray.from_arrays([batch.column(c).take(pa.array(order)) for c in (0, 2, 3)], ["doc_id", "row", "key"])
                lists = pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), members)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([len(s) for s in own], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.binary()), lists], ["node", "n_shingles", "bands", "odd", "members"])
        release()

    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keys = F.when(own.isNull(), F.monotonically_increasing_id()).alias("row"), F.when(own.isNull(), text_key(text)).alias("key")
    return cut(docs.select(own.alias("doc_id"), text.alias("text"), *keys).mapInArrow(run, schema), "sketches")


def text_key(text: Column) -> Column:
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


class Forest:
    """Spanning forest over 0..n-1 by pivots; ``near(p)`` marks the nodes that are near p."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def grow(self, near, order: Iterable[int]) -> list[tuple[int, int]]:
        for p in order:
            away = self.label != self.label[p]
            if not away.any():
                break
            hit = np.flatnonzero(near(p) & away)
            if len(hit):
                labels, first = np.unique(self.label[hit], return_index=True)
                self.edges += [(int(p), int(q)) for q in hit[first]]
                self.label[np.isin(self.label, labels)] = self.label[p]
        return self.edges


def _light(frame: DataFrame, few: bool) -> DataFrame:
    """Marked for a broadcast where it is known to be small, so that a large group's rows stay where they are."""
    return F.broadcast(frame) if few else frame


def _rest(told: DataFrame, group: str, near: Column, distance: Column, reach: float | int, few: bool) -> DataFrame:
    """What goes on after a pivot: nodes that aren't near it, and of the near ones those that such a node could be near, by the triangle inequality."""
    nearest = told.where(~near).groupBy(group).agg(F.min(distance).alias("nearest"))
    return told.join(_light(nearest, few), group).where("node <> pivot").where(~near | (distance >= F.col("nearest") - reach))


def _settle_bands(met: DataFrame, limit: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rounds for buckets of more than ``most`` nodes: (what is left, edges found)."""
    found = []

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = np.bitwise_count(fixed(batch.column("odd"), "<u8") ^ fixed(batch.column("of"), "<u8")).sum(1, dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("band", "node", "odd", "pivot")), pa.array(away)], ["band", "node", "odd", "pivot", "away"])

    before = None
    while True:
        large = cut(met.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("node", "odd")).alias("p")).where(F.col("n") > most).select("band", "n", F.col("p.node").alias("pivot"), F.col("p.odd").alias("of")), "hot-bands")
        n, left = large.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n or (before and 4 * left > 3 * before):  # few bytes a node: the rest is one task's work
            return met, found
        few, before, large = n <= FEW_KEYS, left, large.drop("n")
        told = cut(met.join(_light(large, few), "band").mapInArrow(compare, "band long, node binary, odd binary, pivot binary, away long"), "told")
        found.append(told.where(F.col("away") <= limit).where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
        rest = _rest(told, "band", F.col("away") <= limit, F.col("away"), limit, few)
        met = cut(met.join(_light(large.select("band"), few), "band", "left_anti").select("band", "node", "odd").union(rest.select("band", "node", "odd")), "bands")


def candidate_edges(nodes: DataFrame, threshold: float, samples: int, most: int = MOST_MET) -> DataFrame:
    """``a, b``: spanning forests of the buckets, by odd sketches."""
    limit = farthest(threshold - slack(threshold, samples), samples)
    members = nodes.select(F.explode("bands").alias("band"), "node")
    shared = cut(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    met, found = members.join(shared.select("band"), "band").join(nodes.select("node", "odd"), "node").select("band", "node", "odd"), []
    if not shared.where(F.col("n") > most).isEmpty():
        met, found = _settle_bands(cut(met, "met"), limit, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in groups(batches):
            node, odd = group.column(1).to_pylist(), fixed(group.column(2), "<u8")
            for p, q in Forest(len(node)).grow(lambda p, odd=odd: np.bitwise_count(odd ^ odd[p]).sum(1, dtype=np.int64) <= limit, range(len(node))):
                a.append(min(node[p], node[q]))
                b.append(max(node[p], node[q]))
            if len(a) > 20_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    edges = met.repartition("band").sortWithinPartitions("band", "node").mapInArrow(run, "a binary, b binary")
    for more in found:
        edges = edges.union(more)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge list (a, b), root being the component's least node.

    Alternates the large-star and small-star steps; each is an aggregation by node (combined before the shuffle) and a join in which nodes of very many
    edges aren't dealt, and every round is written out.
    """

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.hash("x", "y").cast("long")), F.sum(F.xxhash64("y", "x").cast("decimal(38,0)"))).first())

    def least_of(pairs: DataFrame) -> DataFrame:
        return cut(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")

    now = cut(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "cc")
    before = None
    while (seen := mark(now)) != before:
        before, total = seen, 2 * seen[0]
        both = now.selectExpr("x AS u", "y AS v").union(now.selectExpr("y AS u", "x AS v"))
        least = least_of(both).select("u", F.least("u", "m").alias("m"), "n")
        large = joined(both, least, ["u"], total).where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        down = cut(large, "large").selectExpr("x AS u", "y AS v")
        lowest = least_of(down)
        small = joined(down, lowest, ["u"], total).where("v <> m").selectExpr("v AS x", "m AS y").union(lowest.selectExpr("u AS x", "m AS y")).distinct()
        now = cut(small, "cc")
    return now.selectExpr("x AS node", "y AS root").union(now.selectExpr("y AS node", "y AS root")).distinct()


def _linked(inter: np.ndarray, sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (sizes + size - inter)


def exact_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between these sets. Pivots whose shingles are common in the group come first."""
    flat, sizes = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    distinct, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    central = np.add.reduceat(count[at], starts) / sizes

    def near(p: int) -> np.ndarray:
        flag = np.zeros(len(distinct), np.int32)
        flag[at[starts[p] : starts[p] + sizes[p]]] = 1
        return _linked(np.add.reduceat(flag[at], starts), sizes, int(sizes[p]), percent)

    return Forest(len(sets)).grow(near, np.argsort(-central, kind="stable"))


def _settle(sets: DataFrame, percent: int, most: int, most_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rounds for groups of more than ``most`` nodes, or of more bytes than ``most_bytes``: (what is left, links found)."""
    found, reach = [], 1 - percent / 100 + 1e-9

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, union = [], []
            for s, p in zip(batch.column("shingles").to_pylist(), batch.column("of").to_pylist(), strict=True):
                s, p = np.frombuffer(s, "<u8"), np.frombuffer(p, "<u8")
                inter.append(len(np.intersect1d(s, p, assume_unique=True)))
                union.append(len(s) + len(p) - inter[-1])
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), batch.column("shingles"), batch.column("pivot"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["node", "root", "shingles", "pivot", "inter", "joint"])

    before = None
    while True:
        size = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"), F.min("node").alias("pivot"))
        large = cut(size.where((F.col("n") > most) | ((F.col("bytes") > most_bytes) & (F.col("n") > 1))).select("root", "pivot", "n"), "large")
        left = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not left or (before and 4 * left > 3 * before):  # the rest is for blocks
            return sets, found
        before, large = left, large.drop("n")
        pivots = cut(large.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("of")), "pivot").select("root", "pivot", "of"), "pivots")
        n, size = pivots.agg(F.count("*"), F.sum(F.length("of"))).first()
        few = n <= FEW_KEYS and size <= FEW_BYTES
        told = cut(sets.join(_light(pivots, few), "root").mapInArrow(compare, "node binary, root binary, shingles binary, pivot binary, inter long, joint long"), "told")
        link = F.col("inter") * 100 >= F.col("joint") * percent
        found.append(told.where(link).where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
        rest = _rest(told, "root", link, 1 - F.col("inter") / F.col("joint"), reach, few)
        sets = cut(sets.join(_light(large.select("root"), few), "root", "left_anti").select("node", "root", "shingles").union(rest.select("node", "root", "shingles")), "settled")


def confirmed_edges(docs: DataFrame, nodes: DataFrame, roots: DataFrame, width: int, percent: int, id_col: str, text_col: str, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``a, b``: spanning forest of all links inside the candidate groups, on full sets."""
    wanted = nodes.select("node", "rep").join(roots, "node")
    texts = docs.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").alias("text")).join(wanted.hint("merge"), "rep").select("node", "root", "text")
    nameless = cut(nodes.where("rep IS NULL").select("node", F.col("alone.key").alias("key")).join(roots, "node"), "nameless")
    if not nameless.isEmpty():
        found = docs.where(F.col(id_col).isNull()).select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
        texts = texts.union(found.join(nameless, "key").select("node", "root", "text"))

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                data = [s.tobytes() for s in shingle_sets(batch.column(2), width)]
                same = [xxhash.xxh3_128_digest(d) == n for d, n in zip(data, batch.column(0).to_pylist(), strict=True)]  # another row may share the id
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["node", "root", "shingles"]).filter(pa.array(same, pa.bool_()))

    sets = cut(texts.mapInArrow(full, "node binary, root binary, shingles binary").dropDuplicates(["node"]), "sets")
    sets, found = _settle(sets, percent, most, most_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            if group.num_rows < 2:
                continue
            node = group.column(0).to_pylist()
            edges = exact_forest([np.frombuffer(s, "<u8") for s in group.column(2).to_pylist()], percent)
            yield pa.RecordBatch.from_pydict({"a": pa.array([node[p] for p, _ in edges], pa.binary()), "b": pa.array([node[q] for _, q in edges], pa.binary())})

    counted = cut(sets.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER), "crowds")
    n = counted.count()
    crowds = _light(counted, n <= FEW_KEYS)
    plain = sets if not n else sets.join(crowds.select("root"), "root", "left_anti").select("node", "root", "shingles")
    edges = plain.repartition("root").sortWithinPartitions("root", "node").mapInArrow(run, "a binary, b binary")
    if n:
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        placed = sets.join(crowds, "root").select("node", "root", "shingles", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        low, high, tasks = F.least("own", "other"), F.greatest("own", "other"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        name = F.concat("root", F.concat_ws("-", low.cast("string"), high.cast("string")).cast("binary"))
        task = F.pmod(F.pmod(F.xxhash64("root"), F.lit(tasks)) + low.cast("long") * blocks + high, F.lit(tasks)).cast("int")  # pairs of one group in different tasks
        paired = placed.select("node", name.alias("root"), "shingles", task.alias("task")).repartitionById(tasks, F.col("task")).sortWithinPartitions("root", "node")
        edges = edges.union(paired.select("node", "root", "shingles").mapInArrow(run, "a binary, b binary"))
    for more in found:
        edges = edges.union(more)
    return edges


def decided(docs: DataFrame, *, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, most_bytes: int = MOST_BYTES, most_met: int = MOST_MET) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, key``."""
    bands, rows = banding(percent / 100)
    sketches = sketch(docs, width, id_col, text_col, bands, rows)
    least_id = F.array_min(F.transform("members", lambda m: m["doc_id"]))
    alone = F.array_min(F.transform(F.filter("members", lambda m: m["row"].isNotNull()), lambda m: F.struct(m["row"].alias("row"), m["key"].alias("key"))))
    nodes = cut(sketches.where("node IS NOT NULL").groupBy("node").agg(
        F.min(least_id).alias("rep"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.min(alone).alias("alone"), F.count("*").alias("n"),
    ), "nodes")
    roots = components(candidate_edges(nodes, percent / 100, bands * rows, most_met))
    linked = components(confirmed_edges(docs, nodes, cut(roots, "roots"), width, percent, id_col, text_col, most, most_bytes))
    named = cut(nodes.select("node", "rep", "alone.row").join(linked, "node"), "named")
    least = cut(named.groupBy("root").agg(F.min("rep").alias("least"), F.min("row").alias("least_row"), F.count("*").alias("n")), "least")
    found = joined(named.select("node", "root"), least, ["root"], named.count()).select("node", "least", "least_row")
    of_node = cut(nodes.select("node", "rep", "alone.row", "n").join(found, "node", "left").select(
        "node", "n", F.coalesce("least", "rep").alias("of_node"), F.coalesce("least_row", "row").alias("of_row"),
    ), "of-node")
    component = F.coalesce("of_node", "doc_id")
    own = component.isNull() & (F.col("node").isNull() | (F.col("row") == F.col("of_row")))
    parts = sketches.select("n_shingles", "node", "members")
    with_words = joined(parts.where("node IS NOT NULL"), of_node, ["node"], of_node.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    without = parts.where("node IS NULL").select("*", F.lit(None).cast(docs.schema[id_col].dataType).alias("of_node"), F.lit(None).cast("long").alias("of_row"))
    return with_words.unionByName(without).select("n_shingles", "node", "of_node", "of_row", F.inline("members")).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce((F.col("doc_id") == component) | own, F.lit(False)).alias("kept"), "key",
    )


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, most_bytes: int = MOST_BYTES, most_met: int = MOST_MET) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``; documents link at 100 * |intersection| >= percent * |union|."""
    return decided(docs, width=width, percent=percent, id_col=id_col, text_col=text_col, most=most, most_bytes=most_bytes, most_met=most_met).drop("key")


def keep_one_of_each(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that name their component, with their own columns; whole repeated rows are reduced to one. Of components of null ids, one."""
    kept = decided(docs, width=width, percent=percent).where("kept").groupBy("doc_id", "key", (F.col("n_shingles") == 0).alias("empty")).agg(F.count("*").alias("n"))
    kept = cut(kept, "kept")
    named = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum("n").alias("n"))
    out = docs.join(named.select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    out = out if named.where("n > 1").isEmpty() else out.dropDuplicates()
    nameless = kept.where("doc_id IS NULL").select(F.col("key").alias("_key"), "empty")
    if nameless.isEmpty():
        return out
    found = docs.where("doc_id IS NULL").withColumn("_key", text_key(F.col("text")))
    full = found.join(nameless.where("NOT empty"), "_key", "left_semi").dropDuplicates(["_key"])
    return out.union(full.select(docs.columns)).union(found.join(nameless.where("empty"), "_key", "left_semi").select(docs.columns))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
