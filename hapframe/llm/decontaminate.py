"""Benchmark decontamination: BM25 over the test items with block-max WAND, then overlap of question and answer.

The test items are the documents of an inverted index; every passage of the training texts is a query. Passages overlap by half and are
twice as long as the longest item, so every item that a text contains lies wholly in a passage. Scores are
divided by the score of an item against itself, so one threshold fits all items and a passage that contains an item scores 1.
Document frequencies, mean and greatest length are those of the whole test set, however it is taken.

Items stand in the order of the weight that their common terms have together, and are cut into ranges. A range's bound for a passage
is the largest such weight in it plus the largest impacts there of the passage's rarer terms; it comes from differences of running sums, for
all passages at once. Where it stays below the threshold, the range is left out. The others run through block-max WAND: cursors over the postings of
the range, a pivot where the impacts could reach the threshold, and the maxima of the blocks around it to jump ahead. Everything above the
threshold is retrieved.

A retrieved item counts if of the five-word shingles of its question, and of those of its answer, at least 0.8 occur in the text. The
answer is an item's last line; an item of one line is split before its last fifth.

Words are lower-cased and stripped of all but letters and digits; words with none are left out. An index is broadcast and holds items
of about ``BLOCK_BYTES`` of text; a larger test set is taken in so many blocks, one after another, each against all texts. Blocks don't change the results.

Defined results: null and empty texts and items match nothing; items without words are ignored; repeated ids and items give rows of their own; texts of any
length are searched whole; an empty table gives an empty result; other columns, whatever their names, are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hapframe.llm.arrow import word_codes
from hapframe.llm.common import cut, release, table
from hapframe.llm.tokens import bounded_batches

K1, B, BLOCK, SHINGLE = 1.2, 0.75, 32, 5
THRESHOLD, OVERLAP, BLOCK_BYTES = 0.6, 0.8, 8 << 20
#: Ranges of items, and the share of items from which on a term is common.
RANGES, COMMON = 16, 0.02
NOT_WORD = re.compile(r"[\W_]+")


def term(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else NOT_WORD.sub("", word)


def terms(text: str) -> list[str]:
    return [t for w in re.findall(r"[^\x20\x09-\x0D]+", text) if (t := term(w))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    lines = [words for line in text.split("\n") if (words := terms(line))]
    if len(lines) > 1:
        return [w for line in lines[:-1] for w in line], lines[-1]
    words = lines[0] if lines else []
    at = len(words) - max(1, len(words) // 5)
    return (words[:at], words[at:]) if at > 0 else (words, words)


def item_words(parts: tuple[list[str], list[str]]) -> list[str]:
    return parts[0] + parts[1] if parts[0] is not parts[1] else parts[0]


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(SHINGLE, len(ids))
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)} if n else set()


class Corpus:
    """Of a whole test set: number of items with words, their mean and greatest length, and in how many each term is (of some terms at least)."""

    def __init__(self, n: int, mean: float, longest: int, df: dict[str, int]):
        self.n, self.mean, self.longest, self.df = n, mean, longest, df

    @classmethod
    def of(cls, parts: list[list[str]]) -> Corpus:
        return cls(len(parts), sum(map(len, parts)) / max(len(parts), 1), max(map(len, parts), default=1), Counter(w for words in parts for w in set(words)))


class Index:
    """Postings with impacts in [0, 1], blocks of them with their maxima, and each item's shingles. The items are all of the test set unless ``corpus`` tells more."""

    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None):
        kept = [(key, qa) for key, text in items if sum(map(len, qa := question_and_answer(text or "")))]
        parts = [item_words(qa) for _, qa in kept]
        self.keys, self.ids = [key for key, _ in kept], {}
        for words in parts:
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        corpus = Corpus.of(parts) if corpus is None else corpus
        df, all_, mean, n = corpus.df, corpus.n, corpus.mean, len(parts)
        weights = []
        for words in parts:
            tf = Counter(words)
            weight = {w: math.log(1 + (all_ - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for w, f in tf.items()}
            own = sum(weight.values())
            weights.append({w: x / own for w, x in weight.items()})
        common = {w for w in self.ids if df[w] > max(2, COMMON * all_)}
        mass = [sum(x for w, x in weight.items() if w in common) for weight in weights]
        order = sorted(range(n), key=lambda k: (mass[k], k))
        self.keys, kept = [self.keys[k] for k in order], [kept[k] for k in order]
        postings: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        size = -(-n // RANGES) if n else 1
        self.ranges = [(a, min(a + size, n)) for a in range(0, n, size)]
        self.bounds = np.zeros((len(self.ranges), len(self.ids) + 1))  # the last is for words in no item
        self.joint = np.zeros(len(self.ranges))
        for k, was in enumerate(order):
            r = k // size
            self.joint[r] = max(self.joint[r], mass[was])
            for w, x in weights[was].items():
                t = self.ids[w]
                postings[t].append((k, x))
                if w not in common:
                    self.bounds[r, t] = max(self.bounds[r, t], x)
        self.items = [[k for k, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.ends = [[p[min(i + BLOCK, len(p)) - 1][0] for i in range(0, len(p), BLOCK)] for p in postings]
        self.maxima = [[max(x for _, x in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in postings]
        self.upper = [max(x) for x in self.impacts]
        self.longest = corpus.longest
        encode = lambda words: [self.ids[w] for w in words]
        self.parts = [(shingles(encode(q)), shingles(encode(a))) for _, (q, a) in kept]

    def search(self, query: Iterable[int], threshold: float, first: int = 0, end: int | None = None) -> dict[int, float]:
        """Every item from ``first`` up to ``end`` with a score of at least ``threshold``, by block-max WAND."""
        end, found = len(self.keys) if end is None else end, {}

        def forward(cursor: list, item: int) -> None:
            items = self.items[cursor[2]]
            at = cursor[1] = bisect_left(items, item, cursor[1])
            cursor[0] = items[at] if at < len(items) and items[at] < end else end

        cursors = [[-1, 0, t] for t in query]  # item, position, term
        for cursor in cursors:
            forward(cursor, first)
        cursors = [c for c in cursors if c[0] < end]

        while True:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (item, _, t) in enumerate(cursors):
                if item == end:
                    break
                total += self.upper[t]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # Blocks that hold the target: if their maxima don't reach the threshold, nothing up to the first block's end does.
            bound, jump = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for _, at, t in cursors[: pivot + 1]:
                block = at // BLOCK
                ends = self.ends[t]
                while block < len(ends) and ends[block] < target:
                    block += 1
                if block < len(ends):
                    bound += self.maxima[t][block]
                    jump = min(jump, ends[block] + 1)
            if bound < threshold - 1e-12:
                for cursor in cursors[: pivot + 1]:
                    forward(cursor, max(jump, target + 1))
                continue
            if cursors[0][0] == target:
                score = math.fsum(self.impacts[t][at] for _, at, t in cursors[: pivot + 1])
                if score >= threshold:
                    found[target] = score
                for cursor in cursors[: pivot + 1]:
                    forward(cursor, target + 1)
            else:
                for cursor in cursors[:pivot]:
                    if cursor[0] < target:
                        forward(cursor, target)

    def scan(self, texts: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of every contaminated text."""
        codes, offsets, dictionary = word_codes(texts)
        ids = np.full(len(dictionary) + 1, -1, np.int64)
        for k, w in enumerate(dictionary):
            t = term(w)
            ids[k] = self.ids.get(t, -1) if t else -2
        tokens = ids[codes]
        real = tokens != -2
        offsets, tokens = np.concatenate([[0], np.cumsum(real)])[offsets], tokens[real]
        half = self.longest
        n = np.diff(offsets)
        per_text = np.maximum(1, -(-(n - 2 * half) // half) + 1)
        row = np.repeat(np.arange(len(n)), per_text)
        start = offsets[row] + half * (np.arange(len(row)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        stop = np.minimum(start + 2 * half, offsets[row + 1])
        best: dict[tuple[int, int], float] = {}
        for r, (first, end) in enumerate(self.ranges):
            sums = np.concatenate([[0], np.cumsum(self.bounds[r][tokens])])
            for k in np.flatnonzero(sums[stop] - sums[start] >= threshold - self.joint[r] - 1e-9):
                query = np.unique(tokens[start[k] : stop[k]])
                query = query[query >= 0]
                if self.bounds[r][query].sum() < threshold - self.joint[r] - 1e-9:
                    continue
                for item, score in self.search(query.tolist(), threshold, first, end).items():
                    place = (int(row[k]), item)
                    best[place] = max(score, best.get(place, 0.0))
        out, seen = [], (-1, {})
        for (i, item), score in sorted(best.items()):
            own = tokens[offsets[i] : offsets[i + 1]].tolist()
            if seen[0] != i:
                seen = (i, {})

            def has(wanted: set, own: list = own, made: dict = seen[1]) -> float:
                if not wanted:
                    return 1.0
                size = len(next(iter(wanted)))
                if size not in made:
                    made[size] = {tuple(own[j : j + size]) for j in range(len(own) - size + 1)}
                return len(wanted & made[size]) / len(wanted)

            question, answer = map(has, self.parts[item])
            if question >= overlap and answer >= overlap:
                out.append((i, item, score, question, answer))
        return out


def indexes(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    """The test set in indexes of about ``block_bytes`` of text, one at a time. Only a block's items and the counts of its terms reach the driver."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    size = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [item_words(question_and_answer(t or "")) for t in batch.column(1).to_pylist()]
            counts = pa.array(list(map(len, found)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts, pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))], ["k", "t", "block", "n_words", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(own.alias("k"), text.alias("t"), F.floor(F.rand(5) * n).cast("int").alias("block"))
    rows = cut(rows.mapInArrow(describe, f"k {kind}, t string, block int, n_words long, terms array<string>").where("n_words > 0"), "items")
    whole = rows.agg(F.count("*"), F.avg("n_words"), F.max("n_words")).first()
    if not whole[0]:
        return
    counts = cut(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    for b in range(n):
        block = rows.where(F.col("block") == b)
        own_terms = block.select(F.explode("terms").alias("term")).distinct()
        df = dict(map(tuple, (counts.join(own_terms, "term", "left_semi") if n > 1 else counts).collect()))
        held = block.select("k", "t").orderBy("k", "t").collect()
        if held:
            yield Index([tuple(r) for r in held], Corpus(*whole, df))


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every text that contains an item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    key, kind = items.schema[item_id].dataType.simpleString(), to_arrow_type(items.schema[item_id].dataType)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {key}, score double, question_overlap double, answer_overlap double"
    narrow, out, last = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), None, None
    for index in indexes(items, item_id, item_text, block_bytes):
        if last is not None:  # another block follows: this one's rows are written, and its index let go
            part = cut(part, "leaks")
            last.destroy()
            out = part if out is None else out.union(part)
        last = shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    found = shared.value.scan(batch.column(1), threshold, overlap)
                    named = pa.array([shared.value.keys[f[1]] for f in found], kind)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), named, *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
            release()

        part = narrow.mapInArrow(run, schema)
    if last is None:
        return spark.createDataFrame([], schema)
    return part if out is None else out.union(part)


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text contains no item, as they are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at_text, last = docs.columns.index(text_col), None
    for index in indexes(items, item_id, item_text, block_bytes):
        if last is not None:
            docs = cut(docs, "clean")
            last.destroy()
        last = shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    keep = np.ones(batch.num_rows, bool)
                    keep[[f[0] for f in shared.value.scan(batch.column(at_text), threshold, overlap)]] = False
                    yield batch.filter(pa.array(keep))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
