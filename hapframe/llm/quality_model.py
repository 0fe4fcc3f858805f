"""Quality classifier with hierarchical empirical Bayes over host and path.

1. Document evidence. On a bounded, fixed sample of labelled rows (``TRAIN_ROWS``, those with the least hash of the id) one half gives
   log ratios of hashed words and word shapes, the other half the weights of a logistic regression on a document's mean ratios and
   repetition. Both are tables of fixed size. Every document then gets the model's log odds from its whole text.
2. Site evidence. All documents count: labelled ones by their label, the others by the model's probability at ``SOFT`` of the weight.
   Grouped by host, and by host and path, they give rates; a host's rate is shrunk to the global one and a path's to its
   host's, by prior strengths estimated from the spread of the rates (method of moments). A site of few documents stays near its prior.
3. A document's log odds are its evidence plus what its path's posterior adds to the global rate. What the document itself gave to its host and path is left
   out of both first, so that neither its evidence nor its label counts twice.

Defined results: null and empty texts have the evidence of a text without words; null hosts and paths are sites of their own; repeated rows give one row
each; texts of any length count whole; labels that are null or unknown ids are ignored; without labels of both kinds the evidence is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.llm.arrow import word_codes
from hapframe.llm.common import cut, joined, table
from hapframe.llm.tokens import bounded_batches

TRAIN_ROWS, SOFT, KEEP_AT = 20_000, 0.25, 0.5
WORDS, SHAPES = 1 << 15, 1 << 11
STRENGTH = (2.0, 200.0)
_RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1"))


def shape(word: str) -> str:
    """Letters by case, digits as 0, repeated signs once."""
    out = _RUNS[0][0].sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    return _RUNS[2][0].sub(r"\1", _RUNS[1][0].sub("0", out))


def features(texts: pa.Array, shapes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape bucket of every word, offsets of the texts, and each text's share of repeated words."""
    import xxhash

    codes, offsets, dictionary = word_codes(texts, lower=False)
    word, kind = np.zeros(len(dictionary), np.int64), np.zeros(len(dictionary), np.int64)
    if len(shapes) > 200_000:
        shapes.clear()
    for k, w in enumerate(dictionary):
        if (s := shapes.get(w)) is None:
            s = shapes[w] = xxhash.xxh32_intdigest(shape(w)) % SHAPES * WORDS + xxhash.xxh32_intdigest(w.lower()) % WORDS
        kind[k], word[k] = divmod(s, WORDS)
    repeated = np.array([1 - len(np.unique(codes[a:b])) / (b - a) if b > a else 0.0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    return word[codes], WORDS + kind[codes], offsets, repeated


def dense(texts: pa.Array, ratios: np.ndarray, shapes: dict[str, int]) -> np.ndarray:
    """Mean log ratio of words and of shapes, repetition, its square, and one for the intercept."""
    word, kind, offsets, repeated = features(texts, shapes)
    n = np.maximum(np.diff(offsets), 1)
    mean = lambda at: np.diff(np.concatenate([[0], np.cumsum(ratios[at])])[offsets]) / n
    return np.stack([mean(word), mean(kind), repeated, repeated**2, np.ones(len(n))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, train_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(log ratios by bucket, weights). What reaches the driver is bounded by the tables' sizes and ``train_rows``."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    sample = known.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(train_rows)
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_y", (F.col("_h") % 2 == 0).alias("_first")), "train")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shapes = np.zeros((2, WORDS + SHAPES), np.int64), {}
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            word, kind, offsets, _ = features(batch.column(0), shapes)
            of = np.repeat(y, np.diff(offsets))
            for k in (0, 1):
                sums[k] += np.bincount(np.concatenate([word[of == k], kind[of == k]]), minlength=sums.shape[1])
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["at", "bad", "good"])

    found = rows.where("_first").select("_text", "_y").mapInArrow(count, "at long, bad long, good long").groupBy("at").agg(F.sum("bad"), F.sum("good")).collect()
    sums = np.zeros((2, WORDS + SHAPES))
    for at, bad, good in found:
        sums[:, at] = bad, good
    ratios = np.zeros(WORDS + SHAPES)
    for part in (slice(0, WORDS), slice(WORDS, None)):
        p = (sums[:, part] + 1) / (sums[:, part] + 1).sum(1, keepdims=True)
        ratios[part] = np.log(p[1] / p[0])

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = {}
        for batch in batches:
            x = dense(batch.column(0), ratios, shapes)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    second = rows.where("not _first").select("_text", "_y").mapInArrow(describe, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in second], float)
    if not len(y) or y.min() == y.max():
        return ratios, np.zeros(5)
    return ratios, logistic(np.array([r["x"] for r in second]), y)


def _strength() -> Column:
    """Beta prior strength by moments from ``rate, weight``: p(1 - p) over the spread beyond sampling noise, less one."""
    mean = F.sum(F.col("rate") * F.col("weight")) / F.sum("weight")
    noise = F.avg(F.col("rate") * (1 - F.col("rate")) / F.greatest("weight", F.lit(1.0)))
    spread = F.greatest(F.coalesce(F.var_pop("rate"), F.lit(0.0)) - noise, F.lit(1e-6))
    return F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, evidence, host_rate, path_rate, quality, kept`` with one row a document."""
    bounded_batches(docs.sparkSession)
    ratios, weights = fit(docs, labels, label, id_col, text_col, train_rows)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dense(batch.column(3), ratios, shapes) @ weights)], ["doc_id", "host", "path", "evidence"])

    site = lambda c: F.when(F.col(f"`{c}`").isNull(), "n").otherwise(F.concat(F.lit("a"), F.col(f"`{c}`").cast("string")))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), site(host_col).alias("host"), site(path_col).alias("path"), F.col(f"`{text_col}`").alias("text"))
    scores = cut(narrow.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, host string, path string, evidence double"), "scores")
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    value = cut(scores.join(known, "doc_id", "left").withColumn("w", F.when(F.col("y").isNull(), SOFT).otherwise(1.0)).withColumn("good", F.coalesce("y", p) * F.col("w")).drop("y"), "value")
    paths = cut(value.groupBy("host", "path").agg(F.sum("good").alias("path_good"), F.sum("w").alias("path_w"), F.count("*").alias("n")), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_w").alias("host_w"), F.count("*").alias("n")), "hosts")
    rates = lambda sites, of: sites.select((F.col(f"{of}_good") / F.col(f"{of}_w")).alias("rate"), F.col(f"{of}_w").alias("weight"))
    rate = hosts.agg(F.sum("host_good") / F.sum("host_w")).first()[0]
    m_host, m_path = (rates(sites, of).agg(_strength()).first()[0] for sites, of in ((hosts, "host"), (paths, "path")))
    rate, m_host, m_path = (0.5 if x is None else float(x) for x in (rate, m_host, m_path))
    counts = paths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sites = cut(joined(paths.withColumnRenamed("n", "rows"), hosts, ["host"], counts[0]).withColumnRenamed("rows", "n"), "sites")
    without = lambda of, prior, strength: (strength * prior + F.col(f"{of}_good") - F.col("good")) / (strength + F.col(f"{of}_w") - F.col("w"))
    odds = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.lit(rate))
    return joined(value, sites, ["host", "path"], counts[1]).withColumn("host_rate", without("host", F.lit(rate), m_host)).withColumn("path_rate", without("path", F.col("host_rate"), m_path)).select(
        "doc_id", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("quality"),
    ).withColumn("kept", F.col("quality") >= KEEP_AT)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
