"""Mixing of sources to target weights by weighted sampling without replacement, prefix-summed to word budgets.

Every source has a budget of words: its share of all words by weight, at most ``most`` times what the source has, the
excess dealt to the others by weight (water filling). A budget is met by whole epochs of the source first; the rest is
taken from its documents in the order of their Efraimidis-Spirakis keys ``-ln(u) / quality``, ``u`` being
a hash of the document id. The document in which the budget ends gives only its first words, so a source's taken words
differ from its target by less than one word.

The order within a source is a prefix sum over any number of rows, so it is made in two levels: keys are cut into about sqrt(n) ranges, n being
the number of all documents, a running sum over a source's ranges gives each range its start, and rows are only ordered inside their range. Rows
are dealt by source and range, never by source alone; what is dealt by source is one row a range. The sources themselves, one row each,
are ranked and filled in one task: a source is the name of a corpus, of which there are few.

Defined results: null text and text without words have size 0 and take 0; a null source is a source of its own, last in
order; rows with equal ids are dealt with as documents of their own (equal keys are settled by id, size and a hash of the text); a null quality
is 1, others are held between ``LEAST_QUALITY`` and 1; a text of any length is one document; an empty table gives an empty result; other columns,
whatever their names, are ignored by ``mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hapframe.llm.common import WORD_COUNT_SQL, cut, settled, table, word_count

WEIGHTS, MOST = (5, 2, 1), 3
SYMBOLS, LEAST_QUALITY = "#*$%&|<>", 0.05


def symbol_quality(symbols: Column, size: Column) -> Column:
    """Weight in (0, 1]: words over words plus symbol characters."""
    return F.when(size > 0, F.greatest(size / (size + symbols), F.lit(LEAST_QUALITY))).otherwise(1.0)


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight in steps of 1e-9, so that every engine's logarithm gives the same order."""
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-F.log(u) / weight * 1e9).cast("long")


def targets(by: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``skey, source_size, target`` from ``skey, source_size``. One row a source in one task, never a document."""
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    filled = (
        ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("at", F.col("cap") / F.col("weight"))
        .withColumn("below", F.sum("cap").over(Window.orderBy("at", "skey").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("above", F.sum("weight").over(Window.orderBy("at", "skey").rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        # The level of water if this source and all that fill up later are not full. Where it lies below the source's own mark it holds.
        .withColumn("level", (F.col("total") - F.coalesce("below", F.lit(0.0))) / F.col("above"))
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "skey", "level"))).over(Window.partitionBy()))
    )
    target = F.least("cap", F.coalesce(F.col("water.level") * F.col("weight"), F.col("cap")))
    return filled.select("skey", "source_size", target.alias("target"))


def sized(docs: DataFrame, whole: bool, id_col: str, text_col: str, source_col: str, quality_col: str | None) -> DataFrame:
    """``doc_id, skey, size, key, tie``, and ``row``, the input's columns, if ``whole``."""
    text, own = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    source = F.col(f"`{source_col}`").cast("string")
    named = settled(docs.select(
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []), own.alias("doc_id"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("a"), source)).alias("skey"),
        (F.col(f"`{quality_col}`").cast("double") if quality_col else F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("given"),
    ))
    given = F.least(F.greatest(F.coalesce("given", F.lit(1.0)), F.lit(LEAST_QUALITY)), F.lit(1.0))
    weight = given if quality_col else symbol_quality(F.col("given"), F.col("size"))
    return named.select(*(["row"] if whole else []), "doc_id", "skey", "size", sampling_key(F.col("doc_id"), weight).alias("key"), "tie")


def taken(docs: DataFrame, columns: list[str], id_col: str, text_col: str, source_col: str, quality_col: str | None, weights: tuple[int, ...], most: int) -> DataFrame:
    """``columns`` of ``sized``, and ``source_size, target, taken``."""
    of = id_col, text_col, source_col, quality_col
    base = cut(sized(docs, False, *of), "mix")
    ranges = max(1, math.isqrt(base.count()))
    at = F.floor(F.col("key") / (F.col("key") + 1e9) * ranges).alias("range")
    # Written out, so that the sums are dealt by source and range, and only they by source.
    totals = cut(base.groupBy("skey", at).agg(F.sum("size").alias("in_range")), "ranges")
    start = F.coalesce(F.sum("in_range").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_source = targets(totals.groupBy("skey").agg(F.sum("in_range").alias("source_size")), weights, most)
    places = cut(totals.select("skey", "range", start.alias("start")).join(per_source, "skey"), "places")
    dealt = (sized(docs, True, *of) if "row" in columns else base).select(*columns, "skey", "key", "tie", *({"doc_id", "size"} - set(columns)), at).repartition("skey", "range")
    inside = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - before))
    return dealt.join(places, ["skey", "range"]).select(*columns, "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` with one row a document. ``quality_col`` holds a weight from 0 to 1, such as a classifier's."""
    return taken(docs, ["doc_id", "size"], id_col, text_col, source_col, quality_col, weights, most)


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix with their own columns: whole epochs as repeated rows; a partly taken one is taken whole from half of its words on, else not."""
    found = taken(docs, ["row", "size"], id_col, text_col, source_col, quality_col, weights, most).where("taken > 0")
    times = F.floor(F.col("taken") / F.col("size")) + F.when(2 * (F.col("taken") % F.col("size")) >= F.col("size"), 1).otherwise(0)
    return found.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("copy")).select("row.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, text, {WORD_COUNT_SQL} AS size,
                  coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS sym FROM documents),
k AS (SELECT doc_id, source, size, CAST(floor(-ln((CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0)
             / (CASE WHEN size > 0 THEN greatest(size::DOUBLE / (size + sym), 0.05) ELSE 1.0 END) * 1e9) AS BIGINT) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
o AS (SELECT source, source_size, weight, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total,
             coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
             row_number() OVER (ORDER BY source_size / weight, source) AS pos FROM w),
l AS (SELECT arg_min((total - below) / above, pos) FILTER (WHERE (total - below) / above <= cap / weight) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap))::DOUBLE AS target FROM o, l),
e AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs, round(target - epochs * source_size)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM r
"""
