r"""Quality rules as a short-circuit cascade.

Every document first gets the base measures of its whole text, which are part of the result, and the base verdict. The
further rules form a cascade: on a sample of about ``SAMPLE_ROWS`` documents each rule's cost (seconds beyond those of an empty job,
rounded to a power of four) and selectivity (share rejected) is measured, and rules are ordered by rejections per cost. The cascade
is one CASE expression, so a rule is only evaluated on documents that all earlier ones have let pass. The order decides the cost alone: a
document is kept if no rule rejects it, whatever the order.

``keep_documents`` doesn't return measures, so there the base's own two conditions are rules of the cascade too, and the dear measure of
repeated windows is only taken of documents that all rules before it have let pass.

Repeated windows are found inside the row, without a shuffle. Windows of three words become 64-bit hashes; only if there are
fewer distinct hashes than windows are the repeated hashes looked for. Few repeated hashes are looked up directly; with
many, windows are sorted by hash and compared with their neighbours, so that a long text costs n log n. Windows with equal hashes
are then compared by their words.

Defined results: null text counts as the empty text (all measures 0, rejected by the base); repeated rows and ids give one
row each; texts of any length, also of blanks alone, take time in proportion to n log n; an empty table gives an empty result; other columns, whatever
their names, are ignored by ``measure`` and kept by ``keep_documents``.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.llm.common import NOT_WS, WS, settled, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Up to so many repeated window hashes are looked up one by one.
FEW = 24
#: Expected rows of the sample that orders the rules, runs of each timed job, and seconds under which a cost isn't told from nothing.
SAMPLE_ROWS, RUNS, LEAST_SECONDS = 512, 2, 0.02
REPEATED = "repeated_windows"


def _covered(starts: Column, width: int = 3) -> Column:
    """Number of words in windows that start at these ascending positions."""
    return F.aggregate(
        starts, F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def _with_neighbours(sorted_: str, value: str) -> Column:
    """Members of an array of structs sorted by ``value`` that have an equal neighbour."""
    at = lambda j: F.get(F.col(sorted_), j)[value]
    return F.filter(F.col(sorted_), lambda x, j: (x[value] == at(j - 1)) | (x[value] == at(j + 1)))


def plain_measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The input's columns under ``row``, ``doc_id``, ``text``, ``words`` and all measures but the repeated windows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_WS))
    return settled(
        docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        .withColumn("words", words(F.col("text"))).withColumn("lines", lines)
        .select(
            "row", "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, f"{WS}+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size("lines").cast("long").alias("n_lines"),
        )
    )


def repeats_measured(measured: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` and ``base_failed``; ``words`` are left out."""
    hashes, word = F.col("hashes"), lambda i: F.get(F.col("words"), i)
    repeated = F.array_distinct(F.filter(F.col("ordered"), lambda h, i: (i > 0) & (h == F.get(F.col("ordered"), i - 1))))
    looked_up = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(F.col("repeated"), F.get(hashes, i)))
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    neighbours = F.transform(_with_neighbours("pairs", "h"), lambda x: x["i"])
    texts = F.array_sort(F.transform(F.col("alike"), lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i"))))
    starts = F.array_sort(F.transform(_with_neighbours("texts", "w"), lambda x: x["i"]))
    out = (
        measured.withColumn("hashes", F.when(F.size("words") >= 3, F.transform(
            F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)),
        )).otherwise(F.array().cast("array<bigint>")))
        .withColumn("any", F.size(F.array_distinct("hashes")) < F.size("hashes"))
        .withColumn("ordered", F.when(F.col("any"), F.sort_array("hashes")))
        .withColumn("repeated", F.when(F.col("any"), repeated))
        .withColumn("pairs", F.when(F.size("repeated") > FEW, pairs))
        .withColumn("alike", F.when(F.size("repeated") > FEW, neighbours).when(F.col("any"), looked_up))
        .withColumn("texts", F.when(F.col("any"), texts))
        .withColumn("starts", F.when(F.col("any"), starts).otherwise(F.array().cast("array<int>")))
        .select(*(c for c in measured.columns if c != "words"), _covered(F.col("starts")).cast("long").alias("n_repeat_words"))
        .withColumn("base_failed", few_words() | too_repetitive())
    )
    return settled(out)


def few_words() -> Column:
    return F.col("n_words") < MIN_WORDS


def too_repetitive() -> Column:
    return 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns under ``row`` and the base measures, one row a document."""
    return repeats_measured(plain_measures(docs, id_col, text_col))


def rules() -> dict[str, Column]:
    """Rejecting conditions over the columns of ``plain_measures``; none is null for any row."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "symbols": F.col("n_symbols") > 0.1 * n,
        "duplicate_lines": F.col("n_dup_lines") > 0.3 * F.greatest(F.col("n_lines"), F.lit(1)),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "shouting": F.regexp_count(text, F.lit(r"\p{Lu}")) > 0.5 * F.greatest(F.col("word_chars"), F.lit(1)),
        "exclamations": (F.length(text) - F.length(F.translate(text, "!", ""))) > 0.3 * n,
        "digits": F.regexp_count(text, F.lit("[0-9]")) > 0.3 * F.greatest(F.col("word_chars"), F.lit(1)),
    }


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows, each taken by chance alone; nothing is gathered in one task."""
    n = docs.count()
    return docs if n <= rows else docs.sample(rows / n, seed=11)


def _seconds(frame: DataFrame, reject: Column | None) -> tuple[float, float]:
    """(least seconds of a job, share of rows rejected)."""
    took, share = math.inf, 0.0
    for _ in range(RUNS):
        began = time.perf_counter()
        n, of = frame.agg(F.coalesce(F.sum(reject.cast("int")), F.lit(0)) if reject is not None else F.lit(0), F.count("*")).first()
        took, share = min(took, time.perf_counter() - began), n / max(of, 1)
    return took, share


def order_rules(docs: DataFrame, candidates: dict[str, Column], sample_rows: int = SAMPLE_ROWS, *, base_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Rule names by rejections per cost on a sample of what the base lets pass (of all, without ``base_first``). Only the running time depends on it.

    ``REPEATED`` among the candidates is timed with its measure.
    """
    plain = plain_measures(sample_of(docs, sample_rows), id_col, text_col)
    held = (repeats_measured(plain).where("NOT base_failed") if base_first else plain).drop("row").persist()
    sample = held.coalesce(1)
    _seconds(sample, None)
    empty, _ = _seconds(sample, None)
    worth = {}
    for name, reject in candidates.items():
        took, share = _seconds(repeats_measured(sample) if name == REPEATED else sample, reject)
        cost = 4.0 ** round(math.log(max(took - empty, LEAST_SECONDS), 4))
        worth[name] = (share + 0.01) / cost
    held.unpersist()
    return sorted(worth, key=lambda name: (-worth[name], name))


def verdict(candidates: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(candidates[name], name).otherwise(out)
    return out


def cascade(docs: DataFrame, order: list[str] | None = None, candidates: dict[str, Column] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` and ``rejected_by`` (null: kept), the base first and then the rules in ``order`` (measured if not given)."""
    candidates = rules() if candidates is None else candidates
    order = order_rules(docs, candidates, id_col=id_col, text_col=text_col) if order is None else order
    found = F.when(F.col("base_failed"), "base").otherwise(verdict(candidates, order))
    return measure(docs, id_col=id_col, text_col=text_col).withColumn("rejected_by", found).withColumn("kept", F.col("rejected_by").isNull())


def keep_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their own columns. Rules dearer than the repeated windows come after them, the others before."""
    candidates = {"few_words": few_words(), REPEATED: too_repetitive()} | rules()
    order = order_rules(docs, candidates, base_first=False, id_col=id_col, text_col=text_col)
    at = order.index(REPEATED)
    before = plain_measures(docs, id_col, text_col).where(verdict(candidates, order[:at]).isNull())
    return repeats_measured(before).where(verdict(candidates, order[at:]).isNull()).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
o AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
x AS (SELECT rid, i, a || ' ' || lead(a, 1) OVER v || ' ' || lead(a, 2) OVER v AS g FROM o WINDOW v AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM x WHERE g IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n FROM c, (SELECT unnest([0, 1, 2]) AS o) AS z WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(ls) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * greatest(n_lines, 1) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR len(regexp_extract_all(text, '\p{Lu}')) > 0.5 * greatest(word_chars, 1) OR length(text) - length(replace(text, '!', '')) > 0.3 * n_words
            OR len(regexp_extract_all(text, '[0-9]')) > 0.3 * greatest(word_chars, 1)) AS kept
FROM b
"""
