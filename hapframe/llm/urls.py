r"""URL filters by hashed host-suffix and path-prefix expressions.

A URL is expanded into every (host suffix, path prefix) expression that a rule could name, each expression is
hashed, the expressions meet the rules on a short prefix of the hash, and the full digest then confirms the match.
Of the rules that fit the longest wins.

The expansion is bounded by the rules and not by the URLs: only as many host labels as the longest rule host has, and
only those path lengths that some rule has. URLs are judged once per distinct (host, path), so a URL that fills
a third of the table costs one expansion; verdicts return to the rows by (host, path), those of very frequent ones by a broadcast of at most 10,000.

Defined results: a null URL or one without ``://`` has an empty host and path; no rule fits it and it gets ``default``.
Repeated ids and URLs give one row each; URLs of any length are judged whole. An empty rule table gives ``default`` to all, an empty table an empty
result. Columns of the input other than the id and the URL, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.llm.common import cut, joined, table

#: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest on which expressions and rules are joined.
PREFIX = 8


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict``; rules are (rule_verdict, rule_host, rule_path), rows with a null are ignored.

    Equal length is settled by the longer host, then by ``block``.
    """
    rules = rules.dropna(subset=["rule_verdict", "rule_host", "rule_path"]).distinct()
    shape = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))).first()
    depth, lengths = shape[0] or 0, sorted(shape[1])
    url = F.col(f"`{url_col}`")
    judged = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not lengths:
        return judged.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))),
        lambda k: F.array_join(F.slice(labels, -k, k), "."),
    )
    prefixes = F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths))
    pairs = cut(judged.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    expressions = (
        pairs.select("host", "path")
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(F.array_compact(prefixes)))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, PREFIX))
    )
    known = rules.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    best = (
        expressions.join(known, "short").where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"),
            F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
        )).alias("best"))
    )
    verdicts = cut(pairs.join(best, ["host", "path"], "left"), "verdicts")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return joined(judged, verdicts, ["host", "path"], total).select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
pairs AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, arg_max(struct_pack(rule := h || q, verdict := v), length(h || q)) AS b FROM pairs JOIN r
      ON (host = h OR suffix(host, '.' || h)) AND prefix(path, q) GROUP BY host, path)
SELECT page_id, p.host, p.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
