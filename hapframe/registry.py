"""All queries of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.functions import alleles as codes
from hapframe.operators import cohort, entropy, ewah, pbwt, route
from hapframe.schema import BLOCK_SITES
from hapframe.sources import archive, bcf, coded, synthetic, vcf
from hapframe.sources.fixtures import duckdb_text, matrix
from hapframe.sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Of a query the fixture and the function of its matrix.
MAKES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Sites a block in the queries; the SQL's sort keys grow with it.
BLOCK = 16


def query(name: str, fixture: str, sql: str | None):
    """Registers a function of a fixture's matrix. In the SQL the fixture is ``m``; STATS, ORDER and WORDS are views over it."""

    def put(make: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(matrix(spark, sf_dir, fixture))
        MAKES[name] = fixture, make
        if sql is not None:
            ORACLE_SQL[name] = f"WITH m AS MATERIALIZED ({duckdb_text(fixture)}),\n{VIEWS}\n{sql}"
        return make

    return put


def _pbwt_view(name: str, block: str, lane: str) -> str:
    return f"""{name}_key AS (
  SELECT a.site_id, a.hap, a.allele, s.archetype, s.group_id, {block} AS blk, {lane} AS lane,
         coalesce(reverse(string_agg(CASE WHEN s.archetype = '2mc' AND s.ac < 10 THEN '' ELSE substr('0123456789abcdef', a.allele + 1, 1) END, '')
           OVER (PARTITION BY {block}, s.group_id, s.archetype, a.hap ORDER BY a.site_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS k
  FROM m a JOIN stats s ON a.site_id = s.site_id),
{name} AS (SELECT site_id, hap, allele, archetype, lane, CAST(row_number() OVER (PARTITION BY site_id, lane ORDER BY k, hap) - 1 AS INT) AS pos FROM {name}_key)"""


VIEWS = f"""raw AS (
  SELECT site_id, max(ploidy) AS ploidy, max(n_allele) AS n_allele, count(*) AS n, CAST(sum(CASE WHEN allele = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ac,
         CAST(sum(CASE WHEN allele = 14 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(sum(CASE WHEN allele = 15 THEN 1 ELSE 0 END) AS BIGINT) AS n_eov,
         CAST(max(allele) + 1 AS INT) AS observed FROM m GROUP BY site_id),
typed AS (SELECT *, CASE WHEN n_allele <= 2 AND n_missing = 0 AND n_eov = 0 THEN '2mc' ELSE 'nm' END AS archetype, CAST(floor(site_id / {BLOCK}) AS INT) AS block_id FROM raw),
firsts AS (SELECT n AS gn, ploidy AS gp, CAST(row_number() OVER (ORDER BY min(site_id)) - 1 AS INT) AS group_id FROM typed GROUP BY n, ploidy),
stats AS (SELECT typed.*, group_id, archetype = '2mc' AND ac < 10 AS rare FROM typed JOIN firsts ON n = gn AND ploidy = gp),
{_pbwt_view("ord", f"CAST(floor(a.site_id / {BLOCK}) AS INT)", "0")},
w1 AS (SELECT site_id, CAST(floor(hap / 32) AS INT) AS word_idx, bit_or(CASE WHEN allele <> 0 THEN CAST(1 AS BIGINT) << CAST(hap % 32 AS INT) ELSE 0 END) AS word FROM m GROUP BY 1, 2),
w4 AS (SELECT site_id, CAST(floor(hap / 8) AS INT) AS word_idx, bit_or(CAST(allele AS BIGINT) << CAST(4 * (hap % 8) AS INT)) AS word FROM m GROUP BY 1, 2),
p1 AS (SELECT site_id, CAST(floor(pos / 32) AS INT) AS word_idx, bit_or(CASE WHEN allele <> 0 THEN CAST(1 AS BIGINT) << CAST(pos % 32 AS INT) ELSE 0 END) AS word FROM ord GROUP BY 1, 2),
p4 AS (SELECT site_id, CAST(floor(pos / 8) AS INT) AS word_idx, bit_or(CAST(allele AS BIGINT) << CAST(4 * (pos % 8) AS INT)) AS word FROM ord GROUP BY 1, 2)"""


def _clean(bits: int) -> str:
    if bits == 1:
        return "CASE WHEN word = 0 THEN 0 WHEN word = 4294967295 THEN 1 END"
    return "CASE WHEN word = (word % 16) * 286331153 THEN CAST(word % 16 AS INT) END"


def _markers(view: str, bits: int) -> str:
    return f""", c AS (SELECT *, {_clean(bits)} AS c FROM {view}),
l AS (SELECT *, lag(c) OVER (PARTITION BY site_id ORDER BY word_idx) AS p FROM c),
k AS (SELECT *, CAST(sum(CASE WHEN c IS NOT NULL AND word_idx > 0 AND (p IS NULL OR p <> c) THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY word_idx) AS INT) AS marker_idx FROM l),
mk AS (SELECT site_id, marker_idx, coalesce(max(c), 0) AS ref, CAST(count(c) AS INT) AS clean, CAST(count(*) - count(c) AS INT) AS dirty,
       coalesce(string_agg(CASE WHEN c IS NULL THEN CAST(word AS VARCHAR) END, ',' ORDER BY word_idx), '') AS words FROM k GROUP BY site_id, marker_idx)"""


def _listed(marked: DataFrame) -> DataFrame:
    return marked.withColumn("words", F.array_join(F.transform("words", lambda w: w.cast("string")), ","))


def _segments(view: str, bits: int) -> str:
    least = 2 if bits == 1 else 1
    return f""", c AS (SELECT *, coalesce({_clean(bits)}, -1) AS c FROM {view}),
r AS (SELECT *, word_idx - row_number() OVER (PARTITION BY site_id, c ORDER BY word_idx) AS isle FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY site_id, c, isle) AS n FROM r),
k AS (SELECT *, CASE WHEN c >= 0 AND n >= {least} THEN c ELSE -1 END AS k FROM n),
j AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY site_id ORDER BY word_idx) = k THEN 0 ELSE 1 END AS new FROM k),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY site_id ORDER BY word_idx) - 1 AS INT) AS segment_idx FROM j)
SELECT site_id, segment_idx, CASE WHEN max(k) >= 0 THEN 'run' ELSE 'literal' END AS kind, CASE WHEN max(k) >= 0 THEN max(k) END AS ref, CAST(count(*) AS INT) AS n_words
FROM s GROUP BY site_id, segment_idx"""


# Scans, recoding, statistics.
query("scan_bytes", "g1", "SELECT count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum(2 * n - 1) AS BIGINT) AS n_vcf_bytes, CAST(sum(2 * n - 1) AS DOUBLE) / sum(n) AS ratio FROM stats")(
    lambda m: route.site_stats(m).agg(F.count("*").alias("n_sites"), F.sum("n").alias("n_bytes"), F.sum(2 * F.col("n") - 1).alias("n_vcf_bytes"), (F.sum(2 * F.col("n") - 1).cast("double") / F.sum("n")).alias("ratio")))
_BYTE = "CASE WHEN allele = 14 THEN 1 WHEN allele = 15 THEN 129 ELSE (allele + 1) * 2 + 1 END"
query("to_bcf", "g2", f"SELECT site_id, hap, {_BYTE} AS byte FROM m")(lambda m: m.select("site_id", "hap", codes.to_bcf(F.col("allele")).alias("byte")))
query("recode_bcf_biallelic", "g2", "SELECT site_id, hap, CASE allele WHEN 14 THEN 2 WHEN 15 THEN 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END AS code FROM m")(
    lambda m: m.select("site_id", "hap", codes.from_bcf_biallelic(codes.to_bcf(F.col("allele"))).alias("code")))
query("recode_bcf_general", "g2", "SELECT site_id, hap, allele FROM m")(lambda m: m.select("site_id", "hap", codes.from_bcf_general(codes.to_bcf(F.col("allele"))).alias("allele")))
query("allele_histogram", "g2", "SELECT site_id, allele, count(*) AS n FROM m GROUP BY site_id, allele")(lambda m: m.groupBy("site_id", "allele").agg(F.count("*").alias("n")))
query("site_ac_an", "g1", "SELECT site_id, n, ac, n - n_missing - n_eov AS an, archetype FROM stats")(
    lambda m: route.site_stats(m).select("site_id", "n", "ac", (F.col("n") - F.col("n_missing") - F.col("n_eov")).alias("an"), "archetype"))
query("n_allele_observed", "g4", "SELECT site_id, observed FROM stats")(lambda m: route.site_stats(m).select("site_id", "observed"))
query("valid_sites", "g4", "SELECT site_id, n, ploidy FROM stats WHERE n % ploidy = 0")(lambda m: route.valid(route.site_stats(m)).select("site_id", "n", "ploidy"))
# Routing.
query("block_assign", "g1", "SELECT DISTINCT site_id, block_id FROM stats")(lambda m: route.blocks(m.select("site_id").distinct(), BLOCK))
query("group_route", "g4", "SELECT site_id, group_id FROM stats")(lambda m: route.groups(route.site_stats(m)).select("site_id", "group_id"))
query("archetype_route", "g4", "SELECT site_id, group_id, archetype FROM stats")(lambda m: route.groups(route.site_stats(m)).select("site_id", "group_id", "archetype"))
query("rare_flag", "g3", "SELECT site_id, ac, rare FROM stats")(lambda m: route.routed(route.site_stats(m), BLOCK).select("site_id", "ac", "rare"))
query("model_counts", "g4", "SELECT block_id, group_id, archetype, count(*) AS n_variants FROM stats GROUP BY block_id, group_id, archetype")(
    lambda m: route.routed(route.site_stats(m), BLOCK).groupBy("block_id", "group_id", "archetype").agg(F.count("*").alias("n_variants")))
query("nonref_positions", "g3", "SELECT site_id, hap, allele FROM m WHERE allele <> 0")(lambda m: m.where("allele <> 0").select("site_id", "hap", "allele"))
# Positional order.
_PBWT = "SELECT site_id, pos, allele FROM ord"
for _name, _fixture in (("pbwt_order_2mc", "g1"), ("pbwt_order_nm", "g2"), ("pbwt_rare", "g3"), ("pbwt_mixed", "g4")):
    query(_name, _fixture, _PBWT)(lambda m: _permuted(m))
query("pbwt_no_reset", "g3", f", {_pbwt_view('nr', '0', '0')} SELECT site_id, pos, allele FROM nr")(
    lambda m: _permuted(m, reset=False))
query("pbwt_strided", "g2", f", {_pbwt_view('st', f'CAST(floor(a.site_id / {BLOCK}) AS INT)', 'a.hap % 2')} SELECT site_id, CAST(pos * 2 + lane AS INT) AS pos, allele FROM st")(
    lambda m: _permuted(m, stride=2))
for _name, _fixture in (("unpermute_2mc", "g1"), ("unpermute_nm", "g2"), ("unpermute_rare", "g3")):
    query(_name, _fixture, "SELECT site_id, hap, allele FROM m")(lambda m: pbwt.explode_vectors(pbwt.restore(pbwt.permute(route.site_vectors(m, BLOCK))).select("site_id", "gt")))


def _permuted(m: DataFrame, **of) -> DataFrame:
    """``site_id, pos, allele``; a site's other columns don't become a value of each allele."""
    return pbwt.explode_vectors(pbwt.permute(route.site_vectors(m, BLOCK), **of).select("site_id", "gt"), "pos")


# Words and markers.
query("pack_2mc", "g1", "SELECT site_id, word_idx, word FROM w1")(lambda m: ewah.pack(m, 1))
query("pack_nm", "g2", "SELECT site_id, word_idx, word FROM w4")(lambda m: ewah.pack(m, 4))
query("ewah_2mc", "g3", f"{_markers('w1', 1)} SELECT * FROM mk")(lambda m: _listed(ewah.markers(ewah.pack(m, 1), 1)))
query("ewah_nm", "g2", f"{_markers('w4', 4)} SELECT * FROM mk")(lambda m: _listed(ewah.markers(ewah.pack(m, 4), 4)))
query("ewah_2mc_pbwt", "g3", f"{_markers('p1', 1)} SELECT * FROM mk")(lambda m: _listed(ewah.markers(ewah.pack(_permuted(m), 1, "pos"), 1)))
query("ewah_nm_pbwt", "g2", f"{_markers('p4', 4)} SELECT * FROM mk")(lambda m: _listed(ewah.markers(ewah.pack(_permuted(m), 4, "pos"), 4)))
query("ctx_segments_2mc", "g3", _segments("w1", 1))(lambda m: ewah.segments(ewah.pack(m, 1), 1))
query("ctx_segments_nm", "g2", _segments("w4", 4))(lambda m: ewah.segments(ewah.pack(m, 4), 4))
query("ewah_popcount", "g3", "SELECT site_id, ac, CAST(ceil(n / 32.0) * 32 AS BIGINT) AS n_padded FROM stats")(lambda m: ewah.ones(ewah.markers(ewah.pack(m, 1), 1)))
query("ewah_hist_nm", "g2", """, h AS (SELECT site_id, allele, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT site_id, 0, CAST(ceil(n / 8.0) * 8 AS BIGINT) - n FROM stats)
SELECT site_id, allele, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY site_id, allele HAVING sum(n) > 0""")(lambda m: ewah.histogram_nm(ewah.markers(ewah.pack(m, 4), 4)))
query("ewah_coverage", "g1", f"{_markers('w1', 1)} SELECT site_id, CAST(sum(clean + dirty) * 32 AS BIGINT) AS n_covered, count(*) AS n_markers FROM mk GROUP BY site_id")(
    lambda m: ewah.coverage(ewah.markers(ewah.pack(m, 1), 1), 1))
query("encoded_bytes", "g3", f"{_markers('p1', 1)} SELECT site_id, CAST(8 * count(*) + 4 * sum(dirty) AS BIGINT) AS n_bytes FROM mk GROUP BY site_id")(
    lambda m: ewah.encoded_bytes(ewah.markers(ewah.pack(_permuted(m), 1, "pos"), 1)))
# Archive and decoding.
for _name, _fixture, _use in (("decode_alleles", "g4", True), ("decode_nopbwt", "g4", False), ("decode_rare", "g3", True)):
    query(_name, _fixture, "SELECT site_id, hap, allele FROM m")(lambda m, use=_use: archive.decode(_stored(m, use), use_pbwt=use))
query("decode_raw", "g4", _PBWT)(lambda m: archive.stored_vectors(_stored(m)))
query("archive_sizes", "g3", f"{_markers('p1', 1)}, b AS (SELECT site_id, CAST(8 * count(*) + 4 * sum(dirty) AS BIGINT) AS n_bytes FROM mk GROUP BY site_id)\n"
      "SELECT b.site_id, n_bytes, CAST(sum(n_bytes) OVER (PARTITION BY block_id ORDER BY b.site_id) AS BIGINT) AS in_flight FROM b JOIN stats ON b.site_id = stats.site_id")(
    lambda m: archive.sizes(archive.encode(m, block_size=BLOCK)))


def _stored(m: DataFrame, use_pbwt: bool = True, block_size: int = BLOCK, reset: bool = True, **of) -> DataFrame:
    path = scratch(m.sparkSession, "archive")
    archive.write(archive.encode(m, block_size=block_size, use_pbwt=use_pbwt, reset=reset), path)
    return archive.read(m.sparkSession, path, **of)


query("archive_roundtrip", "g4", "SELECT site_id, hap, allele FROM m")(lambda m: archive.decode(_stored(m)))
query("archive_no_reset", "g3", "SELECT site_id, hap, allele FROM m")(lambda m: archive.decode(_stored(m, reset=False), reset=False))
query("archive_whole_blocks", "g4", "SELECT site_id, hap, allele FROM m")(lambda m: archive.decode(_stored(m, block_size=BLOCK_SITES)))
_TURNED = "array_to_string(list_reverse(regexp_extract_all(printf('%0{}x', {}), '..')), '')"
query("raw_stream", "g3", f"""{_markers('p1', 1)}, w AS (SELECT site_id, marker_idx, coalesce(string_agg(CASE WHEN c IS NULL THEN {_TURNED.format(8, 'word')} END, '' ORDER BY word_idx), '') AS words FROM k GROUP BY 1, 2)
SELECT mk.site_id, string_agg({_TURNED.format(16, 'CAST(ref AS BIGINT) + (CAST(clean AS BIGINT) << 4) + (CAST(dirty AS BIGINT) << 34)')} || w.words, '' ORDER BY mk.marker_idx) AS stream
FROM mk JOIN w ON mk.site_id = w.site_id AND mk.marker_idx = w.marker_idx GROUP BY mk.site_id""")(
    lambda m: archive.flat(archive.encode(m, block_size=BLOCK)).select("site_id", F.lower(F.hex("stream")).alias("stream")))
query("archive_fold", "g3", f"""{_markers('p1', 1)}, b AS (SELECT site_id, CAST(8 * count(*) + 4 * sum(dirty) AS BIGINT) AS n_bytes FROM mk GROUP BY site_id)
SELECT block_id, CAST(sum(n) AS BIGINT) AS n_in, CAST(sum(n_bytes) AS BIGINT) AS n_out, CAST(sum(n) AS DOUBLE) / sum(n_bytes) AS fold FROM b JOIN stats ON b.site_id = stats.site_id GROUP BY block_id""")(
    lambda m: archive.folds(archive.encode(m, block_size=BLOCK)))
query("pbwt_order_text", "g4", """, o AS (SELECT a.site_id, string_agg(CAST(a.hap AS VARCHAR), ',' ORDER BY a.pos) AS "order" FROM ord a GROUP BY a.site_id) SELECT site_id, "order" FROM o""")(
    lambda m: pbwt.order_texts(route.site_vectors(m, BLOCK)))
query("random_access_site", "g1", "SELECT site_id, pos, allele FROM ord WHERE site_id = 37")(lambda m: archive.stored_vectors(_stored(m, block=37 // BLOCK, site=37)))
# VCF.
_SYMBOL = "CASE WHEN allele = 14 THEN '.' WHEN allele = 15 THEN NULL ELSE CAST(allele AS VARCHAR) END"
_VCF = f"""SELECT site_id, string_agg(gt, chr(9) ORDER BY sample) AS line FROM (
SELECT site_id, CAST(floor(hap / ploidy) AS INT) AS sample, coalesce(string_agg({_SYMBOL}, '|' ORDER BY hap), '') AS gt FROM m GROUP BY 1, 2) GROUP BY site_id"""
query("to_vcf", "g2", _VCF)(vcf.to_vcf)
for _name, _fixture in (("archive_to_vcf", "g4"), ("archive_to_vcf_nm", "g2")):
    query(_name, _fixture, _VCF)(lambda m: vcf.vectors_to_vcf(archive.decode_vectors(archive.encode(m, block_size=BLOCK))))
query("model_archive_to_vcf", "g2", _VCF)(lambda m: vcf.vectors_to_vcf(coded.decode_vectors(coded.encode(m, block_size=BLOCK))))
query("to_vcf_debug", "g1", f"SELECT site_id, line || chr(9) AS line FROM ({_VCF})")(vcf.to_vcf_debug)
query("vcf_parse_roundtrip", "g4", "SELECT site_id, CAST(floor(hap / ploidy) AS INT) AS sample, CAST(hap % ploidy AS INT) AS slot, allele FROM m WHERE allele <> 15")(lambda m: vcf.from_lines(vcf.to_vcf(m)))
_MATRIX = "SELECT site_id, hap, ploidy, n_allele, allele FROM m"


def _vcf_read(m: DataFrame) -> DataFrame:
    path = scratch(m.sparkSession, "vcf")
    vcf.write_records(m, path)
    return vcf.renumbered(vcf.read_alleles(m.sparkSession, path), vcf.read_positions(m.sparkSession, path))


def _bcf_read(m: DataFrame) -> DataFrame:
    path = scratch(m.sparkSession, "bcf")
    bcf.write_bcf(route.site_vectors(m, BLOCK), path)
    return bcf.read_bcf(m.sparkSession, f"{path}/*.bcf").select((F.col("pos") - 1).cast("int").alias("site_id"), "hap", "ploidy", "n_allele", "allele")


def _vcf_vectors(m: DataFrame) -> DataFrame:
    path = scratch(m.sparkSession, "vcf")
    vcf.write_records(m, path)
    sites = vcf.read_sites(m.sparkSession, path, BLOCK).select("site_id", "ploidy", "n_allele", "gt")
    return vcf.renumbered(pbwt.explode_vectors(sites), vcf.read_positions(m.sparkSession, path))


query("vcf_read", "g4", _MATRIX)(_vcf_read)
query("vcf_read_vectors", "g4", _MATRIX)(_vcf_vectors)
query("vcf_samples", "g2", "SELECT CAST(floor(hap / ploidy) AS INT) AS sample, 's' || CAST(floor(hap / ploidy) AS INT) AS name FROM m WHERE site_id = (SELECT min(site_id) FROM m) GROUP BY 1, 2")(lambda m: _header(m))
query("bcf_read", "g4", _MATRIX)(_bcf_read)


def _header(m: DataFrame) -> DataFrame:
    path = scratch(m.sparkSession, "vcf")
    vcf.write_records(m, path)
    return vcf.read_samples(m.sparkSession, path)


# Cohorts.
query("merge_cohorts", "g1", ", s AS (SELECT site_id FROM m GROUP BY site_id HAVING min(hap) < 100 AND max(hap) >= 100) SELECT m.site_id, hap, allele FROM m JOIN s ON m.site_id = s.site_id")(
    lambda m: cohort.merge(m.where("hap < 100"), m.where("hap >= 100").withColumn("hap", F.col("hap") - 100)).select("site_id", "hap", "allele"))
_BITMAP = "SELECT hap, CAST(floor(site_id / 32) AS INT) AS word_idx, bit_or(CASE WHEN allele <> 0 THEN CAST(1 AS BIGINT) << CAST(site_id % 32 AS INT) ELSE 0 END) AS word FROM m{} GROUP BY 1, 2"
query("hap_bitmap", "g3", _BITMAP.format(""))(cohort.bitmaps)
query("hap_bitmap_of_one", "g3", _BITMAP.format(" WHERE hap = 7"))(lambda m: cohort.bitmap_of(cohort.bitmaps(m), 7))
# Random sites.
QUERIES["random_sites"] = lambda spark, sf_dir: synthetic.random_sites(spark, 200, 2000, most=60).select("site_id", "hap", "allele")
ORACLE_SQL["random_sites"] = synthetic.duckdb_text(200, 2000, most=60)
QUERIES["random_archive"] = lambda spark, sf_dir: archive.decode(archive.encode_sites(synthetic.random_vectors(spark, 200, 2000, most=60, block_size=64))).where("allele <> 0")
ORACLE_SQL["random_archive"] = synthetic.duckdb_text(200, 2000, most=60)


# Entropy coding: the decoded streams are the input.
KEYS = ["block_id", "group_id", "archetype"]


def _coded(m: DataFrame, code=entropy.encode, read=entropy.decode) -> DataFrame:
    vectors = route.site_vectors(m, BLOCK).select(*KEYS, "site_id", "gt")
    return pbwt.explode_vectors(entropy.decode_streams(entropy.code_streams(vectors, KEYS, code, 1 << 12), KEYS, read).select("site_id", "gt"))


def _coded_archive(m: DataFrame, use_pbwt: bool, part_bytes: int = 1 << 12) -> DataFrame:
    path = scratch(m.sparkSession, "coded")
    coded.write(coded.encode(m, block_size=BLOCK, use_pbwt=use_pbwt, part_bytes=part_bytes), path)
    return m.sparkSession.read.parquet(path)


query("entropy_roundtrip", "g2", "SELECT site_id, hap, allele FROM m")(_coded)
for _name, _use in (("model_archive_roundtrip", True), ("model_archive_nopbwt", False)):
    query(_name, "g4", "SELECT site_id, hap, allele FROM m")(lambda m, use=_use: coded.decode(_coded_archive(m, use), use_pbwt=use).select("site_id", "hap", "allele"))
query("model_archive_rare", "g3", "SELECT site_id, hap, allele FROM m")(lambda m: coded.decode(_coded_archive(m, True, entropy.PART)).select("site_id", "hap", "allele"))
query("model_archive_raw", "g4", _PBWT)(lambda m: coded.stored_vectors(_coded_archive(m, True)))
_STREAMS = "SELECT block_id, group_id, archetype, count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS n_bytes, true AS equal, true AS smaller FROM stats GROUP BY 1, 2, 3"
for _name, _codec, _level in (("zstd", "zstd", 19), ("lz4", "lz4", 9)):
    query(f"codec_streams_{_name}", "g1", _STREAMS)(lambda m, codec=_codec, level=_level: entropy.codec_streams(route.site_vectors(m, BLOCK), KEYS, codec, level, 1 << 30).select(
        *KEYS, "n_sites", "n_bytes", "equal", (F.col("n_coded") < F.col("n_bytes")).alias("smaller")))
    query(f"codec_roundtrip_{_name}", "g2", "SELECT site_id, hap, allele FROM m")(lambda m, of=entropy.general_codec(_codec, _level): _coded(m, *of))
query("model_folds", "g3", "SELECT block_id, group_id, archetype, CAST(sum(n) AS BIGINT) AS n_bytes, true AS smaller FROM stats GROUP BY 1, 2, 3")(
    lambda m: coded.folds(_coded_archive(m, True, 1 << 30)).select(*KEYS, "n_bytes", (F.col("n_coded") < F.col("n_bytes")).alias("smaller")))
