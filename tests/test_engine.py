import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF, rows_of
from hapframe import registry
from hapframe.functions import alleles as codes
from hapframe.operators import cohort, entropy, ewah, pbwt, route, vectors
from hapframe.sources import archive, vcf



@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == oracle(registry.ORACLE_SQL[name])


def sites(spark, vectors, ploidy=2, n_allele=2):
    rows = [(s, h, ploidy, n_allele, a) for s, v in enumerate(vectors) for h, a in enumerate(v)]
    return spark.createDataFrame(rows, "site_id int, hap int, ploidy int, n_allele int, allele int")


def test_markers_of_known_vectors(spark):
    n, alts = 250_000, ({21, 10048}, {2112, 7182, 92817, 92818})
    rows = [(s, i, 2, 2, 1) for s, a in enumerate(alts) for i in a] + [(s, n - 1, 2, 2, 0) for s in (0, 1)]
    sparse = spark.createDataFrame(rows, "site_id int, hap int, ploidy int, n_allele int, allele int")
    every = spark.range(0, -(-n // 32)).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("site_id"))).select("site_id", F.col("id").cast("int").alias("word_idx"))
    words = every.join(ewah.pack(sparse, 1), ["site_id", "word_idx"], "left").fillna(0, ["word"])
    got = [(r.site_id, r.ref, r.clean, r.dirty, r.words) for r in ewah.markers(words, 1).orderBy("site_id", "marker_idx").collect()]
    assert got == [
        (0, 0, 0, 1, [2097152]), (0, 0, 313, 1, [1]), (0, 0, 7498, 0, []),
        (1, 0, 66, 1, [1]), (1, 0, 157, 1, [16384]), (1, 0, 2675, 1, [393216]), (1, 0, 4912, 0, []),
    ]


@pytest.mark.parametrize("vector", [[0] * 40, [1] * 64, [1] * 40, [0, 1, 0], [1] * 9 + [0] * 31, [1] * 10 + [0] * 30])
def test_archive_round_trip_of_edges(spark, tmp_path, vector):
    frame = sites(spark, [vector, vector[::-1], vector], 1)
    archive.write(archive.encode(frame, block_size=2), str(tmp_path / "a"))
    back = archive.decode(archive.read(spark, str(tmp_path / "a")))
    assert rows_of(back) == rows_of(frame.select("site_id", "hap", "allele"))


def test_rare_sites_do_not_move_the_order(spark):
    nine, ten = [1] * 9 + [0] * 11, [1] * 10 + [0] * 10
    for first, moved in ((nine, False), (ten, True)):
        frame = sites(spark, [first, list(range(2)) * 10])
        out = {r.site_id: r.gt for r in pbwt.permute(route.site_vectors(frame, 16)).collect()}
        assert (bytes(out[1]) != bytes([0, 1] * 10)) == moved or first == ten


def test_bcf_codes(spark):
    frame = spark.range(16).select(F.col("id").cast("int").alias("a"))
    assert [r[0] for r in frame.select(codes.from_bcf_general(codes.to_bcf(F.col("a")))).collect()] == [*range(16)]


def test_vcf_records(spark):
    lines = ["chr1\t5\t.\tA\tC,G\t.\t.\t.\tDP:GT\t3:0|2\t4:.", "chr1\t6\t.\tA\tC\t.\t.\t.\tDP\t3\t4"]
    got = vcf.parse(spark.createDataFrame([(x,) for x in lines], "line string")).orderBy("sample", "slot").collect()
    assert [(r.pos, r.n_allele, r["sample"], r.slot, r.allele) for r in got] == [(5, 3, 0, 0, 0), (5, 3, 0, 1, 2), (5, 3, 1, 0, 14)]


@pytest.mark.parametrize("data", [b"", b"\0", b"\0" * 500, bytes(range(256)) * 3, b"\xff" * 9])
def test_range_coder_round_trip(data):
    assert entropy.decode(entropy.encode(data), len(data)) == data
    assert len(entropy.encode(b"\0" * 5000)) < 200


def test_alleles_beyond_the_limit_fail(spark):
    one = lambda s: spark.createDataFrame([(s,)], "s string").select(codes.vcf_allele(F.col("s"))).first()[0]
    assert [one(x) for x in ("0", "13", ".")] == [0, 13, 14] and one(None) is None
    for x in ("14", "15", "17", "x"):
        with pytest.raises(Exception, match="beyond 13"):
            one(x)


def test_lanes_of_unequal_length(spark):
    frame = sites(spark, [[0, 1, 1, 0, 1] * 5, [1, 0, 1] * 8 + [0], [0] * 25], 1, 4)
    vectors = route.site_vectors(frame, 16)
    assert rows_of(pbwt.restore(pbwt.permute(vectors, stride=2), stride=2).select("site_id", "gt")) == rows_of(vectors.select("site_id", "gt"))


def test_markers_of_vectors_are_those_of_rows():
    rng = np.random.default_rng(3)
    for bits, symbols in ((1, 2), (4, 16)):
        for n in (1, 7, 32, 33, 500):
            gt = np.repeat(rng.integers(0, symbols, n), rng.integers(1, 40, n))[:n].astype(np.uint8)
            words = ewah.vector_words(gt, bits)
            assert (ewah.words_vector(words, bits, n) == gt).all() and len(words) == -(-n // ewah.per_word(bits))
            ref, clean, dirty, literal = ewah.word_markers(words, bits)
            assert (ewah.marker_words(ref, clean, dirty, literal, bits) == words).all()


@pytest.mark.parametrize("archetype", ["2mc", "nm"])
def test_segment_coder_round_trip(archetype):
    rng, bits = np.random.default_rng(4), ewah.BITS[archetype]
    vectors = [np.repeat(rng.integers(0, 2 if bits == 1 else 16, k), rng.integers(1, 300, k)).astype(np.uint8) for k in (1, 3, 20, 40)] + [np.zeros(0, np.uint8), np.zeros(9000, np.uint8)]
    coder, model = entropy.Writer(), entropy.SegmentCoder(archetype)
    for v in vectors:
        words = ewah.vector_words(v, bits)
        model.site(coder, len(words), words)
    data = coder.close()
    reader, model = entropy.Reader(data), entropy.SegmentCoder(archetype)
    for v in vectors:
        assert (ewah.words_vector(model.site(reader, -(-len(v) // ewah.per_word(bits))), bits, len(v)) == v).all()
    model = entropy.FrequencyModel(4)
    assert sum(map(model.probability, range(4))) == 1


def test_context_coder_is_smaller_than_zstd(spark):
    from hapframe.sources import coded
    from hapframe.sources.fixtures import matrix

    vectors = route.site_vectors(matrix(spark, "/root/testdata/sf0.01", "g3")).cache()
    keys = ["block_id", "group_id", "archetype"]
    stored = pbwt.permute(vectors)
    packed = [(r.block_id, r.group_id, r.archetype, r.site_id, ewah.vector_words(np.frombuffer(r.gt, np.uint8), 1).tobytes()) for r in stored.collect()]
    frame = spark.createDataFrame(packed, "block_id int, group_id int, archetype string, site_id int, gt binary")
    by_zstd = entropy.codec_streams(frame, keys, "zstd", 19).agg(F.sum("n_coded")).first()[0]
    assert coded.encode_sites(vectors).agg(F.sum(F.length("payload"))).first()[0] < by_zstd


def test_streams_of_sites(spark, tmp_path):
    from hapframe.streaming import ingest

    schema = "site_id int, hap int, ploidy int, n_allele int, allele int"
    frame = sites(spark, [[0, 1, 1, 0] * 9, [1, 0, 1] * 12, [0] * 36, [1, 1] * 18])
    for k in (0, 1):
        frame.where(f"site_id DIV 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    alleles = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.store_stream(alleles, str(tmp_path / "out"), str(tmp_path / "check"), block_size=16).awaitTermination()
    stored = ingest.stored_stream(spark, str(tmp_path / "out"))
    assert stored.select("block_id").distinct().count() == 2
    assert rows_of(archive.decode(stored)) == rows_of(frame.select("site_id", "hap", "allele"))
    ingest.running_counts(alleles).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.table("counts")) == rows_of(frame.groupBy("site_id").agg(F.count("*").alias("n"), F.sum("allele").alias("ac")))


def test_vcf_of_many_samples_is_read_in_time_linear_in_them(spark, tmp_path):
    n = 20_000
    line = lambda pos, gt: "\t".join(["1", str(pos), ".", "A", "C", ".", ".", ".", "DP:GT", *(f"{k}:{g}" for k, g in zip(range(n), gt, strict=True))])
    text = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *map(str, range(n))])]
    text += [line(1, ["0|1", "1"] * (n // 2)), line(2, ["./1"] * n), line(3, ["1"] * n)]
    (tmp_path / "x.vcf").write_text("\n".join(text))
    began = time.monotonic()
    got = vcf.read_alleles(spark, str(tmp_path / "x.vcf")).groupBy("site_id", "ploidy", "allele").count().collect()
    assert time.monotonic() - began < 30  # was quadratic: a line was split for each of its samples
    assert sorted(map(tuple, got)) == [(0, 2, 0, n // 2), (0, 2, 1, n), (0, 2, 15, n // 2), (1, 2, 1, n), (1, 2, 14, n), (2, 1, 1, n)]


def test_records_of_vectors_are_those_of_rows(spark):
    """Gaps between haplotypes, missing alleles, ends of vectors, whole genotypes of them, and alleles of two letters; pieces meet from several tasks."""
    rng = np.random.default_rng(5)
    rows = [(s, h, p, 12, int(rng.choice([0, 1, 9, 14, 15] + [12] * (s % 2)))) for s, p in ((0, 2), (1, 2), (2, 3), (3, 1)) for h in range(200) if rng.random() < 0.8] + [(4, 1, 2, 1, 0), (5, 0, 2, 2, 15)]
    frame = spark.createDataFrame(rows, "site_id int, hap int, ploidy int, n_allele int, allele int").repartition(7)
    got = {r.site_id: r.line.split("\t", 9) for r in vcf.records(frame).collect()}
    assert {k: v[9] for k, v in got.items()} == {r.site_id: r.line for r in vcf.to_vcf(frame).collect()}
    assert got[0][:9] == ["1", "1", ".", "A", ",".join(f"<A{k}>" for k in range(1, 12)), ".", ".", ".", "GT"] and got[4][4] == "."
    cells = rows_of(frame.select("site_id", "hap", "allele"))
    assert {r.site_id: list(r.gt) for r in route.gathered(frame).collect()} == {s: [a for _, _, a in sorted((h, x, a) for a, h, x in cells if x == s)] for s in got}


def test_fixtures_equal_their_sql_on_odd_tables(spark, tmp_path):
    """Nulls in every column, negative keys, users that are multiples of seven, all days and more event types than five."""
    import duckdb

    from hapframe.sources import fixtures

    rng = np.random.default_rng(6)
    some = lambda values: None if rng.random() < 0.05 else values[rng.integers(len(values))]
    db = duckdb.connect()
    db.sql("CREATE TABLE events (user_id BIGINT, event_type VARCHAR, ts TIMESTAMP); CREATE TABLE lineitem (l_suppkey BIGINT, l_orderkey BIGINT, l_returnflag VARCHAR, l_quantity DOUBLE)")
    db.executemany("INSERT INTO events VALUES (?, ?, ?)", [(some([0, 7, 14, 21, 5, 9, 2**40 + 1]), some(list("abcdefgh")), f"2024-01-{rng.integers(1, 32)} {rng.integers(24)}:30:00") for _ in range(400)])
    db.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?)", [(some([1, 2, 3, 900]), some([-700, -1, 0, 63, 64, 511, 513, 10**12]), some(["R", "N"]), some([47.0, 48.0, 50.0])) for _ in range(150)])
    for table in ("events", "lineitem"):
        db.sql(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    for name in ("g1", "g2", "g3", "g4"):
        frame, found = fixtures.matrix(spark, str(tmp_path), name), db.sql(fixtures.duckdb_text(name))
        assert frame.columns == found.columns == ["site_id", "hap", "ploidy", "n_allele", "allele"] and {t for _, t in frame.dtypes} == {"int"}
        assert sorted(map(tuple, frame.collect()), key=repr) == sorted(found.fetchall(), key=repr), name


@pytest.mark.parametrize("name", ["g1", "g2", "g3", "g4"])
def test_no_join_of_a_fixture_has_a_row_for_each_allele(spark, name):
    """Tasks held the sorted cells of a rectangle (or a broadcast of all events); now cells are made behind the joins."""
    from hapframe.sources.fixtures import matrix

    plan = matrix(spark, SF, name)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert joins and not any("slot#" in line or " h#" in line for line in joins)


def test_vectors_become_alleles_in_bounded_batches():
    """A vector longer than a batch is cut; it was one batch, however long."""
    rng, most = np.random.default_rng(7), vectors.CELLS
    own = [rng.integers(0, 16, n).astype(np.uint8) for n in (3, 0, most - 3, 2 * most + 5, most, 1)]
    got = list(vectors.spread(own, [pa.array(range(len(own)), pa.int32())], ["site_id"], "pos"))
    assert max(b.num_rows for b in got) <= most
    rows = pa.Table.from_batches(got)
    assert rows.column("site_id").to_pylist() == [k for k, v in enumerate(own) for _ in v]
    assert (rows.column("pos").to_numpy() == np.concatenate([np.arange(len(v)) for v in own])).all()
    assert (rows.column("allele").to_numpy() == np.concatenate(own)).all()


def test_batches_are_permuted_by_parts():
    whole = pa.RecordBatch.from_pydict({"site_id": pa.array(range(9)), "gt": pa.array([bytes(1 << 20)] * 8 + [b""], pa.binary())})
    parts = list(vectors.slices(whole.slice(1)))
    assert [x for p in parts for x in p.column("site_id").to_pylist()] == [*range(1, 9)] and max(sum(map(len, p.column("gt").to_pylist())) for p in parts) <= vectors.VECTOR_BYTES


def test_parts_of_streams_hold_no_batch_of_python_rows():
    """Parts are as they were; of a batch of 40 MB, which was copied whole into rows, only a part's bytes are copied."""
    import tracemalloc

    rng = np.random.default_rng(8)
    own = [(k, s, rng.integers(0, 2, n).astype(np.uint8).tobytes()) for k, s, n in ((0, 0, 5), (0, 1, 4), (0, 2, 0), (1, 3, 2), (2, 4, 9), (2, 5, 1))]
    batch = lambda rows: pa.RecordBatch.from_pylist([{"k": k, "site_id": s, "gt": g} for k, s, g in rows])
    got = list(entropy.parts([batch(own[:2]), batch(own[2:])], ["k"], 9))
    assert [(key, number, [r["site_id"] for r in rows], ends, data) for key, number, rows, ends, data in got] == [
        ((0,), 0, [0, 1], [5, 9], own[0][2] + own[1][2]), ((0,), 1, [2], [0], b""), ((1,), 0, [3], [2], own[3][2]), ((2,), 0, [4], [9], own[4][2]), ((2,), 1, [5], [1], own[5][2])]
    large = batch([(0, s, bytes(1 << 20)) for s in range(40)])
    tracemalloc.start()
    assert sum(len(p[-1]) for p in entropy.parts([large], ["k"], 1 << 21)) == 40 << 20
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20


def test_merging_cohorts_deals_no_alleles(spark):
    """Alleles were dealt by site and sorted to meet the table of sites, so that a task held whole sites of all haplotypes. On the smallest tables there is no second cohort."""
    import duckdb

    sf, db = "/root/testdata/sf0.01", duckdb.connect()
    merged = registry.QUERIES["merge_cohorts"](spark, sf)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin [site_id#") == 2 and "SortMergeJoin [site_id#" not in plan and "hashpartitioning(site_id#" not in plan
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    found = sorted(db.sql(registry.ORACLE_SQL["merge_cohorts"]).fetchall())
    assert found and sorted(map(tuple, merged.collect())) == found


@pytest.mark.parametrize("most, join", [(3, "BroadcastHashJoin"), (2, "ShuffledHashJoin")])
def test_cohorts_merge_with_few_and_many_sites(spark, monkeypatch, most, join):
    """Sites of one cohort only, null sites, haplotypes of unequal number and null; beyond the sites that are sent all are still merged, and nothing is sorted."""
    monkeypatch.setattr(cohort, "SENT_SITES", most, raising=False)
    schema = "site_id int, hap int, ploidy int, n_allele int, allele int"
    cells = lambda sizes: [(s, h, 2, 2, (h + (s or 0)) % 2) for s, n in sizes for h in range(n)]
    own, other = cells([(0, 3), (1, 1), (2, 4), (7, 2), (None, 2)]) + [(0, None, 2, 2, 1)], cells([(0, 2), (2, 1), (5, 6), (7, 3), (None, 1)])
    left, right = (spark.createDataFrame(x, schema) for x in (own, other))
    merged = cohort.merge(left, right)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{join} [site_id#") == 2 and plan.count(", BuildRight") == 2 and "SortMergeJoin" not in plan
    size = {0: 4, 2: 4, 7: 2}
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted([r for r in own if r[0] in size] + [(s, h + size[s], *x) for s, h, *x in other if s in size], key=repr)
    assert cohort.merge(left, right.where("site_id = 5")).collect() == []
