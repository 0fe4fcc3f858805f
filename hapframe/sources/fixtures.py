"""Haplotype matrices derived from the driver's tables: as SQL text for DuckDB, and as frames that give the same rows.

The SQL joins every cell of a rectangle with the events of that cell. The frames join a row for each user and event type (or supplier), which knows
its cells as bits, and make the rectangle last: no join or sort sees a row of a single allele, and what a task holds doesn't grow with the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

G1 = """
WITH e AS (SELECT DISTINCT user_id, event_type, CAST(extract(day FROM ts) AS INT) - 1 AS dy,
                  CASE WHEN extract(hour FROM ts) < 12 THEN 0 ELSE 1 END AS slot FROM {events}),
ty AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS tc FROM (SELECT DISTINCT event_type FROM e) t0),
us AS (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INT) AS u FROM (SELECT DISTINCT user_id FROM e) t1),
dd AS (SELECT DISTINCT dy FROM e),
sl AS (SELECT 0 AS slot UNION ALL SELECT 1 AS slot)
SELECT CAST(dd.dy * 5 + ty.tc AS INT) AS site_id, CAST(us.u * 2 + sl.slot AS INT) AS hap, 2 AS ploidy, 2 AS n_allele,
       CASE WHEN e.user_id IS NULL THEN 0 ELSE 1 END AS allele
FROM dd CROSS JOIN ty CROSS JOIN us CROSS JOIN sl
LEFT JOIN e ON e.dy = dd.dy AND e.event_type = ty.event_type AND e.user_id = us.user_id AND e.slot = sl.slot
"""
G2 = """
WITH t AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS tc FROM (SELECT DISTINCT event_type FROM {events}) t0),
e AS (SELECT CAST(extract(day FROM ts) AS INT) - 1 AS dy, user_id, CASE WHEN extract(hour FROM ts) < 12 THEN 0 ELSE 1 END AS slot, min(t.tc) AS al
      FROM {events} ev JOIN t ON ev.event_type = t.event_type
      GROUP BY CAST(extract(day FROM ts) AS INT) - 1, user_id, CASE WHEN extract(hour FROM ts) < 12 THEN 0 ELSE 1 END),
us AS (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INT) AS u FROM (SELECT DISTINCT user_id FROM e) t1),
dd AS (SELECT DISTINCT dy FROM e),
sl AS (SELECT 0 AS slot UNION ALL SELECT 1 AS slot)
SELECT dd.dy AS site_id, CAST(us.u * 2 + sl.slot AS INT) AS hap, 2 AS ploidy, 5 AS n_allele,
       CAST(CASE WHEN sl.slot = 1 AND us.user_id % 7 = 0 THEN 15 ELSE coalesce(e.al, 14) END AS INT) AS allele
FROM dd CROSS JOIN us CROSS JOIN sl
LEFT JOIN e ON e.dy = dd.dy AND e.user_id = us.user_id AND e.slot = sl.slot
"""
G3 = """
WITH m AS (SELECT l_suppkey, l_orderkey % 512 AS h, max(CASE WHEN l_returnflag = 'R' AND l_quantity > 47 THEN 1 ELSE 0 END) AS a
           FROM {lineitem} GROUP BY l_suppkey, l_orderkey % 512),
s AS (SELECT DISTINCT l_suppkey FROM {lineitem}),
h AS (SELECT DISTINCT l_orderkey % 512 AS h FROM {lineitem})
SELECT CAST(s.l_suppkey AS INT) AS site_id, CAST(h.h AS INT) AS hap, 2 AS ploidy, 2 AS n_allele, CAST(coalesce(m.a, 0) AS INT) AS allele
FROM s CROSS JOIN h LEFT JOIN m ON m.l_suppkey = s.l_suppkey AND m.h = h.h
"""
G4 = f"""
WITH g1 AS ({G1}), g2 AS ({G2})
SELECT CAST(floor(site_id / 5) * 7 + site_id % 5 AS INT) AS site_id, hap, ploidy, n_allele, allele FROM g1
UNION ALL SELECT CAST(floor(site_id / 5) * 7 + 5 AS INT), CAST(floor(hap / 2) AS INT), 1, n_allele, allele FROM g1 WHERE site_id % 5 = 1 AND hap % 2 = 0
UNION ALL SELECT CAST(site_id * 7 + 6 AS INT), hap, ploidy, n_allele, allele FROM g2
"""
TEXTS = {"g1": G1, "g2": G2, "g3": G3, "g4": G4}


def _numbered(frame: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a column, numbered from 0 in their order, null last."""
    return frame.select(column).distinct().withColumn(name, (F.row_number().over(Window.orderBy(F.col(column).asc_nulls_last())) - 1).cast("int"))


def _half_days(events: DataFrame) -> DataFrame:
    """``user_id, event_type, dy, slot``."""
    return events.select("user_id", "event_type", (F.dayofmonth("ts") - 1).alias("dy"), F.when(F.hour("ts") < 12, 0).otherwise(1).alias("slot"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _has(bits: Column, place: Column) -> Column:
    return F.call_function("shiftright", F.coalesce(bits, F.lit(0).cast("long")), place).bitwiseAND(F.lit(1).cast("long")).cast("int")


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows in as many tasks as the session has for a shuffle, since each becomes hundreds of cells: by their own size Spark would put them in one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def _cells(halves: DataFrame) -> DataFrame:
    """``dy, slot, at``: the half-days of a user; ``at`` is the bit of one, null if nothing meets it."""
    slots = halves.sparkSession.range(2).select(F.col("id").cast("int").alias("slot"))
    return halves.select("dy").distinct().crossJoin(slots).withColumn("at", F.col("dy") * 2 + F.col("slot"))


def _g1(events: DataFrame) -> DataFrame:
    e = _half_days(events)
    bits = e.where("user_id IS NOT NULL AND event_type IS NOT NULL AND dy IS NOT NULL").groupBy("user_id", "event_type").agg(F.bit_or(_bit(F.col("dy") * 2 + F.col("slot"))).alias("bits"))
    whole = _numbered(e, "user_id", "u").crossJoin(F.broadcast(_numbered(e, "event_type", "tc"))).join(bits, ["user_id", "event_type"], "left")
    cells = _dealt(whole, "user_id").crossJoin(F.broadcast(_cells(e)))
    return cells.select((F.col("dy") * 5 + F.col("tc")).cast("int").alias("site_id"), (F.col("u") * 2 + F.col("slot")).cast("int").alias("hap"), F.lit(2).alias("ploidy"), F.lit(2).alias("n_allele"),
                        F.coalesce(_has(F.col("bits"), F.col("at")), F.lit(0)).alias("allele"))


def _g2(events: DataFrame) -> DataFrame:
    e = _half_days(events)
    typed = e.join(F.broadcast(_numbered(e, "event_type", "tc").where("event_type IS NOT NULL")), "event_type")
    least = typed.where("user_id IS NOT NULL AND dy IS NOT NULL").groupBy("user_id", "dy", "slot").agg(F.min("tc").alias("al"))
    bits = least.groupBy("user_id", "al").agg(F.bit_or(_bit(F.col("dy") * 2 + F.col("slot"))).alias("bits")).groupBy("user_id").agg(F.collect_list(F.struct("al", "bits")).alias("own"))
    whole = _dealt(_numbered(typed, "user_id", "u").join(bits, "user_id", "left"), "user_id").crossJoin(F.broadcast(_cells(typed)))
    found = F.get(F.filter("own", lambda x: _has(x["bits"], F.col("at")) == 1), F.lit(0))["al"]
    allele = F.when((F.col("slot") == 1) & (F.col("user_id") % 7 == 0), 15).otherwise(F.coalesce(found, F.lit(14)))
    return whole.select(F.col("dy").alias("site_id"), (F.col("u") * 2 + F.col("slot")).cast("int").alias("hap"), F.lit(2).alias("ploidy"), F.lit(5).alias("n_allele"), allele.cast("int").alias("allele"))


def _g3(lineitem: DataFrame) -> DataFrame:
    """A supplier has a row for each 64 haplotypes: eight of them, or sixteen where keys are negative."""
    l = lineitem.select("l_suppkey", (F.col("l_orderkey") % 512).alias("h"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 47)).alias("a"))
    hit = l.where("a AND l_suppkey IS NOT NULL AND h IS NOT NULL").groupBy("l_suppkey", F.floor(F.col("h") / 64).cast("int").alias("w")).agg(F.bit_or(_bit(F.pmod("h", F.lit(64)).cast("int"))).alias("bits"))
    h = l.select("h").distinct().groupBy(F.floor(F.col("h") / 64).cast("int").alias("w")).agg(F.collect_list("h").alias("hs"), F.max(F.col("h").isNull()).alias("none"))
    whole = l.select("l_suppkey").distinct().crossJoin(F.broadcast(h)).join(hit, ["l_suppkey", "w"], "left")
    hs = F.explode(F.when(F.col("none"), F.array(F.lit(None).cast("bigint"))).otherwise(F.col("hs"))).alias("h")
    return _dealt(whole, "l_suppkey").select("l_suppkey", "bits", hs).select(
        F.col("l_suppkey").cast("int").alias("site_id"), F.col("h").cast("int").alias("hap"), F.lit(2).alias("ploidy"), F.lit(2).alias("n_allele"),
        F.coalesce(_has(F.col("bits"), F.pmod("h", F.lit(64)).cast("int")), F.lit(0)).alias("allele"))


def _g4(events: DataFrame) -> DataFrame:
    """As in the SQL, of one pass over ``g1``: a cell at every fifth site of it also gives one of the haploid sites."""
    week = (F.floor(F.col("site_id") / 5) * 7).cast("int")
    own = F.struct((week + F.col("site_id") % 5).alias("site_id"), "hap", "ploidy")
    haploid = F.struct((week + 5).alias("site_id"), F.floor(F.col("hap") / 2).cast("int").alias("hap"), F.lit(1).alias("ploidy"))
    twice = (F.col("site_id") % 5 == 1) & (F.col("hap") % 2 == 0)
    cells = _g1(events).select(F.explode(F.when(twice, F.array(own, haploid)).otherwise(F.array(own))).alias("x"), "n_allele", "allele")
    return cells.select("x.*", "n_allele", "allele").select(COLUMNS).union(_g2(events).withColumn("site_id", F.col("site_id") * 7 + 6).select(COLUMNS))


COLUMNS = ["site_id", "hap", "ploidy", "n_allele", "allele"]
FRAMES = {"g1": _g1, "g2": _g2, "g3": _g3, "g4": _g4}


def matrix(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``site_id, hap, ploidy, n_allele, allele``."""
    return FRAMES[name](spark.read.parquet(f"{sf_dir}/{'lineitem' if name == 'g3' else 'events'}.parquet"))


def duckdb_text(name: str) -> str:
    return TEXTS[name].format(events="events", lineitem="lineitem")
