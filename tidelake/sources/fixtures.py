"""The maintenance relations, derived from the benchmark tables by rule (see FIXTURES.md, part C).

One data file of the pretended table is all lineitems of one ship month and supplier; delete files, snapshots,
manifests, the object listing and outcomes follow from orders, months, parts and events. Everything is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the fixtures: now, file size target and band, ratios, counts.
NOW_MS = 1_009_843_200_000  # 2002-01-01T00:00:00Z
TARGET, SMALL, LARGE = 200, 150, 400
SMALL_RATIO, MIN_INPUTS, DELETE_RATIO = 0.36, 4, 0.1
MIN_AGE_MS = 3_600_000
GROUP_BYTES, GROUP_FILES = 500, 4
BUDGET, RETAIN, AGE_DAYS, DELETE_CEILING = 400_000, 3, 7, 100
CURRENT_SPEC = 1
LOCATION = "s3://lake/wh/db/lineitem"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_key(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def spec_of(part_key: Column) -> Column:
    """Months before 1996 were written under the superseded partition spec 0."""
    return F.when(part_key < 199601, 0).otherwise(CURRENT_SPEC)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data file entries, one per ship month and supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
    grouped = lines.groupBy(month_key(F.col("l_shipdate")).alias("part_key"), F.col("l_suppkey").alias("file_no")).agg(
        F.count("*").alias("record_count"), F.sum(F.col("l_quantity").cast("bigint")).alias("file_size"),
        (1 + F.min("l_orderkey") % 97).alias("seq"), F.max("l_shipdate").alias("newest"),
    )
    path = F.concat(F.lit(f"{LOCATION}/data/ship_month="), F.col("part_key").cast("string"), F.lit("/"), F.col("file_no").cast("string"), F.lit(".parquet"))
    return grouped.withColumns({"spec_id": spec_of(F.col("part_key")), "path": path, "newest_ms": F.unix_millis(F.col("newest").cast("timestamp"))}).drop("newest")


FILES_SQL = f"""files AS (
  SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS part_key, l_suppkey AS file_no, count(*) AS record_count,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS file_size, 1 + min(l_orderkey) % 97 AS seq,
         CASE WHEN year(l_shipdate) * 100 + month(l_shipdate) < 199601 THEN 0 ELSE {CURRENT_SPEC} END AS spec_id,
         '{LOCATION}/data/ship_month=' || CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) || '.parquet' AS path,
         epoch_ms(max(l_shipdate)) AS newest_ms
  FROM lineitem GROUP BY year(l_shipdate) * 100 + month(l_shipdate), l_suppkey
)"""


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete file entries: per third month of orders five files, of which two hold equality deletes; and one global
    equality delete per market segment, under the unpartitioned spec (null part_key)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").where(F.month("o_orderdate") % 3 == 0)
    no = F.col("o_custkey") % 5
    by_part = orders.groupBy(month_key(F.col("o_orderdate")).alias("part_key"), no.alias("del_no")).agg(F.count("*").alias("record_count"), (1 + F.min("o_orderkey") % 97).alias("seq"))
    by_part = by_part.select(
        F.concat(F.lit(f"{LOCATION}/data/del-"), F.col("part_key").cast("string"), F.lit("-"), F.col("del_no").cast("string"), F.lit(".parquet")).alias("path"),
        F.when(F.col("del_no") < 2, "equality").otherwise("position").alias("content"), spec_of(F.col("part_key")).alias("spec_id"), "part_key", "record_count", "seq",
    )
    everywhere = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("record_count"), (1 + F.min("c_custkey") % 97).alias("seq"))
    everywhere = everywhere.select(
        F.concat(F.lit(f"{LOCATION}/data/del-all-"), F.col("c_mktsegment"), F.lit(".parquet")).alias("path"), F.lit("equality").alias("content"), F.lit(2).alias("spec_id"), F.lit(None).cast("int").alias("part_key"), "record_count", "seq"
    )
    return by_part.unionByName(everywhere)


DELETES_SQL = f"""deletes AS (
  SELECT '{LOCATION}/data/del-' || CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR) || '-' || CAST(o_custkey % 5 AS VARCHAR) || '.parquet' AS path,
         CASE WHEN o_custkey % 5 < 2 THEN 'equality' ELSE 'position' END AS content,
         CASE WHEN year(o_orderdate) * 100 + month(o_orderdate) < 199601 THEN 0 ELSE {CURRENT_SPEC} END AS spec_id,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS part_key, count(*) AS record_count, 1 + min(o_orderkey) % 97 AS seq
  FROM orders WHERE month(o_orderdate) % 3 = 0 GROUP BY year(o_orderdate) * 100 + month(o_orderdate), o_custkey % 5
  UNION ALL
  SELECT '{LOCATION}/data/del-all-' || c_mktsegment || '.parquet', 'equality', 2, NULL, count(*), 1 + min(c_custkey) % 97 FROM customer GROUP BY c_mktsegment
)"""


def manifests(spark: SparkSession, sf_dir: str, data: DataFrame | None = None) -> DataFrame:
    """Manifests: four per month of data files (data, if they are at hand); a manifest's length follows from its entries."""
    found = (data or files(spark, sf_dir)).groupBy("spec_id", "part_key", (F.col("file_no") % 4).alias("quarter")).agg(F.count("*").alias("entries"))
    return found.select(
        F.concat(F.lit(f"{LOCATION}/metadata/m-"), F.col("part_key").cast("string"), F.lit("-"), F.col("quarter").cast("string"), F.lit(".avro")).alias("path"),
        "spec_id", "part_key", "quarter", F.lit("data").alias("content"), "entries", (256 + 48 * 16 * F.col("entries")).alias("length"),
    )


MANIFESTS_SQL = f"""manifests AS (
  SELECT '{LOCATION}/metadata/m-' || CAST(part_key AS VARCHAR) || '-' || CAST(file_no % 4 AS VARCHAR) || '.avro' AS path, spec_id, part_key, file_no % 4 AS quarter,
         'data' AS content, count(*) AS entries, 256 + 48 * 16 * count(*) AS length
  FROM files GROUP BY spec_id, part_key, file_no % 4
)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per ship month, its parent the month before. Months are made of the few distinct days, not per line."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).count()
    months = days.select(F.trunc("d", "month").alias("m")).distinct()
    key = lambda c: F.year(c) * 100 + F.month(c)
    return months.select(
        key(F.col("m")).cast("bigint").alias("snapshot_id"), key(F.add_months("m", -1)).cast("bigint").alias("parent_id"),
        F.unix_millis(F.col("m").cast("timestamp")).alias("timestamp_ms"), key(F.add_months("m", -3)).cast("int").alias("oldest_part"),
    )


SNAPSHOTS_SQL = """snapshots AS (
  SELECT CAST(year(m) * 100 + month(m) AS BIGINT) AS snapshot_id, CAST(year(m - INTERVAL 1 MONTH) * 100 + month(m - INTERVAL 1 MONTH) AS BIGINT) AS parent_id,
         epoch_ms(CAST(m AS TIMESTAMP)) AS timestamp_ms, CAST(year(m - INTERVAL 3 MONTH) * 100 + month(m - INTERVAL 3 MONTH) AS INT) AS oldest_part
  FROM (SELECT DISTINCT date_trunc('month', l_shipdate) AS m FROM lineitem)
)"""


def listing(spark: SparkSession, sf_dir: str, data: DataFrame | None = None) -> DataFrame:
    """The object listing: every data file (data, if they are at hand), spelled in three ways, and stray files from parts,
    some without a time."""
    kept = (data or files(spark, sf_dir)).select(
        F.when(F.col("file_no") % 3 == 0, F.replace("path", F.lit("s3://"), F.lit("s3a://"))).when(F.col("file_no") % 3 == 1, F.replace("path", F.lit("/data/"), F.lit("//data/"))).otherwise(F.col("path")).alias("path"),
        F.col("file_size").alias("size"), F.col("newest_ms").alias("modified_ms"),
    )
    strays = table(spark, sf_dir, "part").select(
        F.concat(F.lit(f"{LOCATION}/data/abandoned/"), F.col("p_partkey").cast("string"), F.lit(".parquet")).alias("path"), F.col("p_size").cast("bigint").alias("size"),
        F.when(F.col("p_size") % 10 != 0, F.lit(NOW_MS) - F.col("p_size").cast("bigint") * 86_400_000).alias("modified_ms"),
    )
    return kept.unionByName(strays)


LISTING_SQL = f"""listing AS (
  SELECT CASE file_no % 3 WHEN 0 THEN replace(path, 's3://', 's3a://') WHEN 1 THEN replace(path, '/data/', '//data/') ELSE path END AS path, file_size AS size, newest_ms AS modified_ms FROM files
  UNION ALL
  SELECT '{LOCATION}/data/abandoned/' || CAST(p_partkey AS VARCHAR) || '.parquet', CAST(p_size AS BIGINT), CASE WHEN p_size % 10 <> 0 THEN {NOW_MS} - CAST(p_size AS BIGINT) * 86400000 END FROM part
)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change notifications: (table, kind, at_us) from events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation outcomes: event types stand for results, values for durations, users for tables."""
    result = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "refused").when(F.col("event_type") == "view", "no-op").when(F.col("event_type") == "click", "conflicted").otherwise("succeeded")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("table_id"), result.alias("result"), F.greatest(F.col("value"), F.lit(0.0)).alias("took"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


OUTCOMES_SQL = """outcomes AS (
  SELECT event_id, user_id AS table_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'refused' WHEN 'view' THEN 'no-op' WHEN 'click' THEN 'conflicted' ELSE 'succeeded' END AS result,
         greatest(value, 0.0) AS took, epoch_us(ts) AS at_us
  FROM events
)"""
