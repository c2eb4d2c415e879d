"""The registered queries over the engine's operators, each beside the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.functions import paths, values
from tidelake.operators import deletes as D
from tidelake.operators import grouping as G
from tidelake.operators import health as H
from tidelake.operators import outcomes as O
from tidelake.operators import policy as P
from tidelake.operators import reachability as R
from tidelake.operators import rewrite as W
from tidelake.plans import planner
from tidelake.sources import fixtures as X
from tidelake.sources.storage import shared, shared_path
from tidelake.streaming import debounce
from tidelake.streaming import notifications as N

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL twin if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


WITH_FILES = f"WITH {X.FILES_SQL}"
WITH_BOTH = f"WITH {X.FILES_SQL}, {X.DELETES_SQL}"
HEALTH_SQL = f"""{WITH_BOTH}, entries AS (
  SELECT spec_id, part_key, 'data' AS content, file_size, record_count, newest_ms FROM files
  UNION ALL SELECT spec_id, part_key, content, NULL, record_count, NULL FROM deletes
), health AS (
  SELECT spec_id, part_key, count(*) FILTER (content = 'data') AS data_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS data_bytes,
    CAST(coalesce(sum(record_count) FILTER (content = 'data'), 0) AS BIGINT) AS data_rows, count(*) FILTER (content = 'position') AS position_deletes,
    count(*) FILTER (content = 'equality') AS equality_deletes, CAST(coalesce(sum(record_count) FILTER (content <> 'data'), 0) AS BIGINT) AS delete_rows, max(newest_ms) AS newest_ms,
    count(*) FILTER (file_size < {X.SMALL}) AS small_files, count(*) FILTER (file_size > {X.LARGE}) AS large_files,
    CAST(coalesce(sum(file_size) FILTER (file_size < {X.SMALL} OR file_size > {X.LARGE}), 0) AS BIGINT) AS eligible_bytes
  FROM entries GROUP BY spec_id, part_key
), rated AS (
  SELECT *, CASE WHEN data_rows > 0 THEN delete_rows / CAST(data_rows AS DOUBLE) ELSE 0.0 END AS delete_ratio,
    CASE WHEN data_files > 0 THEN small_files / CAST(data_files AS DOUBLE) ELSE 0.0 END AS small_ratio FROM health
)"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.partition_health(X.files(spark, sf_dir), X.deletes(spark, sf_dir), X.SMALL, X.LARGE)


@query(f"{HEALTH_SQL} SELECT * FROM rated")
def partition_health(spark, sf_dir):
    return _health(spark, sf_dir)


@query(f"""{WITH_BOTH}, s AS (SELECT file_size AS v, row_number() OVER (ORDER BY file_size) - 1 AS r, count(*) OVER () AS n FROM files),
p AS (SELECT unnest([0.0, 0.5, 0.95, 1.0]) AS share)
SELECT CAST(share AS DOUBLE) AS share, v AS value FROM p JOIN s ON r = CAST(round(share * (n - 1)) AS BIGINT)""")
def size_percentiles(spark, sf_dir):
    return H.nearest_ranks(X.files(spark, sf_dir), "file_size", [0.0, 0.5, 0.95, 1.0])


@query(f"""{WITH_BOTH} SELECT (SELECT count(*) FROM files) AS data_files, (SELECT CAST(sum(file_size) AS BIGINT) FROM files) AS data_bytes, (SELECT CAST(sum(record_count) AS BIGINT) FROM files) AS data_rows,
(SELECT avg(file_size) FROM files) AS average_size, count(*) FILTER (content = 'position') AS position_deletes, count(*) FILTER (content = 'equality') AS equality_deletes, CAST(sum(record_count) AS BIGINT) AS delete_rows FROM deletes""")
def table_health(spark, sf_dir):
    data = X.files(spark, sf_dir).agg(F.count("*").alias("data_files"), H.total("file_size").alias("data_bytes"), H.total("record_count").alias("data_rows"), F.avg("file_size").alias("average_size"))
    gone = X.deletes(spark, sf_dir).agg(F.count_if(F.col("content") == "position").alias("position_deletes"), F.count_if(F.col("content") == "equality").alias("equality_deletes"), H.total("record_count").alias("delete_rows"))
    return data.join(F.broadcast(gone))  # one row each


@query(f"{WITH_FILES}, {X.MANIFESTS_SQL} SELECT count(*) AS manifests, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (length < 20000) AS undersized, count(*) FILTER (content = 'deletes') AS delete_manifests FROM manifests")
def manifest_health(spark, sf_dir):
    return H.manifest_health(X.manifests(spark, sf_dir), 20_000)


@query(f"WITH {X.SNAPSHOTS_SQL} SELECT count(*) AS snapshots, arg_max(snapshot_id, timestamp_ms) AS current_id, CASE WHEN min(timestamp_ms) <= {X.NOW_MS} THEN {X.NOW_MS} - min(timestamp_ms) END AS oldest_age_ms FROM snapshots")
def snapshot_health(spark, sf_dir):
    return H.snapshot_health(X.snapshots(spark, sf_dir), X.NOW_MS)


@query(f"{HEALTH_SQL} SELECT spec_id, part_key, small_files, small_ratio, large_files, small_files + large_files AS eligible_files, eligible_bytes, small_files * small_ratio AS fragmentation FROM rated WHERE data_files > 0")
def small_file_ratio(spark, sf_dir):
    return _health(spark, sf_dir).where("data_files > 0").select("spec_id", "part_key", "small_files", "small_ratio", "large_files", (F.col("small_files") + F.col("large_files")).alias("eligible_files"), "eligible_bytes", H.fragmentation(F.col("small_files"), F.col("small_ratio")).alias("fragmentation"))


@query(f"{WITH_FILES} SELECT path, file_size, CASE WHEN file_size > {X.LARGE} THEN 'large' WHEN file_size < {X.SMALL} THEN 'small' END AS band FROM files WHERE file_size > {X.LARGE} OR file_size < {X.SMALL}")
def size_eligible(spark, sf_dir):
    size = F.col("file_size")
    return X.files(spark, sf_dir).where((size > X.LARGE) | (size < X.SMALL)).select("path", "file_size", F.when(size > X.LARGE, "large").otherwise("small").alias("band"))


PLAN_SQL = f"""{HEALTH_SQL}, t AS (
  SELECT *, coalesce({X.NOW_MS} - newest_ms >= {X.MIN_AGE_MS}, true) AS settled, small_ratio >= {X.SMALL_RATIO} AND small_files + large_files >= {X.MIN_INPUTS} AS by_small, large_files > 0 AS by_oversized,
    position_deletes + equality_deletes > 0 AND delete_ratio >= {X.DELETE_RATIO} AS by_deletes,
    CASE WHEN position_deletes + equality_deletes > 0 THEN data_files ELSE small_files + large_files END AS inputs,
    CASE WHEN position_deletes + equality_deletes > 0 THEN data_bytes ELSE eligible_bytes END AS input_bytes
  FROM rated WHERE data_files > 0
), u AS (
  SELECT *, CASE WHEN input_bytes <= 0 THEN 0 ELSE greatest(1, CAST(ceil(floor(input_bytes * greatest(0.0, 1 - delete_ratio)) / {float(X.TARGET)}) AS BIGINT)) END AS outputs FROM t
), plan AS (
  SELECT *, CASE WHEN NOT settled THEN 'unsettled' WHEN NOT (by_small OR by_oversized OR by_deletes) THEN 'healthy' WHEN NOT (by_deletes OR by_oversized) AND outputs >= inputs THEN 'no gain'
    WHEN spec_id <> {X.CURRENT_SPEC} THEN 'superseded spec' ELSE 'compact' END AS decision FROM u
)"""
REASON_SQL = "CASE WHEN decision = 'compact' THEN CASE WHEN by_deletes THEN 'deletes' WHEN by_small THEN 'small files' ELSE 'oversized files' END END AS reason"


def _plan(spark, sf_dir):
    return planner.compaction(_health(spark, sf_dir), now_ms=X.NOW_MS, min_age_ms=X.MIN_AGE_MS, small_ratio=X.SMALL_RATIO, min_inputs=X.MIN_INPUTS, delete_ratio=X.DELETE_RATIO, target=X.TARGET, current_spec=X.CURRENT_SPEC)


@query(f"{PLAN_SQL} SELECT spec_id, part_key, settled, by_small, by_oversized, by_deletes, inputs, input_bytes, CAST(outputs AS BIGINT) AS outputs, decision, {REASON_SQL} FROM plan")
def planner_compaction_triggers(spark, sf_dir):
    return _plan(spark, sf_dir).select("spec_id", "part_key", "settled", "by_small", "by_oversized", "by_deletes", "inputs", "input_bytes", "outputs", "decision", "reason")


@query(f"{PLAN_SQL}, w AS (SELECT * FROM plan WHERE decision = 'compact') SELECT count(*) AS operations, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(inputs) AS BIGINT) AS input_files, CAST(sum(outputs) AS BIGINT) AS output_files FROM w")
def plan_totals(spark, sf_dir):
    return _plan(spark, sf_dir).where("decision = 'compact'").agg(F.count("*").alias("operations"), F.sum("input_bytes").cast("bigint").alias("input_bytes"), F.sum("inputs").cast("bigint").alias("input_files"), F.sum("outputs").cast("bigint").alias("output_files"))


@query(f"""{PLAN_SQL} SELECT part_key, CASE WHEN by_deletes THEN 'delete ratio ' || round(delete_ratio, 3) || ' is at least {X.DELETE_RATIO}' WHEN by_small THEN small_files || ' of ' || data_files || ' files are under {X.SMALL} bytes'
  ELSE large_files || ' files are over {X.LARGE} bytes' END AS reason_text FROM plan WHERE decision = 'compact'""")
def plan_reasons(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    text = (
        F.when(F.col("by_deletes"), F.concat(F.lit("delete ratio "), F.round("delete_ratio", 3).cast("string"), F.lit(f" is at least {X.DELETE_RATIO}")))
        .when(F.col("by_small"), F.concat(s("small_files"), F.lit(" of "), s("data_files"), F.lit(f" files are under {X.SMALL} bytes")))
        .otherwise(F.concat(s("large_files"), F.lit(f" files are over {X.LARGE} bytes")))
    )
    return _plan(spark, sf_dir).where("decision = 'compact'").select("part_key", text.alias("reason_text"))


@query(f"{HEALTH_SQL} SELECT spec_id, part_key, CASE WHEN data_bytes <= 0 THEN 0 ELSE greatest(1, CAST(ceil(floor(data_bytes * greatest(0.0, 1 - delete_ratio)) / {float(X.TARGET)}) AS BIGINT)) END AS outputs FROM rated")
def output_estimate(spark, sf_dir):
    return _health(spark, sf_dir).select("spec_id", "part_key", H.output_estimate(F.col("data_bytes"), F.col("delete_ratio"), X.TARGET).alias("outputs"))


@query(f"{WITH_FILES}, {X.MANIFESTS_SQL} SELECT count(*) FILTER (length < 20000) AS undersized, CASE WHEN count(*) FILTER (length < 20000) >= 100 THEN greatest(1, CAST(ceil(sum(length) / 20000.0) AS BIGINT)) END AS outputs FROM manifests")
def planner_manifest_trigger(spark, sf_dir):
    return H.manifest_health(X.manifests(spark, sf_dir), 20_000).select("undersized", planner.rewrite_manifests(F.col("undersized"), F.col("bytes"), 100, 20_000).alias("outputs"))


@query(f"WITH {X.SNAPSHOTS_SQL} SELECT count(*) AS snapshots, CASE WHEN count(*) > {X.RETAIN} AND {X.NOW_MS} - min(timestamp_ms) > {X.AGE_DAYS * 86_400_000} THEN count(*) - {X.RETAIN} END AS may_go FROM snapshots")
def planner_expiration_trigger(spark, sf_dir):
    return H.snapshot_health(X.snapshots(spark, sf_dir), X.NOW_MS).select("snapshots", planner.expire(F.col("snapshots"), F.col("oldest_age_ms"), X.RETAIN, X.AGE_DAYS * 86_400_000).cast("bigint").alias("may_go"))


@query(f"SELECT user_id AS table_id, max(epoch_us(ts) // 1000) AS last_ms, count(*) FILTER (event_type = 'purchase') > 0 AND coalesce({1_704_067_200_000} - max(epoch_us(ts) // 1000) FILTER (event_type = 'error') >= 86400000, true) AS due FROM events GROUP BY user_id")
def orphan_cadence(spark, sf_dir):
    rows = X.changes(spark, sf_dir).groupBy("table_id").agg(F.max(F.floor(F.col("at_us") / 1000)).cast("bigint").alias("last_ms"), F.max(F.when(F.col("kind") == "error", F.floor(F.col("at_us") / 1000))).cast("bigint").alias("scan_ms"), F.count_if(F.col("kind") == "purchase").alias("n"))
    return rows.select("table_id", "last_ms", planner.scan_orphans(F.col("n") > 0, F.col("scan_ms"), 1_704_067_200_000, 86_400_000).alias("due"))


PAIRS_SQL = f"""{WITH_BOTH}, pairs AS (
  SELECT f.path, f.spec_id, f.part_key, f.seq, f.file_size, f.record_count, d.path AS delete_path, d.content, d.seq AS delete_seq FROM files f JOIN deletes d
    ON (f.spec_id = d.spec_id AND f.part_key = d.part_key AND CASE WHEN d.content = 'equality' THEN d.seq > f.seq ELSE d.seq >= f.seq END)
    OR (d.part_key IS NULL AND d.content = 'equality' AND d.seq > f.seq)
)"""


def _pairs(spark, sf_dir):
    return D.applicable(X.files(spark, sf_dir), X.deletes(spark, sf_dir))


def _with_counts(spark, sf_dir):
    """Data files with how many deletes apply to them."""
    counted = D.delete_counts(shared(X.files(spark, sf_dir), "files"), X.deletes(spark, sf_dir))
    return counted.withColumn("n_deletes", F.col("equality") + F.col("position")).drop("equality", "position", "newest")


COUNTED_SQL = f"{PAIRS_SQL}, counted AS (SELECT f.*, coalesce(p.n, 0) AS n_deletes FROM files f LEFT JOIN (SELECT path, count(*) AS n FROM pairs GROUP BY path) p ON p.path = f.path)"


@query(f"{PAIRS_SQL} SELECT path, count(*) FILTER (content = 'equality') AS equality, count(*) FILTER (content = 'position') AS position, max(delete_seq) AS newest FROM pairs GROUP BY path")
def delete_applicability(spark, sf_dir):
    return D.delete_counts(X.files(spark, sf_dir), X.deletes(spark, sf_dir)).where("equality + position > 0").select("path", "equality", "position", "newest")


@query(f"{COUNTED_SQL} SELECT path, file_size, n_deletes FROM counted WHERE n_deletes > 0 OR file_size < {X.SMALL} OR file_size > {X.LARGE}")
def files_with_deletes_eligible(spark, sf_dir):
    return _with_counts(spark, sf_dir).where((F.col("n_deletes") > 0) | (F.col("file_size") < X.SMALL) | (F.col("file_size") > X.LARGE)).select("path", "file_size", "n_deletes")


def _orders(spark, sf_dir, *columns):
    return X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *columns)


def _gone_customers(spark, sf_dir):
    return X.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey)")
def eqdel_single_key(spark, sf_dir):
    return D.without_keys(_orders(spark, sf_dir), _gone_customers(spark, sf_dir), [("o_custkey", "c_custkey")])


NULLED = "SELECT o_orderkey, nullif(o_custkey % 10, 0) AS k FROM orders"


@query(f"SELECT o_orderkey, k FROM ({NULLED}) o WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT nullif(c_custkey % 10, 0) AS k FROM customer WHERE c_custkey % 10 IN (0, 3, 7)) c WHERE c.k IS NOT DISTINCT FROM o.k)")
def eqdel_null_safe(spark, sf_dir):
    keyed = _orders(spark, sf_dir).select("o_orderkey", F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("k"))
    gone = X.table(spark, sf_dir, "customer").where("c_custkey % 10 in (0, 3, 7)").select(F.nullif(F.col("c_custkey") % 10, F.lit(0)).alias("d"))
    return D.without_keys(keyed, gone, [("k", "d")])


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey)
  AND o_orderpriority NOT IN (SELECT min(o_orderpriority) FROM orders)""")
def eqdel_chained_keys(spark, sf_dir):
    orders = _orders(spark, sf_dir, "o_orderpriority")
    first = D.without_keys(orders, _gone_customers(spark, sf_dir), [("o_custkey", "c_custkey")])
    return D.without_keys(first, orders.agg(F.min("o_orderpriority").alias("p")), [("o_orderpriority", "p")])


@query("""SELECT o_orderkey, o_custkey, o_orderkey % 97 AS seq FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey AND o.o_orderkey % 97 < c.c_custkey % 97)""")
def eqdel_sequence_aware(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("seq", F.col("o_orderkey") % 97)
    gone = _gone_customers(spark, sf_dir).withColumn("dseq", F.col("c_custkey") % 97)
    return D.without_newer_keys(rows, gone, [("o_custkey", "c_custkey")], "seq", "dseq")


@query("""WITH l AS (SELECT l_suppkey AS file_no, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem)
SELECT file_no, l_orderkey, l_linenumber, pos FROM l WHERE NOT EXISTS (SELECT 1 FROM partsupp_deletes d WHERE d.file = l.file_no AND d.pos = l.pos)""".replace("partsupp_deletes", "(SELECT s_suppkey AS file, unnest(range(0, s_suppkey % 7 * 3, 3)) AS pos FROM supplier)"))
def posdel_row_selection(spark, sf_dir):
    lines = X.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_no"), "l_orderkey", "l_linenumber", "l_partkey")
    placed = lines.withColumn("pos", (F.row_number().over(Window.partitionBy("file_no").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1).cast("bigint")).drop("l_partkey")
    gone = X.table(spark, sf_dir, "supplier").where("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("file"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s_suppkey") % 7 * 3 - 3, F.lit(3).cast("bigint"))).alias("pos"))
    return D.without_positions(placed, gone, "file_no", "pos")


@query(f"""{PAIRS_SQL} SELECT DISTINCT delete_path, CAST(NULL AS BIGINT) AS content_offset FROM pairs p WHERE part_key % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.delete_path = p.delete_path AND q.part_key % 2 <> 0)""")
def retirable_deletes(spark, sf_dir):
    """Deletes that are done with once the files of all even months are rewritten."""
    found = _pairs(spark, sf_dir).withColumn("content_offset", F.lit(None).cast("bigint"))
    inside = F.col("part_key") % 2 == 0
    return D.retirable(found.where(inside), found.where(~inside))


@query("""WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 9223372036854775807 ELSE s_suppkey * 1000003 END AS target FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 6917529027641081856 ELSE CAST(floor(target * 0.75::DOUBLE) AS BIGINT) END AS small, CASE WHEN s_suppkey % 10 = 0 THEN 9223372036854775807 ELSE CAST(floor(target * 1.8::DOUBLE) AS BIGINT) END AS large,
  greatest(1, CAST(floor(s_suppkey * 1000 / CAST(256 + 48 * (s_suppkey % 20) AS DOUBLE)) AS BIGINT)) AS entries FROM t""")
def size_thresholds(spark, sf_dir):
    key = F.col("s_suppkey").cast("bigint")
    rows = X.table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 10 == 0, F.lit(2**63 - 1)).otherwise(key * 1_000_003).alias("target"))
    return rows.select("s_suppkey", values.small_threshold(F.col("target")).alias("small"), values.large_threshold(F.col("target")).alias("large"), values.entries_per_manifest(key * 1000, key % 20).alias("entries"))


@query(f"""{WITH_FILES}, {X.SNAPSHOTS_SQL}, e AS (SELECT part_key, file_size, CASE WHEN file_no % 10 = 9 THEN 2 ELSE file_no % 2 END AS status, CASE WHEN file_no % 7 <> 0 THEN CAST(part_key AS BIGINT) END AS snapshot_id FROM files)
SELECT part_key, count(*) AS live, count(timestamp_ms) AS dated, max(timestamp_ms) AS newest_ms FROM e LEFT JOIN snapshots USING (snapshot_id) WHERE status <> 2 GROUP BY part_key""")
def live_entries_dated(spark, sf_dir):
    no = F.col("file_no")
    entries = X.files(spark, sf_dir).select("part_key", F.when(no % 10 == 9, 2).otherwise((no % 2).cast("int")).alias("status"), F.when(no % 7 != 0, F.col("part_key").cast("bigint")).alias("snapshot_id"))
    dated = H.live_and_dated(entries, X.snapshots(spark, sf_dir))
    return dated.groupBy("part_key").agg(F.count("*").alias("live"), F.count("dated_ms").alias("dated"), F.max("dated_ms").alias("newest_ms"))


@query("""WITH t AS (SELECT 's3://lake/wh/' || n_regionkey || CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN '/' || n_name ELSE 'x/' || n_name END AS location FROM nation)
SELECT DISTINCT a.location, b.location AS inside FROM t a JOIN t b ON starts_with(b.location, a.location || '/')""")
def nested_sibling_tables(spark, sf_dir):
    n = F.col("n_nationkey") % 3
    tail = F.when(n == 0, F.lit("/")).when(n == 1, F.concat(F.lit("//"), "n_name")).otherwise(F.concat(F.lit("x/"), "n_name"))
    return R.nested_siblings(X.table(spark, sf_dir, "nation").select(F.concat(F.lit("s3a://lake/wh/"), F.col("n_regionkey").cast("string"), tail).alias("location")))


@query("""WITH e AS (SELECT event_id, event_id % 6 AS shape, CASE event_type WHEN 'view' THEN 'updateTable' WHEN 'click' THEN 'createTable' WHEN 'error' THEN 'dropTable' ELSE 'registerTable' END AS type, 't' || user_id AS name FROM events)
SELECT event_id, CASE WHEN shape IN (1, 2) AND type = 'dropTable' OR shape = 3 THEN 'ignored' WHEN shape >= 4 THEN 'refused' ELSE 'table' END AS outcome,
  CASE WHEN shape = 0 THEN 'own' WHEN shape IN (1, 2) AND type <> 'dropTable' THEN 'main' END AS catalog, CASE WHEN shape = 0 OR (shape IN (1, 2) AND type <> 'dropTable') THEN 'a.b' END AS space,
  CASE WHEN shape = 0 OR (shape IN (1, 2) AND type <> 'dropTable') THEN name END AS "table" FROM e""")
def notification_filter(spark, sf_dir):
    """Notifications in every shape: a table's own, cloud events in a body and in headers, of views, without a query, malformed."""
    shape, kind = F.col("event_id") % 6, F.col("event_type")
    of = F.when(kind == "view", "updateTable").when(kind == "click", "createTable").when(kind == "error", "dropTable").otherwise("registerTable")
    name, q = F.concat(F.lit("t"), F.col("user_id").cast("string")), F.lit('"')
    cloud = lambda tail: F.concat(F.lit('{"specversion":"1.0","type":"'), of, F.lit('","namespace":"a\\u001fb","name":"'), name, F.lit(f'"{tail}}}'))
    body = F.when(shape == 0, F.concat(F.lit('{"catalog":"own","namespace":["a","b"],"table":"'), name, F.lit('"}'))).when(shape == 1, cloud("")).when(shape == 3, cloud(',"tabular-type":"view"')).when(shape == 4, F.concat(q, name)).when(shape == 5, cloud(',"tabular-type":"table","type":1'))
    headers = F.when(shape == 2, F.create_map(F.lit("ce-specversion"), F.lit("1.0"), F.lit("ce-type"), of, F.lit("ce-tabular-type"), F.lit("table"), F.lit("ce-namespace"), F.lit("a\x1fb"), F.lit("ce-name"), name))
    rows = X.table(spark, sf_dir, "events").select("event_id", body.alias("body"), headers.alias("headers"), F.when(shape > 0, F.lit("x=1&catalog=main")).alias("query"))
    return N.notified(rows).select("event_id", "outcome", "catalog", F.array_join("namespace", ".").alias("space"), "table")


GROUP_FILES_NO, POSITION_SEQ, SUPPLIER_SEQ, LINE_SEQ = 8, 5, 6, 4
#: Lines in a data file of the group; a file that the SQL numbers is as many of them, one after the other, as that takes.
FILE_LINES = 500_000
GROUP_SQL = f"""WITH l AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_suppkey % {GROUP_FILES_NO} AS file_no,
         row_number() OVER (PARTITION BY l_suppkey % {GROUP_FILES_NO} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem
), live AS (
  SELECT * FROM l WHERE NOT (pos % 7 = 0 AND pos < 700 AND file_no % 3 = 1 AND {POSITION_SEQ} >= file_no + 1)
    AND NOT (l_suppkey % 5 = 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND file_no + 1 < {SUPPLIER_SEQ})
    AND NOT (l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0) AND file_no + 1 < {LINE_SEQ})
)"""


def _group(spark, sf_dir):
    """A group of data files with its delete files, all written into the shared folder: (live rows with lineage, data files)."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    lines = X.table(spark, sf_dir, "lineitem").select(*columns, (F.col("l_suppkey") % GROUP_FILES_NO).cast("int").alias("file_no"))
    at = shared_path(spark, "group")
    order = ["file_no", *columns[:4]]
    lines.repartitionByRange(max(GROUP_FILES_NO, -(-lines.count() // FILE_LINES)), *order).sortWithinPartitions(*order).write.partitionBy("file_no").parquet(f"{at}/data")
    data = spark.read.parquet(f"{at}/data").groupBy("file_no", F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("record_count"))
    earlier = lambda *by: F.coalesce(F.sum("record_count").over(Window.partitionBy(*by).orderBy("file_no", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")  # noqa: E731; one row per file
    tasks = shared(data.select("path", "record_count", "file_no", (F.col("file_no") + 1).cast("bigint").alias("seq"), earlier().alias("first_row_id"), earlier("file_no").alias("offset")), "group-files")
    by_position = tasks.where("file_no % 3 = 1 and offset < 700").select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(699).cast("bigint"), F.lit(7).cast("bigint"))).alias("at"), "offset", "record_count", F.lit(POSITION_SEQ).alias("seq"))
    by_position.where("at >= offset and at < offset + record_count").select("file", (F.col("at") - F.col("offset")).alias("pos"), "seq").write.parquet(f"{at}/positions")
    X.table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(SUPPLIER_SEQ).alias("seq")).write.parquet(f"{at}/by-supplier")
    X.table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(LINE_SEQ).alias("seq")).write.parquet(f"{at}/by-line")
    schema = lines.select(columns).schema
    W.check_sort_columns(schema, ["l_shipdate", "l_quantity", *columns[:4]])
    found = tasks.collect()  # a group's files, whose number is bounded
    rows = W.scan(spark, tasks, schema, [r.path for r in found])
    keyed = {("l_suppkey",): spark.read.parquet(f"{at}/by-supplier"), ("l_orderkey", "l_linenumber"): spark.read.parquet(f"{at}/by-line")}
    return W.staged_live(rows, spark.read.parquet(f"{at}/positions"), keyed), found


def _rewritten(spark, sf_dir):
    """(rows read back with their place in the order, rows produced, data files)."""
    out, found = _group(spark, sf_dir)
    produced, of = out.count(), sum(r.record_count for r in found)
    order = [F.col("l_shipdate").asc_nulls_first(), F.col("l_quantity").desc_nulls_last(), *[F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]]
    path = shared_path(spark, "rewritten")
    W.write_sorted(out, path, order, -(-len(found) * produced // max(1, of) // 2), W.writer_options({W.CODEC: "zstd", "write.parquet.page-size-bytes": "65536"}))
    return W.in_order(spark, path, out.schema), produced, found


@query(f"""{GROUP_SQL}, f AS (SELECT file_no, count(*) AS n FROM l GROUP BY file_no), b AS (SELECT file_no, coalesce(sum(n) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(first + pos AS BIGINT) AS row_id, CAST(file_no + 1 AS BIGINT) AS updated_seq,
  row_number() OVER (ORDER BY l_shipdate ASC NULLS FIRST, l_quantity DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ordinal FROM live JOIN b USING (file_no)""")
def rewrite_group(spark, sf_dir):
    """Real Parquet files, rewritten: positions and two sets of equality keys applied, sorted, written, and read back."""
    rows, _, _ = _rewritten(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col(W.ROW_ID).alias("row_id"), F.col(W.UPDATED).alias("updated_seq"), "ordinal")


@query(f"""{GROUP_SQL} SELECT (SELECT count(*) FROM live) AS produced, (SELECT count(*) FROM live) AS persisted, (SELECT count(*) FROM l WHERE file_no + 1 >= {SUPPLIER_SEQ}) AS floor,
(SELECT count(*) FROM l) AS ceiling, CAST(NULL AS VARCHAR) AS violation""")
def rewrite_contract(spark, sf_dir):
    """The rows that the rewrite produced and wrote against the fewest and the most that its inputs allow."""
    rows, produced, found = _rewritten(spark, sf_dir)
    free = sum(r.record_count for r in found if r.seq >= SUPPLIER_SEQ > POSITION_SEQ > LINE_SEQ)  # no delete file applies
    return W.outcome(produced, rows, free, sum(r.record_count for r in found))


DEAD_SQL = f"""{PAIRS_SQL}, floors AS (SELECT spec_id, part_key, min(seq) AS floor FROM files GROUP BY ALL), judged AS (
  SELECT d.*, CASE WHEN fl IS NULL THEN true WHEN content = 'equality' THEN seq <= fl ELSE seq < fl END AS dead FROM (
    SELECT d.*, CASE WHEN d.part_key IS NULL AND d.content = 'equality' THEN (SELECT min(floor) FROM floors) ELSE f.floor END AS fl
    FROM deletes d LEFT JOIN floors f ON f.spec_id = d.spec_id AND f.part_key = d.part_key) d
)"""


@query(f"{DEAD_SQL} SELECT path, dead FROM judged")
def dangling_by_sequence(spark, sf_dir):
    return D.dead_by_sequence(X.files(spark, sf_dir), X.deletes(spark, sf_dir)).select("path", "dead")


@query(f"{DEAD_SQL} SELECT path, content, seq FROM judged WHERE dead AND path NOT IN (SELECT delete_path FROM pairs)")
def dangling_deletes(spark, sf_dir):
    return D.dangling(X.files(spark, sf_dir), X.deletes(spark, sf_dir)).select("path", "content", "seq")


@query(f"{COUNTED_SQL} SELECT spec_id, part_key, CAST(sum(record_count) AS BIGINT) AS ceiling, CAST(sum(CASE WHEN n_deletes = 0 THEN record_count ELSE 0 END) AS BIGINT) AS floor FROM counted GROUP BY ALL")
def row_count_contract(spark, sf_dir):
    return O.row_contract(_with_counts(spark, sf_dir), "spec_id", "part_key")


@query(f"{PAIRS_SQL} SELECT path, string_agg(DISTINCT delete_path, ',' ORDER BY delete_path) AS delete_set, count(DISTINCT delete_path) AS n_deletes FROM pairs WHERE content = 'equality' GROUP BY path")
def bucket_by_delete_set(spark, sf_dir):
    return D.delete_sets(_pairs(spark, sf_dir))


PACK_SQL = f"""{COUNTED_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS (
  SELECT *, row_number() OVER (PARTITION BY spec_id, part_key ORDER BY file_size, path) AS r FROM counted WHERE n_deletes > 0 OR file_size < {X.SMALL} OR file_size > {X.LARGE}
), packed AS (
  SELECT spec_id, part_key, r, path, file_size, n_deletes, file_size AS bytes, 1 AS n, 0 AS g FROM o WHERE r = 1
  UNION ALL
  SELECT o.spec_id, o.part_key, o.r, o.path, o.file_size, o.n_deletes, CASE WHEN p.bytes + o.file_size > {X.GROUP_BYTES} OR p.n >= {X.GROUP_FILES} THEN o.file_size ELSE p.bytes + o.file_size END,
    CASE WHEN p.bytes + o.file_size > {X.GROUP_BYTES} OR p.n >= {X.GROUP_FILES} THEN 1 ELSE p.n + 1 END, CASE WHEN p.bytes + o.file_size > {X.GROUP_BYTES} OR p.n >= {X.GROUP_FILES} THEN p.g + 1 ELSE p.g END
  FROM packed p JOIN o ON o.spec_id = p.spec_id AND o.part_key = p.part_key AND o.r = p.r + 1
)"""


def _packed(spark, sf_dir):
    eligible = _with_counts(spark, sf_dir).where((F.col("n_deletes") > 0) | (F.col("file_size") < X.SMALL) | (F.col("file_size") > X.LARGE))
    return G.next_fit(eligible, X.GROUP_BYTES, X.GROUP_FILES)


@query(f"{PACK_SQL} SELECT spec_id, part_key, path, file_size, CAST(g AS BIGINT) AS group_no, n_deletes FROM packed")
def pack_groups(spark, sf_dir):
    return _packed(spark, sf_dir).select("spec_id", "part_key", "path", "file_size", "group_no", "n_deletes")


@query(f"""{PACK_SQL}, gs AS (
  SELECT spec_id, part_key, g, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(n_deletes) AS BIGINT) AS deletes, max(file_size) AS largest FROM packed GROUP BY ALL
), kept AS (
  SELECT spec_id, part_key, row_number() OVER (PARTITION BY spec_id, part_key ORDER BY g) - 1 AS group_index, files, bytes, deletes, greatest(1, abs(files - CAST(ceil(bytes / {float(X.TARGET)}) AS BIGINT)) + deletes) AS benefit
  FROM gs WHERE files > 1 OR deletes > 0 OR largest > {X.LARGE}
) SELECT *, row_number() OVER (ORDER BY benefit / CAST(greatest(bytes, 1) AS DOUBLE) DESC, spec_id, part_key, group_index) AS rank FROM kept""")
def rank_groups(spark, sf_dir):
    return G.ranked(G.worthwhile(_packed(spark, sf_dir), X.TARGET, X.LARGE))


@query(f"""{PLAN_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, c AS (
  SELECT CAST(part_key AS VARCHAR) AS name, small_files * small_ratio AS score, CASE WHEN decision = 'compact' THEN input_bytes ELSE 0 END AS cost FROM plan
), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS r FROM c), b AS (
  SELECT name, score, cost, r, cost = 0 OR cost <= {X.BUDGET} AS kept, CASE WHEN cost <= {X.BUDGET} THEN cost ELSE 0 END AS spent FROM o WHERE r = 1
  UNION ALL SELECT o.name, o.score, o.cost, o.r, o.cost = 0 OR b.spent + o.cost <= {X.BUDGET}, CASE WHEN b.spent + o.cost <= {X.BUDGET} THEN b.spent + o.cost ELSE b.spent END FROM b JOIN o ON o.r = b.r + 1
) SELECT name, score, cost, kept FROM b""")
def budget_deferral(spark, sf_dir):
    plans = _plan(spark, sf_dir).select(F.col("part_key").cast("string").alias("name"), H.fragmentation(F.col("small_files"), F.col("small_ratio")).alias("score"), F.when(F.col("decision") == "compact", F.col("input_bytes")).otherwise(0).alias("cost"))
    return G.within_budget(plans, X.BUDGET).select("name", "score", "cost", "kept")


@query("""SELECT o_orderkey, nullif(o_custkey % 10, 0) AS k, row_number() OVER (ORDER BY nullif(o_custkey % 10, 0) ASC NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey) AS ordinal FROM orders""")
def global_sort_nulls(spark, sf_dir):
    """The order of all rows, by a range exchange and sorts within: ordinals are offsets of ranges plus local ones."""
    rows = _orders(spark, sf_dir, "o_totalprice").select("o_orderkey", F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("k"), "o_totalprice")
    order = [F.col("k").asc_nulls_first(), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()]
    placed = rows.repartitionByRange(16, *order).sortWithinPartitions(*order).select("o_orderkey", "k", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"))
    before = placed.groupBy("p").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before), "p").select("o_orderkey", "k", (F.col("offset") + F.col("i") + 1).cast("bigint").alias("ordinal"))


ENTRIES_SQL = "entries AS (SELECT spec_id, part_key, file_no % 4 AS manifest_pos, file_no AS entry_pos FROM files)"


@query(f"{WITH_FILES}, {ENTRIES_SQL} SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY part_key, manifest_pos, entry_pos) - 1 AS position FROM entries")
def cluster_entries(spark, sf_dir):
    return G.clustered(_entries(spark, sf_dir), 26).drop("manifest_no")


@query(f"{WITH_FILES}, {ENTRIES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY part_key, manifest_pos, entry_pos) - 1 AS position FROM entries) SELECT spec_id, position // 26 AS manifest_no, count(*) AS entries, min(part_key) AS first_part, max(part_key) AS last_part FROM c GROUP BY ALL")
def chunk_manifests(spark, sf_dir):
    return G.clustered(_entries(spark, sf_dir), 26).groupBy("spec_id", "manifest_no").agg(F.count("*").alias("entries"), F.min("part_key").alias("first_part"), F.max("part_key").alias("last_part"))


def _entries(spark, sf_dir):
    return X.files(spark, sf_dir).select("spec_id", "part_key", (F.col("file_no") % 4).alias("manifest_pos"), F.col("file_no").alias("entry_pos"))


def norm_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '^s3[an]?://', 's3://'), '([^:])/{{2,}}', '\\1/', 'g'), '/+$', '')"


REACH_SQL = f"""{WITH_BOTH}, {X.MANIFESTS_SQL}, {X.SNAPSHOTS_SQL}, {X.LISTING_SQL}, reach AS (
  SELECT 'data' AS kind, path AS norm_path FROM files UNION SELECT 'data', path FROM deletes UNION SELECT 'metadata', path FROM manifests
  UNION SELECT 'metadata', '{X.LOCATION}/metadata/snap-' || snapshot_id || '.avro' FROM snapshots UNION SELECT 'statistics', '{X.LOCATION}/metadata/stats-' || snapshot_id || '.puffin' FROM snapshots WHERE snapshot_id % 2 = 0
  UNION SELECT 'metadata_json', '{X.LOCATION}/metadata/v' || snapshot_id || '.metadata.json' FROM snapshots UNION SELECT 'metadata_json', '{X.LOCATION}/metadata/version-hint.text'
)"""


def _metadata_paths(snapshots):
    name = lambda head, tail: F.concat(F.lit(f"{X.LOCATION}/metadata/{head}"), F.col("snapshot_id").cast("string"), F.lit(tail)).alias("path")
    hint = snapshots.sparkSession.createDataFrame([(f"{X.LOCATION}/metadata/version-hint.text",)], "path string")
    return snapshots.select(name("snap-", ".avro")), snapshots.where("snapshot_id % 2 = 0").select(name("stats-", ".puffin")), snapshots.select(name("v", ".metadata.json")).unionByName(hint)


def _relations(spark, sf_dir):
    """(data files, delete files, snapshots), each written once: what a table reaches is asked of them several times."""
    return shared(X.files(spark, sf_dir), "files"), shared(X.deletes(spark, sf_dir), "deletes"), shared(X.snapshots(spark, sf_dir), "snapshots")


def _reach(spark, sf_dir, files, deletes, snapshots):
    lists, statistics, documents = _metadata_paths(snapshots)
    return R.reachable(files.select("path").unionByName(deletes.select("path")), X.manifests(spark, sf_dir, files).select("path"), lists, statistics, documents)


@query(f"{REACH_SQL} SELECT DISTINCT kind, norm_path FROM reach")
def reachable_set(spark, sf_dir):
    return _reach(spark, sf_dir, *_relations(spark, sf_dir))


KEPT_MONTHS = 24
EXPIRE_SQL = f"""{REACH_SQL}, live AS (SELECT * FROM snapshots ORDER BY snapshot_id DESC LIMIT {KEPT_MONTHS}), after AS (
  SELECT path AS norm_path FROM files WHERE part_key >= (SELECT min(oldest_part) FROM live) UNION SELECT path FROM deletes WHERE part_key IS NULL OR part_key >= (SELECT min(oldest_part) FROM live)
  UNION SELECT path FROM manifests WHERE part_key >= (SELECT min(oldest_part) FROM live) UNION SELECT '{X.LOCATION}/metadata/snap-' || snapshot_id || '.avro' FROM live UNION SELECT '{X.LOCATION}/metadata/stats-' || snapshot_id || '.puffin' FROM live WHERE snapshot_id % 2 = 0
)"""


@query(f"{EXPIRE_SQL} SELECT norm_path FROM (SELECT norm_path FROM reach WHERE kind <> 'metadata_json' EXCEPT SELECT norm_path FROM after)")
def expire_cleanup(spark, sf_dir):
    """What goes when only the newest 24 snapshots stay."""
    files, deletes, snapshots = _relations(spark, sf_dir)
    live = snapshots.orderBy(F.col("snapshot_id").desc()).limit(KEPT_MONTHS)
    oldest = F.broadcast(live.agg(F.min("oldest_part").alias("oldest")))
    still = lambda df: df.join(oldest).where("part_key is null or part_key >= oldest").select("path")
    lists, statistics, documents = _metadata_paths(live)
    after = R.reachable(still(files).unionByName(still(deletes)), still(X.manifests(spark, sf_dir, files)), lists, statistics, documents)
    return R.now_unreachable(_reach(spark, sf_dir, files, deletes, snapshots), after, X.LOCATION)


@query(f"""WITH {X.SNAPSHOTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY snapshot_id DESC) - 1 AS depth, snapshot_id = max(snapshot_id) OVER () AS head FROM snapshots)
SELECT snapshot_id, CAST(depth AS INT) AS depth, depth < {X.RETAIN} OR {X.NOW_MS} - timestamp_ms <= {400 * 86_400_000} OR head AS kept FROM r""")
def snapshots_to_expire(spark, sf_dir):
    snapshots = X.snapshots(spark, sf_dir)
    head = F.broadcast(snapshots.agg(F.max("snapshot_id").alias("last")))
    marked = snapshots.join(head).withColumn("head", F.col("snapshot_id") == F.col("last"))
    return R.retained(marked, X.NOW_MS, 400 * 86_400_000, X.RETAIN).select("snapshot_id", "depth", "kept")


CUTOFF = X.NOW_MS - X.AGE_DAYS * 86_400_000
ORPHAN_SQL = f"""{REACH_SQL}, l AS (SELECT path, {norm_sql('path')} AS norm_path, size, modified_ms FROM listing), judged AS (
  SELECT l.*, CASE WHEN r.norm_path IS NOT NULL THEN 'reachable' WHEN NOT starts_with(l.norm_path, '{X.LOCATION}/') THEN 'outside' WHEN modified_ms IS NULL THEN 'undated' WHEN modified_ms > {CUTOFF} THEN 'young' ELSE 'orphan' END AS status
  FROM l LEFT JOIN (SELECT DISTINCT norm_path FROM reach) r ON r.norm_path = l.norm_path
)"""


def _judged(spark, sf_dir):
    files, deletes, snapshots = _relations(spark, sf_dir)
    return R.orphans(X.listing(spark, sf_dir, files), _reach(spark, sf_dir, files, deletes, snapshots), X.LOCATION, CUTOFF)


@query(f"{ORPHAN_SQL} SELECT path, norm_path, size, modified_ms, status FROM judged")
def orphan_candidates(spark, sf_dir):
    return _judged(spark, sf_dir)


@query(f"{ORPHAN_SQL} SELECT count(*) AS scanned, count(*) FILTER (status = 'reachable') AS observed, count(*) > 0 AND count(*) FILTER (status = 'reachable') = 0 AS refused FROM judged")
def orphan_overlap(spark, sf_dir):
    return R.refusal(_judged(spark, sf_dir), True)


@query(f"{ORPHAN_SQL} SELECT norm_path FROM judged WHERE status = 'orphan' AND norm_path NOT IN (SELECT '{X.LOCATION}/data/abandoned/' || p_partkey || '.parquet' FROM part WHERE p_size % 7 = 0)")
def orphan_reverify(spark, sf_dir):
    """Candidates that a fresh reachable set, which now holds some of them, still does not reach."""
    fresh = X.table(spark, sf_dir, "part").where("p_size % 7 = 0").select(paths.normalize(F.concat(F.lit(f"{X.LOCATION}/data/abandoned/"), F.col("p_partkey").cast("string"), F.lit(".parquet"))).alias("norm_path"))
    return _judged(spark, sf_dir).where("status = 'orphan'").select("norm_path").join(fresh, "norm_path", "left_anti")


@query(f"{ORPHAN_SQL} SELECT norm_path FROM judged WHERE status = 'orphan' ORDER BY norm_path LIMIT {X.DELETE_CEILING}")
def orphan_ceiling(spark, sf_dir):
    return R.below_ceiling(_judged(spark, sf_dir).where("status = 'orphan'").select("norm_path"), X.DELETE_CEILING)


@query(f"""WITH l AS (SELECT '{X.LOCATION}/' || CASE WHEN p_size % 3 = 0 THEN p_brand || '/inner/metadata/' ELSE 'metadata/' END || p_partkey || '.metadata.json' AS path FROM part)
SELECT '{X.LOCATION}/' || split_part(substr(path, {len(X.LOCATION) + 2}), '/metadata/', 1) AS root, count(*) AS documents FROM l WHERE contains(substr(path, {len(X.LOCATION) + 2}), '/metadata/') GROUP BY ALL""")
def nested_table_roots(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    path = F.concat(F.lit(f"{X.LOCATION}/"), F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit("/inner/metadata/"))).otherwise("metadata/"), F.col("p_partkey").cast("string"), F.lit(".metadata.json"))
    return R.foreign_roots(part.select(path.alias("path")), X.LOCATION)


@query(f"{WITH_FILES}, {X.LISTING_SQL} SELECT path, {norm_sql('path')} AS norm_path FROM listing")
def path_normalize(spark, sf_dir):
    return X.listing(spark, sf_dir).select("path", paths.normalize(F.col("path")).alias("norm_path"))


@query(f"{WITH_FILES}, {X.LISTING_SQL} SELECT path, starts_with({norm_sql('path')}, '{X.LOCATION}/data/abandoned/') AS inside FROM listing")
def path_inside(spark, sf_dir):
    return X.listing(spark, sf_dir).select("path", paths.is_inside(F.lit(f"s3a://{X.LOCATION.removeprefix('s3://')}/data/abandoned/"), F.col("path")).alias("inside"))


@query("""SELECT p_partkey, 'brand=' || replace(replace(CASE WHEN p_size % 9 = 0 THEN p_brand || '/' || p_type ELSE p_brand END, '%', '%25'), '/', '%2F') || '/kind=' ||
  CASE WHEN p_size % 11 = 0 THEN 'null' WHEN p_size % 13 = 0 THEN '%6Eull' WHEN p_size % 17 = 0 THEN '%61bsent' ELSE replace(replace(p_type, '%', '%25'), '/', '%2F') END
  || '/day=' || strftime(DATE '1970-01-01' + CAST(p_partkey % 20000 AS INT), '%Y-%m-%d') || '/last=absent' AS part_key FROM part""")
def partition_key_render(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    brand = F.when(F.col("p_size") % 9 == 0, F.concat("p_brand", F.lit("/"), "p_type")).otherwise(F.col("p_brand"))
    kind = F.when(F.col("p_size") % 11 == 0, F.lit(None)).when(F.col("p_size") % 13 == 0, "null").when(F.col("p_size") % 17 == 0, "absent").otherwise(F.col("p_type"))
    return part.select("p_partkey", paths.partition_key([("brand", brand, "identity"), ("kind", kind, "identity"), ("day", F.col("p_partkey") % 20000, "day"), ("last", None, "identity")]).alias("part_key"))


RULES = [("prod.EUROPE.GERMANY", "skip"), ("prod.A*.*", "maintain"), ("prod.**", "inspect")]


@query("""SELECT n_nationkey, 'prod/' || r_name || '/' || n_name AS name, CASE WHEN r_name = 'EUROPE' AND n_name = 'GERMANY' THEN 0 WHEN starts_with(r_name, 'A') THEN 1 ELSE 2 END AS rule,
  CASE WHEN r_name = 'EUROPE' AND n_name = 'GERMANY' THEN 'skip' WHEN starts_with(r_name, 'A') THEN 'maintain' ELSE 'inspect' END AS decision FROM nation JOIN region ON n_regionkey = r_regionkey""")
def policy_first_match(spark, sf_dir):
    nation, region = X.table(spark, sf_dir, "nation"), X.table(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", P.render_name(F.array(F.lit("prod"), F.col("r_name"), F.col("n_name"))).alias("name"))
    return P.first_match(named, RULES)


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN c_custkey END, CASE WHEN c_custkey % 5 = 0 THEN 5 END, CASE WHEN c_custkey % 3 = 0 THEN 3 END, 512) AS value,
  CASE WHEN c_custkey % 7 = 0 THEN 'rule' WHEN c_custkey % 5 = 0 THEN 'defaults' WHEN c_custkey % 3 = 0 THEN 'table property' ELSE 'engine default' END AS layer FROM customer""")
def policy_resolve(spark, sf_dir):
    key = F.col("c_custkey")
    layers = {"rule": F.when(key % 7 == 0, key), "defaults": F.when(key % 5 == 0, F.lit(5)), "catalog policy": F.lit(None), "table property": values.positive(F.when(key % 3 == 0, F.lit(" 3 ")).otherwise("0")), "engine default": F.lit(512)}
    value, layer = P.resolve(layers, list(layers))
    return X.table(spark, sf_dir, "customer").select("c_custkey", value.cast("bigint").alias("value"), layer.alias("layer"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%H:%M') >= '22:00' OR strftime(ts + INTERVAL 9 HOUR, '%H:%M') < '06:00' AS open FROM events")
def maintenance_window(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", values.in_window(F.col("ts").cast("timestamp"), "22:00", "06:00", "Asia/Tokyo").alias("open"))


HOUR_US = 3_600_000_000


@query(f"""WITH RECURSIVE e AS (SELECT event_type AS kind, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events), w AS (
  SELECT kind, t, r, t AS opened FROM e WHERE r = 1
  UNION ALL SELECT e.kind, e.t, e.r, CASE WHEN e.t >= w.opened + {HOUR_US} THEN e.t ELSE w.opened END FROM w JOIN e ON e.kind = w.kind AND e.r = w.r + 1
) SELECT kind, opened AS opened_at, count(*) AS events FROM w GROUP BY ALL""")
def event_debounce(spark, sf_dir):
    return debounce.windows(X.changes(spark, sf_dir), "kind", "at_us", HOUR_US)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50")
def event_json_filter(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k")).where("k >= 50")


@query(f"WITH {X.OUTCOMES_SQL} SELECT result, count(*) AS n, CAST(count(DISTINCT table_id) AS BIGINT) AS tables FROM outcomes GROUP BY result")
def metrics_counts(spark, sf_dir):
    return X.outcomes(spark, sf_dir).groupBy("result").agg(F.count("*").alias("n"), F.countDistinct("table_id").alias("tables"))


@query(f"WITH {X.OUTCOMES_SQL}, b AS (SELECT unnest(range(0, 13)) AS i) SELECT CASE WHEN i < 12 THEN pow(2.0, i) END AS bound, (SELECT count(*) FROM outcomes WHERE i = 12 OR took <= pow(2.0, i)) AS count FROM b")
def duration_histogram(spark, sf_dir):
    return O.histogram(X.outcomes(spark, sf_dir), "took")


CAP = 50


@query(f"""WITH {X.OUTCOMES_SQL}, f AS (SELECT table_id, row_number() OVER (ORDER BY min(at_us), table_id) AS r FROM outcomes GROUP BY table_id)
SELECT CASE WHEN r <= {CAP} THEN CAST(o.table_id AS VARCHAR) ELSE '<over-cardinality-cap>' END AS label, result, count(*) AS n FROM outcomes o JOIN f ON f.table_id = o.table_id GROUP BY ALL""")
def namespace_cap(spark, sf_dir):
    return O.capped_names(X.outcomes(spark, sf_dir), "table_id", "at_us", CAP).groupBy("label", "result").agg(F.count("*").alias("n"))


def _summary_sql() -> str:
    parts = []
    for gone, word in (("true", "removed"), ("false", "surviving")):
        for content in ("data", "position", "equality"):
            w = f"gone = {gone} AND content = '{content}'"
            parts += [f"count(*) FILTER ({w}) AS {word}_{content}_files", f"CAST(coalesce(sum(file_size) FILTER ({w}), 0) AS BIGINT) AS {word}_{content}_bytes", f"CAST(coalesce(sum(record_count) FILTER ({w}), 0) AS BIGINT) AS {word}_{content}_rows"]
    return f"""{COUNTED_SQL}, e AS (SELECT n_deletes > 0 OR file_size < {X.SMALL} AS gone, 'data' AS content, file_size, record_count FROM counted
      UNION ALL SELECT part_key IS NOT NULL, content, record_count * 8, record_count FROM deletes) SELECT {', '.join(parts)} FROM e"""


@query(_summary_sql())
def rewrite_summary(spark, sf_dir):
    data = _with_counts(spark, sf_dir).select(((F.col("n_deletes") > 0) | (F.col("file_size") < X.SMALL)).alias("gone"), F.lit("data").alias("content"), "file_size", "record_count")
    gone = X.deletes(spark, sf_dir).select(F.col("part_key").isNotNull().alias("gone"), "content", (F.col("record_count") * 8).alias("file_size"), "record_count")
    return O.rewrite_counts(data.unionByName(gone))


@query(f"{WITH_FILES} SELECT path, record_count, CAST(coalesce(sum(record_count) OVER (ORDER BY seq, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row_id FROM files")
def row_lineage(spark, sf_dir):
    return R.lineage(X.files(spark, sf_dir).withColumn("commit_pos", F.struct("seq", "path"))).select("path", "record_count", "first_row_id")


@query(f"WITH {X.OUTCOMES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY at_us DESC, event_id DESC) AS n FROM outcomes) SELECT table_id, event_id, result FROM r WHERE n = 1")
def latest_outcome_per_table(spark, sf_dir):
    return R.newest_per_key(X.outcomes(spark, sf_dir), "table_id", "at_us", "event_id").select("table_id", "event_id", "result")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b >= 1048576 THEN CASE WHEN b / 1048576.0 >= 100 THEN printf('%.0f', round(b / 1048576.0, 0)) WHEN b / 1048576.0 >= 10 THEN printf('%.1f', round(b / 1048576.0, 1)) ELSE printf('%.2f', round(b / 1048576.0, 2)) END || ' MiB'
  WHEN b >= 1024 THEN CASE WHEN b / 1024.0 >= 100 THEN printf('%.0f', round(b / 1024.0, 0)) WHEN b / 1024.0 >= 10 THEN printf('%.1f', round(b / 1024.0, 1)) ELSE printf('%.2f', round(b / 1024.0, 2)) END || ' KiB' ELSE b || ' B' END AS size,
  CASE WHEN b >= 86400 THEN b // 86400 || 'd' WHEN b >= 3600 THEN b // 3600 || 'h' WHEN b >= 60 THEN b // 60 || 'm' ELSE b || 's' END AS duration
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * l_partkey AS b FROM lineitem)""")
def human_units(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") * F.col("l_partkey")).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", values.human_bytes(F.col("b")).alias("size"), values.human_duration(F.col("b")).alias("duration"))


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'client.secret' WHEN 1 THEN 's3.access-KEY-id' WHEN 2 THEN 'uri' WHEN 3 THEN 'oauth2.Token' ELSE 'warehouse' END AS name, CASE WHEN p_size % 4 = 0 THEN ' ' || p_size || ' ' WHEN p_size % 4 = 1 THEN '-' || p_size ELSE p_brand END AS value FROM part)
SELECT p_partkey, name, CASE WHEN regexp_matches(lower(name), 'secret|key|token|credential|password|sas') THEN '***' ELSE value END AS shown, CASE WHEN TRY_CAST(trim(value) AS BIGINT) > 0 THEN TRY_CAST(trim(value) AS BIGINT) END AS number FROM p""")
def redacted_properties(spark, sf_dir):
    part, m5, m4 = X.table(spark, sf_dir, "part"), F.col("p_size") % 5, F.col("p_size") % 4
    name = F.when(m5 == 0, "client.secret").when(m5 == 1, "s3.access-KEY-id").when(m5 == 2, "uri").when(m5 == 3, "oauth2.Token").otherwise("warehouse")
    value = F.when(m4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).when(m4 == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    rows = part.select("p_partkey", name.alias("name"), value.alias("value"))
    return rows.select("p_partkey", "name", F.when(values.is_secret(F.col("name")), "***").otherwise(F.col("value")).alias("shown"), values.positive(F.col("value")).alias("number"))
