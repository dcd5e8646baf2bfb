"""The registered queries of the engine and their DuckDB equivalents.

All corpora derive from the given tables by integer arithmetic: a change log from `events` (key user_id, column
event_type, clock from event_id), replicated customers with row clocks and column clocks, a delete log. Results hold
integers, strings and booleans only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelake.functions import codec, hlc
from mergelake.operators import capture as cap
from mergelake.operators import merge, retention, scan
from mergelake.operators.schema import COLUMN_HLCS, COLUMN_SIGS, DELETED_ROWS, ROW_HLC, TableSpec, ensure_metadata
from mergelake.plans.policy import SignaturePolicy, unverified
from mergelake.sources.staging import staging

EVENT_COLUMNS = ["click", "error", "purchase", "signup", "view"]
PROFILE = TableSpec.of("profile", "user_id long, " + ", ".join(f"{c} long" for c in EVENT_COLUMNS), ["user_id"])
CUSTOMER = TableSpec.of("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal_no_sync double, c_mktsegment string", ["c_custkey"])
#: A fixed present for the drift gate: 2025-01-01 in 32.32 fixed-point seconds.
NOW = 1_735_689_600 << 32
PAGE = 20_000

QUERIES, ORACLE = {}, {}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clock(time, node):
    return F.concat(time.cast("string"), F.lit("/"), F.lower(F.hex(node)))


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        F.lit("profile").alias("table_name"), F.concat(F.lit('{"user_id":'), F.col("user_id").cast("string"), F.lit("}")).alias("row_pks"), F.col("event_type").alias("column_name"),
        clock(F.floor(i / 700), i % 37 + 1).alias("hlc_timestamp"), i.cast("string").alias("value"), F.lit("device").alias("device_id"), F.lit(None).cast("string").alias("sig"), i.alias("input_index"),
    )


SQL_LOG = """log AS (SELECT event_id AS i, user_id, '{"user_id":' || user_id || '}' AS row_pks, event_type AS column_name,
  CAST(event_id // 700 AS VARCHAR) || '/' || lower(hex(event_id % 37 + 1)) AS hlc, CAST(event_id AS VARCHAR) AS value,
  lpad(CAST(event_id // 700 AS VARCHAR), 20, '0') || lpad(lower(hex(event_id % 37 + 1)), 32, '0') AS key FROM events)"""


def profiles(spark: SparkSession, log: DataFrame) -> DataFrame:
    """The log merged into an empty table, as a stored snapshot."""
    empty = spark.createDataFrame([], PROFILE.schema)
    return staging(spark)("profile", merge.merge_rows(empty, merge.staged_rows(merge.classify_table(log, empty, PROFILE, None)), PROFILE))


def old_half(log: DataFrame) -> DataFrame:
    return log.filter(F.col("input_index") % 3 == 0)


def new_half(log: DataFrame) -> DataFrame:
    return log.filter(F.col("input_index") % 3 != 0)


SQL_STATE = """stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, column_name ORDER BY key DESC, i) AS rn
  FROM log WHERE i % 3 = 0) WHERE rn = 1)"""


def customers(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.expr("cast(map() as map<string,string>)")
    segment = F.when(k % 2 == 0, F.create_map(F.lit("c_mktsegment"), clock(k % 70 + 95, k % 30 + 1))).otherwise(none)
    name = F.when(k % 5 == 0, F.create_map(F.lit("c_name"), F.lit(""))).otherwise(none)
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").alias("c_acctbal_no_sync"), "c_mktsegment", F.when(k % 11 != 0, clock(k % 50 + 90, k % 20 + 1)).alias(ROW_HLC), F.map_concat(segment, name).alias(COLUMN_HLCS),
        F.when(k % 4 == 0, F.create_map(F.lit("c_name"), F.lit('{"by":"a"}'))).otherwise(none).alias(COLUMN_SIGS),
    )


SQL_CUSTOMERS = """cust AS (SELECT c_custkey AS k, c_name, c_nationkey, c_mktsegment,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 50 + 90) || '/' || lower(hex(c_custkey % 20 + 1)) END AS row_hlc,
  CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 70 + 95) || '/' || lower(hex(c_custkey % 30 + 1)) END AS segment_hlc FROM customer),
cells AS (SELECT k, 'c_name' AS column_name, to_json(c_name)::VARCHAR AS value, row_hlc AS hlc, CASE WHEN k % 4 = 0 THEN '{"by":"a"}' END AS sig FROM cust
  UNION ALL SELECT k, 'c_nationkey', CAST(c_nationkey AS VARCHAR), row_hlc, NULL FROM cust
  UNION ALL SELECT k, 'c_mktsegment', to_json(c_mktsegment)::VARCHAR, coalesce(segment_hlc, row_hlc), NULL FROM cust),
changes AS (SELECT 'customer' AS table_name, '{"c_custkey":' || k || '}' AS row_pks, column_name, hlc AS hlc_timestamp, value, 'device' AS device_id, sig, k,
  lpad(split_part(hlc, '/', 1), 20, '0') || lpad(split_part(hlc, '/', 2), 32, '0') AS key FROM cells WHERE hlc IS NOT NULL)"""
SQL_RECORD = "table_name, row_pks, column_name, hlc_timestamp, value, device_id, sig"


def customer_changes(spark: SparkSession, sf: str, **more) -> DataFrame:
    return scan.scan_changes(customers(spark, sf), CUSTOMER, device_id="device", **more)


# Registers


@registered(f"WITH {SQL_LOG} SELECT row_pks, column_name, hlc AS hlc_timestamp, value FROM (SELECT *, row_number() OVER (PARTITION BY row_pks, column_name ORDER BY key DESC, i) AS rn FROM log) WHERE rn = 1")
def lww_latest(spark, sf):
    log = event_log(spark, sf).withColumns({"key": hlc.hlc_key("hlc_timestamp"), "stored_key": F.lit(hlc.OLDEST)})
    return merge.decide_winners(log, ["row_pks", "column_name"]).filter(F.col("status") == merge.APPLIED).select("row_pks", "column_name", "hlc_timestamp", "value")


def as_cells(state: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in EVENT_COLUMNS]))
    return state.select("user_id", F.col(ROW_HLC).alias("row_hlc"), COLUMN_HLCS, cells.alias("c")).select("user_id", "row_hlc", "c.column_name", F.col("c.value").alias("value"), F.col(COLUMN_HLCS)[F.col("c.column_name")].alias("column_hlc")).filter("column_hlc IS NOT NULL")


@registered(f"""WITH {SQL_LOG}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, column_name ORDER BY key DESC, i % 3 = 0 DESC, i) AS rn FROM log) WHERE rn = 1),
  rows AS (SELECT user_id, min(hlc) AS row_hlc FROM best JOIN (SELECT user_id, max(key) AS key FROM log GROUP BY user_id) USING (user_id, key) GROUP BY user_id)
  SELECT user_id, row_hlc, column_name, CAST(value AS BIGINT) AS value, hlc AS column_hlc FROM best JOIN rows USING (user_id)""")  # fmt: skip
def lww_per_column_merge(spark, sf):
    log = event_log(spark, sf)
    state = profiles(spark, old_half(log))
    staged = merge.staged_rows(merge.classify_table(new_half(log), state, PROFILE, None))
    return as_cells(merge.merge_rows(state, staged, PROFILE))


SQL_CLASSIFIED = f"""WITH {SQL_LOG}, {SQL_STATE},
  joined AS (SELECT l.*, coalesce(s.key, '') < l.key AS candidate FROM log l LEFT JOIN stored s ON l.user_id = s.user_id AND l.column_name = s.column_name WHERE l.i % 3 <> 0),
  best AS (SELECT user_id, column_name, max(key) AS key FROM joined WHERE candidate GROUP BY ALL),
  winners AS (SELECT user_id, column_name, min(i) AS win FROM joined JOIN best USING (user_id, column_name, key) GROUP BY ALL),
  firsts AS (SELECT user_id, column_name, key AS first_key, i AS first_i FROM (SELECT *, row_number() OVER (PARTITION BY user_id, column_name ORDER BY key, i) AS rn FROM joined WHERE candidate) WHERE rn = 1),
  done AS (SELECT j.i AS input_index, CASE WHEN j.i = w.win THEN 'applied' WHEN (j.key, j.i) >= (f.first_key, f.first_i) THEN 'superseded_in_batch' ELSE 'stale' END AS status
    FROM joined j LEFT JOIN winners w USING (user_id, column_name) LEFT JOIN firsts f USING (user_id, column_name))"""  # fmt: skip


@registered(SQL_CLASSIFIED + " SELECT input_index, status FROM done")
def lww_classify(spark, sf):
    log = event_log(spark, sf)
    return merge.classify_table(new_half(log), profiles(spark, old_half(log)), PROFILE, None).select("input_index", "status")


@registered(SQL_CLASSIFIED + """ SELECT count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'stale') AS skipped_stale, CAST(0 AS BIGINT) AS skipped_shadowed_by_delete, CAST(0 AS BIGINT) AS skipped_unknown_table,
  CAST(0 AS BIGINT) AS skipped_unknown_column, CAST(0 AS BIGINT) AS skipped_no_sync_column, CAST(0 AS BIGINT) AS skipped_reserved_column, CAST(0 AS BIGINT) AS skipped_policy, CAST(0 AS BIGINT) AS skipped_insert_constraint,
  count(*) FILTER (status = 'superseded_in_batch') AS skipped_superseded_in_batch FROM done""")  # fmt: skip
def lww_report(spark, sf):
    return merge.report_counts(lww_classify(spark, sf))


CLOCKS = ["", "5/01", "5/1", "5/02", "5/10", "99/a", "100/a", "7", "/ff", "abc/1", "18446744073709551615/1", "18446744073709551616/1", "3/ffffffffffffffffffffffffffffffff", "3/1ffffffffffffffffffffffffffffffff", "4/xyz", "4/1/2", "0007/00", "+6/A"]
SQL_KEY = """lpad(CASE WHEN length(ltrim(regexp_extract({h}, '^\\+?([0-9]+)(/|$)', 1), '0')) <= 20 AND lpad(ltrim(regexp_extract({h}, '^\\+?([0-9]+)(/|$)', 1), '0'), 20, '0') <= '18446744073709551615'
    THEN ltrim(regexp_extract({h}, '^\\+?([0-9]+)(/|$)', 1), '0') ELSE '' END, 20, '0')
  || lpad(CASE WHEN length(ltrim(lower(regexp_extract({h}, '^[^/]*/\\+?([0-9a-fA-F]+)$', 1)), '0')) <= 32 THEN ltrim(lower(regexp_extract({h}, '^[^/]*/\\+?([0-9a-fA-F]+)$', 1)), '0') ELSE '' END, 32, '0')"""
SQL_CLOCKS = "clocks(h) AS (VALUES " + ", ".join(f"('{c}')" for c in CLOCKS) + ")"


@registered(f"WITH {SQL_CLOCKS}, keyed AS (SELECT h, {SQL_KEY.format(h='h')} AS key FROM clocks) SELECT a.h AS a, b.h AS b, CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END AS ordering, a.key > b.key AS newer FROM keyed a, keyed b")
def hlc_order_edge_cases(spark, sf):
    a, b = (spark.createDataFrame([(c,) for c in CLOCKS], f"{x} string") for x in "ab")
    return a.crossJoin(b).select("a", "b", hlc.hlc_compare("a", "b").alias("ordering"), hlc.is_newer("a", "b").alias("newer"))


@registered(f"WITH {SQL_LOG} SELECT user_id, hlc AS newest FROM (SELECT user_id, hlc, row_number() OVER (PARTITION BY user_id ORDER BY key DESC, hlc DESC) AS rn FROM log) WHERE rn = 1")
def hlc_max_per_row(spark, sf):
    return event_log(spark, sf).withColumn("user_id", F.get_json_object("row_pks", "$.user_id").cast("long")).groupBy("user_id").agg(hlc.hlc_max("hlc_timestamp").alias("newest"))


@registered(f"WITH {SQL_LOG} SELECT user_id, hlc AS oldest FROM (SELECT user_id, hlc, row_number() OVER (PARTITION BY user_id ORDER BY key, hlc) AS rn FROM log) WHERE rn = 1")
def hlc_min_per_row(spark, sf):
    return event_log(spark, sf).withColumn("user_id", F.get_json_object("row_pks", "$.user_id").cast("long")).groupBy("user_id").agg(hlc.hlc_min("hlc_timestamp").alias("oldest"))


@registered(f"WITH {SQL_LOG} SELECT i AS input_index, split_part(hlc, '/', 2) AS node, key, hlc LIKE '%/1a' AS from_node FROM log")
def hlc_parts(spark, sf):
    node = F.lit("1a".rjust(32, "0"))
    return event_log(spark, sf).select("input_index", hlc.node_suffix("hlc_timestamp").alias("node"), hlc.hlc_key("hlc_timestamp").alias("key"), hlc.is_from_node("hlc_timestamp", node).alias("from_node"))


@registered("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN list_aggregate(list_transform(range(16, 0, -1), lambda k: substr(md5(CAST(c_custkey AS VARCHAR)), 2 * k - 1, 2)), 'string_agg', '') END AS node FROM customer""")
def device_nodes(spark, sf):
    digest = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    spelled = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return table(spark, sf, "customer").select("c_custkey", hlc.node_of_uuid(F.when(F.col("c_custkey") % 3 == 0, "no uuid").otherwise(spelled)).alias("node"))


# Scans


@registered(f"WITH {SQL_CUSTOMERS} SELECT {SQL_RECORD} FROM changes")
def scan_unpivot_customer(spark, sf):
    return customer_changes(spark, sf)


@registered(f"WITH {SQL_CUSTOMERS} SELECT {SQL_RECORD} FROM changes WHERE key > lpad('99', 20, '0') || lpad('a', 32, '0')")
def scan_after_cursor(spark, sf):
    return customer_changes(spark, sf, after_hlc="99/a")


@registered(f"WITH {SQL_CUSTOMERS} SELECT row_pks, column_name, hlc_timestamp FROM changes")
def scan_row_hlc_fallback(spark, sf):
    return customer_changes(spark, sf).select("row_pks", "column_name", "hlc_timestamp")


@registered(f"WITH {SQL_CUSTOMERS} SELECT {SQL_RECORD} FROM changes WHERE split_part(hlc_timestamp, '/', 2) = 'b'")
def scan_origin_node(spark, sf):
    return customer_changes(spark, sf, filters=scan.ScanFilters(origin_node="b".rjust(32, "0")))


@registered(f"WITH {SQL_CUSTOMERS} SELECT {SQL_RECORD} FROM changes WHERE k IN (1, 2, 3, 55)")
def scan_row_pks(spark, sf):
    return customer_changes(spark, sf, filters=scan.ScanFilters(row_pks=[f'{{"c_custkey":{k}}}' for k in (1, 2, 3, 55, -9)]))


@registered(f"WITH {SQL_CUSTOMERS} SELECT {SQL_RECORD} FROM changes WHERE k % 7 = 0")
def scan_row_pks_table(spark, sf):
    keys = table(spark, sf, "customer").filter("c_custkey % 7 = 0").select(F.concat(F.lit('{"c_custkey":'), F.col("c_custkey").cast("string"), F.lit("}")))
    return customer_changes(spark, sf, filters=scan.ScanFilters(row_pks=keys))


@registered(f"WITH {SQL_CUSTOMERS} SELECT {SQL_RECORD} FROM changes WHERE k IN (SELECT k FROM cust WHERE c_nationkey = 7)")
def scan_column_eq(spark, sf):
    return customer_changes(spark, sf, filters=scan.ScanFilters(column_eq=("c_nationkey", "7")))


@registered(f"WITH {SQL_CUSTOMERS} SELECT {SQL_RECORD} FROM changes WHERE false")
def scan_column_eq_absent(spark, sf):
    return customer_changes(spark, sf, filters=scan.ScanFilters(column_eq=("no-such-column", "7")))


@registered(f"WITH {SQL_CUSTOMERS} SELECT column_name, count(*) AS n FROM changes GROUP BY column_name")
def scan_no_sync_excluded(spark, sf):
    return customer_changes(spark, sf).groupBy("column_name").agg(F.count("*").alias("n"))


@registered(f"""WITH {SQL_CUSTOMERS}, {SQL_LOG} SELECT table_name, count(*) AS n, max(key) AS newest FROM (SELECT table_name, key FROM changes UNION ALL SELECT 'profile', max(key) FROM log CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS columns(c) GROUP BY user_id, c) GROUP BY table_name""")  # a column that never won falls back to its row's clock
def feed_of_tables(spark, sf):
    feed = scan.changes_of({"customer": (customers(spark, sf), CUSTOMER), "profile": (profiles(spark, event_log(spark, sf)), PROFILE)})
    return feed.groupBy("table_name").agg(F.count("*").alias("n"), F.max(hlc.hlc_key("hlc_timestamp")).alias("newest"))


# Pages

SQL_SIZES = f"""WITH {SQL_LOG}, rec AS (SELECT hlc, key, octet_length(encode('{{"tableName":"profile","rowPks":"{{\\"user_id\\":' || user_id || '}}","columnName":"' || column_name || '","hlcTimestamp":"' || hlc || '","value":' || value || ',"deviceId":"device"}}')) AS size FROM log),
  sizes AS (SELECT hlc, key, count(*) AS n, CAST(sum(size) + count(*) + 1 AS BIGINT) AS bytes FROM rec GROUP BY hlc, key),
  summed AS (SELECT *, sum(bytes) OVER (ORDER BY key, hlc) AS total, row_number() OVER (ORDER BY key, hlc) AS rn FROM sizes)"""  # fmt: skip


@registered(SQL_SIZES + " SELECT hlc, n, bytes FROM sizes")
def page_sizes(spark, sf):
    return scan.group_sizes(event_log(spark, sf)).select("hlc", "n", "bytes")


@registered(SQL_SIZES + f" SELECT i AS input_index FROM log JOIN summed USING (hlc) WHERE total <= {PAGE} OR rn = 1")
def page_first(spark, sf):
    return scan.first_page(event_log(spark, sf), PAGE)[0].select("input_index")


@registered(SQL_SIZES + f" SELECT hlc, n, bytes, CAST(total AS BIGINT) AS total, (SELECT count(*) FROM summed WHERE total > {PAGE} AND rn > 1) > 0 AS has_more FROM summed WHERE total <= {PAGE} OR rn = 1")
def page_has_more(spark, sf):
    return scan.page_groups(scan.group_sizes(event_log(spark, sf)), PAGE).select("hlc", "n", "bytes", "total", "has_more")


@registered(SQL_SIZES + " SELECT i AS input_index FROM log JOIN summed USING (hlc) WHERE rn = 1")
def page_ge_one(spark, sf):
    return scan.first_page(event_log(spark, sf), 1)[0].select("input_index")


@registered(SQL_SIZES.replace("WITH", "WITH RECURSIVE", 1) + f""", walk AS (SELECT rn, hlc, bytes AS spent, 0 AS page FROM summed WHERE rn = 1
    UNION ALL SELECT s.rn, s.hlc, CASE WHEN w.spent + s.bytes > {PAGE} THEN s.bytes ELSE w.spent + s.bytes END, CASE WHEN w.spent + s.bytes > {PAGE} THEN w.page + 1 ELSE w.page END FROM walk w JOIN summed s ON s.rn = w.rn + 1)
  SELECT page, count(*) AS n, count(DISTINCT hlc) AS transactions FROM log JOIN walk USING (hlc) GROUP BY page""")  # fmt: skip
def page_history(spark, sf):
    return scan.pages(event_log(spark, sf), PAGE).groupBy("page").agg(F.count("*").alias("n"), F.count_distinct("hlc_timestamp").alias("transactions"))


# Tombstones: every third user has one, its clock from the user's number


def delete_log(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct().filter("user_id % 3 = 0")
    u, none = F.col("user_id"), F.expr("cast(map() as map<string,string>)")
    return users.select(F.concat(F.lit("t"), u.cast("string")).alias("id"), F.lit("profile").alias("table_name"), F.concat(F.lit('{ "user_id" : '), u.cast("string"), F.lit("}")).alias("row_pks"), F.when(u % 21 != 0, clock(u % 16, u % 40 + 1)).alias(ROW_HLC), none.alias(COLUMN_HLCS), none.alias(COLUMN_SIGS))


SQL_DELETES = """tomb AS (SELECT DISTINCT user_id, lpad(CAST(user_id % 16 AS VARCHAR), 20, '0') || lpad(lower(hex(user_id % 40 + 1)), 32, '0') AS deleted_key,
  (user_id % 16) || '/' || lower(hex(user_id % 40 + 1)) AS deleted_hlc FROM events WHERE user_id % 3 = 0 AND user_id % 21 <> 0)"""


@registered(f"""WITH {SQL_LOG}, {SQL_DELETES}, best AS (SELECT *, row_number() OVER (PARTITION BY user_id, column_name ORDER BY key DESC, i) AS rn FROM log),
  newest AS (SELECT user_id, max(key) AS newest FROM log GROUP BY user_id)
  SELECT CASE WHEN rn > 1 THEN 'superseded_in_batch' WHEN deleted_key >= newest THEN 'shadowed_by_delete' ELSE 'applied' END AS status, b.user_id, count(*) AS n
  FROM best b JOIN newest USING (user_id) LEFT JOIN tomb t ON t.user_id = b.user_id GROUP BY ALL""")  # fmt: skip
def delete_shadow_inserts(spark, sf):
    empty = spark.createDataFrame([], PROFILE.schema)
    shadows = merge.of_table(merge.tombstone_keys(delete_log(spark, sf)), PROFILE)
    rows = merge.classify_table(event_log(spark, sf), empty, PROFILE, shadows)
    return rows.withColumn("user_id", F.get_json_object("pk", "$.user_id").cast("long")).groupBy("status", "user_id").agg(F.count("*").alias("n"))


SQL_PROFILES = f"WITH {SQL_LOG}, {SQL_DELETES}, rows AS (SELECT user_id, max(key) AS row_key FROM log GROUP BY user_id)"


@registered(SQL_PROFILES + " SELECT user_id FROM rows LEFT JOIN tomb USING (user_id) WHERE deleted_key IS NULL OR row_key > deleted_key")
def delete_propagate(spark, sf):
    state = profiles(spark, event_log(spark, sf))
    return merge.propagate_deletes(state, PROFILE, merge.of_table(merge.tombstone_keys(delete_log(spark, sf)), PROFILE))[0].select("user_id")


@registered(SQL_PROFILES + """ SELECT '{"user_id":' || user_id || '}' AS pk FROM rows JOIN tomb USING (user_id) WHERE row_key > deleted_key""")
def delete_target_newer(spark, sf):
    state = profiles(spark, event_log(spark, sf))
    return merge.propagate_deletes(state, PROFILE, merge.of_table(merge.tombstone_keys(delete_log(spark, sf)), PROFILE))[1]


@registered(SQL_PROFILES + " SELECT user_id FROM rows LEFT JOIN tomb USING (user_id) WHERE deleted_key IS NULL OR row_key > deleted_key")
def delete_stale_replay(spark, sf):
    """The delete log already has all tombstones; the same arrive again, are stale, and still act on the targets."""
    log = delete_log(spark, sf)
    again = log.filter(F.col(ROW_HLC).isNotNull()).select(F.lit(DELETED_ROWS).alias("table_name"), F.concat(F.lit('{"id":"'), F.col("id"), F.lit('"}')).alias("row_pks"), F.lit("table_name").alias("column_name"), F.col(ROW_HLC).alias("hlc_timestamp"), F.lit('"profile"').alias("value"), F.lit("d").alias("device_id"), F.lit(None).cast("string").alias("sig"), F.monotonically_increasing_id().alias("input_index"))
    stored = log.withColumn(COLUMN_HLCS, F.create_map(F.lit("table_name"), F.col(ROW_HLC), F.lit("row_pks"), F.col(ROW_HLC)))
    tables = {"profile": profiles(spark, event_log(spark, sf)), DELETED_ROWS: stored}
    return merge.apply_batch(tables, {"profile": PROFILE}, again.filter(F.col("hlc_timestamp").rlike("^[0-9]+/[1-9a-f]")), NOW, save=staging(spark)).tables["profile"].select("user_id")


# Capture: the new snapshot lacks every tenth customer, renames every fourth, has a new one for every seventh


def next_customers(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").alias("c_acctbal_no_sync"), "c_mktsegment")
    kept = rows.filter(k % 10 != 0).withColumn("c_name", F.when(k % 4 == 0, F.lit("renamed")).otherwise(F.col("c_name"))).withColumn("c_acctbal_no_sync", F.when(k % 9 == 1, F.lit(0.0)).otherwise(F.col("c_acctbal_no_sync")))
    return kept.unionByName(rows.filter(k % 7 == 0).withColumn("c_custkey", k + 10_000_000))


@registered("""SELECT c_custkey + 10000000 AS c_custkey, '500/a' AS row_hlc, 'c_mktsegment=500/a,c_name=500/a,c_nationkey=500/a' AS clocks FROM customer WHERE c_custkey % 7 = 0""")
def capture_insert(spark, sf):
    return clocks_of(cap.capture(customers(spark, sf), next_customers(spark, sf), CUSTOMER, "500/a")[0].filter("c_custkey >= 10000000"))


def clocks_of(rows):
    return rows.select("c_custkey", F.col(ROW_HLC).alias("row_hlc"), F.array_join(F.array_sort(F.transform(F.map_entries(COLUMN_HLCS), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("clocks"))


@registered(f"""WITH {SQL_CUSTOMERS} SELECT k AS c_custkey, CASE WHEN k % 4 = 0 OR k % 9 = 1 AND k IN (SELECT c_custkey FROM customer WHERE c_acctbal <> 0) THEN '500/a' ELSE row_hlc END AS row_hlc,
  concat_ws(',', CASE WHEN segment_hlc IS NOT NULL THEN 'c_mktsegment=' || segment_hlc END, CASE WHEN k % 4 = 0 THEN 'c_name=500/a' WHEN k % 5 = 0 THEN 'c_name=' END) AS clocks FROM cust WHERE k % 10 <> 0""")  # fmt: skip
def capture_update(spark, sf):
    return clocks_of(cap.capture(customers(spark, sf), next_customers(spark, sf), CUSTOMER, "500/a")[0].filter("c_custkey < 10000000"))


@registered("""SELECT 'customer' AS table_name, '{"c_custkey":' || c_custkey || '}' AS row_pks, '500/a' AS row_hlc,
  substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) AS id
  FROM (SELECT c_custkey, sha256('customer' || chr(31) || '{"c_custkey":' || c_custkey || '}' || chr(31) || '500/a') AS d FROM customer WHERE c_custkey % 10 = 0)""")  # fmt: skip
def capture_delete(spark, sf):
    keys = cap.capture(customers(spark, sf), next_customers(spark, sf), CUSTOMER, "500/a")[1]
    return cap.tombstones(keys, "customer", "500/a").select("id", "table_name", "row_pks", F.col(ROW_HLC).alias("row_hlc"))


@registered("""SELECT kind, dirty, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 10 = 0 THEN 'delete' WHEN c_custkey % 4 = 0 OR c_custkey % 9 = 1 AND c_acctbal <> 0 THEN 'update' ELSE 'same' END AS kind, c_custkey % 10 = 0 OR c_custkey % 4 = 0 AS dirty FROM customer
  UNION ALL SELECT 'insert', true FROM customer WHERE c_custkey % 7 = 0) GROUP BY ALL""")  # fmt: skip
def capture_kinds(spark, sf):
    return cap.capture(customers(spark, sf), next_customers(spark, sf), CUSTOMER, "500/a")[2].groupBy("kind", "dirty").agg(F.count("*").alias("n"))


@registered("""SELECT event_type AS table_name, row_number() OVER (ORDER BY max(event_id), event_type) AS place FROM events GROUP BY event_type""")
def dirty_tables(spark, sf):
    from pyspark.sql import Window

    dirty = table(spark, sf, "events").groupBy(F.col("event_type").alias("table_name")).agg(F.max("event_id").alias("last_modified"))
    return scan.scan_dirty_tables(dirty).withColumn("last_modified", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("last_modified")).cast("long")).drop("last_modified")


@registered(f"""WITH {SQL_CUSTOMERS} SELECT k AS c_custkey, '500/a' AS row_hlc, concat_ws(',', 'c_acctbal_no_sync=500/a', CASE WHEN segment_hlc IS NOT NULL THEN 'c_mktsegment=' || segment_hlc END, 'c_name=500/a') AS clocks FROM cust WHERE k % 2 = 0
  UNION ALL SELECT k, row_hlc, concat_ws(',', CASE WHEN segment_hlc IS NOT NULL THEN 'c_mktsegment=' || segment_hlc END, CASE WHEN k % 5 = 0 THEN 'c_name=' END) FROM cust WHERE k % 2 <> 0
  UNION ALL SELECT k + 10000000, '500/a', 'c_mktsegment=500/a,c_name=500/a,c_nationkey=500/a' FROM cust WHERE k % 2 = 0""")  # fmt: skip
def upsert_stamps_all(spark, sf):
    rows = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").alias("c_acctbal_no_sync"), "c_mktsegment")
    rows = rows.unionByName(rows.withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return clocks_of(cap.upsert(customers(spark, sf), rows, CUSTOMER, "500/a", ["c_name", "c_acctbal_no_sync"]))


@registered("SELECT c_custkey, '7/b' AS row_hlc, 'c_acctbal_no_sync=7/b,c_mktsegment=7/b,c_name=7/b,c_nationkey=7/b' AS clocks FROM customer")
def install_backfill(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").alias("c_acctbal_no_sync"), "c_mktsegment")
    return clocks_of(cap.install(rows, CUSTOMER, "7/b"))


@registered(f"""WITH {SQL_CUSTOMERS} SELECT k AS c_custkey, coalesce(row_hlc, '7/b') AS row_hlc, CASE WHEN row_hlc IS NULL THEN 'c_mktsegment=7/b,c_name=7/b,c_nationkey=7/b'
  ELSE concat_ws(',', CASE WHEN segment_hlc IS NOT NULL THEN 'c_mktsegment=' || segment_hlc END, CASE WHEN k % 5 = 0 THEN 'c_name=' END) END AS clocks FROM cust""")  # fmt: skip
def stamp_null_rows(spark, sf):
    return clocks_of(cap.stamp_unstamped(customers(spark, sf), CUSTOMER, "7/b"))


# Checks


@registered("""SELECT event_id AS input_index, CASE event_type WHEN 'click' THEN 'unknown_column' WHEN 'error' THEN 'no_sync_column' WHEN 'purchase' THEN 'reserved_column' WHEN 'view' THEN 'reserved_column' END AS reason FROM events""")
def eligibility_reasons(spark, sf):
    names = {"click": "gone_no_sync", "error": "c_acctbal_no_sync", "purchase": "c_custkey", "view": ROW_HLC, "signup": "c_name"}
    column = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return table(spark, sf, "events").select(F.col("event_id").alias("input_index"), merge.eligibility(column, CUSTOMER).alias("reason"))


@registered("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '{"a":' || c_custkey || ',"b":"x"}' WHEN 1 THEN '{"a":' || c_custkey || ',"b":"y z"}' END AS pk FROM customer""")
def row_identity_invalid(spark, sf):
    k = F.col("c_custkey").cast("string")
    spellings = [("{\"a\":", ',"b":"x"}'), ('{ "b" : "y z", "a": ', "}"), ('{"a":', "}"), ('{"a":', ',"b":"x","c":1}'), ("[", "]"), ('{"a":"no number', '","b":"x"}')]
    text = F.coalesce(*[F.when(F.col("c_custkey") % 6 == i, F.concat(F.lit(a), k, F.lit(b))) for i, (a, b) in enumerate(spellings)])
    keys = TableSpec.of("t", "a long, b string", ["a", "b"]).keys
    return table(spark, sf, "customer").select("c_custkey", codec.canonical_pk(text, keys).alias("pk"))


@registered("SELECT input_index, kind FROM (SELECT event_id AS input_index, CASE WHEN event_id % 101 = 0 THEN 1 WHEN event_id % 103 = 0 THEN 2 WHEN event_id % 107 = 0 THEN 3 END AS kind FROM events) WHERE kind IS NOT NULL")
def preflight_identifiers(spark, sf):
    i = F.col("input_index")
    batch = event_log(spark, sf).withColumns({"table_name": F.when(i % 101 == 0, 'bad"name').otherwise("profile"), "column_name": F.when(i % 103 == 0, "").otherwise("grün-1"), "hlc_timestamp": F.when(i % 107 == 0, "18446744073709551615/0abc").otherwise(F.col("hlc_timestamp"))})
    return merge.preflight_failures(batch, NOW).select("input_index", F.col("check").alias("kind"))


@registered("SELECT event_id AS input_index FROM events WHERE event_id % 97 > 50 AND event_id % 97 * 900 > 43200")
def preflight_drift(spark, sf):
    ahead = F.when(F.col("input_index") % 97 > 50, F.lit(NOW).cast("decimal(20,0)") + (F.col("input_index") % 97 * 900).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)")).otherwise(F.lit(5).cast("decimal(20,0)"))
    batch = event_log(spark, sf).withColumn("hlc_timestamp", F.concat(ahead.cast("decimal(20,0)").cast("string"), F.lit("/a")))
    return merge.preflight_failures(batch, NOW).filter("check = 4").select("input_index")


@registered("""SELECT item_id, '{"$blob_hex":"' || lower(hex(encode(text))) || '"}' AS tagged, text, true AS same FROM benchmark""")
def blob_roundtrip(spark, sf):
    from pyspark.sql import types as T

    b = F.col("text").cast("binary")
    tagged = codec.encode_value(b, T.BinaryType())
    return table(spark, sf, "benchmark").select("item_id", tagged.alias("tagged"), codec.decode_value(tagged, T.BinaryType()).cast("string").alias("text"), (codec.decode_value(tagged, T.BinaryType()) == b).alias("same"))


@registered("""WITH parts AS (SELECT c_custkey AS k, encode('customer') AS p1, encode('{"c_custkey":' || c_custkey || '}') AS p2, encode('c_name') AS p3, encode(c_custkey || '/a') AS p4, encode('"' || c_name || '"') AS p5 FROM customer)
  SELECT k AS c_custkey, sha256(unhex(lpad(hex(octet_length(p1)), 8, '0')) || p1 || unhex(lpad(hex(octet_length(p2)), 8, '0')) || p2 || unhex(lpad(hex(octet_length(p3)), 8, '0')) || p3
    || unhex(lpad(hex(octet_length(p4)), 8, '0')) || p4 || unhex(lpad(hex(octet_length(p5)), 8, '0')) || p5) AS digest FROM parts""")  # fmt: skip
def preimage_sha256(spark, sf):
    k = F.col("c_custkey").cast("string")
    data = codec.scalar_preimage(F.lit("customer"), F.concat(F.lit('{"c_custkey":'), k, F.lit("}")), F.lit("c_name"), F.concat(k, F.lit("/a")), codec.json_string(F.col("c_name")))
    return table(spark, sf, "customer").select("c_custkey", F.sha2(data, 256).alias("digest"))


@registered("""SELECT c_custkey, '{"a":[1,{"x":null,"y":' || c_custkey || '}],"b":"' || c_name || '"}' AS canonical FROM customer""")
def canonical_json_values(spark, sf):
    raw = F.concat(F.lit('{ "b":"'), F.col("c_name"), F.lit('", "a" : [1, {"y":'), F.col("c_custkey").cast("string"), F.lit(', "x":null}]}'))
    return table(spark, sf, "customer").select("c_custkey", codec.canonical_json(raw).alias("canonical"))


@registered("""SELECT event_id AS input_index FROM events WHERE event_id % 3 = 2""")
def unverified_signatures(spark, sf):
    sig = F.when(F.col("input_index") % 3 == 1, "null").when(F.col("input_index") % 3 == 2, '"forged"')
    return unverified(event_log(spark, sf).withColumn("sig", sig), SignaturePolicy().provider)


@registered("""SELECT '{"turn":' || turn || ',"conv_id":' || conv_id || '}' AS row_pks, column_name, count(*) AS n
  FROM conversations CROSS JOIN (VALUES ('role'), ('text')) AS tracked(column_name) GROUP BY ALL""")  # fmt: skip
def composite_pk_order(spark, sf):
    spec = TableSpec.of("conversations", "turn long, conv_id long, role string, text string", ["conv_id", "turn"])
    rows = cap.stamp_inserts(table(spark, sf, "conversations"), spec, "3/c")
    return scan.scan_changes(rows, spec).groupBy("row_pks", "column_name").agg(F.count("*").alias("n"))


@registered("SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def fk_check(spark, sf):
    from mergelake.operators.schema import foreign_key_violations

    child = TableSpec.of("orders", table(spark, sf, "orders").schema, ["o_orderkey"], foreign_keys=(("o_custkey", "customer", "c_custkey"),))
    parents = table(spark, sf, "customer").filter("c_custkey % 10 <> 0")
    return foreign_key_violations({"orders": table(spark, sf, "orders"), "customer": parents}, {"orders": child})[0][1].select("o_orderkey")


@registered("""WITH first AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL)
  SELECT '{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_linenumber":' || l_linenumber || '}' AS pk, 'insert_unique' AS status
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) EXCEPT SELECT '{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_linenumber":' || l_linenumber || '}', 'insert_unique'
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY '{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_linenumber":' || l_linenumber || '}' COLLATE "C") AS rn FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem)) WHERE rn = 1""".replace(' COLLATE "C"', ""))  # fmt: skip
def insert_constraint_duplicates(spark, sf):
    spec = TableSpec.of("lineitem", "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string", ["l_orderkey", "l_partkey", "l_linenumber"], unique=(("l_orderkey", "l_linenumber"),))
    rows = table(spark, sf, "lineitem")
    pk = F.concat(F.lit('{"l_orderkey":'), F.col("l_orderkey").cast("string"), F.lit(',"l_partkey":'), F.col("l_partkey").cast("string"), F.lit(',"l_linenumber":'), F.col("l_linenumber").cast("string"), F.lit("}"))
    batch = rows.select(F.lit("lineitem").alias("table_name"), pk.alias("row_pks"), F.lit("l_returnflag").alias("column_name"), F.lit("9/9").alias("hlc_timestamp"), codec.json_string(F.col("l_returnflag")).alias("value"), F.lit("d").alias("device_id"), F.lit(None).cast("string").alias("sig"), F.monotonically_increasing_id().alias("input_index"))
    empty = spark.createDataFrame([], spec.schema)
    staged = staging(spark)("winners", merge.staged_rows(merge.classify_table(batch, empty, spec, None)))
    return merge.constraint_failures(staged, empty, spec)


# Retention and statistics: days from the order's key, at nanosecond clocks

DAY = 86_400_000_000_000


def aged_log(spark, sf):
    k, none = F.col("o_orderkey"), F.expr("cast(map() as map<string,string>)")
    stamp = clock((k % 100 + 1).cast("decimal(20,0)") * F.lit(DAY).cast("decimal(20,0)") + (k % 3).cast("decimal(20,0)"), k % 30 + 1)
    stamp = F.concat(((k % 100 + 1) * DAY + k % 3).cast("string"), F.lit("/"), F.lower(F.hex(k % 30 + 1)))
    return table(spark, sf, "orders").select(k.cast("string").alias("id"), F.lit("t").alias("table_name"), F.lit("{}").alias("row_pks"), F.when(k % 13 != 0, stamp).alias(ROW_HLC), none.alias(COLUMN_HLCS), none.alias(COLUMN_SIGS))


SQL_AGED = f"WITH aged AS (SELECT o_orderkey AS k, (o_orderkey % 100 + 1) * {DAY} + o_orderkey % 3 AS t, CASE WHEN o_orderkey % 13 <> 0 THEN ((o_orderkey % 100 + 1) * {DAY} + o_orderkey % 3) || '/' || lower(hex(o_orderkey % 30 + 1)) END AS hlc FROM orders)"


@registered(SQL_AGED + f" SELECT CAST(k AS VARCHAR) AS id FROM aged WHERE hlc IS NOT NULL AND t < 60 * {DAY}")
def retention_time(spark, sf):
    return retention.split_prunable(aged_log(spark, sf), retention.Retention(30), 90 * DAY)[0].select("id")


@registered(SQL_AGED + " SELECT count(*) FILTER (hlc IS NOT NULL) AS pruned, count(*) FILTER (hlc IS NULL) AS kept FROM aged")
def retention_all(spark, sf):
    pruned, kept = retention.split_prunable(aged_log(spark, sf), retention.Retention(), None)
    return pruned.agg(F.count("*").alias("pruned")).crossJoin(kept.agg(F.count("*").alias("kept")))


@registered(SQL_AGED + f""", gone AS (SELECT * FROM aged WHERE hlc IS NOT NULL AND t < 60 * {DAY})
  SELECT (SELECT count(*) FROM gone) AS rows_deleted, (SELECT hlc FROM gone ORDER BY t DESC, k % 30 DESC, hlc DESC LIMIT 1) AS max_pruned_hlc""")
def retention_max_pruned(spark, sf):
    return retention.prune_summary(retention.split_prunable(aged_log(spark, sf), retention.Retention(30), 90 * DAY)[0])


@registered("SELECT (SELECT count(*) FROM customer) AS live_row_count, CAST(1 AS BIGINT) AS crdt_table_count, (SELECT count(*) FROM orders) AS delete_log_row_count")
def crdt_stats(spark, sf):
    tables = {"customer": customers(spark, sf), DELETED_ROWS: aged_log(spark, sf), "cache_no_sync": ensure_metadata(table(spark, sf, "nation")), "plain": table(spark, sf, "nation")}
    return spark.createDataFrame([tuple(retention.stats(tables).values())], "live_row_count long, crdt_table_count long, delete_log_row_count long")


@registered("""WITH source(name, body) AS (VALUES ('0001', 'a'), ('0002', 'b'), ('0004', 'd')), journal(name, digest) AS (VALUES ('0001', sha256('a')), ('0002', sha256('x')), ('0003', sha256('c')))
  SELECT name, CASE WHEN body IS NULL THEN 'missing' WHEN digest IS NULL THEN 'pending' WHEN digest <> sha256(body) THEN 'changed' ELSE 'applied' END AS status FROM source FULL JOIN journal USING (name)""")
def migration_drift(spark, sf):
    from mergelake.sources.store import journal_status, migration_digest

    journal = {name: migration_digest(body) for name, body in {"0001": "a", "0002": "x", "0003": "c"}.items()}
    return spark.createDataFrame(list(journal_status({"0001": "a", "0002": "b", "0004": "d"}, journal).items()), "name string, status string")


@registered("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'legacy' FROM customer WHERE c_custkey % 2 <> 0")
def legacy_merge(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    current = rows.filter("c_custkey % 2 = 0")
    return cap.merge_legacy(current, rows.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("legacy")), ["c_custkey"])


@registered("SELECT c_custkey, octet_length(encode(c_name)) + 8 + 8 + octet_length(encode(c_mktsegment)) AS bytes FROM customer")
def transaction_bytes(spark, sf):
    spec = TableSpec.of("customer", table(spark, sf, "customer").schema, ["c_custkey"])
    size = sum((codec.parameter_bytes(c, spec.kind(c)) for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), F.lit(0))
    return table(spark, sf, "customer").select("c_custkey", size.alias("bytes"))


# The store: transactions over all customers, in a folder of their own; scans and merges of what they wrote

STORED = "c_custkey long, c_name string, c_nationkey int, c_acctbal_no_sync double, c_mktsegment string"
DEVICES = ("00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000002")
SQL_WRITTEN = """written AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN 'update' ELSE 'insert' END AS written_by
  FROM customer WHERE c_custkey % 10 <> 0)"""


def opened_store(spark, device: str = DEVICES[0]):
    """A new store with an empty table of customers."""
    from mergelake.sources.staging import fresh_folder
    from mergelake.sources.store import Store, StoreConfig

    store = Store(spark, fresh_folder(spark, "store"), StoreConfig(device, max_transaction_bytes=1 << 50))
    with store.write() as tx:
        tx.create_table("customer", STORED, ["c_custkey"])
    return store


def customer_rows(spark, sf):
    return table(spark, sf, "customer").withColumnRenamed("c_acctbal", "c_acctbal_no_sync")


def written_store(spark, sf):
    """All customers inserted, every fourth renamed, every tenth deleted, each in a commit: the snapshot before the
    others, the one after all, the clocks of insert and update, and the rows that the update returned."""
    store, k = opened_store(spark), F.col("c_custkey")
    with store.write() as tx:
        tx.insert("customer", customer_rows(spark, sf))
        inserted = tx.hlc
    before = store.snapshot()
    with store.write() as tx:
        returned = tx.update("customer", {"c_name": F.lit("renamed")}, k % 4 == 0)
        updated = tx.hlc
    with store.write() as tx:
        tx.delete("customer", k % 10 == 0)
    store.close()
    return before, store.snapshot(), (inserted, updated), returned


@registered(f"WITH {SQL_WRITTEN} SELECT * FROM written")
def store_written(spark, sf):
    _, after, (inserted, updated), _ = written_store(spark, sf)
    by = F.when(F.col(ROW_HLC) == inserted, "insert").when(F.col(ROW_HLC) == updated, "update")
    return after.table("customer").select("c_custkey", "c_name", by.alias("written_by"))


@registered("SELECT c_custkey, 'renamed' AS c_name, c_mktsegment FROM customer WHERE c_custkey % 4 = 0")
def store_returning(spark, sf):
    return written_store(spark, sf)[3].select("c_custkey", "c_name", "c_mktsegment")


@registered("""SELECT 'customer' AS table_name, '{"c_custkey":' || c_custkey || '}' AS row_pks FROM customer WHERE c_custkey % 10 = 0""")
def store_delete_log(spark, sf):
    return written_store(spark, sf)[1].table(DELETED_ROWS).select("table_name", "row_pks")


@registered("""SELECT '{"c_custkey":' || c_custkey || '}' AS row_pks, 'c_name' AS column_name, '"renamed"' AS value FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 10 <> 0""")
def store_scan_after(spark, sf):
    _, after, (inserted, _), _ = written_store(spark, sf)
    return after.scan("customer", inserted).select("row_pks", "column_name", "value")


@registered(f"WITH {SQL_WRITTEN} SELECT w.c_custkey, w.c_name, c.c_nationkey, c.c_mktsegment, true AS local_is_null FROM written w JOIN customer c USING (c_custkey)")
def store_apply(spark, sf):
    """A second store merges the first one's inserts, then its updates and tombstones; local columns stay behind."""
    before, after, (inserted, _), _ = written_store(spark, sf)
    other = opened_store(spark, DEVICES[1])
    other.apply(before.scan("customer"))
    other.apply(after.scan("customer", inserted).unionByName(after.scan(DELETED_ROWS)))
    other.close()
    return other.snapshot().table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.col("c_acctbal_no_sync").isNull().alias("local_is_null"))


@registered("SELECT c_custkey, coalesce(n.c_name, c.c_name) AS c_name FROM customer c LEFT JOIN (SELECT c_custkey, 'kept' AS c_name FROM customer WHERE c_custkey % 6 = 0) n USING (c_custkey) UNION ALL SELECT c_custkey + 10000000, c_name FROM customer WHERE c_custkey % 6 = 0")
def store_upsert(spark, sf):
    """Every sixth customer comes again under its key, with another name, and once more under a new key."""
    store, k = opened_store(spark), F.col("c_custkey")
    again = customer_rows(spark, sf).filter(k % 6 == 0)
    with store.write() as tx:
        tx.insert("customer", customer_rows(spark, sf))
    with store.write() as tx:
        tx.upsert("customer", again.withColumn("c_name", F.lit("kept")).unionByName(again.withColumn("c_custkey", k + 10_000_000)), ["c_name"])
    store.close()
    return store.snapshot().table("customer").select("c_custkey", "c_name")


@registered("""SELECT true AS refused, count(*) AS kept FROM customer""")
def insert_unique_local(spark, sf):
    """An insert that repeats unique values is refused as a whole, and leaves the table as it was."""
    from mergelake.operators.schema import EngineError

    store, refused = opened_store(spark), False
    with store.write() as tx:
        tx.create_table("named", "id long, name string", ["id"], unique=(("name",),))
        tx.insert("named", customer_rows(spark, sf).select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name")))
    try:
        with store.write() as tx:
            tx.insert("named", customer_rows(spark, sf).select((-F.col("c_custkey") - 1).alias("id"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name")))
    except EngineError:
        refused = True
    store.close()
    return store.snapshot().table("named").agg(F.count("*").alias("kept")).withColumn("refused", F.lit(refused))


@registered("""WITH open AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0)
  SELECT '{"c_custkey":' || c_custkey || '}' AS pk, 'insert_not_null' AS status FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT '{"c_custkey":' || k || '}', 'insert_unique' FROM open WHERE k % 2 = 1 AND k - 1 IN (SELECT k FROM open)""")  # fmt: skip
def constraint_cascade(spark, sf):
    """Pairs of customers share a unique value; one that lacks its name doesn't keep the other out."""
    spec = TableSpec.of("customer", "c_custkey long, c_name string, pair long", ["c_custkey"], required=("c_name",), unique=(("pair",),))
    k = F.col("c_custkey")
    cells = F.array(F.struct(F.lit("c_name").alias("column_name"), F.when(k % 5 != 0, codec.json_string(F.col("c_name"))).otherwise("null").alias("value")), F.struct(F.lit("pair").alias("column_name"), F.floor(k / 2).cast("string").alias("value")))
    pk = F.concat(F.lit('{"c_custkey":'), k.cast("string"), F.lit("}"))
    batch = table(spark, sf, "customer").select(F.lit("customer").alias("table_name"), pk.alias("row_pks"), F.explode(cells).alias("cell")).select("table_name", "row_pks", "cell.*", F.lit("9/9").alias("hlc_timestamp"), F.lit("d").alias("device_id"), F.lit(None).cast("string").alias("sig"), F.monotonically_increasing_id().alias("input_index"))
    empty = spark.createDataFrame([], spec.schema)
    staged = staging(spark)("winners", merge.staged_rows(merge.classify_table(batch, empty, spec, None)))
    return merge.constraint_failures(staged, empty, spec)


# Ordinary SQL over live state, guarded

USER_SQL = {
    "sql_rollup": """SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)""",
    "sql_window": """SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) AS t WHERE place <= 2""",
    "sql_recursive": """WITH RECURSIVE steps(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 40) SELECT n, total FROM steps""",
    "sql_set_operations": """SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders UNION SELECT c_nationkey FROM customer INTERSECT SELECT n_nationkey FROM nation""",
    "sql_cube_distinct": """SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
}


def _user_sql(text: str):
    def run(spark, sf):
        from mergelake.plans.guard import Guard, tables_in

        names = tables_in(spark, text)
        for n in names:
            table(spark, sf, n).createOrReplaceTempView(n)
        return Guard(frozenset(names)).sql(spark, text)

    return run


QUERIES |= {name: _user_sql(text) for name, text in USER_SQL.items()}
ORACLE |= USER_SQL
