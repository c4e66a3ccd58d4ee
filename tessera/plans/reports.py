"""More registered queries: listings, predicates, joins of the lifecycle, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, lifecycle, scans, verify
from ..sources import tables
from .catalogue import _STATUS, _TASK, _query, _read, _status, _tasks

_JOB = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END"
_KNOWN = ", ".join(f"('{s}')" for s in _STATUS)


def _zero(table: str, expression: str) -> str:
    return f"SELECT '{table}' AS relation, coalesce(k.s, c.s) AS status, coalesce(m, 0) AS n FROM (VALUES {_KNOWN}) k(s) FULL JOIN (SELECT {expression} AS s, count(*) AS m FROM {table} GROUP BY 1) c ON k.s = c.s"


@_query(" UNION ALL ".join([_zero("orders", _JOB), _zero("lineitem", _TASK), _zero("events", "event_type")]))
def status_counts_by_table(spark, sf_dir):
    jobs = _read(spark, sf_dir, "orders").select(_status(F.col("o_orderstatus")).alias("s"))
    tasks = _tasks(spark, sf_dir).select(F.col("status").alias("s"))
    events = _read(spark, sf_dir, "events").select(F.col("event_type").alias("s"))
    parts = [lifecycle.zero_filled(df, "s", _STATUS).withColumn("relation", F.lit(name)) for name, df in (("orders", jobs), ("lineitem", tasks), ("events", events))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("relation", "status", "n")


@_query("""WITH m AS (SELECT max(ts)::DATE AS last FROM events), c AS (SELECT unnest(generate_series(last - 6, last, INTERVAL 1 DAY))::DATE AS d FROM m),
n AS (SELECT strftime(d, '%Y-%m-%d') AS day, count(e.ts) AS n FROM c LEFT JOIN events e ON e.ts::DATE = d GROUP BY d) SELECT * FROM n UNION ALL SELECT 'total', sum(n)::BIGINT FROM n""")
def jobs_by_day_total(spark, sf_dir):
    days = lifecycle.daily(_read(spark, sf_dir, "events").select("ts"), "ts", 7)
    return days.unionByName(days.agg(F.sum("n").alias("n")).select(F.lit("total").alias("day"), "n"))


@_query("SELECT l_orderkey AS o_orderkey, " + ", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in _STATUS) + f" FROM (SELECT l_orderkey, {_TASK} AS s FROM lineitem) GROUP BY 1")
def job_cards(spark, sf_dir):
    cards = _tasks(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).pivot("status", _STATUS).count()
    return cards.na.fill(0, _STATUS)


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderpriority = '1-URGENT'")
def visible_jobs(spark, sf_dir):
    jobs = _read(spark, sf_dir, "orders")
    return jobs.where(lifecycle.visible(F.col("o_custkey"), F.lit(7), F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey")


@_query(f"SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'leased' ELSE 'completed' END AS s FROM lineitem) WHERE s = 'leased' AND l_suppkey = 3 AND l_shipdate > TIMESTAMP '1996-01-01'")
def leases_held(spark, sf_dir):
    tasks = _read(spark, sf_dir, "lineitem").withColumn("s", F.when(F.col("l_returnflag") == "N", "leased").otherwise("completed"))
    held = lifecycle.lease_held(F.col("s"), F.col("l_suppkey"), F.col("l_shipdate"), F.lit(3), F.expr("timestamp_ntz '1996-01-01'"))
    return tasks.where(held).select("l_orderkey", "l_linenumber")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 20")
def jobs_by_status(spark, sf_dir):
    jobs = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return lifecycle.page(jobs, "o_orderdate", "o_orderkey", 100, 20).select("o_orderkey", "o_totalprice")


@_query("SELECT count(*) AS total, ceil(count(*) / 100)::BIGINT AS pages FROM orders WHERE o_orderstatus = 'P'")
def page_totals(spark, sf_dir):
    total = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").agg(F.count("*").alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / 100))


def _listing(name: str, table: str, columns: list[str], order: list[str], limit: int, where: str = "TRUE"):
    """A table's rows in an order; the limit is the feature (a page)."""
    sql = f"SELECT {', '.join(columns)} FROM {table} WHERE {where} ORDER BY {', '.join(order)} LIMIT {limit}"

    def run(spark, sf_dir):
        by = [F.col(c.split()[0]).desc() if c.endswith(" DESC") else F.col(c) for c in order]
        return _read(spark, sf_dir, table).where(where).orderBy(*by).limit(limit).select(*columns)

    _query(sql, name)(run)


_listing("list_tasks", "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"], ["l_orderkey", "l_linenumber"], 100)
_listing("list_completed_tasks", "lineitem", ["l_orderkey", "l_linenumber"], ["l_linenumber", "l_orderkey"], 100, "l_linestatus = 'F' AND l_orderkey < 500")
_listing("list_finished_jobs", "orders", ["o_orderkey", "o_orderdate"], ["o_orderdate", "o_orderkey"], 100, "o_orderstatus = 'F'")
_listing("list_artifacts", "documents", ["doc_id", "source", "n_chars"], ["n_chars DESC", "doc_id"], 100)
_listing("list_users", "customer", ["c_custkey", "c_name"], ["c_name"], 100)
_listing("list_keys", "supplier", ["s_suppkey", "s_name"], ["s_name DESC"], 100)


@_query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1997-01-01'")
def affected_jobs(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").where("l_linestatus = 'O' and l_shipdate < timestamp_ntz '1997-01-01'").select("l_orderkey").distinct()


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'absent' WHEN l_shipdate < o_orderdate THEN 'before its job' ELSE 'of another kind' END AS violation
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 97 <> 0) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_shipdate < o_orderdate OR (l_linestatus = 'O' AND o_orderstatus = 'F')""")
def artifact_integrity(spark, sf_dir):
    jobs = _read(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0").select("o_orderkey", "o_orderdate", "o_orderstatus")
    kept = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus")
    both = kept.join(jobs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    why = F.when(F.col("o_orderkey").isNull(), "absent").when(F.col("l_shipdate") < F.col("o_orderdate"), "before its job").when((F.col("l_linestatus") == "O") & (F.col("o_orderstatus") == "F"), "of another kind")
    return both.select("l_orderkey", "l_linenumber", why.alias("violation")).where("violation is not null")


@_query("SELECT n_nationkey, n_name, coalesce(enabled, TRUE) AS enabled FROM nation LEFT JOIN (SELECT r_regionkey AS k, r_regionkey < 2 AS enabled FROM region WHERE r_regionkey < 4) ON n_nationkey = k")
def workload_settings(spark, sf_dir):
    settings = _read(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("n_nationkey"), (F.col("r_regionkey") < 2).alias("enabled"))
    return _read(spark, sf_dir, "nation").join(settings, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("enabled", F.lit(True)).alias("enabled"))


@_query("""SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'cluster token' WHEN c_name IS NOT NULL THEN lower(trim(c_name)) ELSE concat('user ', left(o_custkey::VARCHAR, 8)) END AS owner
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey""")
def owner_names(spark, sf_dir):
    known = _read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_name")
    jobs = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(known, F.col("c_custkey") == F.col("o_custkey"), "left")
    fallback = F.concat(F.lit("user "), F.left(F.col("o_custkey").cast("string"), F.lit(8)))
    return jobs.select("o_orderkey", F.when(F.col("o_custkey") % 11 == 0, "cluster token").otherwise(F.coalesce(tx.normalised(F.col("c_name")), fallback)).alias("owner"))


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN n IS NULL THEN l_returnflag ELSE 'L' END AS l_returnflag FROM lineitem
LEFT JOIN (SELECT l_orderkey AS k, min(l_linenumber) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON k = l_orderkey AND n = l_linenumber""")
def claimed_tasks(spark, sf_dir):
    tasks = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    claims = tasks.where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber")).withColumn("l_returnflag", F.lit("L"))
    return lifecycle.updated(tasks, claims, ["l_orderkey", "l_linenumber"], ["l_returnflag"]).drop("l_linestatus")


@_query("""SELECT e.event_id, coalesce(a.attempt, 1) AS attempt FROM events e LEFT JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS attempt FROM lineitem GROUP BY 1) a ON a.k = e.event_id
WHERE NOT (e.event_type = 'error' AND a.attempt IS NOT NULL)""")
def backfilled_attempts(spark, sf_dir):
    attempts = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max("l_linenumber").alias("attempt"))
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type").join(attempts, "event_id", "left")
    return rows.where(~((F.col("event_type") == "error") & F.col("attempt").isNotNull())).select("event_id", F.coalesce("attempt", F.lit(1)).alias("attempt"))


@_query(f"SELECT l_orderkey, l_linenumber, CASE WHEN s IN ('completed', 'failed') THEN s ELSE 'cancelled' END AS status FROM (SELECT *, {_TASK} AS s FROM lineitem) WHERE l_orderkey % 5 = 0")
def cancelled_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir).where("l_orderkey % 5 = 0").select("l_orderkey", "l_linenumber", lifecycle.cancelled(F.col("status")).alias("status"))


@_query("SELECT user_id, event_type, min(props) AS digest, count(*) AS n, min(props) <> max(props) AS conflict FROM events GROUP BY 1, 2")
def completion_conflicts(spark, sf_dir):
    return lifecycle.completions(_read(spark, sf_dir, "events"), ["user_id", "event_type"], "props")


_MOVE = "CASE event_type WHEN 'signup' THEN 'leased' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END"


@_query(f"""WITH RECURSIVE e AS (SELECT user_id, {_MOVE} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, {_MOVE}) AS r FROM events), m(a, b) AS (VALUES ('pending', 'leased'), ('leased', 'running'), ('leased', 'pending'), ('leased', 'completed'), ('leased', 'failed'), ('running', 'pending'), ('running', 'completed'), ('running', 'failed')),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS r, 'pending' AS s FROM e UNION ALL SELECT f.user_id, e.r, CASE WHEN m.b IS NULL THEN f.s ELSE m.b END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1 LEFT JOIN m ON m.a = f.s AND m.b = e.s)
SELECT user_id, arg_max(s, r) AS status FROM f GROUP BY 1""")
def replayed_tasks(spark, sf_dir):
    kind = F.col("event_type")
    move = F.when(kind == "signup", "leased").when(kind == "view", "running").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("pending")
    return lifecycle.folded(_read(spark, sf_dir, "events").select("user_id", "ts", move.alias("move")), "user_id", "ts", "move")


@_query(f"SELECT o_orderkey, CASE WHEN s = 'completed' AND o_custkey % 2 = 0 THEN 'reducing' ELSE s END AS status FROM (SELECT *, {_JOB} AS s FROM orders)")
def reducing_jobs(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", lifecycle.reducing(_status(F.col("o_orderstatus")), F.col("o_custkey") % 2 == 0).alias("status"))


@_query("SELECT event_type AS route, CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10)::BIGINT + 1 END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def duration_histogram(spark, sf_dir):
    events = _read(spark, sf_dir, "events").where("value is not null")
    return events.groupBy(F.col("event_type").alias("route"), F.width_bucket("value", F.lit(0.0), F.lit(100.0), F.lit(10)).alias("bucket")).agg(F.count("*").alias("n"))


@_query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), c AS (SELECT hour, sum(n) OVER (ORDER BY hour)::BIGINT AS completed FROM h),
r AS (SELECT hour, (completed - first_value(completed) OVER w) / greatest((epoch(hour) - epoch(first_value(hour) OVER w)) / 60, 1.0 / 60) AS rate FROM c WINDOW w AS (ORDER BY hour ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
l AS (SELECT * FROM r ORDER BY hour DESC LIMIT 90) SELECT arg_max(rate, hour) AS current, max(rate) AS peak FROM l""")
def throughput_peak(spark, sf_dir):
    hours = _read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg(F.count("*").alias("n"))
    done = hours.withColumn("completed", F.sum("n").over(Window.orderBy("at")))  # a row an hour
    return lifecycle.rate_summary(lifecycle.trailing_rate(done, "at", "completed"), "at")


@_query("SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1")
def contiguous_indexes(spark, sf_dir):
    k = F.col("l_linenumber") - 1
    whole = (F.min(k) == 0) & (F.max(k) == F.count("*") - 1) & (F.countDistinct(k) == F.count("*"))
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(whole.alias("contiguous"))


@_query("""WITH p AS (SELECT n_regionkey::BIGINT AS a, n_nationkey::BIGINT % 6 AS b FROM nation), s AS (SELECT DISTINCT least(a, b) AS left_block, greatest(a, b) AS right_block FROM p),
n AS (SELECT max(right_block) AS last FROM s), w AS (SELECT x AS left_block, y AS right_block FROM n, unnest(range(0, last + 1)) t(x), unnest(range(0, last + 1)) u(y) WHERE x <= y)
SELECT *, 'missing' AS side FROM (SELECT * FROM w EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM s EXCEPT SELECT * FROM w)""")
def pair_coverage(spark, sf_dir):
    a, b = F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long") % 6
    seen = _read(spark, sf_dir, "nation").select(F.least(a, b).alias("left_block"), F.greatest(a, b).alias("right_block")).distinct()
    return graph.pair_coverage(seen)


@_query("SELECT least(o_custkey, o_orderkey % 150) AS a, greatest(o_custkey, o_orderkey % 150) AS b, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_edges(spark, sf_dir):
    x, y = F.col("o_custkey"), F.col("o_orderkey") % 150
    return _read(spark, sf_dir, "orders").groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count("*").alias("n")).where("n > 1")


@_query("SELECT l_orderkey, l_linenumber, (l_linenumber * pow(2, 12 - floor(log2(l_quantity))))::BIGINT AS ulps, l_linenumber * pow(2, 12 - floor(log2(l_quantity))) <= 1000 AS within FROM lineitem")
def ulp_distances(spark, sf_dir):
    a, b = F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber") * 2.0**-40
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", verify.ulp_distance(a, b).cast("long").alias("ulps"))
    return rows.withColumn("within", F.col("ulps") <= 1000)


@_query("""SELECT n_nationkey, n_nationkey::BIGINT AS left, n_regionkey::BIGINT AS right, n_nationkey::BIGINT AS index, lower(replace(n_name, '_', '-')) AS name, regexp_full_match(lower(replace(n_name, '_', '-')), '[a-z][a-z0-9]*(-[a-z0-9]+)*') AS valid,
regexp_full_match(concat(n_nationkey, '.', n_regionkey, '.0-rc'), '(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)(-[0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?') AS semver, regexp_full_match(lower(n_name), '[a-z][a-z0-9]*([-_.][a-z0-9]+)*') AS identifier FROM nation""")
def key_forms(spark, sf_dir):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    pair = tx.block_pair(F.concat(F.lit("map."), n, F.lit("x"), r))
    name = tx.workload_name(F.lower("n_name"))
    version = F.concat(n, F.lit("."), r, F.lit(".0-rc"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", pair["left"].alias("left"), pair["right"].alias("right"), tx.index_key(F.concat(F.lit("map."), n)).alias("index"), name.alias("name"), tx.is_workload_name(name).alias("valid"), tx.is_semver(version).alias("semver"), tx.is_identifier(F.lower("n_name")).alias("identifier"))


_CELL = "CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'NaN' ELSE (value / 50)::VARCHAR END"


@_query(f"SELECT event_id, CASE WHEN event_id % 4 > 1 AND value / 50 BETWEEN 0 AND 1 THEN value / 50 END AS similarity, (CASE WHEN value < 0 THEN ceil(value * 1000) ELSE floor(value * 1000) END) / 1000 AS ms FROM events")
def parsed_floats(spark, sf_dir):
    k = F.col("event_id") % 4
    cell = F.when(k == 0, "x").when(k == 1, "NaN").otherwise((F.col("value") / 50).cast("string"))
    return _read(spark, sf_dir, "events").select("event_id", tx.ranged_float(cell).alias("similarity"), tx.truncated_ms(F.col("value")).alias("ms"))


@_query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN TRUE WHEN page_id % 3 = 1 THEN FALSE ELSE page_id % 2 = 0 END AS previewable FROM pages""")
def previewable(spark, sf_dir):
    k = F.col("page_id")
    media = F.when(k % 3 == 0, "Text/CSV; charset=utf-8").when(k % 3 == 1, "application/json")
    name = F.when((k % 3 == 2) & (k % 2 == 0), "Result.CSV").otherwise("result.tsv")
    return _read(spark, sf_dir, "pages").select("page_id", tx.is_csv(media, name).alias("previewable"))


@_query("SELECT event_type, avg(epoch(ts)) - epoch(min(ts)) AS mean_offset, (epoch(max(ts)) - epoch(min(ts)))::DOUBLE AS seconds FROM events GROUP BY 1")
def epoch_seconds(spark, sf_dir):
    at = F.col("ts").cast("timestamp").cast("double")
    return _read(spark, sf_dir, "events").groupBy("event_type").agg((F.avg(at) - F.min(at)).alias("mean_offset"), (F.max(at) - F.min(at)).alias("seconds"))


@_query("SELECT sum(strlen(text)) FILTER (source = 'web')::BIGINT AS datasets, sum(strlen(text)) FILTER (source <> 'web')::BIGINT AS other, sum(strlen(text))::BIGINT AS total FROM documents")
def artifact_bytes(spark, sf_dir):
    size = F.octet_length("text")
    return _read(spark, sf_dir, "documents").agg(F.sum(F.when(F.col("source") == "web", size)).alias("datasets"), F.sum(F.when(F.col("source") != "web", size)).alias("other"), F.sum(size).alias("total"))


@_query("SELECT least(count(*), 5000) AS scanned, count(*) FILTER (r < 5000 AND ok) AS valid, count(*) FILTER (r < 5000 AND NOT ok) AS invalid, count(*) > 5000 AS stopped_early, min(r) FILTER (r < 5000 AND NOT ok) AS first_invalid FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS r, event_type <> 'error' AS ok FROM events)")
def scan_policy(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", (F.col("event_type") != "error").alias("ok"))
    return scans.stats(tables.numbered(events, ["event_id"]), "ok", "row_no", 5000)


@_query("SELECT (r // 1000)::BIGINT AS shard, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) GROUP BY 1")
def row_shards(spark, sf_dir):
    rows = tables.numbered(_read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    return scans.sharded(rows, "row_no", 1000).groupBy("shard").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@_query("""SELECT count(*) FILTER (busy OR online) AS online, count(*) FILTER (busy) AS busy, count(*) AS total FROM (SELECT user_id, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS online,
max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS busy FROM events GROUP BY 1 ORDER BY user_id LIMIT 100)""")
def listed_worker_counts(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("user_id", "ts")
    now = events.agg(F.max("ts").alias("now"))
    seen = events.groupBy("user_id").agg(F.max("ts").alias("seen")).orderBy("user_id").limit(100).crossJoin(F.broadcast(now))  # now: one row
    online, busy = F.col("seen") >= F.col("now") - F.expr("interval 1 day"), F.col("seen") >= F.col("now") - F.expr("interval 1 hour")
    return seen.agg(F.count_if(online | busy).alias("online"), F.count_if(busy).alias("busy"), F.count("*").alias("total"))


@_query(f"""SELECT 'jobs' AS metric, {_JOB} AS label, count(*)::DOUBLE AS value FROM orders GROUP BY 2 UNION ALL SELECT 'tasks', {_TASK}, count(*)::DOUBLE FROM lineitem GROUP BY 2
UNION ALL SELECT 'artifact_chars', source, sum(n_chars)::DOUBLE FROM documents GROUP BY 2""")
def gauges(spark, sf_dir):
    jobs = _read(spark, sf_dir, "orders").groupBy(_status(F.col("o_orderstatus")).alias("label")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("jobs"))
    tasks = _tasks(spark, sf_dir).groupBy(F.col("status").alias("label")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("tasks"))
    chars = _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("label")).agg(F.sum("n_chars").cast("double").alias("value")).withColumn("metric", F.lit("artifact_chars"))
    return jobs.unionByName(tasks).unionByName(chars).select("metric", "label", "value")


@_query("SELECT c_custkey, 'c_acctbal' AS why FROM customer WHERE c_custkey % 10 = 0 AND c_acctbal <> 0 AND c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey % 7 = 0")
def table_differences(spark, sf_dir):
    base = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    other = base.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") * 1.01).otherwise(F.col("c_acctbal") * (1 + 1e-12)))
    return verify.tables_match(base, other, ["c_custkey"], 0.0, 1e-9)
