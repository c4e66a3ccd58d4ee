"""Registered queries over the driver's tables, and the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as fp
from ..functions import text as tx
from ..operators import graph, lifecycle, topk, verify
from ..sources import tables
from ..streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "embeddings").select("vec_id", fp.packed(F.col("embedding"), 64).alias("words"))
    return df.withColumn("n", fp.bits(F.col("words")))


def _scored(spark: SparkSession, sf_dir: str, query_id: int = 0) -> DataFrame:
    """Similarity of every fingerprint but the query to it.  The query is one row."""
    prints = _prints(spark, sf_dir)
    q = prints.where(F.col("vec_id") == query_id).limit(1).collect()
    if not q:
        raise ValueError(f"no vector {query_id}")
    words = F.array(*[F.lit(w).cast("long") for w in q[0].words])
    sim = fp.tanimoto(fp.shared(F.col("words"), words), F.col("n"), F.lit(q[0].n))
    return prints.where(F.col("vec_id") != query_id).select("vec_id", sim.alias("similarity"))


_FP = """WITH fp AS (SELECT vec_id, list_filter(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda x: x IS NOT NULL) AS b FROM embeddings)"""
_SIM = "coalesce(len(list_intersect(x.b, y.b))::DOUBLE / nullif(len(x.b) + len(y.b) - len(list_intersect(x.b, y.b)), 0), 0.0)"
_SCORED = f"{_FP}, s AS (SELECT x.vec_id, {_SIM} AS similarity FROM fp x, fp y WHERE y.vec_id = 0 AND x.vec_id <> 0)"


def _top_sql(k: int, way: str, where: str = "") -> str:
    return f"{_SCORED} SELECT row_number() OVER (ORDER BY similarity {way}, vec_id) AS rank, vec_id, similarity FROM s {where} ORDER BY rank LIMIT {k}"


@_query(_top_sql(20, "DESC"))
def topk_tanimoto_greater(spark, sf_dir):
    return topk.top(_scored(spark, sf_dir), 20, "similarity", ["vec_id"]).select("rank", "vec_id", "similarity")


@_query(_top_sql(20, "ASC"))
def topk_tanimoto_less(spark, sf_dir):
    return topk.top(_scored(spark, sf_dir), 20, "similarity", ["vec_id"], "less").select("rank", "vec_id", "similarity")


@_query(_top_sql(1000, "DESC", "WHERE similarity >= 0.4"))
def topk_threshold(spark, sf_dir):
    near = topk.threshold(_scored(spark, sf_dir), "similarity", 0.4)
    return topk.top(near, 1000, "similarity", ["vec_id"]).select("rank", "vec_id", "similarity")


@_query(_top_sql(20, "DESC"))
def topk_sharded_merge(spark, sf_dir):
    shard = F.floor(F.col("vec_id") / 100)
    return topk.top_by_shard(_scored(spark, sf_dir), shard, 20, "similarity", ["vec_id"]).select("rank", "vec_id", "similarity")


@_query(r"""WITH t AS (SELECT doc_id, lower(trim(text)) AS c, list_distinct(string_split_regex(lower(trim(text)), '[ \t\r\n]+')) AS b FROM documents),
s AS (SELECT x.doc_id, len(list_intersect(x.b, y.b))::DOUBLE / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) AS similarity FROM t x, t y WHERE y.doc_id = 0 AND x.doc_id <> 0 AND x.c <> y.c)
SELECT row_number() OVER (ORDER BY similarity DESC, doc_id) AS rank, doc_id, similarity FROM s ORDER BY rank LIMIT 20""")
def topk_text_tokens(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", tx.normalised(F.col("text")).alias("canonical"), tx.tokens(F.col("text")).alias("t"))
    q = docs.where("doc_id = 0").limit(1).collect()[0]
    query = F.array(*[F.lit(w) for w in q.t])
    rest = topk.not_self(docs, "doc_id", "canonical", 0, q.canonical)
    common = F.size(F.array_intersect("t", query))
    scored = rest.select("doc_id", fp.tanimoto(common, F.size("t"), F.lit(len(q.t))).alias("similarity"))
    return topk.top(scored, 20, "similarity", ["doc_id"]).select("rank", "doc_id", "similarity")


def _edges(spark, sf_dir, threshold, direction):
    prints = _prints(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "words", "n")
    return graph.edges(prints, threshold, direction)


_EDGES = f"{_FP}, e AS (SELECT x.vec_id AS source_id, y.vec_id AS target_id, {_SIM} AS similarity FROM fp x JOIN fp y ON x.vec_id < y.vec_id)"


@_query(f"{_EDGES} SELECT * FROM e WHERE similarity >= 0.5")
def similarity_graph_greater(spark, sf_dir):
    return _edges(spark, sf_dir, 0.5, "greater").orderBy("source_id", "target_id", F.col("similarity").desc())


@_query(f"{_EDGES} SELECT * FROM e WHERE similarity <= 0.16")
def similarity_graph_less(spark, sf_dir):
    return _edges(spark, sf_dir, 0.16, "less").orderBy("source_id", "target_id", F.col("similarity").desc())


@_query(f"{_EDGES} SELECT (SELECT count(*) FROM fp) AS molecules, (SELECT count(*) * (count(*) - 1) // 2 FROM fp) AS checked_pairs, (SELECT count(*) FROM e WHERE similarity >= 0.5) AS edges")
def graph_checked_pairs(spark, sf_dir):
    n = _read(spark, sf_dir, "embeddings").agg(F.count("*").alias("molecules"))
    n = n.withColumn("checked_pairs", F.floor(F.col("molecules") * (F.col("molecules") - 1) / 2).cast("long"))
    return n.crossJoin(_edges(spark, sf_dir, 0.5, "greater").agg(F.count("*").alias("edges")))  # one row each


@_query(f"{_EDGES} SELECT v AS vec_id, count(*) AS degree FROM (SELECT source_id AS v FROM e WHERE similarity >= 0.5 UNION ALL SELECT target_id FROM e WHERE similarity >= 0.5) GROUP BY v")
def graph_degree(spark, sf_dir):
    ends = _edges(spark, sf_dir, 0.5, "greater").select(F.explode(F.array("source_id", "target_id")).alias("vec_id"))
    return ends.groupBy("vec_id").agg(F.count("*").alias("degree"))


@_query("""WITH b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS block, count(*) OVER () AS n FROM embeddings), c AS (SELECT block, count(*) AS m FROM b GROUP BY block)
SELECT x.block::BIGINT AS left_block, y.block::BIGINT AS right_block, (CASE WHEN x.block = y.block THEN x.m * (x.m - 1) // 2 ELSE x.m * y.m END)::BIGINT AS pairs FROM c x JOIN c y ON x.block <= y.block""")
def block_pairs(spark, sf_dir):
    ids = _read(spark, sf_dir, "embeddings").select("vec_id")
    blocks = tables.numbered(ids, ["vec_id"]).groupBy(F.floor(F.col("row_no") / 100).alias("block")).agg(F.count("*").alias("m"))
    left = blocks.select(F.col("block").alias("left_block"), F.col("m").alias("a"))
    right = blocks.select(F.col("block").alias("right_block"), F.col("m").alias("b"))
    pairs = graph.block_pairs(blocks).join(left, "left_block").join(right, "right_block")
    same = F.floor(F.col("a") * (F.col("a") - 1) / 2)
    return pairs.select("left_block", "right_block", F.when(F.col("left_block") == F.col("right_block"), same).otherwise(F.col("a") * F.col("b")).cast("long").alias("pairs"))


@_query("SELECT md5(lower(trim(text))) AS text_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_pairs(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.md5(tx.normalised(F.col("text"))).alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count("*").alias("n")).where("n > 1")


@_query("SELECT count(*) AS scanned, count(l.doc_id) AS valid, count(*) - count(l.doc_id) AS invalid FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def scan_stats(spark, sf_dir):
    known = _read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("ok", F.lit(True))
    docs = _read(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left")
    return docs.agg(F.count("*").alias("scanned"), F.count_if("ok").alias("valid"), F.count_if(F.col("ok").isNull()).alias("invalid"))


@_query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def first_rows(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(25)


def _range(low, high):
    def run(spark, sf_dir):
        part = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
        if low is not None:
            part = part.where(F.col("p_retailprice") >= low)
        return part if high is None else part.where(F.col("p_retailprice") <= high)

    return run


_query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1400", "range_filter_both")(_range(950, 1400))
_query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 905", "range_filter_min")(_range(905, None))
_query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 950", "range_filter_max")(_range(None, 950))


@_query(r"""SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, length(text) - length(replace(text, chr(10), '')) AS line_feeds, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(text)::DOUBLE / strlen(text) AS chars_per_byte FROM documents""")
def descriptor_batch(spark, sf_dir):
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select(
        "doc_id",
        F.length(t).cast("long").alias("chars"),
        F.octet_length(t).cast("long").alias("bytes"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("line_feeds"),
        F.length(F.regexp_replace(t, "[^0-9]", "")).cast("long").alias("digits"),
        F.length(F.regexp_replace(t, "[^A-Z]", "")).cast("long").alias("capitals"),
        F.try_divide(F.length(t).cast("double"), F.octet_length(t).cast("double")).alias("chars_per_byte"),
    )


@_query("SELECT p_partkey % 4 AS part_no, p_partkey FROM part")
def ordered_concat(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select("p_partkey")
    return tables.concat_ordered([part.where(F.col("p_partkey") % 4 == k) for k in range(4)], "p_partkey").select("part_no", "p_partkey")


_STATUS = ["pending", "running", "completed", "failed", "cancelled"]


def _status(c):
    return F.when(c == "F", "completed").when(c == "O", "pending").otherwise("running")


@_query("""SELECT coalesce(k.status, c.status) AS status, coalesce(m, 0) AS n FROM (VALUES ('pending'), ('running'), ('completed'), ('failed'), ('cancelled')) k(status)
FULL JOIN (SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, count(*) AS m FROM orders GROUP BY 1) c ON k.status = c.status""")
def status_counts_zero_filled(spark, sf_dir):
    jobs = _read(spark, sf_dir, "orders").select(_status(F.col("o_orderstatus")).alias("s"))
    return lifecycle.zero_filled(jobs, "s", _STATUS)


_TASK = "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END"


def _tasks(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "completed").otherwise("pending")
    return _read(spark, sf_dir, "lineitem").withColumn("status", status)


@_query(f"SELECT l_orderkey AS o_orderkey, {_TASK} AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def job_task_counts(spark, sf_dir):
    return _tasks(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey"), "status").agg(F.count("*").alias("n"))


@_query(f"""SELECT o_orderkey, CASE WHEN total IS NULL THEN 'pending' WHEN failed > 0 THEN 'failed' WHEN completed = total THEN 'completed' WHEN completed > 0 THEN 'running' ELSE 'pending' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS total, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'completed') AS completed FROM (SELECT l_orderkey, {_TASK} AS s FROM lineitem) GROUP BY 1) ON o_orderkey = l_orderkey""")
def derived_job_status(spark, sf_dir):
    counts = _tasks(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "completed").alias("completed"))
    jobs = _read(spark, sf_dir, "orders").select("o_orderkey").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0)
    return jobs.select("o_orderkey", lifecycle.derived_status(F.col("total"), F.col("failed"), F.col("completed"), F.lit(0)).alias("status"))


@_query("""WITH m AS (SELECT max(ts)::DATE AS last FROM events), c AS (SELECT unnest(generate_series(last - 6, last, INTERVAL 1 DAY))::DATE AS d FROM m)
SELECT strftime(d, '%Y-%m-%d') AS day, count(e.ts) AS n FROM c LEFT JOIN events e ON e.ts::DATE = d GROUP BY d""")
def jobs_by_day_7d(spark, sf_dir):
    return lifecycle.daily(_read(spark, sf_dir, "events").select("ts"), "ts", 7)


@_query("SELECT event_type AS workload, count(*) AS n FROM events GROUP BY 1")
def counts_by_workload(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("workload")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "workload")


@_query(f"""SELECT count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, coalesce(avg(CASE WHEN s = 'completed' THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) END), 0) AS avg_days,
CASE WHEN count(*) FILTER (s <> 'pending') > 0 THEN count(*) FILTER (s = 'failed')::DOUBLE / count(*) FILTER (s <> 'pending') ELSE 0 END AS failure_rate FROM (SELECT *, {_TASK} AS s FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""")
def task_stats(spark, sf_dir):
    jobs = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    t = _tasks(spark, sf_dir).join(jobs, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    out = t.agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.avg(F.when(F.col("status") == "completed", days)), F.lit(0.0)).alias("avg_days"))
    return out.withColumn("failure_rate", F.coalesce(F.try_divide(F.col("failed").cast("double"), (F.col("failed") + F.col("completed")).cast("double")), F.lit(0.0)))


@_query("SELECT source AS kind, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1")
def bytes_by_kind(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("kind")).agg(F.sum("n_chars").alias("total"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def jobs_page(spark, sf_dir):
    return lifecycle.page(_read(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 50, 100).select("o_orderkey", "o_totalprice")


@_query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem
WHERE l_linestatus = 'O' AND l_linenumber < 4 AND l_returnflag IN ('N') AND l_partkey NOT IN (SELECT user_id FROM events)) WHERE r = 1""")
def claim_next(spark, sf_dir):
    open_ = _read(spark, sf_dir, "lineitem").where("l_linestatus = 'O' and l_linenumber < 4").where(F.col("l_returnflag").isin("N"))
    voted = _read(spark, sf_dir, "events").select(F.col("user_id").alias("l_partkey"))
    return lifecycle.next_tasks(open_, voted, "l_partkey", "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 THEN 'pending' ELSE 'failed' END AS new_status FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1997-01-01'")
def expire_leases(spark, sf_dir):
    late = _read(spark, sf_dir, "lineitem").where("l_linestatus = 'O' and l_shipdate < timestamp_ntz '1997-01-01'")
    return late.select("l_orderkey", "l_linenumber", lifecycle.expired(F.col("l_linenumber"), 3, F.col("l_shipdate"), F.expr("timestamp_ntz '1997-01-01'")).alias("new_status"))


@_query("SELECT user_id, CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'offline' ELSE 'online' END AS status FROM events GROUP BY user_id")
def stale_workers(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    now = events.agg((F.max("ts") - F.expr("interval 1 day")).alias("cut"))
    return events.groupBy("user_id").agg(F.max("ts").alias("seen")).crossJoin(F.broadcast(now)).select("user_id", F.when(F.col("seen") < F.col("cut"), "offline").otherwise("online").alias("status"))  # now: one row


@_query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_vote(spark, sf_dir):
    votes = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return lifecycle.latest(votes, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


_VOTES = "votes AS (SELECT event_id % 60 AS task, user_id AS owner, event_type AS digest, ts, event_id FROM events)"


def _votes(spark, sf_dir):
    return _read(spark, sf_dir, "events").select((F.col("event_id") % 60).alias("task"), F.col("user_id").alias("owner"), F.col("event_type").alias("digest"), "ts", "event_id")


@_query(f"""WITH {_VOTES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, owner ORDER BY ts DESC, event_id DESC) AS r FROM votes) WHERE r = 1),
c AS (SELECT task, digest, count(DISTINCT owner) AS votes, row_number() OVER (PARTITION BY task ORDER BY count(DISTINCT owner) DESC, digest) AS r FROM l GROUP BY 1, 2)
SELECT task, digest, votes, CASE WHEN votes >= 2 THEN 'accept' ELSE 'wait' END AS decision FROM c WHERE r = 1""")
def quorum_winner(spark, sf_dir):
    last = lifecycle.latest(_votes(spark, sf_dir), ["task", "owner"], [F.col("ts"), F.col("event_id")])
    return lifecycle.quorum(last, 2)


@_query(f"""WITH {_VOTES}, o AS (SELECT task, owner, min(digest) AS digest, min(digest) <> max(digest) AS two FROM votes GROUP BY 1, 2), t AS (SELECT task, bool_or(two) AS two FROM o GROUP BY 1),
c AS (SELECT task, digest, count(*) FILTER (NOT two) AS votes FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY votes DESC, digest) AS r, rank() OVER (PARTITION BY task ORDER BY votes DESC) AS k FROM c),
s AS (SELECT task, max(digest) FILTER (r = 1) AS first, max(votes) AS votes, count(*) FILTER (k = 1) > 1 AS tied FROM r GROUP BY task),
d AS (SELECT s.*, CASE WHEN two THEN 'reject' WHEN votes >= 2 AND NOT tied THEN 'accept' WHEN votes >= 2 THEN 'reject' ELSE 'inconclusive' END AS decision FROM s JOIN t USING (task))
SELECT task, CASE WHEN decision = 'accept' THEN first END AS digest, votes, decision FROM d""")
def quorum_winner_strict(spark, sf_dir):
    return lifecycle.quorum_strict(_votes(spark, sf_dir), 2)


@_query("SELECT s_suppkey, coalesce(n_name, concat('Worker ', left(s_name, 8))) AS name, n_name IS NULL AS fallback FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 15) ON s_nationkey = n_nationkey")
def worker_name_lookup(spark, sf_dir):
    names = _read(spark, sf_dir, "nation").where("n_nationkey < 15").select("n_nationkey", "n_name")
    out = _read(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select("s_suppkey", F.coalesce("n_name", F.concat(F.lit("Worker "), F.left("s_name", F.lit(8)))).alias("name"), F.col("n_name").isNull().alias("fallback"))


@_query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), c AS (SELECT hour, sum(n) OVER (ORDER BY hour)::BIGINT AS completed FROM h)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, completed, (completed - first_value(completed) OVER w) / greatest((epoch(hour) - epoch(first_value(hour) OVER w)) / 60, 1.0 / 60) AS rate FROM c WINDOW w AS (ORDER BY hour ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def throughput_lag(spark, sf_dir):
    hours = _read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg(F.count("*").alias("n"))
    done = hours.withColumn("completed", F.sum("n").over(Window.orderBy("at")))  # a row an hour
    return lifecycle.trailing_rate(done, "at", "completed").select(F.date_format("at", "yyyy-MM-dd HH").alias("hour"), "completed", "rate")


@_query(r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages)
SELECT CASE WHEN path = '' THEN '/' ELSE array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') THEN '{id}' ELSE s END), '/') END AS route, count(*) AS n FROM p GROUP BY 1""")
def route_normalise(spark, sf_dir):
    return _read(spark, sf_dir, "pages").groupBy(tx.route(F.col("url")).alias("route")).agg(F.count("*").alias("n"))


@_query(r"""SELECT doc_id, substring(regexp_replace(regexp_replace(text, '[A-Za-z]:\\[^\s''"\],)]+', '<path>', 'g'), '(^|[\s''"(\[=])/[^\s''"\],)]+', '\1<path>', 'g'), 1, 300) AS cleaned FROM documents""")
def error_sanitise(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.sanitised(F.col("text")).alias("cleaned"))


@_query("""SELECT count(DISTINCT o_orderkey) AS jobs, count(l_orderkey) AS artifacts, coalesce(sum(l_quantity), 0)::DOUBLE AS freed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01'""")
def prune_totals(spark, sf_dir):
    old = _read(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderdate < timestamp_ntz '1995-01-01'").select("o_orderkey")
    kept = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    per_job = old.join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("a"), F.sum("l_quantity").alias("q"))
    return per_job.agg(F.count("*").alias("jobs"), F.coalesce(F.sum("a"), F.lit(0)).alias("artifacts"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("freed"))


@_query(f"{_SCORED}, r AS (SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s ORDER BY rank LIMIT 100), l AS (SELECT *, lag(vec_id) OVER (ORDER BY rank) AS before FROM r) SELECT count(*) FILTER (vec_id < before) AS violations, count(*) AS ranks, max(rank) = count(DISTINCT rank) AS contiguous FROM l")
def partial_order_check(spark, sf_dir):
    ranked = topk.top(_scored(spark, sf_dir), 100, "similarity", ["vec_id"])
    bad = verify.out_of_order(ranked, "rank", [F.col("vec_id")]).agg(F.count("*").alias("violations"))
    whole = ranked.agg(F.count("*").alias("ranks"), (F.max("rank") == F.countDistinct("rank")).alias("contiguous"))
    return bad.crossJoin(whole)  # one row each


@_query("""SELECT count(*) FILTER (ok) AS within, count(*) FILTER (NOT ok) AS outside FROM (SELECT abs(a - b) <= greatest(0.01, 0.001 * greatest(abs(a), abs(b))) OR a = b AS ok
FROM (SELECT l_extendedprice AS a, l_extendedprice * (1 + l_tax / 50) AS b FROM lineitem))""")
def numeric_tolerance(spark, sf_dir):
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_tax") / 50)
    ok = _read(spark, sf_dir, "lineitem").select(verify.within(a, b, 0.01, 0.001).alias("ok"))
    return ok.agg(F.count_if("ok").alias("within"), F.count_if(~F.col("ok")).alias("outside"))


@_query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = windows.tumbling(events, "ts", "event_type", "1 day")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@_query("SELECT floor((p_partkey - 1) / 100)::BIGINT AS shard, count(*) AS n FROM part GROUP BY 1")
def shard_row_counts(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select("p_partkey")
    return part.groupBy(F.floor((F.col("p_partkey") - 1) / 100).alias("shard")).agg(F.count("*").alias("n"))


@_query("SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 2) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def key_set_difference(spark, sf_dir):
    jobs = _read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    tasks = _read(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return verify.key_difference(jobs, tasks, ["o_orderkey"])


@_query("SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', l_orderkey, l_linenumber, l_returnflag)) AS digest FROM lineitem")
def record_digests(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_returnflag"), 256).alias("digest"))


@_query("SELECT count(*) FILTER (last_ts >= now - INTERVAL 1 DAY) AS online, count(*) FILTER (last_ts >= now - INTERVAL 1 HOUR) AS busy, count(*) AS total FROM (SELECT user_id, max(ts) AS last_ts, (SELECT max(ts) FROM events) AS now FROM events GROUP BY user_id)")
def worker_counts(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    seen = events.groupBy("user_id").agg(F.max("ts").alias("seen")).crossJoin(F.broadcast(now))  # now: one row
    return seen.agg(F.count_if(F.col("seen") >= F.col("now") - F.expr("interval 1 day")).alias("online"), F.count_if(F.col("seen") >= F.col("now") - F.expr("interval 1 hour")).alias("busy"), F.count("*").alias("total"))


from . import reports as _reports  # noqa: E402, F401  registers more queries
