"""Reports over jobs, tasks, workers and votes held as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(status, n): every known status, 0 where absent; unknown ones survive."""
    known = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias("status"))
    counts = df.groupBy(F.col(key).alias("status")).agg(F.count("*").alias("m"))
    return known.join(counts, "status", "full_outer").select("status", F.coalesce("m", F.lit(0)).alias("n"))


def derived_status(total: Column, failed: Column, completed: Column, running: Column) -> Column:
    """Job status from counts of its tasks; the first rule that holds."""
    return F.when(total == 0, "pending").when(failed > 0, "failed").when(completed == total, "completed").when((running > 0) | (completed > 0), "running").otherwise("pending")


def daily(df: DataFrame, ts: str, days: int) -> DataFrame:
    """(day, n) of the last days up to the latest, absent days as 0."""
    day = F.to_date(F.col(ts))
    last = df.agg(F.max(day).alias("last"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("d"))
    counts = df.groupBy(day.alias("d")).agg(F.count("*").alias("m"))
    return calendar.join(counts, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("m", F.lit(0)).alias("n"))


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The latest row of each key.  max_by keeps one row per key and task."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max(F.struct(*by, *[F.col(c).alias(f"v_{c}") for c in rest])).alias("m"))
    return found.select(*keys, *[F.col("m")[f"v_{c}"].alias(c) for c in rest])


def page(df: DataFrame, ts: str, key: str, limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset at least 0")
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).offset(offset).limit(limit)


def next_tasks(tasks: DataFrame, voted: DataFrame, on: str, queue: str, by: list[str]) -> DataFrame:
    """The oldest claimable task of each queue that its owner hasn't voted on."""
    open_ = tasks.join(voted.select(on).distinct(), on, "left_anti")
    best = open_.groupBy(queue).agg(F.min(F.struct(*by)).alias("m"))
    return best.select(queue, *[F.col("m")[c].alias(c) for c in by])


def quorum(votes: DataFrame, need: int) -> DataFrame:
    """(task, digest, votes, decision) by each owner's latest vote; the digest
    with most owners, the smaller of equals, wins with need owners."""
    counts = votes.groupBy("task", "digest").agg(F.countDistinct("owner").alias("votes"))
    best = counts.groupBy("task").agg(F.min(F.struct((-F.col("votes")).alias("o"), "digest", "votes")).alias("m"))
    return best.select("task", F.col("m.digest").alias("digest"), F.col("m.votes").alias("votes"), F.when(F.col("m.votes") >= need, "accept").otherwise("wait").alias("decision"))


def quorum_strict(votes: DataFrame, need: int) -> DataFrame:
    """(task, digest, votes, decision): an owner with two digests rejects its task;
    else one vote an owner, and the digest with most votes wins if it has `need` and
    no equal.  A tie at `need` or more rejects, all else is inconclusive."""
    own = votes.groupBy("task", "owner").agg(F.min("digest").alias("digest"), (F.min("digest") != F.max("digest")).alias("two"))
    counts = own.groupBy("task", "digest").agg(F.count_if(~F.col("two")).alias("votes"), F.max("two").alias("two"))
    ranked = counts.groupBy("task").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("o"), "digest"))).alias("c"), F.max("two").alias("two"))
    top, second = -F.col("c")[0]["o"], -F.get(F.col("c"), F.lit(1))["o"]
    tied = F.coalesce(second == top, F.lit(False))
    decision = F.when(F.col("two"), "reject").when((top >= need) & ~tied, "accept").when((top >= need) & tied, "reject").otherwise("inconclusive")
    return ranked.select("task", F.when(decision == "accept", F.col("c")[0]["digest"]).alias("digest"), top.alias("votes"), decision.alias("decision"))


def expired(attempt: Column, most: int, lease_until: Column, now: Column) -> Column:
    """What a leased or running task becomes once its lease has run out: pending
    with attempts left, else failed; null while the lease holds."""
    return F.when(lease_until < now, F.when(attempt < most, "pending").otherwise("failed"))


def cancelled(status: Column) -> Column:
    """The status after its job is cancelled: finished tasks keep theirs."""
    return F.when(status.isin("completed", "failed", "cancelled"), status).otherwise("cancelled")


def reducing(status: Column, has_reducer: Column) -> Column:
    """A completed job whose workload has a reducer goes on to reduce."""
    return F.when((status == "completed") & F.coalesce(has_reducer, F.lit(False)), "reducing").otherwise(status)


def completions(df: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, digest, n, conflict): repeated completions of a key are one; those
    with different digests conflict."""
    return df.groupBy(*keys).agg(F.min(digest).alias("digest"), F.count("*").alias("n"), (F.min(digest) != F.max(digest)).alias("conflict"))


def lease_held(status: Column, owner: Column, lease_until: Column, worker: Column, now: Column) -> Column:
    """Whether the worker holds a lease that hasn't run out."""
    return F.coalesce(status.isin("leased", "running") & (owner == worker) & (lease_until > now), F.lit(False))


def visible(owner: Column, user: Column, admin: Column) -> Column:
    """Admins see all, others what they own."""
    return F.coalesce(admin, F.lit(False)) | F.coalesce(owner == user, F.lit(False))


def updated(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with columns taken from the row of changes that has its keys, if any."""
    new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("hit_"))
    out = df.join(new, keys, "left")
    return out.select(*[F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def folded(events: DataFrame, task: str, at: str, status: str) -> DataFrame:
    """(task, status) after all events: what moves a task from its status counts,
    other events are ignored; tasks begin pending."""
    moves = F.create_map(*[F.lit(x) for pair in MOVES for x in pair])
    ordered = events.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(at, status))).alias("e"))
    last = F.aggregate("e", F.lit("pending"), lambda now, e: F.when(F.array_contains(F.split(moves[now], ","), e[status]), e[status]).otherwise(now))
    return ordered.select(task, last.alias("status"))


#: The statuses that may follow each one.
MOVES = [
    ("pending", "leased,cancelled"),
    ("leased", "running,pending,completed,failed,cancelled"),
    ("running", "pending,completed,failed,cancelled"),
    ("completed", ""),
    ("failed", ""),
    ("cancelled", ""),
]


def trailing_rate(df: DataFrame, at: str, done: str, samples: int = 15) -> DataFrame:
    """Adds rate: what was done since so many samples ago (or the first), per
    minute, over at least a second."""
    w = Window.orderBy(at)
    first = w.rowsBetween(-samples, 0)
    minutes = (F.unix_timestamp(F.col(at)) - F.unix_timestamp(F.first(at).over(first))) / 60
    return df.withColumn("rate", (F.col(done) - F.first(done).over(first)) / F.greatest(minutes, F.lit(1 / 60)))


def rate_summary(rates: DataFrame, at: str, last: int = 90) -> DataFrame:
    """(current, peak) of the last samples of a table with rates, one row."""
    newest = rates.orderBy(F.col(at).desc()).limit(last)
    return newest.agg(F.max_by("rate", at).alias("current"), F.max("rate").alias("peak"))
