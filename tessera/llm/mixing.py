"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Rates r of documents minimise the sum of a * (r log r - r + 1), subject to
sum(size * r) = target in every source and r <= cap.  The cost a of a document is
its size plus doc_cost mean sizes of its source, so short documents, which tell
little, keep rates near 1.  The dual has one variable a source; its optimum
tilts documents exponentially: r = min(cap, exp(lambda * size / a)).

Newton iterations on the dual's optimality condition (in logarithms, inside a
shrinking bracket) run for all sources at once.  Documents of one source and
size share a rate, so the sums run over such cells, pre-aggregated.  Rates
become whole copies cell by cell, from large sizes to small, carrying the
fraction along; what then lacks or exceeds is settled by single documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, require

#: Documents of a cell that one task ranks together.
_PART = 256


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but space and the controls 9 to 13."""
    plain = text
    for c in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.coalesce(F.size(F.array_remove(F.split(plain, " "), "")), F.lit(0)).cast("long")


def _targets(sources: DataFrame, weights: tuple, cap: float) -> DataFrame:
    """Adds weight and target to (key, source, source_size): shares of all sizes
    by weight, each at most cap times the source's size, the excess reshared by
    weight.  One row a source: a catalogue, which fits one task."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    most = F.col("source_size") * F.lit(float(cap))
    out = out.withColumn("fills", most / F.col("weight"))
    by = Window.orderBy("fills", "key")
    every = Window.partitionBy()
    out = out.withColumn("at", F.row_number().over(by))
    before = F.coalesce(F.sum(most).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    level = F.min_by(F.when(F.col("fills") >= F.col("level"), F.col("level")), F.when(F.col("fills") >= F.col("level"), F.col("at"))).over(every)
    out = out.withColumn("target", F.least(most, F.coalesce(level * F.col("weight"), most)))
    return out.drop("fills", "at", "level")


def _solve(spark: SparkSession, scratch: Scratch, cells: DataFrame, sources: DataFrame, cap: float, tolerance: float, rounds: int) -> DataFrame:
    """(key, lam): the dual variable of each source that is not saturated."""
    state = sources.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * (cap * (1 - 1e-9))))
    state = state.select(
        "key",
        "target",
        F.log(F.col("target") / F.col("source_size")).alias("lam"),
        F.lit(-1e7).alias("lo"),
        F.lit(1e7).alias("hi"),
        F.lit(False).alias("done"),
    )
    state = scratch.table(state, "dual-0")
    for i in range(1, rounds + 1):
        x = F.col("lam") * F.col("f")
        rate = F.when(x >= F.lit(cap).cast("double"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(x)))
        mass = F.col("n") * F.col("size") * F.col("rate")
        sums = (
            cells.join(state.select("key", "lam"), "key")
            .withColumn("rate", rate)
            .groupBy("key")
            .agg(F.sum(mass).alias("got"), F.sum(F.when(F.col("rate") < cap, mass * F.col("f"))).alias("slope"))
        )
        off = F.log(F.col("got") / F.col("target"))
        lo = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(F.col("off") * F.col("got"), F.col("slope"))
        inside = F.coalesce((F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2")), F.lit(False))
        state = (
            state.join(sums, "key", "left")
            .withColumn("off", off)
            .withColumn("done", F.coalesce(F.abs("off") <= tolerance, F.lit(True)))
            .withColumn("lo2", lo)
            .withColumn("hi2", hi)
            .withColumn("step", step)
            .withColumn("next", F.when(F.col("done"), F.col("lam")).when(inside, F.col("step")).otherwise((F.col("lo2") + F.col("hi2")) / 2))
            .select("key", "target", F.col("next").alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "done")
        )
        state = scratch.counted(state, f"dual-{i}", "not done")
        scratch.drop(f"dual-{i - 1}")
        if not scratch.rows[f"dual-{i}"]:
            break
    return state.select("key", "lam")


def _settle(scratch: Scratch, cells: DataFrame, sources: DataFrame, cap: int, rounds: int) -> DataFrame:
    """Moves single documents of cells up or down a copy, the largest that fit
    first, until what a source lacks or exceeds is below its smallest document
    (or the rounds end)."""
    cells = scratch.table(cells, "copies-0")
    for i in range(1, rounds + 1):
        got = cells.groupBy("key").agg(F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("up"))).alias("got"))
        lack = sources.join(got, "key").select("key", F.floor(F.col("target") - F.col("got") + 0.5).cast("long").alias("lack"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("lack")) & F.when(F.col("lack") > 0, (F.col("up") < F.col("n")) & (F.col("base") + 1 <= cap)).otherwise(F.col("up") > 0)
        pick = cells.join(lack, "key").where(fits).groupBy("key").agg(F.max("size").alias("pick"), F.first("lack").alias("lack"))
        room = F.when(F.col("lack") > 0, F.col("n") - F.col("up")).otherwise(F.col("up"))
        move = F.least(room, F.floor(F.abs("lack") / F.col("size"))) * F.signum("lack").cast("long")
        moved = cells.join(pick, "key", "left").withColumn("move", F.when(F.col("size") == F.col("pick"), move).otherwise(F.lit(0)).cast("long"))
        moved = scratch.counted(moved.withColumn("up", F.col("up") + F.col("move")).drop("pick", "lack"), f"copies-{i}", "move <> 0")
        scratch.drop(f"copies-{i - 1}")
        cells, still = moved.drop("move"), scratch.rows[f"copies-{i}"]
        if not still:
            break
    return cells


def mix(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = (5.0, 2.0, 1.0),
    cap: int = 3,
    doc_cost: float = 1.0,
    tolerance: float = 1e-7,
    newton_rounds: int = 60,
    settle_rounds: int = 8,
) -> DataFrame:
    """docs with columns size, source_size, target, copies and taken (size *
    copies); a column of docs with such a name is renamed with a leading
    underscore.

    Sources sort by code point, null (a source of its own) last, and take the
    weights in turn.  Size is the number of words; null and empty texts have size
    0, rate 1 and one copy.  Which documents of a cell get one copy more depends
    on a hash of their ids: reruns agree.  Repeated rows are separate documents.
    An empty table gives no rows.
    """
    require(docs, id_col, text_col, source_col)
    scratch = Scratch(spark, "mix")
    names = ("size", "source_size", "target", "copies", "taken")
    new = fresh(docs, *names)
    clash = {c: n for c, n in zip(names, new, strict=True) if c != n}
    given = docs.withColumnsRenamed({c: clash[c.lower()] for c in docs.columns if c.lower() in clash})
    id_col, text_col, source_col = (clash.get(c.lower(), c) for c in (id_col, text_col, source_col))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))

    sized = given.select(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = scratch.table(sized, "sized")
    counted = scratch.table(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counted")
    counted = counted.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sources = counted.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources = scratch.table(_targets(sources, weights, cap), "sources")

    mean = F.col("source_size") / F.col("docs")
    cells = counted.drop("source").join(sources.select("key", "source_size", "docs", "target"), "key")
    cells = scratch.table(cells.withColumn("f", F.coalesce(F.try_divide(F.col("size"), F.col("size") + mean * doc_cost), F.lit(0.0))), "cells")
    lam = _solve(spark, scratch, cells, sources, cap, tolerance, newton_rounds)

    rate = (
        F.when(F.col("size") == 0, F.lit(1.0))
        .when(F.col("target") <= 0, F.lit(0.0))
        .when(F.col("lam").isNull() | (F.col("lam") * F.col("f") >= cap), F.lit(float(cap)))
        .otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("f"))))
    )
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    rated = cells.join(lam, "key", "left").withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    rated = rated.withColumn("part", F.col("n") * (F.col("rate") - F.col("base"))).withColumn("sum", F.sum("part").over(down))
    up = F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("part") + 0.5)
    rated = rated.withColumn("up", F.greatest(F.lit(0), F.least("n", up)).cast("long")).select("key", "size", "n", "base", "up")
    cells = _settle(scratch, rated, sources.select("key", "target"), cap, settle_rounds)

    # documents of a cell that get one copy more: the first by hash, in parts
    # of a bounded number of rows
    many = F.ceil(F.col("n") / _PART).cast("long")
    cells = cells.withColumn("parts", many)
    part = F.pmod(F.xxhash64("i", F.lit(7)), F.col("parts"))
    big = cells.where("parts > 1").select("key", "size", "parts")
    shares = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(big, ["key", "size"]).groupBy("key", "size", part.alias("part")).agg(F.count("*").alias("rows"))
    upto = Window.partitionBy("key", "size").orderBy("part")
    shares = shares.join(cells.select("key", "size", "n", "up"), ["key", "size"]).withColumn("sum", F.sum("rows").over(upto))
    quota = F.floor(F.col("up") * F.col("sum") / F.col("n") + 1e-9) - F.floor(F.col("up") * (F.col("sum") - F.col("rows")) / F.col("n") + 1e-9)
    shares = shares.select("key", "size", "part", "n", quota.alias("up"))
    small = cells.where("parts <= 1").select("key", "size", F.lit(0).cast("long").alias("part"), "n", "up")
    quotas = scratch.table(small.unionByName(shares).join(cells.select("key", "size", "base", "parts"), ["key", "size"]), "quotas")

    k, p, b, q, r = fresh(given, "key_", "part_", "base_", "quota_", "rank_")
    dealt = given.withColumn(k, key).withColumn("size", word_count(F.col(text_col)))
    facts = cells.select(F.col("key").alias(k), "size", F.col("parts").alias(b))
    dealt = dealt.join(facts, [k, "size"]).withColumn(p, F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.col(b))).drop(b)
    first = Window.partitionBy(k, "size", p).orderBy(F.xxhash64(F.col(id_col), F.lit(11)), F.col(id_col))
    dealt = dealt.repartition(F.col(k), F.col("size"), F.col(p)).withColumn(r, F.row_number().over(first))
    quotas = quotas.select(F.col("key").alias(k), "size", F.col("part").alias(p), F.col("base").alias(b), F.col("up").alias(q))
    dealt = dealt.join(quotas, [k, "size", p])
    dealt = dealt.withColumn("copies", (F.col(b) + F.when(F.col(r) <= F.col(q), 1).otherwise(0)).cast("int"))
    facts = sources.select(F.col("key").alias(k), "source_size", "target")
    out = dealt.join(facts, k).withColumn("taken", F.col("size") * F.col("copies"))
    return out.drop(k, p, b, q, r)
