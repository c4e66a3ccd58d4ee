"""Sharding by sampled splitters (DataFrame operations only).

Records are ordered by (hash of the text, id), so equal texts lie side by side.
Size-weighted key samples give quantile boundaries, which cut the order into
fine ranges; ranges that turn out overfull are sampled again and subdivided.
Every range's size is then counted exactly, and shards are filled with whole
ranges in key order.  A group of equal texts larger than a fine range is placed
first, whole if it fits in one shard; else its ranges go to several shards.

Only samples, groups larger than a fine range and range totals come to the
driver: each is bounded by n_shards and the two parameters, not by the data.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, literal_rows, position_in, require

_LOW = -(1 << 63)
_HIGH = (1 << 63) - 1


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1 for the record's end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard(
    spark: SparkSession,
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 512,
    samples_per_range: int = 8,
    rounds: int = 4,
) -> DataFrame:
    """docs with columns size, shard (0 to n_shards - 1) and slot (gapless from 0
    in a shard); a column of docs with such a name is renamed with a leading
    underscore.  Law: near equal bytes in all shards, within about a fine range
    (1/ranges_per_shard of a shard) or the largest record.

    A null text has size 1 and is one group with other nulls; empty texts are
    another.  Null ids come first.  Repeated rows are separate records with slots
    of their own.  An empty table gives no rows.
    """
    require(docs, id_col, text_col)
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    scratch = Scratch(spark, "shard")
    h = F.xxhash64(F.col(text_col))
    i = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))
    size = record_size(F.col(text_col))
    keys = scratch.table(docs.select(h.alias("h"), i.alias("i"), size.alias("size")), "keys")

    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = n_shards * ranges_per_shard
    heavy = {}
    splitters: list[tuple[int, int]] = []
    counted: list[tuple[int, int, int]] = []
    if rows:
        most_bytes, most_rows = total / n_ranges, rows / n_ranges
        heavy = {
            r.h: (r.bytes, r.n)
            for r in keys.groupBy("h")
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
            .where((F.col("n") > 1) & ((F.col("bytes") > F.lit(most_bytes)) | (F.col("n") > F.lit(4 * most_rows + 64))))
            .collect()
        }
        weight = (F.col("size") / F.lit(float(total)) + F.lit(1.0 / rows)) / 2
        splitters = _edges(heavy)
        full = None  # all ranges
        rate = float(n_ranges * samples_per_range)
        for at in range(rounds):
            splitters = _refine(keys, splitters, heavy, full, weight, rate, n_ranges, at)
            ranged = keys.withColumn("range", _range_of(splitters, F.col("h"), F.col("i")))
            counted = [(r.range, r.bytes, r.n) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()]
            full = [r for r, b, n in counted if n > 1 and (b / total + n / rows) / 2 > 3 / n_ranges]
            if not full:
                break
            rate *= 8
    shard_of, offset_of = _place(counted, splitters, heavy, total, n_shards)

    new_size, new_shard, new_slot, range_c = fresh(docs, "size", "shard", "slot", "range_")
    renames = {c: n for c, n in (("size", new_size), ("shard", new_shard), ("slot", new_slot)) if n != c}
    if renames:  # our names stand, clashing columns give way
        docs = docs.withColumnsRenamed({c: renames[c.lower()] for c in docs.columns if c.lower() in renames})
    order = Window.partitionBy(range_c).orderBy(h, i, F.col("size"))
    out = docs.withColumn("size", size).withColumn(range_c, _range_of(splitters, h, i))
    out = out.withColumn("slot", F.row_number().over(order).cast("long") - 1)
    lookup = literal_rows([{"s": s, "o": o} for s, o in zip(shard_of, offset_of, strict=True)], "struct<s:int,o:bigint>")
    found = F.get(lookup, F.col(range_c))
    return out.withColumn("shard", found["s"]).withColumn("slot", F.col("slot") + found["o"]).drop(range_c)


def _range_of(splitters: list[tuple[int, int]], h: Column, i: Column) -> Column:
    if not splitters:
        return F.lit(0)
    known = literal_rows([{"h": a, "i": b} for a, b in splitters], "struct<h:bigint,i:bigint>")
    return position_in(known, len(splitters), F.struct(h.alias("h"), i.alias("i")))


def _edges(heavy: dict) -> list[tuple[int, int]]:
    """Heavy groups have ranges of their own."""
    return sorted({(h, _LOW) for h in heavy} | {(h + 1, _LOW) for h in heavy if h < _HIGH})


def _refine(keys, splitters, heavy, full, weight, rate, n_ranges, seed):
    """Splitters with those that size-weighted samples add; of the ranges in
    full only, if given."""
    p = F.least(F.lit(1.0), weight * F.lit(rate))
    u = F.shiftrightunsigned(F.xxhash64("h", "i", F.lit(seed)), 11) / F.lit(float(1 << 53))
    picked = keys.select("h", "i", (weight / p).alias("w"), (u < p).alias("in_"))
    if full is not None:
        picked = picked.withColumn("range", _range_of(splitters, F.col("h"), F.col("i"))).where(F.col("range").isin(full))
    sample = sorted((r.h, r.i, r.w) for r in picked.where("in_").select("h", "i", "w").collect())
    step, held, out = 1.0 / n_ranges, 0.0, set(splitters)
    for at, (h, i, w) in enumerate(sample):
        if held >= step:
            # a light group stays whole
            out.add((h, i) if h in heavy else (h, _LOW))
            held = 0.0
        held += w
    return sorted(out)


def _place(counted, splitters, heavy, total, n_shards):
    """Of each range its shard, and the slot that its first record has."""
    n = len(splitters) + 1
    size, rows = [0] * n, [0] * n
    for r, b, c in counted:
        size[r], rows[r] = b, c
    target, load, shard_of = total / n_shards, [0.0] * n_shards, [-1] * n
    for h, (b, _) in sorted(heavy.items(), key=lambda x: (-x[1][0], x[0])):
        least = min(range(n_shards), key=lambda s: (load[s], s))
        if load[least] + b <= target:
            first = bisect_right(splitters, (h, _LOW))
            last = bisect_right(splitters, (h + 1, _LOW)) if h < _HIGH else n
            for r in range(first, last):
                shard_of[r] = least
            load[least] += b
    room = list(accumulate(max(0.0, target - x) for x in load))
    done = 0.0
    for r in range(n):
        if shard_of[r] < 0:
            shard_of[r] = min(bisect_right(room, done + size[r] / 2), n_shards - 1)
            done += size[r]
    offset, used = [0] * n, [0] * n_shards
    for r in range(n):
        offset[r] = used[shard_of[r]]
        used[shard_of[r]] += rows[r]
    return shard_of, offset
