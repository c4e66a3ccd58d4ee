"""Comparison of results: tolerance, order and key checks, digests."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0, nan_equal: bool = False) -> Column:
    close = F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))
    both_nan, some_nan = F.isnan(a) & F.isnan(b), F.isnan(a) | F.isnan(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(some_nan, both_nan if nan_equal else F.lit(False)).otherwise(close | (a == b))


def ulp_distance(a: Column, b: Column) -> Column:
    """How many doubles lie between two finite ones; null if one isn't finite."""

    @F.pandas_udf("decimal(20,0)")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        both = pd.DataFrame({"a": x, "b": y}).astype("float64")
        ok = np.isfinite(both).all(axis=1)
        return pd.Series([Decimal(ulps(p, q)) if k else None for p, q, k in zip(both["a"], both["b"], ok, strict=True)], dtype=object)

    return distance(a, b)


def ulps(a: float, b: float) -> int:
    """Doubles between a and b."""
    def key(x: float) -> int:
        n = struct.unpack("<q", struct.pack("<d", x))[0]
        return n if n >= 0 else -(n & 0x7FFFFFFFFFFFFFFF)

    return abs(key(a) - key(b))


def out_of_order(df: DataFrame, by: str, key: list[Column]) -> DataFrame:
    """Rows whose sort key is below the row before, in the order of by.  Rows are
    compared within ranges of `by`, the last of each range with the first of the
    next that has rows: one row a range meets in one task."""
    parts = df.withColumn("k", F.struct(*key)).repartitionByRange(by).withColumn("p", F.spark_partition_id())
    before = F.lag("k").over(Window.partitionBy("p").orderBy(by))
    # a range's number is as good as its bounds: `by` orders both
    ends = parts.groupBy("p").agg(F.min(by).alias("first"), F.max_by("k", by).alias("last"))
    ends = ends.withColumn("last", F.lag("last").over(Window.orderBy("first"))).select("first", "last")  # a row a range
    own = parts.withColumn("own", before).drop("p")
    edges = own.join(F.broadcast(ends), own[by] == ends["first"], "left")
    return edges.where("k < coalesce(own, last)").drop("k", "own", "first", "last")


def ulp_within(a: Column, b: Column, most: int) -> Column:
    """Whether two doubles are at most so many apart; nulls and NaN equal themselves."""
    same = a.eqNullSafe(b)
    return same | F.coalesce(ulp_distance(a, b) <= most, F.lit(False))


def nested_within(a, b, absolute: float = 0.0, relative: float = 0.0, nan_equal: bool = False) -> bool:
    """Whether two values of lists, dicts and numbers have one shape and all
    numbers are close; what isn't a number must be equal."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(nested_within(a[k], b[k], absolute, relative, nan_equal) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(nested_within(x, y, absolute, relative, nan_equal) for x, y in zip(a, b, strict=True))
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in (a, b)):
        return type(a) is type(b) and a == b
    if math.isnan(a) or math.isnan(b):
        return nan_equal and math.isnan(a) and math.isnan(b)
    return a == b or abs(a - b) <= max(absolute, relative * max(abs(a), abs(b)))


@dataclass(frozen=True)
class Decision:
    status: str  # accepted, rejected or inconclusive
    reason: str
    digest: str | None = None


def canonical_match(expected: Iterable, actual: Iterable, canonical, most: int = 100_000_000) -> Decision:
    """Compares two streams of records by the digest of their canonical bytes."""

    def framed(records):
        for n, r in enumerate(records):
            if n >= most:
                raise OverflowError
            if not isinstance(out := canonical(r), bytes):
                raise ValueError("canonical must return bytes")
            yield out

    try:
        left, right = ordered_digest(framed(expected)), ordered_digest(framed(actual))
    except OverflowError:
        return Decision("rejected", "record-limit")
    except Exception:
        return Decision("rejected", "canonicalization-failed")
    return Decision("accepted", "canonical-match", left) if left == right else Decision("rejected", "canonical-mismatch")


def tables_match(expected: DataFrame, actual: DataFrame, keys: list[str], absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """(keys, why) of the rows that differ: on one side only, or a column whose
    values aren't close (doubles) or equal (others).  Keys are distinct on each side."""
    numbers = {c for c, t in expected.dtypes if t in ("double", "float")}
    rest = [c for c in expected.columns if c not in keys]
    a = expected.select(*keys, F.struct(*rest).alias("a"))
    b = actual.select(*keys, F.struct(*rest).alias("b"))
    both = a.join(b, keys, "full_outer")
    why = F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing")
    for c in rest:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        same = within(x.cast("double"), y.cast("double"), absolute, relative, True) if c in numbers else x.eqNullSafe(y)
        why = why.when(~same, c)
    return both.select(*keys, why.alias("why")).where("why is not null")


def ordered_table_digest(df: DataFrame, order: list[str], line: Column) -> str:
    """SHA-256 of a table's rows in an order, each after its length in 8 bytes.
    Rows are hashed where they come in; one digest can't be split, so they pass
    the driver one partition at a time."""
    rows = df.orderBy(*order).select(line.cast("binary").alias("b")).toLocalIterator(prefetchPartitions=True)
    return ordered_digest(bytes(r.b) for r in rows)


def key_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks."""
    a, b = expected.select(*keys).distinct().withColumn("in_a", F.lit(1)), actual.select(*keys).distinct().withColumn("in_b", F.lit(1))
    return a.join(b, keys, "full_outer").where("in_a is null or in_b is null").select(*keys, F.when(F.col("in_a").isNull(), "unexpected").otherwise("missing").alias("side"))


def ordered_digest(records: Iterable[bytes]) -> str:
    """SHA-256 of records, each after its length in 8 bytes."""
    h = hashlib.sha256()
    for r in records:
        h.update(struct.pack(">Q", len(r)))
        h.update(r)
    return h.hexdigest()
