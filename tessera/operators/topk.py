"""Exact top-k by similarity to one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("greater", "less")


def order(score: str, ids: list[str], direction: str = "greater") -> list[Column]:
    """Ranking key: similarity by direction, then ids."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    return [F.col(score).desc() if direction == "greater" else F.col(score).asc(), *[F.col(c).asc() for c in ids]]


def threshold(df: DataFrame, score: str, bound: float | None, direction: str = "greater") -> DataFrame:
    """Inclusive bound; None keeps all."""
    if bound is None:
        return df
    if isinstance(bound, bool) or not 0 <= bound <= 1:
        raise ValueError("threshold must be in 0 to 1")
    return df.where(F.col(score) >= bound if direction == "greater" else F.col(score) <= bound)


def top(df: DataFrame, k: int, score: str, ids: list[str], direction: str = "greater") -> DataFrame:
    """The k best rows with their rank from 1.  Each partition keeps k rows; the
    rank is over the k survivors."""
    if isinstance(k, bool) or k < 1:
        raise ValueError("k must be at least 1")
    key = order(score, ids, direction)
    return df.orderBy(*key).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*key)).cast("long"))


def top_by_shard(df: DataFrame, shard: Column, k: int, score: str, ids: list[str], direction: str = "greater") -> DataFrame:
    """Top k of each logical shard, merged: equals top()."""
    w = Window.partitionBy("shard").orderBy(*order(score, ids, direction))
    part = df.withColumn("shard", shard).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n", "shard")
    return top(part, k, score, ids, direction)


def not_self(df: DataFrame, id_col: str, canonical: str, query_id, query_canonical) -> DataFrame:
    """Drops the query: same id, or same canonical form (null-safe)."""
    return df.where(~(F.col(id_col).eqNullSafe(F.lit(query_id)) | F.col(canonical).eqNullSafe(F.lit(query_canonical))))
