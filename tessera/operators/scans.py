"""Scans with a policy for invalid rows, row limits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(rows: DataFrame, valid: str, row_no: str, max_rows: int | None = None) -> DataFrame:
    """One row: scanned, valid, invalid, stopped_early, first_invalid.  Rows count
    as scanned, valid or not, up to max_rows; more stop the scan early."""
    inside = F.lit(True) if max_rows is None else F.col(row_no) < max_rows
    ok = F.coalesce(F.col(valid), F.lit(False))
    return rows.agg(
        F.count_if(inside).alias("scanned"),
        F.count_if(inside & ok).alias("valid"),
        F.count_if(inside & ~ok).alias("invalid"),
        (F.count("*") > F.count_if(inside)).alias("stopped_early"),
        F.min(F.when(inside & ~ok, F.col(row_no))).alias("first_invalid"),
    )


def accepted(rows: DataFrame, valid: str, row_no: str, skip_invalid: bool = True, max_rows: int | None = None) -> DataFrame:
    """The valid rows among the first max_rows.  Without skip_invalid, an invalid
    row raises with the smallest row number, from 1."""
    own = rows if max_rows is None else rows.where(F.col(row_no) < max_rows)
    if not skip_invalid and (bad := stats(own, valid, row_no).first()["first_invalid"]) is not None:
        raise ValueError(f"row {bad + 1} is invalid")
    return own.where(F.col(valid))


def find(rows: DataFrame, id_col: str, key, valid: str, row_no: str):
    """The first row with an id; raises if there is none, or it is invalid."""
    got = rows.where(F.col(id_col) == key).orderBy(row_no).limit(1).collect()
    if not got:
        raise ValueError(f"no row {key}")
    if not got[0][valid]:
        raise ValueError(f"row {key} is invalid")
    return got[0]


def sharded(rows: DataFrame, row_no: str, rows_per_shard: int) -> DataFrame:
    """rows with the number of their shard."""
    if isinstance(rows_per_shard, bool) or rows_per_shard < 1:
        raise ValueError("rows_per_shard must be at least 1")
    return rows.withColumn("shard", F.floor(F.col(row_no) / rows_per_shard))


def in_blocks(rows: DataFrame, id_col: str, row_no: str, block: int) -> DataFrame:
    """rows with block, by their number; an empty or repeated id raises."""
    if not rows.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull() | (F.col(id_col) == "")).isEmpty():
        raise ValueError("empty or repeated id")
    return rows.withColumn("block", F.floor(F.col(row_no) / block))
