"""Sources and sinks: delimited tables with row numbers, ordered CSV files."""

from __future__ import annotations

import hashlib
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, required: list[str], sep: str = "\t", multiline: bool = True, strict: bool = False) -> DataFrame:
    """All-text table with a header; an empty or absent cell is "".  strict: a row
    with more or fewer cells than the header raises when it is read.
    Raises if a required column is missing or a name is empty or repeated."""
    head = spark.read.text(path).limit(1).collect()
    names = head[0][0].lstrip("﻿").rstrip("\r").split(sep) if head else []
    names = [n.strip('"') for n in names]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if len(set(names)) < len(names) or "" in names:
        raise ValueError("column names must be distinct and not empty")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, quote='"', escape='"', multiLine=multiline, mode="FAILFAST" if strict else "PERMISSIVE")
    return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def numbered(df: DataFrame, by: list[str], name: str = "row_no") -> DataFrame:
    """Consecutive row numbers from 0 in the order of by, whose values differ.
    Ranges are sorted apart; only their sizes meet in one task.  A row's range is
    known by the least key in it, so it doesn't matter if a rerun cuts ranges
    elsewhere: rows are numbered in the pass that counts them."""
    key = F.struct(*by)
    parts = df.repartitionByRange(*by).withColumn("p_", F.spark_partition_id())
    own = Window.partitionBy("p_").orderBy(*by)
    parts = parts.withColumn("i_", F.row_number().over(own) - 1)
    sizes = parts.groupBy("p_").agg(F.count("*").alias("n_"), F.min(key).alias("low_"))
    before = Window.orderBy("low_").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base_", F.coalesce(F.sum("n_").over(before), F.lit(0))).select("p_", "base_")
    return parts.join(F.broadcast(base), "p_").withColumn(name, F.col("base_") + F.col("i_")).drop("p_", "i_", "base_")


def write_ordered(df: DataFrame, path: str, line_end: str = "\r\n", digits: int | None = 6) -> int:
    """One CSV file in the order of df, through a local iterator; doubles with so
    many digits, as Python rounds them (None: shortest that reads back).  The file
    appears at once, when whole."""
    def cell(v) -> str:
        if v is None:
            return ""
        if isinstance(v, float):
            return repr(v) if digits is None else f"{v:.{digits}f}"
        s = str(v)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s

    target, n = Path(path), 0
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(",".join(df.columns) + line_end)
        for row in df.toLocalIterator(prefetchPartitions=True):
            f.write(",".join(cell(v) for v in row) + line_end)
            n += 1
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, target)
    return n


def preview(df: DataFrame, rows: int = 30) -> tuple[list, bool]:
    """The first rows, and whether there are more."""
    got = df.limit(rows + 1).collect()
    return got[:rows], len(got) > rows


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def concat_ordered(parts: list[DataFrame], row: str) -> DataFrame:
    """Parts of one schema as one table with part_no; any other schema raises."""
    if any(p.schema != parts[0].schema for p in parts):
        raise ValueError("parts differ in schema")
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part_no", F.lit(k).cast("long"))
        out = p if out is None else out.unionByName(p)
    return out.orderBy("part_no", row)
