"""Sources that check what they read, shard files and sealed artifacts."""

from __future__ import annotations

import csv
import io
import json
import os
import stat
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import content_id, dimensions, to_json
from ..functions.text import ranged_float
from . import tables

EDGES = ["source_id", "target_id", "similarity"]
LINE_BYTES, SHARD_BYTES = 8 << 20, 64 << 20


def _refuse(df: DataFrame, bad, what: str) -> None:
    found = df.where(bad).limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


def _header(spark: SparkSession, path: str, sep: str, want: list[str]) -> None:
    head = spark.read.text(path).limit(1).collect()
    names = head[0][0].lstrip("﻿").rstrip("\r").split(sep) if head else []
    if names != want:
        raise ValueError(f"the header must be {want}")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge list: exact header, no empty id, similarity a number in 0 to 1."""
    _header(spark, path, ",", EDGES)
    raw = tables.read_table(spark, path, EDGES, sep=",", strict=True)
    out = raw.select("source_id", "target_id", ranged_float(F.col("similarity")).alias("similarity"), F.col("similarity").alias("cell"))
    _refuse(out, "source_id = '' or target_id = '' or similarity is null", "bad edge")
    return out.drop("cell")


def read_partial(spark: SparkSession, path: str, columns: list[str], ids: list[str], direction: str = "greater") -> DataFrame:
    """A ranked partial result of columns (rank first, similarity last): ranks from 1
    without gaps, similarity a number in 0 to 1 (NaN and infinities refused), rows
    in the order of the ranking key.  A partial is bounded by its top k."""
    _header(spark, path, ",", columns)
    raw = tables.read_table(spark, path, columns, sep=",", strict=True)
    score = columns[-1]
    out = raw.select(F.col(columns[0]).try_cast("long").alias(columns[0]), *columns[1:-1], ranged_float(F.col(score)).alias(score))
    _refuse(out, f"{columns[0]} is null or {score} is null", "bad row")
    n, least, most, distinct = out.agg(F.count("*"), F.min(columns[0]), F.max(columns[0]), F.countDistinct(columns[0])).first()
    if n and (least, most, distinct) != (1, n, n):
        raise ValueError("ranks must run from 1 without gaps")
    way = -F.col(score) if direction == "greater" else F.col(score)
    w = Window.orderBy(columns[0])  # at most top k rows
    key = F.struct(way, *ids)
    _refuse(out.withColumn("before", F.lag(key).over(w)), key < F.col("before"), "out of order")
    return out


def inspect_table(spark: SparkSession, path: str, sep: str, columns: list[str], exact: bool = False, max_records: int | None = None) -> int:
    """Records of a delimited table whose header has (exactly) the columns and whose
    rows have as many cells as the header; more than max_records raise."""
    if exact:
        _header(spark, path, sep, columns)
    rows = tables.read_table(spark, path, columns, sep, strict=True)
    try:
        n = rows.agg(F.count("*"), *[F.count(F.col(f"`{c}`")) for c in rows.columns]).first()[0]
    except Exception as e:
        raise ValueError("rows differ in length from the header") from e
    if max_records is not None and n > max_records:
        raise ValueError(f"{n} records are over the limit of {max_records}")
    return n


def inspect_json(path: str, kind: str, rectangular: bool = False, max_records: int | None = None) -> int:
    """Records of one JSON document: elements of an array, else 1.  Its top level
    must be of the kind (array or object); NaN and repeated keys raise."""

    def refuse(name: str):
        raise ValueError(f"JSON has no {name}")

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key occurs twice")
        return dict(pairs)

    value = json.loads(Path(path).read_text("utf-8"), parse_constant=refuse, object_pairs_hook=once)
    if not isinstance(value, {"array": list, "object": dict}[kind]):
        raise ValueError(f"the document must be an {kind}")
    if rectangular:
        dimensions(value)
    n = len(value) if isinstance(value, list) else 1
    if max_records is not None and n > max_records:
        raise ValueError(f"{n} records are over the limit of {max_records}")
    return n


class Inspectors:
    """Checks of artifacts by (schema, validator)."""

    def __init__(self):
        self._known: dict[tuple[str, str], Callable[[str], int]] = {("opaque-bytes@1", "bytes"): os.path.getsize}

    def add(self, schema: str, validator: str, inspect: Callable[[str], int]) -> None:
        if (schema, validator) in self._known:
            raise ValueError("an inspector of this name is there already")
        self._known[schema, validator] = inspect

    def inspect(self, schema: str, validator: str, path: str) -> int:
        if (schema, validator) not in self._known:
            raise ValueError(f"no inspector for {schema}, {validator}")
        return self._known[schema, validator](path)


def verified_bytes(path: str, sha256: str) -> str:
    """The path, if the file has that digest."""
    if tables.file_sha256(path) != sha256:
        raise ValueError("the file differs from its digest")
    return path


def preview(path: str, media: str, rows: int = 30, most: int = 64 << 10) -> tuple[list[list[str]], bool]:
    """The first rows of a CSV file, from its first bytes only, and whether there
    are more; a row that the bytes cut off isn't shown."""
    if media.split(";")[0].strip().lower() != "text/csv" and not path.lower().endswith(".csv"):
        raise ValueError("only CSV has a preview")
    with open(path, "rb") as f:
        raw = f.read(most + 1)
    cut = len(raw) > most
    if cut:
        raw = raw[: raw.rfind(b"\n", 0, most) + 1]
    got = list(csv.reader(io.StringIO(raw.decode("utf-8", "replace"), newline="")))
    return got[:rows], cut or len(got) > rows


def write_shards(df: DataFrame, path: str, row_no: str, rows_per_shard: int, sep: str = "\t", max_rows: int | None = None) -> None:
    """Files of at most so many rows, each with the header, in folders
    shard=0, 1, ..., by row number; each shard is written by one task."""
    if isinstance(rows_per_shard, bool) or rows_per_shard < 1:
        raise ValueError("rows_per_shard must be at least 1")
    own = df if max_rows is None else df.where(F.col(row_no) < max_rows)
    own = own.withColumn("shard", F.floor(F.col(row_no) / rows_per_shard))
    ordered = own.repartition("shard").sortWithinPartitions("shard", row_no).drop(row_no)
    ordered.write.mode("overwrite").partitionBy("shard").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def line_shards(spark: SparkSession, path: str, rows_per_shard: int, max_rows: int | None = None) -> DataFrame:
    """(shard, row_no, line) of a file by physical lines, blank ones included, the
    header left out; a line over LINE_BYTES or a shard over SHARD_BYTES raises."""
    size = os.path.getsize(path.removeprefix("file://"))
    lines = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    rows = tables.numbered(lines, ["b", "m"]).where("row_no > 0").withColumn("row_no", F.col("row_no") - 1) if size else tables.numbered(lines, ["b", "m"])
    rows = rows.select("row_no", F.regexp_replace("value", "\r$", "").alias("line"))
    rows = rows if max_rows is None else rows.where(F.col("row_no") < max_rows)
    out = rows.withColumn("shard", F.floor(F.col("row_no") / rows_per_shard))
    _refuse(out.select("row_no", F.octet_length("line").alias("bytes")), F.col("bytes") > LINE_BYTES, "a line is too long")
    _refuse(out.groupBy("shard").agg(F.sum(F.octet_length("line") + 1).alias("bytes")), F.col("bytes") > SHARD_BYTES, "a shard is too large")
    return out.select("shard", "row_no", "line")


def seal(path: str, schema: str, max_bytes: int) -> dict:
    """Makes a file read-only and describes it in a sidecar beside it, which
    appears whole; its id follows from schema and bytes."""
    target = Path(path)
    if (size := target.stat().st_size) > max_bytes:
        raise ValueError(f"{size} bytes are over the limit of {max_bytes}")
    digest = tables.file_sha256(path)
    out = {"id": content_id(schema, digest), "schema": schema, "sha256": digest, "bytes": size}
    target.chmod(stat.S_IRUSR | stat.S_IRGRP | stat.S_IROTH)
    put(f"{path}.json", to_json(out).encode())
    return out


def put(path: str, data: bytes) -> str:
    """Writes a file that appears at once, when whole and on disk; its digest."""
    import hashlib
    import tempfile

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, target)
    return hashlib.sha256(data).hexdigest()
