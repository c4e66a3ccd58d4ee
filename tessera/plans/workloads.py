"""Named workloads over molecule tables: parameters, plan, result file; a registry."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import metadata
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry
from ..functions.canonical import to_json, version
from ..functions.fingerprint import shared, tanimoto
from ..operators import graph, scans, topk
from ..sources import tables
from . import schema

COLUMNS = ["chembl_id", "canonical_smiles"]


class Workload:
    """Table to table: validate() checks and completes parameters, transform() is
    the plan, finalize() the order of the result, write() its file.  Spark cuts the
    input and merges partial results, so there is no hook for either."""

    name: ClassVar[str]
    version: ClassVar[str] = "1.0.0"
    parameters: ClassVar[dict]  # a schema
    defaults: ClassVar[dict] = {}
    line_end: ClassVar[str] = "\n"
    form: ClassVar[list[dict]] = []  # fields of a user interface, as data

    def __init__(self, make: Callable[[], chemistry.Backend] = chemistry.Rdkit):
        self.make = make

    def domain(self, params: dict) -> None:
        """Rules that the schema can't say; raises ValueError."""

    def validate(self, params: dict) -> dict:
        schema.check(params, self.parameters)
        out = {**self.defaults, **params}
        self.domain(out)
        return out

    def for_tasks(self, params: dict) -> dict:
        """The parameters that a task sees: row limits act on the whole input."""
        return {k: v for k, v in params.items() if k not in ("max_rows", "progress_every")}

    def transform(self, rows: DataFrame, params: dict) -> DataFrame:
        raise NotImplementedError

    def finalize(self, out: DataFrame, params: dict) -> DataFrame:
        return out

    def run(self, rows: DataFrame, params: dict) -> DataFrame:
        """rows(row_no, chembl_id, canonical_smiles)"""
        params = self.validate(params)
        return self.finalize(self.transform(rows, params), params)

    def write(self, out: DataFrame, path: str) -> int:
        return tables.write_ordered(out, path, self.line_end)

    def described(self) -> dict:
        return {"name": self.name, "version": self.version, "parameters": self.parameters, "defaults": self.defaults, "form": self.form}

    def _molecules(self, rows: DataFrame, names: list[str] | None = None, empty_is_valid: bool = False) -> DataFrame:
        m = chemistry.described(F.col("canonical_smiles"), self.make, names, empty_is_valid)
        return rows.withColumn("m", m).withColumn("valid", F.col("m.valid"))


def _object(required: list[str], **properties) -> dict:
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
_COUNT = {"type": "integer", "minimum": 1}
_WAY = {"enum": list(topk.DIRECTIONS)}
_TEXT = {"type": "string", "minLength": 1, "maxLength": 200}


class SimilaritySearch(Workload):
    name = "similarity-search"
    line_end = "\r\n"
    parameters = _object([], query_id=_TEXT, query_smiles=_TEXT, top_k=_COUNT, threshold=_SHARE, threshold_direction=_WAY, max_rows=_COUNT, progress_every=_COUNT)
    defaults = {"top_k": 20, "threshold": None, "threshold_direction": "greater", "max_rows": None}

    def domain(self, params):
        if ("query_id" in params) == ("query_smiles" in params):
            raise ValueError("give one of query_id and query_smiles")

    def transform(self, rows, params):
        all_ = self._molecules(rows)
        if "query_id" in params:  # over the whole table, whatever max_rows is
            q = scans.find(all_, "chembl_id", params["query_id"], "valid", "row_no")
            query_id, query = params["query_id"], q["m"]
        else:
            one = rows.sparkSession.createDataFrame([(0, "query", params["query_smiles"])], "row_no long, chembl_id string, canonical_smiles string")
            query_id, query = "query", scans.find(self._molecules(one), "chembl_id", "query", "valid", "row_no")["m"]
        words = F.array(*[F.lit(w).cast("long") for w in query["words"]])
        own = scans.accepted(all_, "valid", "row_no", True, params["max_rows"])
        rest = topk.not_self(own.withColumn("c", F.col("m.canonical")), "chembl_id", "c", query_id, query["canonical"])
        sim = tanimoto(shared(F.col("m.words"), words), F.col("m.n"), F.lit(query["n"]))
        scored = rest.select(*COLUMNS, sim.alias("similarity"))
        return topk.threshold(scored, "similarity", params["threshold"], params["threshold_direction"])

    def finalize(self, out, params):
        ranked = topk.top(out, params["top_k"], "similarity", COLUMNS, params["threshold_direction"])
        return ranked.select("rank", *COLUMNS, "similarity").orderBy("rank")


class SimilaritySearchParallel(SimilaritySearch):
    """The same result; threads are Spark's tasks, the parameter is only checked."""

    name = "similarity-search-parallel"
    parameters = _object([], **SimilaritySearch.parameters["properties"], threads=_COUNT)


class SimilarityGraph(Workload):
    name = "similarity-graph"
    line_end = "\r\n"
    parameters = _object(["threshold"], threshold=_SHARE, threshold_direction=_WAY, block_size=_COUNT, max_rows=_COUNT)
    defaults = {"threshold_direction": "greater", "block_size": 256, "max_rows": None}

    def transform(self, rows, params):
        own = scans.accepted(self._molecules(rows), "valid", "row_no", True, params["max_rows"])
        prints = own.select(F.col("chembl_id").alias("id"), F.col("row_no").alias("ord"), F.col("m.words").alias("words"), F.col("m.n").alias("n"))
        if prints.where("id = ''").count():
            raise ValueError("empty id")
        graph.assert_unique(prints, "id")
        return graph.edges(prints, float(params["threshold"]), params["threshold_direction"], per_block=params["block_size"])

    def finalize(self, out, params):
        return out.orderBy("source_id", "target_id", F.col("similarity").desc())


class DescriptorBatch(Workload):
    name = "descriptor-batch"
    parameters = _object(["descriptors"], descriptors={"type": "array", "items": _TEXT, "minItems": 1, "uniqueItems": True}, skip_invalid={"type": "boolean"})
    defaults = {"skip_invalid": True}

    def transform(self, rows, params):
        names = params["descriptors"]
        own = scans.accepted(self._molecules(rows, names, True), "valid", "row_no", params["skip_invalid"])
        return own.select("row_no", "chembl_id", F.col("m.canonical").alias("canonical_smiles"), *[F.col("m.values")[i].alias(n) for i, n in enumerate(names)])

    def finalize(self, out, params):
        return out.orderBy("row_no").drop("row_no")


class MolwtFilter(Workload):
    name = "molwt-filter"
    parameters = _object([], min_weight={"type": "number", "minimum": 0}, max_weight={"type": "number", "minimum": 0}, skip_invalid={"type": "boolean"})
    defaults = {"skip_invalid": True, "min_weight": None, "max_weight": None}

    def domain(self, params):
        low, high = params["min_weight"], params["max_weight"]
        if low is None and high is None:
            raise ValueError("give min_weight or max_weight")
        if low is not None and high is not None and low > high:
            raise ValueError("min_weight exceeds max_weight")

    def transform(self, rows, params):
        own = scans.accepted(self._molecules(rows, None, True), "valid", "row_no", params["skip_invalid"])
        out = own.select("row_no", "chembl_id", F.col("m.canonical").alias("canonical_smiles"), F.col("m.weight").alias("molwt"))
        if params["min_weight"] is not None:
            out = out.where(F.col("molwt") >= params["min_weight"])
        return out if params["max_weight"] is None else out.where(F.col("molwt") <= params["max_weight"])

    def finalize(self, out, params):
        return out.orderBy("row_no").drop("row_no")


@dataclass
class Registry:
    """Workloads by name and version; disabled ones can't be required."""

    _known: dict[tuple[str, str], type[Workload]] = field(default_factory=dict)
    _off: set[str] = field(default_factory=set)

    def register(self, kind: type[Workload]) -> type[Workload]:
        version(kind.version)
        schema.define(kind.parameters)
        if (kind.name, kind.version) in self._known:
            raise ValueError(f"{kind.name}@{kind.version} is registered")
        self._known[kind.name, kind.version] = kind
        return kind

    def names(self) -> list[str]:
        return sorted({n for n, _ in self._known})

    def _found(self, name: str) -> list[tuple[str, str]]:
        if not (found := [k for k in self._known if k[0] == name]):
            raise KeyError(f"no workload {name}")
        return found

    def disable(self, name: str) -> None:
        self._found(name)
        self._off.add(name)

    def enable(self, name: str) -> None:
        self._found(name)
        self._off.discard(name)

    def require(self, name: str, wanted: str | None = None) -> type[Workload]:
        """The version asked for, else the latest."""
        found = self._found(name)
        if name in self._off:
            raise ValueError(f"{name} is disabled")
        if wanted is not None and (name, wanted) not in self._known:
            raise KeyError(f"no version {wanted} of {name}")
        return self._known[(name, wanted) if wanted else max(found, key=lambda k: version(k[1]))]

    def descriptions(self) -> list[dict]:
        return [{**self._known[k]().described(), "enabled": k[0] not in self._off} for k in sorted(self._known)]

    def export(self, path: str) -> None:
        Path(path).write_text(to_json({"schema_version": 2, "workloads": self.descriptions()}) + "\n", "utf-8")

    def discover(self, group: str, allowed: set[str]) -> list[str]:
        """Registers the entry points of a group that are on the list."""
        found = [e for e in metadata.entry_points(group=group) if e.name in allowed]
        for e in sorted(found, key=lambda e: e.name):
            self.register(e.load())
        return sorted(e.name for e in found)


def read_catalog(path: str) -> list[dict]:
    """The descriptions of an exported catalog, each checked."""
    got = json.loads(Path(path).read_text("utf-8"))
    if got.get("schema_version") != 2 or not isinstance(got.get("workloads"), list):
        raise ValueError("not a catalog of version 2")
    for w in got["workloads"]:
        version(w["version"])
        schema.define(w["parameters"])
    if len({(w["name"], w["version"]) for w in got["workloads"]}) < len(got["workloads"]):
        raise ValueError("a workload is listed twice")
    return got["workloads"]


def library() -> Registry:
    out = Registry()
    for kind in (SimilaritySearch, SimilaritySearchParallel, SimilarityGraph, DescriptorBatch, MolwtFilter):
        out.register(kind)
    return out


def submit(spark, paths: list[str] | str, name: str, params: dict, out: str, make=chemistry.Rdkit, registry: Registry | None = None) -> int:
    """Runs a workload over tables of molecules (columns chembl_id and
    canonical_smiles, tab-separated) into one CSV file; its rows."""
    paths = [paths] if isinstance(paths, str) else paths
    work = (registry or library()).require(name)(make)
    schema.check_limits(params, len(paths), 0)
    work.validate(params)
    parts = []
    for k, path in enumerate(paths):
        rows = tables.read_table(spark, path, COLUMNS).select(*COLUMNS)
        # Spark reads one file with quoted line feeds in order, in one partition
        parts.append(rows.withColumn("p", F.lit(k)).withColumn("m", F.monotonically_increasing_id()))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = tables.numbered(rows, ["p", "m"]).drop("p", "m")
    return work.write(work.run(rows, params), out)
