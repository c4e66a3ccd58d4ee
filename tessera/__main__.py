"""Command line: list, run, export and allowlist of workloads, and the two
similarity commands."""

from __future__ import annotations

import argparse
import json
import sys

from .plans import workloads


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names and versions")
    run = sub.add_parser("run", help="run a workload over tables")
    run.add_argument("name")
    run.add_argument("input", nargs="+")
    run.add_argument("--params", default="{}", help="JSON object")
    run.add_argument("--output", required=True)
    export = sub.add_parser("export", help="catalog as JSON")
    export.add_argument("output")
    sub.add_parser("allowlist", help="names that may run, as JSON")
    search = sub.add_parser("similarity-search")
    search.add_argument("input")
    one = search.add_mutually_exclusive_group(required=True)
    one.add_argument("--query-id")
    one.add_argument("--query-smiles")
    search.add_argument("--top-k", type=int, default=20)
    links = sub.add_parser("similarity-graph")
    links.add_argument("input")
    for q in (search, links):
        q.add_argument("--threshold", type=float, required=q is links)
        q.add_argument("--threshold-direction", choices=("greater", "less"), default="greater")
        q.add_argument("--max-rows", type=int)
        q.add_argument("--output", required=True)
    return p


def main(args: list[str] | None = None, spark=None, make=workloads.chemistry.Rdkit) -> int:
    a = _parser().parse_args(args)
    known = workloads.library()
    if a.command == "list":
        print("\n".join(f"{d['name']}@{d['version']}" for d in known.descriptions()))
        return 0
    if a.command == "allowlist":
        print(json.dumps(known.names()))
        return 0
    if a.command == "export":
        known.export(a.output)
        return 0
    if a.command == "run":
        name, inputs, params = a.name, a.input, json.loads(a.params)
    else:
        name, inputs = a.command, [a.input]
        keys = ("query_id", "query_smiles", "top_k", "threshold", "threshold_direction", "max_rows")
        params = {k: v for k in keys if (v := getattr(a, k, None)) is not None}
    try:
        known.require(name)(make).validate(params)
    except (KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tessera").getOrCreate()
    print(workloads.submit(spark, inputs, name, params, a.output, make, known))
    return 0


if __name__ == "__main__":
    sys.exit(main())
