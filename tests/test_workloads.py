"""Parameters, registry, workloads with a toy backend, sources that check."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions import canonical
from tessera.functions import text as tx
from tessera.operators import lifecycle, scans, verify
from tessera.plans import schema, workloads
from tessera.sources import strict


class Toy:
    """Letters are atoms; a digit makes a text invalid."""

    def parse(self, smiles):
        return None if any(c.isdigit() for c in smiles) else smiles

    def canonical(self, m):
        return "".join(sorted(m))

    def bits(self, m):
        return sorted({hash_(m[i : i + 2]) % 2048 for i in range(len(m))})

    def weight(self, m):
        return float(len(m))

    def descriptors(self, m, names):
        return [float(m.count(n)) for n in names]


def hash_(s):
    return int.from_bytes(s.encode(), "big") * 2654435761 % (1 << 32)


MOLECULES = "chembl_id\tcanonical_smiles\textra\nQUERY\tCCO\t\nALCOHOL\tCCCO\t1\nAMINE\tCCN\t\nBROKEN\tC1\t\nDUPLICATE\tCCO\t\nLONG\tCCCCCCNO\t\n"


@pytest.fixture
def molecules(tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text(MOLECULES)
    return str(p)


def brute(rows, query, k):
    q = set(Toy().bits(query))
    own = [(len(q & set(Toy().bits(s))) / len(q | set(Toy().bits(s))), i, s) for i, s in rows]
    return sorted(own, key=lambda r: (-r[0], r[1], r[2]))[:k]


def test_search_equals_brute_force(spark, molecules, tmp_path):
    out = str(tmp_path / "o.csv")
    rows = [("ALCOHOL", "CCCO"), ("AMINE", "CCN"), ("LONG", "CCCCCCNO")]
    want = "".join(f"{n},{i},{s},{x:.6f}\r\n" for n, (x, i, s) in enumerate(brute(rows, "CCO", 2), 1))
    for name in ("similarity-search", "similarity-search-parallel"):
        assert workloads.submit(spark, molecules, name, {"query_id": "QUERY", "top_k": 2}, out, Toy) == 2
        assert open(out, newline="").read() == "rank,chembl_id,canonical_smiles,similarity\r\n" + want
    with pytest.raises(ValueError, match="invalid"):
        workloads.submit(spark, molecules, "similarity-search", {"query_id": "BROKEN"}, out, Toy)
    with pytest.raises(ValueError, match="no row"):
        workloads.submit(spark, molecules, "similarity-search", {"query_id": "X"}, out, Toy)


def test_other_workloads(spark, molecules, tmp_path):
    out = str(tmp_path / "deep" / "o.csv")
    assert workloads.submit(spark, molecules, "molwt-filter", {"min_weight": 3, "max_weight": 4}, out, Toy) == 4
    assert open(out, newline="").read().startswith("chembl_id,canonical_smiles,molwt\nQUERY,CCO,3.000000\nALCOHOL,CCCO,4.000000\n")
    assert workloads.submit(spark, molecules, "descriptor-batch", {"descriptors": ["C", "O"]}, out, Toy) == 5
    with pytest.raises(ValueError, match="row 4 is invalid"):
        workloads.submit(spark, molecules, "descriptor-batch", {"descriptors": ["C"], "skip_invalid": False}, out, Toy)
    assert workloads.submit(spark, molecules, "similarity-graph", {"threshold": 0, "block_size": 2}, out, Toy) == 10
    assert workloads.submit(spark, [molecules, molecules], "molwt-filter", {"min_weight": 8}, out, Toy) == 2
    with pytest.raises(ValueError, match="repeated id"):
        workloads.submit(spark, [molecules, molecules], "similarity-graph", {"threshold": 0}, out, Toy)


def test_command_line(spark, molecules, tmp_path, capsys):
    assert main(["list"]) == 0 and "molwt-filter@1.0.0" in capsys.readouterr().out
    assert main(["run", "molwt-filter", molecules, "--params", "{}", "--output", str(tmp_path / "o")], spark, Toy) == 2
    assert main(["similarity-search", molecules, "--query-smiles", "CCO", "--output", str(tmp_path / "o")], spark, Toy) == 0
    assert main(["export", str(tmp_path / "c.json")]) == 0
    assert [w["name"] for w in workloads.read_catalog(str(tmp_path / "c.json"))] == workloads.library().names()


def test_registry():
    r = workloads.library()
    with pytest.raises(ValueError):
        r.register(workloads.MolwtFilter)
    r.disable("molwt-filter")
    with pytest.raises(ValueError):
        r.require("molwt-filter")
    r.enable("molwt-filter")
    newer = type("Newer", (workloads.MolwtFilter,), {"version": "1.10.0"})
    r.register(newer)
    assert r.require("molwt-filter") is newer and r.require("molwt-filter", "1.0.0") is workloads.MolwtFilter
    with pytest.raises(KeyError):
        r.require("nothing")


@pytest.mark.parametrize("bad", [{"kind": 1}, {"type": "int"}, {"type": ["string", "string"]}, {"required": ["a", "a"]}, {"enum": []}, {"enum": [1, 1.0]}, {"minItems": -1}, {"minLength": 3, "maxLength": 2}, {"multipleOf": 0}, {"pattern": "a+"}, {"pattern": r"(a)\1"}, {"pattern": "["}, {"uniqueItems": 1}, {"anyOf": []}, {"items": 3}, {"maximum": float("nan")}])
def test_schema_definitions_that_are_refused(bad):
    with pytest.raises(schema.SchemaError):
        schema.define(bad)


@pytest.mark.parametrize("value, s, ok", [
    (5, {"type": "integer"}, True), (5.0, {"type": "integer"}, False), (True, {"type": "integer"}, False),
    (0.3, {"multipleOf": 0.1}, True), (0.35, {"multipleOf": 0.1}, False), (1, {"const": 1.0}, True), (True, {"enum": [1]}, False),
    ("abc", {"pattern": "^a.c$", "maxLength": 3}, True), ([1, 1.0], {"uniqueItems": True}, False), ([1, "a"], {"items": {"type": "integer"}}, False),
    ({"a": 1}, {"properties": {"a": {"type": "string"}}}, False), ({"b": 1}, {"additionalProperties": False}, False), ({}, {"required": ["a"]}, False),
    (3, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}, False), (3, {"anyOf": [{"minimum": 1}, {"maximum": 2}]}, True), (3, {"not": {"minimum": 4}}, True),
    (3, {"exclusiveMaximum": 3}, False), ({"a": 1, "b": 2}, {"maxProperties": 1}, False),
])
def test_schema_instances(value, s, ok):
    schema.define(s)
    assert (not schema.faults(value, s)) is ok


def test_limits_names_and_orders():
    with pytest.raises(ValueError):
        schema.check_limits({"a": "x" * (2 << 20)}, 1, 1)
    assert canonical.to_json({"b": 1, "a": [1.5, None]}) == '{"a":[1.5,null],"b":1}'
    with pytest.raises(ValueError):
        canonical.to_json(float("nan"))
    assert canonical.content_id("s@1", "aa") == canonical.content_id("s@1", "aa") != canonical.content_id("s@2", "aa")
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.9.0", "1.10.0"]
    assert sorted(order, key=canonical.version) == order
    assert canonical.in_range("1.5.0", ">=1.2,<2") and not canonical.in_range("2.0.0", "<2")
    assert canonical.dimensions([[1, 2, 3], [4, 5, 6]]) == [2, 3]
    with pytest.raises(ValueError):
        canonical.dimensions([[1], [1, 2]])
    assert canonical.stage_order({"c": ["a", "b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        canonical.stage_order({"a": ["b"], "b": ["a"]})
    assert canonical.collection_digest([("b", "2", 5), ("a", "1", 3)]) == canonical.collection_digest([("a", "1", 3), ("b", "2", 5)])
    with pytest.raises(ValueError):
        canonical.ascending([("a", 1), ("a", 2)])


def test_strict_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    good = put("e.csv", "source_id,target_id,similarity\na,b,0.5\n")
    assert strict.read_edges(spark, good).count() == 1
    for bad in ("a,b,1.5", "a,,0.5", "a,b,NaN", "a,b,x"):
        with pytest.raises(ValueError):
            strict.read_edges(spark, put("bad.csv", f"source_id,target_id,similarity\n{bad}\n"))
    cols, head = ["rank", "id", "similarity"], "rank,id,similarity\n"
    assert strict.read_partial(spark, put("p.csv", head + "1,a,0.9\n2,b,0.9\n3,a,0.1\n"), cols, ["id"]).count() == 3
    for bad in ("2,a,0.9", "1,a,0.1\n2,b,0.9", "1,a,0.9\n3,b,0.1", "1,a,Infinity", "1,b,0.5\n2,a,0.5"):
        with pytest.raises(ValueError):
            strict.read_partial(spark, put("bad.csv", head + bad + "\n"), cols, ["id"])
    assert strict.inspect_table(spark, put("t.tsv", "a\tb\n1\t2\n3\t\n"), "\t", ["a"]) == 2
    for text, kw in (("a\tb\n1\t2\n3\n", {}), ("a\tb\n1\t2\t3\n", {}), ("a\tb\n1\t2\n", {"exact": True}), ("a\tb\n1\t2\n3\t4\n", {"max_records": 1})):
        with pytest.raises(ValueError):
            strict.inspect_table(spark, put("bad.tsv", text), "\t", ["a"], **kw)
    assert strict.inspect_json(put("j.json", "[[1,2],[3,4]]"), "array", True) == 2
    for bad in ("[NaN]", "{}", "[[1],[2,3]]"):
        with pytest.raises(ValueError):
            strict.inspect_json(put("bad.json", bad), "array", True)
    with pytest.raises(ValueError):
        strict.inspect_json(put("bad.json", '{"a":1,"a":2}'), "object")


def test_shards_seal_and_preview(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("row_no"), F.concat(F.lit("r"), "id").alias("name"), F.lit("").alias("e"))
    strict.write_shards(rows, str(tmp_path / "s"), "row_no", 10, max_rows=22)
    files = sorted(p for p in (tmp_path / "s").rglob("part-*"))
    assert [len(p.read_text().splitlines()) for p in files] == [11, 11, 3]
    assert files[0].read_text().splitlines()[:2] == ["name\te", "r0\t"]
    p = tmp_path / "lines.tsv"
    p.write_text("h\na\n\nb\r\nc\n")
    got = [tuple(r) for r in strict.line_shards(spark, str(p), 2).orderBy("row_no").collect()]
    assert got == [(0, 0, "a"), (0, 1, ""), (1, 2, "b"), (1, 3, "c")]
    info = strict.seal(str(p), "lines@1", 100)
    assert json.loads((tmp_path / "lines.tsv.json").read_text()) == info and not os.stat(p).st_mode & 0o222
    assert strict.verified_bytes(str(p), info["sha256"]) == str(p)
    with pytest.raises(ValueError):
        strict.verified_bytes(str(p), "0" * 64)
    with pytest.raises(ValueError):
        strict.seal(str(p), "lines@1", 3)
    big = tmp_path / "big.csv"
    big.write_text("a,b\n" + "x,y\n" * 40)
    assert strict.preview(str(big), "text/csv")[1] and len(strict.preview(str(big), "text/csv", most=10)[0]) == 2
    known = strict.Inspectors()
    known.add("mine@1", "two", lambda path: 2)
    assert known.inspect("mine@1", "two", str(p)) == 2
    with pytest.raises(ValueError):
        known.inspect("mine@1", "three", str(p))


def test_verifiers(spark):
    assert verify.nested_within({"a": [1.0, {"b": 2}]}, {"a": [1.0 + 1e-12, {"b": 2}]}, 1e-9)
    assert not verify.nested_within([1.0], [1.0, 2.0], 1) and not verify.nested_within([True], [1], 1)
    assert verify.nested_within(float("nan"), float("nan"), nan_equal=True)
    ok = verify.canonical_match([1, 2], [1, 2], lambda r: str(r).encode())
    assert ok.status == "accepted" and ok.digest
    assert verify.canonical_match([1], [2], lambda r: str(r).encode()).reason == "canonical-mismatch"
    assert verify.canonical_match([1, 2], [1, 2], lambda r: b"", 1).reason == "record-limit"
    assert verify.canonical_match([1], [1], lambda r: r).reason == "canonicalization-failed"
    df = spark.range(100)
    assert verify.ordered_table_digest(df, ["id"], F.col("id").cast("string")) == verify.ordered_digest(str(i).encode() for i in range(100))
    bad = spark.createDataFrame([(i, i if i % 10 else -1) for i in range(100)], "r int, v int")
    assert verify.out_of_order(bad.repartition(5), "r", [F.col("v")]).count() == 9


def test_strict_quorum_and_scans(spark):
    votes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 1, "y"), ("b", 2, "x"), ("b", 3, "x"), ("c", 1, "x"), ("c", 2, "x"), ("c", 3, "y"), ("c", 4, "y"), ("d", 1, "x"), ("d", 2, "y")], "task string, owner int, digest string")
    got = {r.task: (r.digest, r.decision) for r in lifecycle.quorum_strict(votes, 2).collect()}
    assert got == {"a": ("x", "accept"), "b": (None, "reject"), "c": (None, "reject"), "d": (None, "inconclusive")}
    rows = spark.createDataFrame([(0, "a", True), (1, "b", False), (2, "", True), (3, "a", True)], "row_no long, id string, ok boolean")
    assert tuple(scans.stats(rows, "ok", "row_no", 3).first()) == (3, 2, 1, True, 1)
    with pytest.raises(ValueError):
        scans.in_blocks(rows, "id", "row_no", 2)
    assert scans.in_blocks(rows.where("row_no < 2"), "id", "row_no", 1).count() == 2


def test_text_rules(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(tx.sanitised(F.lit(r"in /work/a/b: open '/etc/x y' C:\tmp\f, see a/b"), "/work")) == r"in <worker-dir>/a/b: open '<path> y' <path>, see a/b"
    u = "123e4567-e89b-12d3-a456-426614174000"
    assert one(tx.route(F.lit(f"https://h/jobs/{u}/{u}/7x/42/9?q=1"))) == "/jobs/{id}/{id}/7x/{id}/{id}" and one(tx.route(F.lit("https://h"))) == "/"
    assert one(tx.index_key(F.lit("map.7"))) == 7 and one(tx.block_pair(F.lit("map.x1"))) is None
    assert one(tx.truncated_ms(F.lit(-1.2345))) == -1.234 and one(tx.ranged_float(F.lit("1e-1"))) == 0.1
