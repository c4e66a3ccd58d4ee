import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, topk, verify
from tessera.sources import tables
from tessera.streaming import windows


def test_top_ties_go_by_id_and_k_is_checked(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "id string, s double")
    assert [r.id for r in topk.top(df, 2, "s", ["id"]).orderBy("rank").collect()] == ["c", "a"]
    assert [r.id for r in topk.top(df, 9, "s", ["id"], "less").orderBy("rank").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        topk.top(df, 0, "s", ["id"])
    with pytest.raises(ValueError):
        topk.threshold(df, "s", 1.5)


def test_self_exclusion_is_null_safe(spark):
    df = spark.createDataFrame([("q", "x"), ("r", "x"), (None, "y"), ("s", None)], "id string, c string")
    assert topk.not_self(df, "id", "c", "q", "x").count() == 2


def test_graph_does_not_depend_on_blocks(spark):
    rows = [(i, i, [(i * 2654435761) % (1 << 40)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ord long, words array<long>")
    df = df.withColumn("n", F.aggregate("words", F.lit(0), lambda a, w: a + F.bit_count(w)))
    one = sorted(map(tuple, graph.edges(df, 0.3, blocks=1).collect()))
    for more in (dict(blocks=5), dict(per_block=7), dict()):
        assert one and one == sorted(map(tuple, graph.edges(df, 0.3, **more).collect()))
    assert sorted(map(tuple, graph.edges(df, 0.2, "less", per_block=9).collect())) == sorted(map(tuple, graph.edges(df, 0.2, "less", blocks=1).collect()))
    with pytest.raises(ValueError):
        graph.assert_unique(df.unionByName(df), "id")
    edges = graph.edges(df, 0.3)
    with pytest.raises(ValueError):
        graph.merged(edges.unionByName(edges))


def test_table_reading_and_numbers(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text('id\tsmiles\textra\nA\t"C/C=C\\"\t1\nB\t"x""y"\t\n')
    df = tables.read_table(spark, str(p), ["id", "smiles"])
    assert [r.smiles for r in df.collect()] == ["C/C=C\\", 'x"y']
    with pytest.raises(ValueError):
        tables.read_table(spark, str(p), ["nothing"])
    assert [r.extra for r in df.collect()] == ["1", ""]
    many = spark.range(0, 1000, 1, 7)
    assert [r.row_no for r in tables.numbered(many, ["id"]).orderBy("id").collect()] == list(range(1000))


def test_ordered_csv_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1 / 128), (2, None, 0.5)], "rank int, id string, s double").orderBy("rank")
    out = tmp_path / "deep" / "o.csv"
    assert tables.write_ordered(df, str(out)) == 2
    assert out.read_bytes() == b'rank,id,s\r\n1,"a,b",0.007812\r\n2,,0.500000\r\n'
    tables.write_ordered(df, str(out), "\n", None)
    assert out.read_bytes() == b'rank,id,s\n1,"a,b",0.0078125\n2,,0.5\n'


def test_tolerance_and_order(spark):
    row = spark.range(1).select(verify.within(F.lit(1.0), F.lit(1.0005), relative=1e-3).alias("a"), verify.within(F.lit(float("nan")), F.lit(float("nan"))).alias("b"), verify.within(F.lit(None).cast("double"), F.lit(1.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, False)
    assert verify.ulps(1.0, 1.0000000000000002) == 1 and verify.ulps(0.0, -0.0) == 0
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 9)], "r int, v int")
    assert verify.out_of_order(df, "r", [F.col("v")]).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = str(tmp_path / "in")
    src.write.parquet(folder)
    q = windows.stream(spark, folder, src.schema, "ts", "event_type", "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, windows.tumbling(src, "ts", "event_type", "1 day").collect()))
