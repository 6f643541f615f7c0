"""Graph and product-quantized indexes, and streams of queries, against exact searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import evaluation as E, graph, index as I, vector as V
from veldt.operators.pq import PQIndex
from veldt.plans import registry
from veldt.streaming.search import answers, search_stream

SF = "/root/testdata/sf0.01"
SPECS = [("HNSW32", "efSearch=64"), ("GPU,Cagra,64,32,NN_DESCENT", "itopk_size=64,search_width=4"), ("PQ16", "k_factor=16"), ("GPU,IVF8,PQ16x8", "nprobe=8,k_factor=16")]


@pytest.fixture(scope="module")
def tables(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


@pytest.mark.parametrize("metric", ["L2", "IP"])
@pytest.mark.parametrize("spec,params", SPECS)
def test_recall(spark, tables, spec, params, metric):
    e, q = tables
    index = I.build_index(e, "vec_id", "embedding", spec, metric)
    for where in (None, F.col("label") < 3):
        truth = V.knn_join(e, q, "vec_id", "qid", "embedding", "qv", 10, metric=metric, where=where)
        got = I.search_index(index, q, "qid", "qv", 10, params, where)
        assert set(got.columns) == {"qid", "vec_id", "label", "vs_distance"} and got.count() == truth.count()
        assert E.recall(got, truth, ["qid", "vec_id"]) >= 0.9
        # what is found has its true distance
        both = got.alias("a").join(truth.alias("b"), ["qid", "vec_id"])
        assert both.where("abs(a.vs_distance - b.vs_distance) > 1e-9").count() == 0
        assert where is None or got.where("label >= 3").count() == 0


def test_texts():
    assert I.parse_params("efSearch=128, nprobe=3") == {"ef": 128, "nprobe": 3} and I.parse_params("") == {}
    for bad in (lambda: I.parse_params("depth=3"), lambda: I.build_index(None, "k", "v", "LSH"), lambda: I.build_index(None, "k", "v", "IVF8,PQ8x4")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("metric", ["L2", "IP"])
def test_shards_and_repeats(spark, metric):
    """Several shards; many equal vectors, repeated rows and odd vectors, with parts that are far apart."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(60, 4)), 50 + r.normal(size=(60, 4)), np.tile([1.0, 2.0, 3.0, 4.0], (80, 1))]).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0], rows[150], (900, None), (901, [float("nan")] * 4), (902, [None, 1.0, 1.0, 1.0]), (903, [float("inf")] * 4)]
    d = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    q = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, [50.0] * 4), (2, [0.0] * 4), (3, None), (4, [float("nan")] * 4)], "qid long, qv array<double>")
    for index, args in ((graph.GraphIndex.build(d, "k", "v", 8, metric, shard_rows=40), {"ef": 64}), (PQIndex.build(d, "k", "v", 4, None, metric), {"k_factor": 30})):
        got = index.search(q, "qid", "qv", 12, **args)
        truth = V.knn_join(d, q, "k", "qid", "v", "qv", 12, metric=metric)
        assert sorted(r["vs_distance"] for r in got.collect()) == pytest.approx(sorted(r["vs_distance"] for r in truth.collect()))
        assert sorted(map(tuple, got.where("qid = 0").select("k").collect())) == sorted(map(tuple, truth.where("qid = 0").select("k").collect()))
        with pytest.raises(Exception, match="length"):
            index.search(q.select("qid", F.array(F.lit(1.0)).alias("qv")), "qid", "qv", 1).collect()


def test_empty(spark):
    d = spark.createDataFrame([], "k long, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, qv array<double>")
    for spec in ("HNSW8", "PQ2", "IVF4,PQ2"):
        index = I.build_index(d, "k", "v", spec)
        assert index.search(q, "qid", "qv", 3).count() == 0
        one = I.build_index(spark.createDataFrame([(7, [1.0, 2.0])], "k long, v array<double>"), "k", "v", spec)
        assert [r["k"] for r in one.search(q, "qid", "qv", 3).collect()] == [7] and one.search(q.where("qid > 0"), "qid", "qv", 3).count() == 0
    with pytest.raises(ValueError):
        I.build_index(spark.createDataFrame([(7, [1.0, 2.0, 3.0])], "k long, v array<double>"), "k", "v", "PQ2")


def test_graph_reaches_all():
    """Every vector is reached from the first, also in parts that lie far apart."""
    r = np.random.default_rng(2)
    x = np.concatenate([c + r.normal(size=(30, 3)) for c in (0, 100, 200, 300)])
    for m in (2, 5):
        _, layers = graph.build_graph(x, m)
        seen, front = {0}, [0]
        while front:
            front = [j for i in front for j in layers[0][i].tolist() if j not in seen and not seen.add(j)]
        assert len(seen) == len(x)


def test_save(spark, tables, tmp_path):
    e, q = tables
    index = I.build_index(e, "vec_id", "embedding", "HNSW16")
    again = graph.GraphIndex.load(spark, index.save(f"file://{tmp_path}/g"), e, index.n, "vec_id", "embedding")
    a, b = (sorted(map(tuple, x.search(q, "qid", "qv", 5).collect())) for x in (index, again))
    assert a == b and len(a) == 5 * q.count()


def test_stream(spark, tables, tmp_path):
    """Queries that arrive in two files are answered as one table of them is, each once, also after a restart."""
    e, q = tables
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    search = lambda b: V.knn_join(e, b, "vec_id", "qid", "embedding", "qv", 5)
    want = sorted(map(tuple, search(q).collect()))
    q.where("qid % 100 = 0").coalesce(1).write.parquet(source)
    for more in (None, q.where("qid % 100 <> 0"), None):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(q.schema).parquet(source)
        search_stream(stream, search, out, f"{tmp_path}/state", available_now=True).awaitTermination()
    got = answers(spark, out)
    assert sorted(map(tuple, got.drop("batch").collect())) == want and got.select("batch").distinct().count() == 2
    with pytest.raises(ValueError):
        search_stream(q, search, out, f"{tmp_path}/state")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
@pytest.mark.parametrize("name", ["hnsw_recall", "pq_recall"])
def test_registered_recall(spark, sf, name):
    r = registry.QUERIES[name](spark, f"/root/testdata/{sf}").first()
    assert r["recall"] >= 0.9 and r["n_hit"] <= r["n_truth"] == r["n_queries"] * 20
