"""What searches need as queries and data grow together, and their results where work is cut into tiles, blocks and groups."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldt.operators import vector as V


def batch(x, keys=None, **more):
    keys = np.arange(len(x)) if keys is None else keys
    cols = {"k": pa.array(keys, pa.int64()), "h": pa.array(keys, pa.int64()), "v": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))}
    return pa.RecordBatch.from_pydict(cols | {n: pa.array(v) for n, v in more.items()})


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("k", [10, 100])
def test_kernel_memory_does_not_follow_queries_times_rows(k):
    r = np.random.default_rng(1)
    q, batches = r.normal(size=(8000, 4)), [batch(r.normal(size=(4000, 4)), np.arange(4000) + 4000 * i) for i in range(3)]
    step = V.kernel(np.arange(8000), q, "L2", k, None)
    tracemalloc.start()
    out = [b.num_rows for b in step(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out) == 8000 * k and max(out) <= 1 << 16
    # one matrix of all queries and a batch's rows has 256 MB, and there were several
    assert peak < (64 << 20) + 5 * 8000 * k * 32


@pytest.mark.parametrize("metric", ["L2", "IP"])
def test_kernel_by_tiles_and_slices(monkeypatch, metric):
    monkeypatch.setattr(V, "TILE", 50)
    monkeypatch.setattr(V, "SLICE_BYTES", 300)
    r = np.random.default_rng(2)
    x, q = r.normal(size=(200, 3)).round(1).astype(np.float32).astype(float), r.normal(size=(23, 3)).round(1)
    x[100:] = x[:100]  # ties
    far = ((q[:, None] - x) ** 2).sum(axis=2) if metric == "L2" else -(q @ x.T)
    got = [t for b in V.kernel(np.arange(23), q, metric, 6, None)(batch(x[i : i + 40], np.arange(i, i + 40)) for i in range(0, 200, 40)) for t in zip(b["q"].to_pylist(), b["k"].to_pylist(), strict=True)]
    assert sorted(got) == sorted((i, j) for i in range(23) for j in sorted(range(200), key=lambda j: (round(far[i, j], 9), j))[:6])
    # groups, some of them small, are held against their own queries
    for n in (2, 150):
        g = r.integers(0, n, 200)
        members = [np.flatnonzero(r.random(23) < 0.4) for _ in range(n)]
        own = {i: [j for j in range(200) if i in members[g[j]]] for i in range(23)}
        step = V.kernel(np.arange(23), q, metric, 6, None, group=lambda b: b["g"].to_numpy(), members=members)
        got = [t for b in step(batch(x[i : i + 40], np.arange(i, i + 40), g=g[i : i + 40]) for i in range(0, 200, 40)) for t in zip(b["q"].to_pylist(), b["k"].to_pylist(), strict=True)]
        assert sorted(got) == sorted((i, j) for i in range(23) for j in sorted(own[i], key=lambda j: (round(far[i, j], 9), j))[:6])


def test_rows_that_must_differ_are_never_found():
    x = np.zeros((5, 2))
    step = V.kernel(np.arange(2), np.zeros((2, 2)), "L2", 3, None, own=np.array([7, 8]))
    got = [t for b in step([batch(x, a=[7, 7, 7, 7, 8])]) for t in zip(b["q"].to_pylist(), b["k"].to_pylist(), strict=True)]
    assert sorted(got) == [(0, 4), (1, 0), (1, 1), (1, 2)]


def test_blocks_of_hits(spark, monkeypatch):
    r = np.random.default_rng(4)
    x, q = r.normal(size=(90, 5)), r.normal(size=(31, 5))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(9)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, qv array<double>")
    whole = rows(V.knn_join(d, qs, "k", "qid", "v", "qv", 4), "qid", "k")
    monkeypatch.setattr(V, "BLOCK_HITS", 40)
    assert len(list(V.query_blocks(qs, "qid", "qv", k=4))) > 1
    assert rows(V.knn_join(d, qs, "k", "qid", "v", "qv", 4), "qid", "k") == whole
    far = ((q[:, None] - x) ** 2).sum(axis=2)
    assert whole == sorted((i, int(j)) for i in range(31) for j in np.argsort(far[i])[:4])


def test_classes_by_tiles(spark, monkeypatch):
    r = np.random.default_rng(5)
    x, c = r.normal(size=(70, 3)), r.normal(size=(20, 3))
    c[10:] = c[:10]  # the first of equals is meant
    monkeypatch.setattr(V, "TILE", 45)
    far = ((x[:, None] - c[:10]) ** 2).sum(axis=2)
    assert V._nearest_one(x, c, "L2").tolist() == far.argmin(axis=1).tolist()
    assert V._nearest_one(x, c, "IP").tolist() == (x @ c[:10].T).argmax(axis=1).tolist()
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(70, [float("nan"), 0.0, 0.0])], "k long, v array<double>")
    cs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "qid long, qv array<double>")
    assert rows(V.classify(d, cs, "qid", "v", "qv"), "k", "class_id") == [*enumerate(far.argmin(axis=1).tolist()), (70, 0)]


def test_no_more_tasks_than_the_shuffle(spark):
    d = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("h"), F.array(F.lit(1.0)).alias("v")).repartition(50)
    got = V.searched(d, V.kernel(np.arange(3), np.ones((3, 1)), "L2", 2, None))
    assert got.rdd.getNumPartitions() <= 4 and got.count() <= 4 * 6


def test_project_distance_is_made_in_small_batches():
    r = np.random.default_rng(6)
    q, x = r.normal(size=(3000, 4)), r.normal(size=(3000, 4))
    table = pa.table({"__qv": pa.array(q.tolist()), "q0": pa.array(np.arange(3000))})
    rows_ = pa.RecordBatch.from_pydict({"__v": pa.array(x.tolist()), "d0": pa.array(np.arange(3000))})
    tracemalloc.start()
    n, total = [], 0.0
    for b in V._all_pairs(table, "L2", ["d0"], ["q0"])([rows_]):
        n.append(b.num_rows)
        total += b["d"].to_numpy().sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n) == 9_000_000 and max(n) <= 1 << 16 and peak < 32 << 20
    assert abs(total - sum(((x - v) ** 2).sum() for v in q)) < 1e-3


@pytest.mark.parametrize("metric", ["L2", "IP"])
def test_project_distance_of_odd_vectors(spark, metric, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_BYTES", 32)  # several blocks of queries
    nan, inf = float("nan"), float("inf")
    odd = [[1.0, 2.0], None, [nan, 0.0], [inf, 1.0], [None, 1.0], [3.0], [], [0.5, 0.25]]
    d = spark.createDataFrame([(i, v, f"s{i}") for i, v in enumerate(odd)], "k long, v array<float>, s string")
    q = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "qid int, qv array<double>")
    got = V.project_distance(d, q, "v", "qv", metric)
    assert got.columns == ["k", "v", "s", "qid", "qv", "Distance"]
    # the definition, in expressions
    from veldt.functions.exprs import DISTANCES

    want = d.crossJoin(q).withColumn("Distance", DISTANCES[metric]("v", "qv"))
    text = lambda df: sorted(map(str, df.collect()))
    assert text(got) == text(want) and got.count() == 64
    assert V.project_distance(d.where("k > 50"), q, "v", "qv").count() == 0 == V.project_distance(d, q.where("qid > 50"), "v", "qv").count()


@pytest.mark.parametrize("k", [2, 5, 9])
def test_project_distance_top_k_of_odd_vectors(spark, k):
    nan, inf = float("nan"), float("inf")
    odd = [[1.0, 2.0], None, [nan, 0.0], [inf, 1.0], [None, 1.0], [1.0, 2.0], [0.5, 0.25]]
    d = spark.createDataFrame([(i, v, f"s{i}") for i, v in enumerate(odd)], "k long, v array<float>, s string")
    q = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "qid long, qv array<double>")
    got = V.project_distance_top_k(d, q, "k", "qid", "v", "qv", k)
    want = V.nearest(V.project_distance(d, q, "v", "qv", keep_data=False, keep_query=False), ["qid"], "Distance", "k", k)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # by hand: an infinite distance is nearer than none, which comes after all others
    assert [r["k"] for r in got.where("qid = 0").orderBy(F.col("Distance").asc_nulls_last(), "k").collect()] == [0, 5, 6, 3, 2, 1, 4][:k]
    some = V.project_distance_top_k(d.where("k in (0, 5, 6)"), q.where("qid in (0, 6)"), "k", "qid", "v", "qv", k)
    assert some.count() == 2 * min(k, 3)


@pytest.mark.parametrize("name", ["knn_post_partitioned", "knn_post_partitioned_images", "knn_post_filter_partitioned", "ivf_post_filter_partitioned"])
def test_partitioned_queries_search_once(spark, name):
    from veldt.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "parquet" in plan


def test_refined_search_leaves_hits_with_the_executors(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from veldt.operators import ivf

    r = np.random.default_rng(8)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 4)))], "k long, v array<double>")
    q = d.where("k < 20").select(F.col("k").alias("qid"), F.col("v").alias("qv"))
    index = ivf.IVFIndex.build(d, "k", "v", "IVF8,Flat")
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("hits went to the driver"))
    monkeypatch.setattr(V, "BLOCK_HITS", 45)
    got = index.search(q, "qid", "qv", 9, nprobe=2, refine=True)
    assert rows(got, "qid", "k") == rows(V.knn_join(d, q, "k", "qid", "v", "qv", 9), "qid", "k")


@pytest.mark.parametrize("on", ["a = b", "a <=> b", "a BETWEEN b - 1 AND b AND (w > u OR a = 2)", "a > 1"])
@pytest.mark.parametrize("index", [None, "IVF4,Flat"])
def test_conditional_search_by_classes(spark, monkeypatch, on, index):
    from veldt.operators import ivf

    r = np.random.default_rng(9)
    x, q = r.normal(size=(240, 3)), r.normal(size=(25, 3))
    x[200:] = x[:40]  # rows that are equal in key and vector, but not in what the condition reads
    a, w = [None if i % 11 == 0 else int(v) for i, v in enumerate(r.integers(0, 4, 240))], r.integers(0, 50, 240).tolist()
    b, u = [None if i % 7 == 0 else int(v) for i, v in enumerate(r.integers(0, 4, 25))], r.integers(0, 50, 25).tolist()
    key = [i if i < 200 else i - 200 for i in range(240)]
    data = [(key[i], v.tolist(), a[i], w[i], i) for i, v in enumerate(x)] + [(900, None, 1, 9, 900), (901, [float("nan")] * 3, 1, 9, 901)]
    query = [(i, v.tolist(), b[i], u[i]) for i, v in enumerate(q)] + [(30, None, 1, 9), (31, [float("nan")] * 3, 3, 9)]
    d = spark.createDataFrame(data, "k long, v array<double>, a int, w int, row int").repartition(3)
    qs = spark.createDataFrame(query, "qid long, qv array<double>, b int, u int")

    def holds(i, j):
        eq = a[i] is not None and a[i] == b[j]
        near = a[i] is not None and b[j] is not None and b[j] - 1 <= a[i] <= b[j]
        return {"a = b": eq, "a <=> b": a[i] == b[j], "a > 1": (a[i] or 0) > 1}.get(on, near and (w[i] > u[j] or a[i] == 2))

    far = ((q[:, None] - x) ** 2).sum(axis=2)
    want = sorted((j, i) for j in range(25) for i in sorted((i for i in range(240) if holds(i, j)), key=lambda i: (far[j, i], key[i]))[:5])
    monkeypatch.setattr(V, "BLOCK_HITS", 60)
    if index is None:
        got = V.correlated_knn(d, qs, F.expr(on), "k", "qid", "v", "qv", 5)
        assert got.columns == ["k", "a", "w", "row", "qid", "b", "u", "vs_distance"]
    else:
        got = ivf.IVFIndex.build(d, "k", "v", index).search(qs, "qid", "qv", 5, nprobe=4, on=F.expr(on))
        assert got.columns == ["qid", "b", "u", "k", "a", "w", "row", "vs_distance"]
    # of rows equal in key and vector either may be cut off at the fifth place
    assert sorted((j, key[i]) for j, i in want) == rows(got, "qid", "k")
    assert all(holds(i, j) for j, i in rows(got, "qid", "row")) and len(set(rows(got, "qid", "row"))) == len(want)
    # no distance is an expression on pairs of rows
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_conditional_search_of_some_lists(spark):
    from veldt.operators import ivf

    r = np.random.default_rng(10)
    d = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(r.normal(size=(300, 2)))], "k long, v array<double>, a int")
    q = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(r.normal(size=(12, 2)))], "qid long, qv array<double>, b int")
    index = ivf.IVFIndex.build(d, "k", "v", "IVF5,Flat")
    lists, place = {x["k"]: x["__list"] for x in index.lists.collect()}, {x["k"]: np.array(x["v"]) for x in d.collect()}
    want, near = [], []
    for x in q.collect():
        probed = np.argsort(((index.centroids - np.array(x["qv"])) ** 2).sum(axis=1))[:2]
        far = {k: ((v - np.array(x["qv"])) ** 2).sum() for k, v in place.items() if k % 3 == x["b"] and lists[k] in probed}
        want += [(x["qid"], k) for k in sorted(far, key=far.get)[:4]]
        near += [(x["qid"], k) for k, v in far.items() if v < 0.5]
    assert rows(index.search(q, "qid", "qv", 4, nprobe=2, on=F.expr("a = b")), "qid", "k") == sorted(want)
    assert rows(index.search(q, "qid", "qv", radius=0.5, nprobe=2, on=F.expr("a = b")), "qid", "k") == sorted(near)
