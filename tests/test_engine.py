"""Operators on tiny inputs with known results, and every query against DuckDB on the smallest tables."""

import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import dataset, evaluation as E, ivf, relational as R, vector as V
from veldt.plans import registry
from veldt.session import Session, parse_schema
from veldt.sources import files

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
DATA = [([1.0, 1, 1, 1, 1], "a"), ([1.0, 3, 1, 3, 1], "b"), ([2.0, 2, 8, 8, 8], "c"), ([8.0, 8, 2, 2, 2], "d"), ([3.0, 1, 3, 1, 3], "e")]
QUERIES = [(0, [0.99, 1.01, 0.98, 1.02, 0.99]), (1, [8.05, 7.55, 1.95, 2.10, 1.99])]


@pytest.fixture(scope="module")
def vectors(spark):
    data = spark.createDataFrame([(i, [float(x) for x in v], c) for i, (v, c) in enumerate(DATA)], "k long, v array<float>, c string")
    return data, spark.createDataFrame(QUERIES, "qid long, qv array<float>")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_knn(vectors):
    d, q = vectors
    assert rows(V.knn_join(d, q, "k", "qid", "v", "qv", 2), "qid", "c") == [(0, "a"), (0, "b"), (1, "d"), (1, "e")]


def test_knn_bitmap(vectors):
    d, q = vectors
    assert rows(V.knn_join(d, q, "k", "qid", "v", "qv", 2, where=F.col("k") < 2), "qid", "k") == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_knn_short_and_empty(vectors, spark):
    d, q = vectors
    assert V.knn_join(d, q, "k", "qid", "v", "qv", 50).count() == 10
    assert V.knn_join(d, q.where("qid > 5"), "k", "qid", "v", "qv", 2).count() == 0
    assert V.knn_join(d.where("k > 50"), q, "k", "qid", "v", "qv", 2).count() == 0


def test_range_inner_product(vectors):
    d, q = vectors
    # by hand: only c and d exceed 50, and only with the second query
    assert rows(V.knn_join(d, q, "k", "qid", "v", "qv", radius=50.0, metric="IP"), "qid", "c") == [(1, "c"), (1, "d")]


@pytest.mark.parametrize("metric", ["L2", "IP"])
def test_kernel_by_brute_force(spark, metric):
    r = np.random.default_rng(3)
    x, q = r.normal(size=(300, 6)).round(1), r.normal(size=(9, 6)).round(1)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, qv array<double>")
    far = ((q[:, None] - x) ** 2).sum(axis=2) if metric == "L2" else -(q @ x.T)
    got = rows(V.knn_join(d, qs, "k", "qid", "v", "qv", 7, metric=metric), "qid", "k")
    assert got == sorted((i, j) for i in range(9) for j in sorted(range(300), key=lambda j: (round(far[i, j], 9), j))[:7])
    limit = 3.0 if metric == "L2" else 4.0
    got = rows(V.knn_join(d, qs, "k", "qid", "v", "qv", radius=limit, metric=metric), "qid", "k")
    assert got == sorted((int(i), int(j)) for i, j in zip(*np.nonzero(far < limit if metric == "L2" else far < -limit)))


def test_repeated_keys_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows_ = [(1, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [0.1, 0.0]), (2, [0.1, 0.0]), (3, [nan, 0.0]), (4, None), (5, [inf, 0.0]), (6, [None, 0.0]), (7, [5.0, 5.0])]
    d = spark.createDataFrame(rows_, "k long, v array<double>")
    q = spark.createDataFrame([(0, [0.0, 0.0]), (1, [nan, 1.0]), (2, None)], "qid long, qv array<double>")
    assert rows(V.knn_join(d, q, "k", "qid", "v", "qv", 2), "qid", "k") == [(0, 1), (0, 1)]
    assert rows(V.knn_join(d, q, "k", "qid", "v", "qv", 3), "qid", "k") == [(0, 1), (0, 1), (0, 2)]
    assert rows(V.knn_join(d, q, "k", "qid", "v", "qv", 9), "qid", "k") == [(0, 1), (0, 1), (0, 2), (0, 2), (0, 7)]
    assert rows(V.knn_join(d, q, "k", "qid", "v", "qv", radius=1.0), "qid", "k") == [(0, 1), (0, 1), (0, 2), (0, 2)]
    with pytest.raises(Exception, match="length"):
        V.knn_join(spark.createDataFrame([(1, [1.0])], "k long, v array<double>"), q, "k", "qid", "v", "qv", 1).collect()


def test_apart_and_classes(vectors, spark):
    d, _ = vectors
    q = d.select(F.col("k").alias("qid"), F.col("v").alias("qv"))
    near = rows(V.knn_join(d, q, "k", "qid", "v", "qv", 1, apart=("k", "qid")), "qid", "k")
    assert near == [(0, 1), (1, 0), (2, 4), (3, 1), (4, 0)]  # d is as near to b as to e
    got = rows(V.classify(d, q.where("qid in (0, 2)"), "qid", "v", "qv"), "k", "class_id")
    assert got == [(0, 0), (1, 0), (2, 2), (3, 0), (4, 0)]


def test_project_distance(vectors, spark):
    d, _ = vectors
    q = spark.createDataFrame([(0, QUERIES[0][1]), (1, [2.5, 1.5, 7.5, 8.5, 9.0])], "qid long, qv array<double>")
    got = {(r["c"], r["qid"]): r["Distance"] for r in V.project_distance(d.where("k < 3"), q, "v", "qv").collect()}
    want = {("a", 0): 0.001101, ("b", 0): 7.881102, ("c", 0): 149.141098, ("a", 1): 165, ("b", 1): 141, ("c", 1): 2}
    assert all(abs(got[k] - v) < 1e-3 for k, v in want.items())


def test_batch_equals_singles(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id < 4").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    batch = rows(V.knn_join(e, q, "vec_id", "qid", "embedding", "qv", 7), "qid", "vec_id")
    singles = [r for i in range(4) for r in rows(V.knn_join(e, q.where(f"qid = {i}"), "vec_id", "qid", "embedding", "qv", 7), "qid", "vec_id")]
    assert batch == sorted(singles)


def test_ivf_recall_and_store(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    index = ivf.IVFIndex.build(e, "vec_id", "embedding", "IVF8,Flat")
    index = ivf.IVFIndex.load(spark, index.save(str(tmp_path), "IVF8,Flat"))
    truth = V.knn_join(e, q, "vec_id", "qid", "embedding", "qv", 10)
    got = [E.recall(index.search(q, "qid", "qv", 10, nprobe=n), truth, ["qid", "vec_id"]) for n in (1, 4, 8)]
    assert got == sorted(got) and got[-1] == 1.0
    assert ivf.parse_spec("GPU,IVF16,Flat") == 16 and ivf.parse_spec("Flat") is None and ivf.parse_params("nprobe=30") == {"nprobe": 30}
    for bad in (lambda: ivf.parse_spec("HNSW32"), lambda: ivf.parse_spec("IVF16,PQ8"), lambda: ivf.parse_params("efSearch=9")):
        with pytest.raises(ValueError):
            bad()
    # of a saved index only the probed lists are read
    one = index.search(q.limit(1), "qid", "qv", 10, nprobe=1)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__list#\d+ = \d", one)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_ivf_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    truth = registry.QUERIES["ivf_full_probe"](spark, d)
    assert E.recall(registry.QUERIES["ivf_recall"](spark, d), truth, ["qid", "id"]) >= 0.9


@pytest.mark.parametrize("metric", ["L2", "IP"])
def test_ivf_refined_is_exact(spark, metric):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    index = ivf.IVFIndex.build(e, "vec_id", "embedding", "IVF8,Flat", metric)
    truth = V.knn_join(e, q, "vec_id", "qid", "embedding", "qv", 10, metric=metric)
    assert E.recall(index.search(q, "qid", "qv", 10, nprobe=1, refine=True), truth, ["qid", "vec_id"]) == 1.0


def test_evaluation(spark):
    t = spark.createDataFrame([(0, 1, 1.00001), (0, 2, 2.0), (1, 1, None), (1, 1, None)], "q int, k int, d double")
    f = spark.createDataFrame([(0, 1, 1.00004), (1, 1, None), (1, 3, 2.0)], "q int, k int, d double")
    assert E.recall(f, t, ["q", "k"]) == 0.5 and abs(E.precision(f, t, ["q", "k"]) - 2 / 3) < 1e-9
    assert E.row_recall(f, t) == 0.5 and E.row_recall(t, t) == 1.0 and E.row_recall(f, t, ("d",)) == 0.5
    assert E.row_recall(t.where("false"), t.where("false")) == 1.0 and E.row_recall(t, t.where("false")) == 0.0
    per = {r["q"]: r["recall"] for r in E.recall_per_query(f.where("k < 3"), t.select("q", "k").distinct(), "q", "k").collect()}
    assert per == {0: 0.5, 1: 1.0}
    a, b = (spark.createDataFrame([(i, x) for i, x in enumerate(v)], "place int, x int") for v in ([1, 2, 3], [1, 3, 2]))
    assert abs(E.strict_recall(b, a, "place") - 1 / 3) < 1e-9
    one = lambda x: spark.createDataFrame([(x,)], "x double")
    assert E.scalar_error(one(11.0), one(10.0)) == (1.0, 0.1) and E.scalar_error(one(None), one(1.0)) is None and E.scalar_error(a, one(1.0)) is None


def test_dataset_keys_and_splits(spark, tmp_path):
    a = spark.createDataFrame([(f"p{i}",) for i in range(37)], "ext string")
    b = spark.createDataFrame([(i * 3,) for i in range(30)], "k long")
    m = dataset.map_keys(a, "ext", b, "k", 5).collect()
    assert len(m) == 30 and len({r["ext"] for r in m}) == 30 and {r["k"] for r in m} == {i * 3 for i in range(30)}
    assert sorted(map(tuple, m)) == sorted(map(tuple, dataset.map_keys(a.repartition(7), "ext", b, "k", 5).collect())) != sorted(map(tuple, dataset.map_keys(a, "ext", b, "k", 6).collect()))
    n = dataset.assign_keys(a, "ext", b.limit(5), "k", 5).groupBy("k").count().collect()
    assert sorted(r["count"] for r in n) == [7, 7, 7, 8, 8]
    assert rows(dataset.dense_keys(a, ["ext"], "i"), "i", "ext") == [(i, e) for i, e in enumerate(sorted(f"p{i}" for i in range(37)))]
    data, q = dataset.split(b, "k", 8, 1)
    assert q.columns == ["k_queries"] and q.count() == 8 and data.count() == 22 and data.join(q, data["k"] == q["k_queries"]).count() == 0
    paths = dataset.write_shards(b, str(tmp_path), "b", 4, "k")
    assert [spark.read.parquet(p).count() for p in paths] == [7, 8, 7, 8] and dataset.scan(spark, paths).count() == 30
    b.withColumnRenamed("k", "x").write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        dataset.scan(spark, [*paths, f"{tmp_path}/other"])
    got = dataset.random_counts(b, "k", 1000, 3)
    assert got.agg(F.sum("n")).first()[0] == 1000 and got.count() == 30 and len({r["n"] for r in got.collect()}) > 10
    assert dataset.dense_keys(b.where("false"), ["k"], "i").count() == 0


def test_dataset_checks(spark):
    t = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (2, 6, "b"), (2, 6, "b"), (3, None, None)], "id int, x int, s string")
    assert rows(dataset.drop_copies(t, "id", ("s",)), "id", "x") == [(1, 5), (2, 6), (3, None)]
    v = t.withColumn("v", F.when(F.col("id") == 1, F.array(F.lit(1.0), F.lit(0.0))).when(F.col("id") == 2, F.array(F.lit(0.6), F.lit(0.9))).otherwise(F.array(F.lit(float("nan")))))
    other = spark.createDataFrame([(5,)], "k int")
    got = {r["check"]: r["n"] for r in dataset.validate(v, "id", "v", {"x": (other, "k")}, {"x": (0, 5)}, unit=0.01).collect()}
    assert got == {"nulls:id": 0, "nulls:x": 1, "nulls:s": 1, "nulls:v": 0, "range:x": 2, "repeated keys": 2, "repeated rows": 1, "repeated vectors": 2, "vector length": 1, "vector values": 1, "vector norm": 4, "foreign:x": 2}
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.LongType(), True), T.StructField("id", T.ShortType(), False)])
    assert [f.simpleString() for f in dataset.enforce(t, schema).schema] == ["x:bigint", "id:smallint"]
    with pytest.raises(ValueError):
        dataset.enforce(t, T.StructType([T.StructField("x", T.LongType(), False)]))
    with pytest.raises(ValueError):
        dataset.enforce(t, T.StructType([T.StructField("y", T.LongType(), True)]))


def test_csv_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, 2.5, 'a "b", c'), (2, None, "d")], "id int, x double, s string")
    files.write_csv(t, f"{tmp_path}/t")
    back = files.read_csv(spark, [f"{tmp_path}/t"])
    assert back.dtypes == t.dtypes and rows(back, *t.columns) == rows(t, *t.columns)
    one = files.from_rows(spark, [[1, "x"], [2, None]], "a int, b string")
    files.write_fragments(one, f"{tmp_path}/f", 2)
    assert rows(files.read_parquet(spark, [f"{tmp_path}/f"]), "a", "b") == [(1, "x"), (2, None)]


def test_scatter(spark):
    df = spark.createDataFrame([(9, 100), (1, 200), (3, 300), (1, 400), (9, 500), (3, 600)], "query_id int, value int")
    ports = R.scatter(df, "query_id", 3)
    assert [rows(p, "query_id", "value") for p in ports] == [[(1, 200), (1, 400)], [(3, 300), (3, 600)], [(9, 100), (9, 500)]]
    with pytest.raises(ValueError):
        R.scatter(df, "query_id", 2)
    # fewer keys than ports: the ports that have no rows are empty, and gathering gives all rows back
    assert len(R.scatter(df, "query_id", 5)) == 3 and rows(R.gather(R.scatter(df, "query_id", 5)), "query_id", "value") == rows(df, "query_id", "value")


def test_joins_with_nulls(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(1,), (None,)], "k int")
    assert R.join(a, b, "inner", ["k"], ["k"]).count() == 1
    assert R.join(a, b, "inner", ["k"], ["k"], null_safe=True).count() == 2
    assert rows(R.join(a, b, "left_anti", ["k"], ["k"]), "k") == [(None,)]
    with pytest.raises(ValueError):
        R.join(a, b, "inner", ["k"], ["k"], suffixes=("_x", "_x"))


def test_session(spark, tmp_path):
    schema = parse_schema("CREATE TABLE t (a INT NOT NULL, b VARCHAR(10), c DECIMAL(12,2), d DATE)")["t"]
    assert [f.dataType.simpleString() for f in schema] == ["int", "string", "decimal(12,2)", "date"]
    df = files.random_table(spark, schema, 50)
    for i in range(2):
        df.write.parquet(f"{tmp_path}/t-{i}.parquet")
    s = Session(spark, str(tmp_path))
    s.load_table("t", ["a", "b"])
    assert s.sql("SELECT count(*) FROM t").first()[0] == 100 and "t" in s.table_names()
    with pytest.raises(ValueError):
        s.load_table("t", ["nope"])


def test_workers_elsewhere(tmp_path):
    """Queries with Python workers also run where nothing but the driver finds the package."""
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r})\nimport __spark_entry__ as e\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\nprint('rows', e.queries()['knn_l2'](s, {SF!r}).count(), e.entry(s).count())"
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200 20" in out.stdout, out.stderr[-2000:]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(x, y):
    if isinstance(x, float) and isinstance(y, (float, int)):
        return x == y or abs(x - y) <= 1e-9 * max(1, abs(x)) or (np.isnan(x) and (y is None or np.isnan(y)))
    return x == y or (x is None and isinstance(y, float) and np.isnan(y))


def key(r):
    return tuple((x is None, round(x, 4) if isinstance(x, float) else str(x)) for x in r)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_oracle(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    a = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    b = sorted(oracle.execute(f"select {', '.join(cols)} from ({registry.ORACLE_SQL[name]}) x").fetchall(), key=key)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
