"""Queries that search vectors inside relational plans.

Reviews and images are derived from `embeddings`, all of them, which belong to
parts and customers by vec_id; queries are the vectors whose vec_id is divisible
by 50, against all rows. Queries with one query vector take vec_id 0. Columns
that the tables lack are left out of the texts; all others are as in the texts.
Money is counted in whole numbers: cents, and for amounts hundredths of a cent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import evaluation as E, index as I, ivf, relational as R, vector as V
from veldt.operators.relational import gather
from veldt.scratch import materialize

from .opqueries import read

QUERIES: dict = {}
ORACLE_SQL: dict = {}

CTES = """reviews AS (SELECT vec_id AS rv_reviewkey, label % 5 + 1 AS rv_rating, label AS rv_label, vec_id % (SELECT count(*) FROM part) AS rv_partkey, (vec_id * 7) % (SELECT count(*) FROM customer) AS rv_custkey, (vec_id * 3607) % 200 * 7200 AS rv_time, (vec_id * 31) % 200 AS rv_length, (vec_id * 7919) % 100000 AS rv_item, (vec_id * 13) % 97 AS rv_vote, CAST(embedding AS DOUBLE[]) AS rv_embedding FROM embeddings),
images AS (SELECT vec_id AS i_imagekey, vec_id % (SELECT count(*) FROM part) AS i_partkey, CASE WHEN vec_id % 4 = 0 THEN 'MAIN' ELSE 'PT0' || (vec_id % 4) END AS i_variant, CAST(embedding AS DOUBLE[]) AS i_embedding FROM embeddings),
qs AS (SELECT vec_id AS qid, label AS q_label, label % 5 + 1 AS q_rating, (vec_id * 3607) % 200 * 7200 AS q_time, (vec_id * 31) % 200 AS q_length, (vec_id * 7919) % 100000 AS q_item, (vec_id * 13) % 97 AS q_vote, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
li AS (SELECT *, CAST(FLOOR(l_quantity * 100 + 0.5) AS BIGINT) AS qty, CAST(FLOOR(l_extendedprice * 100 + 0.5) AS BIGINT) AS price, CAST(FLOOR(l_extendedprice * 100 + 0.5) AS BIGINT) * (100 - CAST(FLOOR(l_discount * 100 + 0.5) AS BIGINT)) AS amount FROM lineitem),
ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(SUM(qty) AS BIGINT) AS ps_availqty, MIN(price) AS ps_supplycost FROM li GROUP BY 1, 2)"""
AMOUNT, QTY = "CAST(SUM(CAST(amount AS DECIMAL(18,0))) AS DOUBLE) / 10000", "CAST(SUM(qty) AS DOUBLE) / 100"
K = 20


def _derived(prefix: str):
    """Columns that stand in for a review's time, length, item and votes."""
    v = F.col("vec_id")
    return [(v * 3607 % 200 * 7200).alias(prefix + "time"), (v * 31 % 200).alias(prefix + "length"), (v * 7919 % 100000).alias(prefix + "item"), (v * 13 % 97).alias(prefix + "vote")]


def reviews(s, d):
    parts, custs = read(s, d, "part").count(), read(s, d, "customer").count()
    return read(s, d, "embeddings").select(F.col("vec_id").alias("rv_reviewkey"), (F.col("label") % 5 + 1).alias("rv_rating"), F.col("label").alias("rv_label"), (F.col("vec_id") % parts).alias("rv_partkey"), (F.col("vec_id") * 7 % custs).alias("rv_custkey"), *_derived("rv_"), F.col("embedding").alias("rv_embedding"))


def images(s, d):
    parts = read(s, d, "part").count()
    variant = F.when(F.col("vec_id") % 4 == 0, "MAIN").otherwise(F.concat(F.lit("PT0"), (F.col("vec_id") % 4).cast("string")))
    return read(s, d, "embeddings").select(F.col("vec_id").alias("i_imagekey"), (F.col("vec_id") % parts).alias("i_partkey"), variant.alias("i_variant"), F.col("embedding").alias("i_embedding"))


def queries_(s, d, where="true"):
    e = read(s, d, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label"), (F.col("label") % 5 + 1).alias("q_rating"), *_derived("q_"), F.col("embedding").alias("qv")).where(where)


def near_reviews(s, d, where="qid = 0", k=K, cond=None, **kw):
    return V.knn_join(reviews(s, d), queries_(s, d, where), "rv_reviewkey", "qid", "rv_embedding", "qv", k, where=cond, **kw)


def near_images(s, d, where="qid = 0", k=K, cond=None, **kw):
    return V.knn_join(images(s, d), queries_(s, d, where), "i_imagekey", "qid", "i_embedding", "qv", k, where=cond, **kw)


def _cents(c):
    return F.floor(F.col(c) * 100 + 0.5).cast("bigint")


def lineitem(s, d):
    price = _cents("l_extendedprice")
    return read(s, d, "lineitem").withColumns({"price": price, "qty": _cents("l_quantity"), "amount": price * (100 - _cents("l_discount"))})


def partsupp(s, d):
    return lineitem(s, d).groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.sum("qty").alias("ps_availqty"), F.min("price").alias("ps_supplycost"))


def amount(c="amount", alias="revenue"):
    """A sum of amounts, exact, in whole units."""
    return (F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")).cast("double") / 10000).alias(alias)


def quantity(c="qty", alias="sum_qty"):
    return (F.sum(c).cast("double") / 100).alias(alias)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if sql.startswith("WITH") else f"WITH {CTES} {sql}"
        return f

    return add


L2 = "round(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 5)"


def _top(t, key, col, w="true", k=K, metric="L2"):
    dist = f"list_sum(list_transform(list_zip({col}, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" if metric == "L2" else f"list_inner_product({col}, qv)"
    return f"SELECT qid, {key} AS id, round({dist}, 5) AS dist FROM {t}, qs WHERE {w} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {dist} {'' if metric == 'L2' else 'DESC'}, {key}) <= {k}"


def _out(df, key):
    return df.select("qid", F.col(key).alias("id"), F.round("vs_distance", 5).alias("dist"))


def _rounded(c):
    """As round at 5 digits, without a decimal for each row: half up, as the SQL does it."""
    x = F.col(c)
    return F.when(x.between(0, 1e9), F.floor(x * 1e5 + 0.5) / 1e5).otherwise(F.round(x, 5))


#: The star buckets of a rating, by its value.
LOWER, UPPER = (0, 1, 1, 3, 3, 4), (0, 2, 2, 4, 5, 5)
_low, _up = (f"element_at(array({', '.join(map(str, b))}), cast({{}} as int) + 1)" for b in (LOWER, UPPER))
_low_sql, _up_sql = (f"(CAST({list(b)} AS INT[]))[{{}} + 1]" for b in (LOWER, UPPER))
DAY = 86400
#: Conditions on a review and a query, with places for the star buckets.
FAMILIES = {
    "label": "rv_label = q_label",
    "days": f"q_time BETWEEN rv_time - {3 * DAY} AND rv_time",
    "three": f"rv_length BETWEEN q_length - 30 AND q_length + 30 AND rv_time BETWEEN q_time - {30 * DAY} AND q_time AND rv_rating BETWEEN {{low}} AND {{up}}",
    "five": f"q_time BETWEEN rv_time - {7 * DAY} AND rv_time AND q_length BETWEEN rv_length - 30 AND rv_length + 30 AND q_item BETWEEN rv_item - 5000 AND rv_item + 5000 AND q_rating BETWEEN {{low}} AND {{up}} AND q_vote * 10 >= rv_vote",
}


def _condition(family: str, low: str, up: str) -> str:
    return FAMILIES[family].format(low=low.format("q_rating"), up=up.format("q_rating"))


def _micro():
    r, i = ("reviews", "rv_reviewkey", "rv_embedding"), ("images", "i_imagekey", "i_embedding")
    add = lambda n, f, sql: query(n, sql)(f)
    within = lambda t, key, col, x: f"SELECT qid, {key} AS id, {L2.format(a=col, b='qv')} AS dist FROM {t}, qs WHERE list_sum(list_transform(list_zip({col}, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) < {x}"

    def index(s, d, which):
        return ivf.IVFIndex.build(reviews(s, d), *r[1:], "IVF8,Flat") if which == "r" else ivf.IVFIndex.build(images(s, d), *i[1:], "IVF8,Flat")

    def ann(s, d, which, k=K, **kw):
        return index(s, d, which).search(queries_(s, d), "qid", "qv", k, **({"nprobe": 3, "refine": True} | kw))

    def post(near, cond, k=K):
        return V.nearest(near.where(cond), ["qid"], "dist", "id", k)

    # exhaustive
    add("knn_l2", lambda s, d: _out(near_reviews(s, d, "true"), "rv_reviewkey"), _top(*r))
    add("knn_ip", lambda s, d: _out(near_images(s, d, "true", metric="IP"), "i_imagekey"), _top(*i, metric="IP"))
    add("knn_range", lambda s, d: _out(V.knn_join(reviews(s, d), queries_(s, d), "rv_reviewkey", "qid", "rv_embedding", "qv", radius=1.2), "rv_reviewkey"), within(*r, 1.2))
    add("knn_prefilter", lambda s, d: _out(near_reviews(s, d, "true", cond=F.col("rv_rating") >= 4), "rv_reviewkey"), _top(*r, "rv_rating >= 4"))
    add("knn_bitmap", lambda s, d: _out(V.knn_join(images(s, d).withColumn("bitmap", F.col("i_variant") == "MAIN"), queries_(s, d), "i_imagekey", "qid", "i_embedding", "qv", K, where=F.col("bitmap")), "i_imagekey"), _top(*i, "i_variant = 'MAIN'"))
    add("knn_bitmap_range", lambda s, d: _out(V.knn_join(images(s, d), queries_(s, d), "i_imagekey", "qid", "i_embedding", "qv", radius=1.2, where=F.col("i_variant") == "MAIN"), "i_imagekey"), f"SELECT * FROM ({within(*i, 1.2)}) x WHERE id % 4 = 0")
    add("knn_full_columns", lambda s, d: near_reviews(s, d, "true").drop(*[c for c in queries_(s, d).columns if c != "qid"]).withColumn("vs_distance", F.round("vs_distance", 5)), f"SELECT qid, reviews.* EXCLUDE (rv_embedding), dist AS vs_distance FROM ({_top(*r)}) x JOIN reviews ON id = rv_reviewkey")
    add("knn_pre_partkey", lambda s, d: _out(near_images(s, d, "true", cond=F.col("i_partkey") < 100), "i_imagekey"), _top(*i, "i_partkey < 100"))
    part = "SELECT qid, id, dist FROM ({0}) x JOIN {1} ON id = {2} WHERE {3} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= {4}"
    named = lambda df, key, *more: df.select("qid", F.col(key).alias("id"), F.round("vs_distance", 5).alias("dist"), *more)
    add("knn_postfilter", lambda s, d: post(named(near_reviews(s, d, "true", 100), "rv_reviewkey", "rv_rating"), "rv_rating >= 4").drop("rv_rating"), part.format(_top(*r, k=100), *r[:2], "rv_rating >= 4", K))
    add("knn_postfilter_images", lambda s, d: post(named(near_images(s, d, "true", 100), "i_imagekey", "i_variant"), "i_variant = 'MAIN'").drop("i_variant"), part.format(_top(*i, k=100), *i[:2], "i_variant = 'MAIN'", K))
    add("knn_prejoin", lambda s, d: _out(V.knn_join(reviews(s, d).join(read(s, d, "part", "p_partkey", "p_size").where("p_size >= 10"), F.col("rv_partkey") == F.col("p_partkey")), queries_(s, d), "rv_reviewkey", "qid", "rv_embedding", "qv", K), "rv_reviewkey"), _top("reviews JOIN part ON rv_partkey = p_partkey", *r[1:], "p_size >= 10"))
    add("knn_postjoin", lambda s, d: V.nearest(_out(near_reviews(s, d, "true", 100).join(read(s, d, "part").where("p_size >= 10"), F.col("rv_partkey") == F.col("p_partkey")), "rv_reviewkey"), ["qid"], "dist", "id", K), f"SELECT qid, id, dist FROM ({_top(*r, k=100)}) x JOIN reviews ON id = rv_reviewkey JOIN part ON rv_partkey = p_partkey WHERE p_size >= 10 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= {K}")
    add("knn_partitioned", lambda s, d: gather([_out(near_reviews(s, d, f"qid div 50 % 5 = {g}", cond=F.col("rv_rating") >= g + 1), "rv_reviewkey") for g in range(5)]), _top(*r, "rv_rating >= qid // 50 % 5 + 1"))

    # one search of a larger k, then a scatter by query, each part filtered, sorted and cut, and gathered
    def partitioned(s, d, near, conds):
        # written once, as each part would search anew
        near, group = materialize(near, "near"), (F.col("qid") / 50).cast("bigint") % len(conds)
        ports = [near.where(group == g) for g in range(len(conds))]
        return gather([R.limit_per_group(p.where(c), ["qid"], [("dist", "asc"), ("id", "asc")], K) for p, c in zip(ports, conds, strict=True)])

    add("knn_post_partitioned", lambda s, d: partitioned(s, d, named(near_reviews(s, d, "true", 100), "rv_reviewkey", "rv_rating"), ["rv_rating >= 4"] * 5).drop("rv_rating"), part.format(_top(*r, k=100), *r[:2], "rv_rating >= 4", K))
    add("knn_post_partitioned_images", lambda s, d: partitioned(s, d, named(near_images(s, d, "true", 100), "i_imagekey", "i_variant"), ["i_variant = 'MAIN'"] * 5).drop("i_variant"), part.format(_top(*i, k=100), *i[:2], "i_variant = 'MAIN'", K))
    add("knn_post_filter_partitioned", lambda s, d: partitioned(s, d, named(near_reviews(s, d, "true", 100), "rv_reviewkey", "rv_rating"), [f"rv_rating >= {g + 1}" for g in range(5)]).drop("rv_rating"), part.format(_top(*r, k=100), *r[:2], "rv_rating >= qid // 50 % 5 + 1", K))
    add("project_distance", lambda s, d: V.project_distance(images(s, d).select("i_imagekey", "i_embedding"), queries_(s, d).select("qid", "qv"), "i_embedding", "qv", keep_data=False, keep_query=False).select("qid", F.col("i_imagekey").alias("id"), _rounded("Distance").alias("dist")), f"SELECT qid, i_imagekey AS id, {L2.format(a='i_embedding', b='qv')} AS dist FROM images, qs")
    add("project_distance_top_k", lambda s, d: V.project_distance_top_k(images(s, d), queries_(s, d), "i_imagekey", "qid", "i_embedding", "qv", K).select("qid", F.col("i_imagekey").alias("id"), F.round("Distance", 5).alias("dist")), _top(*i))
    # by index: exact where refined or all lists are probed
    add("ivf_full_probe", lambda s, d: _out(ann(s, d, "i", nprobe=8, refine=False), "i_imagekey"), _top(*i))
    add("ivf_recall", lambda s, d: _out(ann(s, d, "i"), "i_imagekey"), _top(*i))
    add("ivf_reviews", lambda s, d: _out(ann(s, d, "r"), "rv_reviewkey"), _top(*r))
    add("ivf_full_columns", lambda s, d: ann(s, d, "r").select("qid", *[c for c in reviews(s, d).columns if c != "rv_embedding"], F.round("vs_distance", 5).alias("vs_distance")), f"SELECT qid, reviews.* EXCLUDE (rv_embedding), dist AS vs_distance FROM ({_top(*r)}) x JOIN reviews ON id = rv_reviewkey")
    add("ivf_range", lambda s, d: _out(ann(s, d, "i", None, radius=1.2, nprobe=8, refine=False), "i_imagekey"), within(*i, 1.2))
    add("ivf_bitmap_reviews", lambda s, d: _out(ann(s, d, "r", where=F.col("rv_rating") >= 4), "rv_reviewkey"), _top(*r, "rv_rating >= 4"))
    add("ivf_bitmap_images", lambda s, d: _out(ann(s, d, "i", where=F.col("i_variant") == "MAIN"), "i_imagekey"), _top(*i, "i_variant = 'MAIN'"))
    add("ivf_post_reviews", lambda s, d: post(named(ann(s, d, "r", 100), "rv_reviewkey", "rv_rating"), "rv_rating >= 4").drop("rv_rating"), part.format(_top(*r, k=100), *r[:2], "rv_rating >= 4", K))
    add("ivf_post_images", lambda s, d: post(named(ann(s, d, "i", 100), "i_imagekey", "i_variant"), "i_variant = 'MAIN'").drop("i_variant"), part.format(_top(*i, k=100), *i[:2], "i_variant = 'MAIN'", K))
    add("ivf_post_filter_partitioned", lambda s, d: partitioned(s, d, named(ann(s, d, "r", 100), "rv_reviewkey", "rv_rating"), [f"rv_rating >= {g + 1}" for g in range(5)]).drop("rv_rating"), part.format(_top(*r, k=100), *r[:2], "rv_rating >= qid // 50 % 5 + 1", K))
    # approximate: the share of the true neighbours that is found
    def measured(s, d, spec, params):
        got = I.search_index(I.build_index(images(s, d), *i[1:], spec), queries_(s, d), "qid", "qv", K, params)
        per = E.recall_per_query(_out(got, "i_imagekey"), _out(near_images(s, d, "true"), "i_imagekey"), "qid", "id")
        n, hit = F.sum("n_truth"), F.sum("n_hit")
        return per.agg(F.count(F.lit(1)).alias("n_queries"), n.alias("n_truth"), hit.alias("n_hit"), (hit / n).alias("recall"))

    add("hnsw_recall", lambda s, d: measured(s, d, "HNSW32", "efSearch=128"), None)
    add("pq_recall", lambda s, d: measured(s, d, "IVF8,PQ16", "nprobe=8,k_factor=16"), None)
    add("knn_inline_expr", lambda s, d: _out(ann(s, d, "r", nprobe=8, refine=False, on=F.col("rv_rating") == F.col("q_rating")), "rv_reviewkey"), _top(*r, "rv_rating = q_rating"))
    add("knn_correlated", lambda s, d: _out(V.correlated_knn(reviews(s, d), queries_(s, d), F.expr("rv_rating = q_rating"), "rv_reviewkey", "qid", "rv_embedding", "qv", K), "rv_reviewkey"), _top(*r, "rv_rating = q_rating"))
    for f in FAMILIES:
        on, sql = _condition(f, _low, _up), _top(*r, _condition(f, _low_sql, _up_sql))
        add(f"filtered_{f}", lambda s, d, on=on: _out(V.correlated_knn(reviews(s, d), queries_(s, d), F.expr(on), "rv_reviewkey", "qid", "rv_embedding", "qv", K), "rv_reviewkey"), sql)
        add(f"filtered_{f}_index", lambda s, d, on=on: _out(ann(s, d, "r", nprobe=8, refine=False, on=F.expr(on)), "rv_reviewkey"), sql)


_micro()
NEAR_R = "nr AS (" + _top("reviews", "rv_reviewkey", "rv_embedding", "qid = 0") + ")"
NEAR_I = "ni AS (" + _top("images", "i_imagekey", "i_embedding", "qid = 0 AND i_variant = 'MAIN'") + ")"
W = f"WITH {CTES}, {NEAR_R}, {NEAR_I} "


_NEAREST_CLASS = "SELECT rv_partkey, rv_reviewkey, qid FROM (SELECT rv_partkey, rv_reviewkey, qid, list_sum(list_transform(list_zip(rv_embedding, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM reviews, qs) x QUALIFY row_number() OVER (PARTITION BY rv_reviewkey ORDER BY d, qid) = 1"


def _date(text):
    return F.lit(text).cast("date")


@query("vech_q1_start", f"WITH {CTES}, near AS ({_NEAREST_CLASS}), cls AS (SELECT rv_partkey, qid FROM (SELECT rv_partkey, qid, count(*) AS n FROM near GROUP BY ALL) y QUALIFY row_number() OVER (PARTITION BY rv_partkey ORDER BY n DESC, qid) = 1) SELECT l_returnflag, l_linestatus, qid AS class_id, {QTY} AS sum_qty, {AMOUNT} AS sum_disc_price, COUNT(*) AS n FROM li JOIN cls ON l_partkey = rv_partkey WHERE l_shipdate <= DATE '2000-09-02' GROUP BY ALL")
def _(s, d):
    # the few classes go to the reviews, map-side
    near = V.classify(reviews(s, d), queries_(s, d), "qid", "rv_embedding", "qv")
    n = near.groupBy("rv_partkey", "class_id").agg(F.count(F.lit(1)).alias("n"))
    cls = n.withColumn("m", -F.col("n")).transform(lambda x: V.nearest(x, ["rv_partkey"], "m", "class_id", 1)).select("rv_partkey", "class_id")
    li = lineitem(s, d).where(F.col("l_shipdate") <= _date("2000-09-02"))
    return li.join(cls, F.col("l_partkey") == F.col("rv_partkey")).groupBy("l_returnflag", "l_linestatus", "class_id").agg(quantity(), amount(alias="sum_disc_price"), F.count(F.lit(1)).alias("n"))


@query("vech_q1_end", f"WITH {CTES}, near AS ({_NEAREST_CLASS}) SELECT l_returnflag, l_linestatus, qid AS class_id, {QTY} AS sum_qty, {AMOUNT} AS sum_disc_price, COUNT(*) AS n FROM li JOIN near ON l_partkey = rv_partkey WHERE l_shipdate <= DATE '2000-09-02' GROUP BY ALL")
def _(s, d):
    # as q1_start, with a row for every review of a part
    near = V.classify(reviews(s, d), queries_(s, d), "qid", "rv_embedding", "qv").groupBy("rv_partkey", "class_id").agg(F.count(F.lit(1)).alias("m"))
    li = lineitem(s, d).where(F.col("l_shipdate") <= _date("2000-09-02"))
    j = li.join(near, F.col("l_partkey") == F.col("rv_partkey"))
    return j.groupBy("l_returnflag", "l_linestatus", "class_id").agg(quantity(F.col("qty") * F.col("m")), amount(F.col("amount") * F.col("m"), "sum_disc_price"), F.sum("m").alias("n"))


@query("vech_q2_start", W.rstrip() + ", eu AS (SELECT ps.*, s_suppkey, s_name, s_acctbal, n_name FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') SELECT i_imagekey, dist AS vs_distance, s_acctbal, s_name, n_name, p_partkey FROM ni JOIN images ON id = i_imagekey JOIN part ON i_partkey = p_partkey JOIN eu ON p_partkey = ps_partkey WHERE ps_supplycost = (SELECT min(e2.ps_supplycost) FROM eu e2 WHERE e2.ps_partkey = p_partkey) ORDER BY s_acctbal DESC, dist, n_name, s_name, p_partkey, i_imagekey LIMIT 100")
def _(s, d):
    near = near_images(s, d, cond=F.col("i_variant") == "MAIN").select("i_imagekey", "i_partkey", F.round("vs_distance", 5).alias("vs_distance"))
    sup = read(s, d, "supplier").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(s, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    # only the near parts' lines are aggregated
    mine = lineitem(s, d).join(near.select("i_partkey").distinct(), F.col("l_partkey") == F.col("i_partkey"), "left_semi").groupBy(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk")).agg(F.min("price").alias("cost"))
    mine = mine.join(sup.select("s_suppkey", "s_acctbal", "s_name", "n_name"), F.col("sk") == F.col("s_suppkey"))
    best = mine.groupBy(F.col("pk").alias("bk")).agg(F.min("cost").alias("low"))
    j = mine.join(best, (F.col("pk") == F.col("bk")) & (F.col("cost") == F.col("low"))).join(read(s, d, "part", "p_partkey"), F.col("pk") == F.col("p_partkey")).join(near, F.col("i_partkey") == F.col("pk"))
    return j.select("i_imagekey", "vs_distance", "s_acctbal", "s_name", "n_name", "p_partkey").orderBy(F.desc("s_acctbal"), "vs_distance", "n_name", "s_name", "p_partkey", "i_imagekey").limit(100)


@query("vech_q10_mid", W + f"SELECT c_custkey IN (SELECT rv_custkey FROM nr JOIN reviews ON id = rv_reviewkey) AS is_in_top_k, c_custkey, c_name, {AMOUNT} AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN li ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' GROUP BY ALL ORDER BY is_in_top_k, revenue DESC, c_custkey LIMIT 20")
def _(s, d):
    who = near_reviews(s, d).select(F.col("rv_custkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    o = read(s, d, "orders").where((F.col("o_orderdate") >= _date("1996-10-01")) & (F.col("o_orderdate") < _date("1997-01-01")))
    j = lineitem(s, d).where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(amount())
    j = j.join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(who, F.col("k") == F.col("c_custkey"), "left")
    return j.select(F.coalesce("hit", F.lit(False)).alias("is_in_top_k"), "c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy("is_in_top_k", F.desc("revenue"), "c_custkey").limit(20)


_STOCK = "own AS (SELECT ps_partkey, SUM(CAST(ps_supplycost AS DECIMAL(18,0)) * ps_availqty) AS v FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' GROUP BY 1), stock AS (SELECT * FROM own WHERE v * 10000 > (SELECT SUM(v) FROM own) ORDER BY v DESC, 1 LIMIT 100)"


def _stock(s, d):
    sup = read(s, d, "supplier").join(read(s, d, "nation").where("n_name = 'NATION_7'"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")
    own = lineitem(s, d).join(sup, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").groupBy(F.col("l_partkey").alias("ps_partkey"), "l_suppkey").agg(F.sum("qty").alias("q"), F.min("price").alias("c"))
    own = own.groupBy("ps_partkey").agg(F.sum((F.col("c") * F.col("q")).cast("decimal(18,0)")).alias("v"))
    return own.crossJoin(own.agg(F.sum("v").alias("all"))).where(F.col("v") * 10000 > F.col("all")).drop("all").orderBy(F.desc("v"), "ps_partkey").limit(100)


def _main_images(s, d, stock):
    return images(s, d).where("i_variant = 'MAIN'").join(stock.select("ps_partkey"), F.col("i_partkey") == F.col("ps_partkey"), "left_semi").select(F.col("i_imagekey").alias("qid"), F.col("i_partkey").alias("part"), F.col("i_embedding").alias("qv"))


_PAIRS = "pair AS (SELECT a.i_imagekey AS qk, a.i_partkey AS part, b.i_partkey AS other, b.i_imagekey AS k, list_sum(list_transform(list_zip(a.i_embedding, b.i_embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dd FROM images a JOIN stock ON a.i_partkey = ps_partkey JOIN images b ON a.i_partkey <> b.i_partkey WHERE a.i_variant = 'MAIN')"
_Q11 = "SELECT ps_partkey, CAST(v AS DOUBLE) / 10000 AS stock_value, other AS duplicate_partkey, round(dd, 5) AS visual_distance FROM stock LEFT JOIN images q ON ps_partkey = q.i_partkey AND q.i_variant = 'MAIN' LEFT JOIN"


@query("vech_q11_end", f"WITH {CTES}, {_STOCK}, {_PAIRS} {_Q11} (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY qk ORDER BY dd, k) = 1) ON q.i_imagekey = qk")
def _(s, d):
    stock = _stock(s, d)
    q = _main_images(s, d, stock)
    near = V.knn_join(images(s, d), q, "i_imagekey", "qid", "i_embedding", "qv", 1, apart=("i_partkey", "part"))
    return _duplicates(stock, q, near)


def _duplicates(stock, q, near):
    near = near.select(F.col("qid").alias("qk"), F.col("i_partkey").alias("duplicate_partkey"), F.round("vs_distance", 5).alias("visual_distance"))
    j = stock.join(q.select("qid", "part"), F.col("ps_partkey") == F.col("part"), "left").join(near, F.col("qid") == F.col("qk"), "left")
    return j.select("ps_partkey", (F.col("v").cast("double") / 10000).alias("stock_value"), "duplicate_partkey", "visual_distance")


@query("vech_q11_end_ranged", f"WITH {CTES}, {_STOCK}, {_PAIRS} {_Q11} pair ON q.i_imagekey = qk AND dd < 1.4")
def _(s, d):
    stock = _stock(s, d)
    q = _main_images(s, d, stock)
    return _duplicates(stock, q, V.knn_join(images(s, d), q, "i_imagekey", "qid", "i_embedding", "qv", radius=1.4, apart=("i_partkey", "part")))


@query("vech_q13_mid", W + "SELECT c_count, count(*) AS custdist, CAST(sum(coalesce(n, 0)) AS BIGINT) AS reviewdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) c LEFT JOIN (SELECT rv_custkey, count(*) AS n FROM nr JOIN reviews ON id = rv_reviewkey GROUP BY 1) r ON c_custkey = rv_custkey GROUP BY 1")
def _(s, d):
    n = near_reviews(s, d).groupBy("rv_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return c.join(n, F.col("c_custkey") == F.col("rv_custkey"), "left").groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist"), F.sum(F.coalesce("n", F.lit(0))).alias("reviewdist"))


@query("vech_q15_end", f"WITH {CTES}, best AS (SELECT l_suppkey, sum(CAST(amount AS DECIMAL(18,0))) AS r FROM li WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY 1 ORDER BY r DESC, 1 LIMIT 1), parts AS (SELECT DISTINCT ps_partkey FROM ps JOIN best ON ps_suppkey = l_suppkey) " + _top("reviews JOIN parts ON rv_partkey = ps_partkey", "rv_reviewkey", "rv_embedding", "qid = 0"))
def _(s, d):
    li = lineitem(s, d).where((F.col("l_shipdate") >= _date("1996-01-01")) & (F.col("l_shipdate") < _date("1996-04-01")))
    best = li.groupBy("l_suppkey").agg(F.sum(F.col("amount").cast("decimal(18,0)")).alias("r")).orderBy(F.desc("r"), "l_suppkey").limit(1)
    parts = read(s, d, "lineitem", "l_partkey", F.col("l_suppkey").alias("k")).join(best, F.col("k") == F.col("l_suppkey"), "left_semi").select("l_partkey")
    r = reviews(s, d).join(parts, F.col("rv_partkey") == F.col("l_partkey"), "left_semi")
    return _out(V.knn_join(r, queries_(s, d, "qid = 0"), "rv_reviewkey", "qid", "rv_embedding", "qv", K), "rv_reviewkey")


# k is 3 here: the stand-in for partsupp gives a part a quarter of all suppliers, so 20 parts would leave none
NEAR_3 = "nr3 AS (" + _top("reviews", "rv_reviewkey", "rv_embedding", "qid = 0", 3) + ")"


@query("vech_q16_start", f"WITH {CTES}, {NEAR_3} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT p2.ps_suppkey FROM ps p2 JOIN reviews ON p2.ps_partkey = rv_partkey JOIN nr3 ON id = rv_reviewkey) GROUP BY ALL")
def _(s, d):
    pairs = read(s, d, "lineitem", F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
    bad = pairs.select(F.col("ps_suppkey").alias("bad"), F.col("ps_partkey").alias("k")).join(near_reviews(s, d, k=3).select("rv_partkey").distinct(), F.col("k") == F.col("rv_partkey"), "left_semi").select("bad").distinct()
    p = read(s, d, "part").where("p_brand <> 'Brand#45' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)")
    j = pairs.join(p, F.col("p_partkey") == F.col("ps_partkey")).join(bad, F.col("ps_suppkey") == F.col("bad"), "left_anti")
    return j.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("ps_suppkey").alias("supplier_cnt"))


_Q18 = f"SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {QTY} AS total_qty, CAST(SUM(CASE WHEN l_partkey IN (SELECT i_partkey FROM {{}}) THEN qty ELSE 0 END) AS DOUBLE) / 100 AS similar_qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN li ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM li GROUP BY 1 HAVING sum(qty) > 15000) GROUP BY ALL ORDER BY similar_qty DESC, o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100"


def _large_orders(s, d, near):
    near = near.select(F.col("i_partkey").alias("pk")).distinct().withColumn("hit", F.lit(True))
    # lines are summed by order before anything is joined, in one pass for both sums
    g = lineitem(s, d).join(near, F.col("l_partkey") == F.col("pk"), "left").groupBy("l_orderkey").agg(F.sum("qty").alias("t"), F.sum(F.when(F.col("hit"), F.col("qty")).otherwise(0)).alias("n")).where("t > 15000")
    j = read(s, d, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey")).join(read(s, d, "customer", "c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    out = j.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", (F.col("t").cast("double") / 100).alias("total_qty"), (F.col("n").cast("double") / 100).alias("similar_qty"))
    return out.orderBy(F.desc("similar_qty"), F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


@query("vech_q18_mid", W + _Q18.format("ni JOIN images ON id = i_imagekey"))
def _(s, d):
    return _large_orders(s, d, near_images(s, d, cond=F.col("i_variant") == "MAIN"))


@query("vech_q18_mid_ranged", f"WITH {CTES} " + _Q18.format("images, qs WHERE qid = 0 AND i_variant = 'MAIN' AND list_sum(list_transform(list_zip(i_embedding, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) < 1.4"))
def _(s, d):
    return _large_orders(s, d, V.knn_join(images(s, d), queries_(s, d, "qid = 0"), "i_imagekey", "qid", "i_embedding", "qv", radius=1.4, where=F.col("i_variant") == "MAIN"))


_Q19 = "(p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)"


@query("vech_q19_start", W + f"SELECT {AMOUNT} AS revenue FROM li JOIN part ON p_partkey = l_partkey WHERE {_Q19} OR (p_partkey IN (SELECT rv_partkey FROM nr JOIN reviews ON id = rv_reviewkey) AND l_quantity BETWEEN 30 AND 40) OR (p_partkey IN (SELECT i_partkey FROM ni JOIN images ON id = i_imagekey) AND l_quantity BETWEEN 40 AND 50)")
def _(s, d):
    rv = near_reviews(s, d).select(F.col("rv_partkey").alias("rk")).distinct()
    im = near_images(s, d, cond=F.col("i_variant") == "MAIN").select(F.col("i_partkey").alias("ik")).distinct()
    p = read(s, d, "part").join(rv, F.col("p_partkey") == F.col("rk"), "left").join(im, F.col("p_partkey") == F.col("ik"), "left")
    p = p.where("p_brand in ('Brand#12', 'Brand#23', 'Brand#34') or rk is not null or ik is not null")
    j = lineitem(s, d).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.where(f"{_Q19} OR (rk IS NOT NULL AND l_quantity BETWEEN 30 AND 40) OR (ik IS NOT NULL AND l_quantity BETWEEN 40 AND 50)").agg(amount())


@query("vech_q_test", f"WITH {CTES} " + _top("reviews JOIN part ON rv_partkey = p_partkey", "rv_reviewkey", "rv_embedding", "qid = 0 AND p_size > 30 AND rv_partkey < 100000", metric="IP"))
def _(s, d):
    p = read(s, d, "part", "p_partkey", "p_size").where("p_size > 30")
    r = reviews(s, d).where("rv_partkey < 100000").join(p, F.col("rv_partkey") == F.col("p_partkey"))
    return _out(V.knn_join(r, queries_(s, d, "qid = 0"), "rv_reviewkey", "qid", "rv_embedding", "qv", K, metric="IP"), "rv_reviewkey")
