"""One query for each relational operator, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import exprs as E
from veldt.functions.aggs import aggregate as agg
from veldt.operators import dataset
from veldt.operators import relational as R

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def read(spark, d, name, *cols):
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add




@query("scan_parquet", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    return read(s, d, "nation", "n_nationkey", "n_name")


@query("scan_filter_project", "SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity < 5 AND l_shipdate >= DATE '1997-01-01'")
def _(s, d):
    return read(s, d, "lineitem").where((F.col("l_quantity") < 5) & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("date"))).select("l_orderkey", (F.col("l_quantity") * 2).alias("twice"))


@query("union_gather", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(s, d):
    return R.gather([R.rename(read(s, d, "customer"), ["c_nationkey"], ["k"]), R.rename(read(s, d, "supplier"), ["s_nationkey"], ["k"])])


@query("filter_null", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN n_chars > 2000 THEN n_chars END AS n FROM documents) x WHERE n IS NOT NULL")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, F.col("n_chars")).alias("n")).where(F.col("n").isNotNull()).select("doc_id")


@query("project_expr", "SELECT p_partkey, p_size * p_size * 2 AS v, abs(p_size - 20) AS a FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", E.product(["p_size", "p_size", F.lit(2)]).alias("v"), F.abs(F.col("p_size") - 20).alias("a"))


@query("rename_drop", "SELECT r_regionkey AS k, r_name AS n FROM region")
def _(s, d):
    return R.rename(read(s, d, "region"), ["r_regionkey", "r_name"], ["k", "n"])


@query("like_match", "SELECT p_partkey FROM part WHERE p_name LIKE '%red%'")
def _(s, d):
    return read(s, d, "part").where(E.like("p_name", "%red%")).select("p_partkey")


@query("starts_ends", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'small') OR suffix(p_name, 'widget')")
def _(s, d):
    return read(s, d, "part").where(E.any_of([E.starts_with("p_name", "small"), E.ends_with("p_name", "widget")])).select("p_partkey")


@query("in_range_between", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice BETWEEN 900 AND 1000 AND p_brand NOT IN ('Brand#1', 'Brand#2') AND p_type IN ('PROMO', 'SMALL')")
def _(s, d):
    return read(s, d, "part").where(E.all_of([E.in_range("p_size", 10, 20), E.between("p_retailprice", 900, 1000), E.not_in("p_brand", ["Brand#1", "Brand#2"]), E.is_in("p_type", ["PROMO", "SMALL"])])).select("p_partkey")


@query("if_else_sum", "SELECT sum(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END)::BIGINT AS n FROM part")
def _(s, d):
    return read(s, d, "part").agg(F.sum(E.if_else(F.col("p_type") == "PROMO", 1, 0)).alias("n"))


@query("choose_bucket", "SELECT vec_id, (['a','b','c'])[label + 1] AS bucket FROM embeddings WHERE label < 3")
def _(s, d):
    return read(s, d, "embeddings").where("label < 3").select("vec_id", E.choose("label", [F.lit(x) for x in "abc"]).alias("bucket"))


@query("substring_len", "SELECT c_custkey, substring(c_name, 2, 4) AS s, length(c_name)::INT AS n, regexp_extract(c_name, '#0*([0-9]+)', 1) AS num FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", E.substring0("c_name", 1, 5).alias("s"), E.length("c_name").alias("n"), E.extract("c_name", "#0*([0-9]+)", ["num"])["num"].alias("num"))


@query("year_minute", "SELECT event_id, year(ts) AS y, minute(ts) AS m FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", E.year("ts").alias("y"), E.minute("ts").alias("m"))


@query("math_bitwise", "SELECT p_partkey, round(sqrt(p_size), 9) AS r, round(exp(p_size / 50.0::DOUBLE), 9) AS e, p_size & 5 AS a, p_size | 5 AS o, xor(p_size, 5) AS x, ~p_size AS n, CASE WHEN p_size % 10 <> 0 THEN p_size::DOUBLE / (p_size % 10) END AS q FROM part")
def _(s, d):
    n = F.col("p_size")
    return read(s, d, "part").select("p_partkey", F.round(F.sqrt(n), 9).alias("r"), F.round(F.exp(n / 50.0), 9).alias("e"), n.bitwiseAND(5).alias("a"), n.bitwiseOR(5).alias("o"), n.bitwiseXOR(5).alias("x"), F.bitwise_not(n).alias("n"), E.divide(n.cast("double"), n % 10).alias("q"))


# whole tables; the customers' keys are shifted and some are null, so that both sides have rows without a match
_CUST = "SELECT CASE WHEN c_nationkey <> 3 THEN c_custkey + 100 END AS ck, c_name FROM customer"


def _customers(s, d):
    return read(s, d, "customer").select(F.when(F.col("c_nationkey") != 3, F.col("c_custkey") + 100).alias("ck"), "c_name")


for kind, sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}.items():
    QUERIES[f"join_{kind}"] = lambda s, d, kind=kind: R.join(_customers(s, d), read(s, d, "orders", "o_orderkey", "o_custkey"), kind, ["ck"], ["o_custkey"])
    ORACLE_SQL[f"join_{kind}"] = f"SELECT * FROM ({_CUST}) a {sql} (SELECT o_orderkey, o_custkey FROM orders) b ON ck = o_custkey"
for kind, sql in {"left_semi": "EXISTS", "left_anti": "NOT EXISTS"}.items():
    QUERIES[f"join_{kind[5:]}"] = lambda s, d, kind=kind: R.join(_customers(s, d), read(s, d, "orders"), kind, ["ck"], ["o_custkey"])
    ORACLE_SQL[f"join_{kind[5:]}"] = f"SELECT ck, c_name FROM ({_CUST}) a WHERE {sql} (SELECT 1 FROM orders WHERE o_custkey = ck)"
    QUERIES[f"join_right_{kind[5:]}"] = lambda s, d, kind=kind: R.join(_customers(s, d), read(s, d, "orders", "o_orderkey", "o_custkey"), "right" + kind[4:], ["ck"], ["o_custkey"])
    ORACLE_SQL[f"join_right_{kind[5:]}"] = f"SELECT o_orderkey, o_custkey FROM orders WHERE {sql} (SELECT 1 FROM ({_CUST}) a WHERE ck = o_custkey)"


@query("join_suffixes", "SELECT a.n_nationkey AS n_nationkey_l, a.n_name AS n_name_l, b.n_nationkey AS n_nationkey_r, b.n_name AS n_name_r, a.n_regionkey AS n_regionkey_l, b.n_regionkey AS n_regionkey_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(s, d):
    n = read(s, d, "nation")
    return R.join(n, n, "inner", ["n_regionkey"], ["n_regionkey"], residual=lambda a, b: a["n_nationkey_l"] < b["n_nationkey_r"])


@query("join_cross_scalar", "SELECT s_suppkey FROM supplier, (SELECT sum(s_acctbal::DECIMAL(15,2)) / count(*) AS a FROM supplier) x WHERE s_acctbal > a")
def _(s, d):
    sup = read(s, d, "supplier")
    mean = sup.agg((F.sum(F.col("s_acctbal").cast("decimal(15,2)")).cast("double") / F.count(F.lit(1))).alias("a"))
    return R.join(sup, mean, "cross", [], []).where("s_acctbal > a").select("s_suppkey")


@query("join_null_safe", "SELECT a.k, count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT nullif(n_nationkey, 3) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k")
def _(s, d):
    a = read(s, d, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = read(s, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("k"))
    return R.join(a, b, "inner", ["k"], ["k"], null_safe=True).groupBy(F.col("k_l").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("take_gather", "SELECT n_nationkey, n_name, n_regionkey, s_suppkey, s_name, s_acctbal FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def _(s, d):
    return R.take(read(s, d, "nation"), read(s, d, "supplier"), "n_nationkey", "s_nationkey")


@query("agg_keyed", "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS s, count(*) AS n, min(o_totalprice) AS lo, max(o_orderdate) AS hi, count(o_custkey) AS v FROM orders GROUP BY o_orderstatus")
def _(s, d):
    return read(s, d, "orders").groupBy("o_orderstatus").agg(agg("sum", "o_custkey", "s"), agg("count_all", alias="n"), agg("min", "o_totalprice", "lo"), agg("max", "o_orderdate", "hi"), agg("count_valid", "o_custkey", "v"))


@query("agg_scalar", "SELECT sum(CASE WHEN l_quantity < 0 THEN 1 END)::BIGINT AS nothing, count(*) AS n, sum(l_linenumber)::DOUBLE / count(*) AS m FROM lineitem")
def _(s, d):
    return read(s, d, "lineitem").agg(F.sum(F.when(F.col("l_quantity") < 0, 1)).alias("nothing"), agg("count_all", alias="n"), agg("mean", "l_linenumber", "m"))


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(agg("count_distinct", "l_partkey", "n"))


@query("agg_stddev_median", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, median(l_quantity) AS med FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(agg("stddev", "l_quantity"), 6).alias("sd"), agg("median", "l_quantity", "med"))


@query("agg_corr2", "SELECT l_linenumber, round(power(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY l_linenumber")
def _(s, d):
    return read(s, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.corr("l_quantity", "l_extendedprice") ** 2, 6).alias("r2"))


@query("agg_collect_list", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
def _(s, d):
    return read(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(agg("list", "n_name")), ",").alias("names"))


@query("agg_one", "SELECT n_regionkey, min(n_name) AS n FROM nation GROUP BY n_regionkey")
def _(s, d):
    return read(s, d, "nation").groupBy("n_regionkey").agg(agg("one", "n_name", "n"))


@query("distinct_keys", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(s, d):
    return R.distinct(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("sort_null_order", "SELECT p_partkey, k, row_number() OVER (ORDER BY k DESC NULLS FIRST, p_partkey) - 1 AS place FROM (SELECT p_partkey, nullif(p_size, 7) AS k FROM part) x")
def _(s, d):
    # the whole table in order; places number the sorted rows range by range
    return dataset.ranked(read(s, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("k")), R.sort_keys([("k", "desc"), ("p_partkey", "asc")]), "place")


@query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def _(s, d):
    return R.limit(R.order_by(read(s, d, "orders", "o_orderkey"), [("o_orderkey", "asc")]), 10, 25)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def _(s, d):
    return R.top_k(read(s, d, "orders", "o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 15)


@query("top_k_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _(s, d):
    return R.limit_per_group(read(s, d, "orders"), ["o_custkey"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 2).select("o_custkey", "o_orderkey")


@query("scatter_count", "SELECT l_linenumber AS port, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def _(s, d):
    ports = R.scatter(read(s, d, "lineitem", "l_linenumber"), "l_linenumber", 7)
    return R.gather([p.groupBy(F.col("l_linenumber").alias("port")).agg(F.count(F.lit(1)).alias("n")) for p in ports])


@query("order_limit_per_partition", "SELECT n_regionkey, n_nationkey FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) <= 3")
def _(s, d):
    return R.limit_per_group(read(s, d, "nation"), ["n_regionkey"], [("n_name", "desc")], 3).select("n_regionkey", "n_nationkey")


for name, f, sql in (
    ("math_functions", lambda x: [F.sin(x), F.cos(x), F.tan(x), F.asin(x / 100), F.acos(x / 100), F.atan(x), F.log(x), F.ceil(x / 3).cast("double"), F.floor(x / 3).cast("double")], "sin({x}), cos({x}), tan({x}), asin({x} / 100), acos({x} / 100), atan({x}), ln({x}), ceil({x} / 3), floor({x} / 3)"),
    ("round_half_even", lambda x: [F.rint(x / 2), F.rint(-x / 2)], "round_even({x} / 2, 0), round_even(-{x} / 2, 0)"),
):
    parts = sql.format(x="p_size::DOUBLE").split("), ")
    parts = [p if p.endswith(")") else p + ")" for p in parts]
    QUERIES[name] = lambda s, d, f=f: read(s, d, "part").select("p_partkey", *[F.round(c, 9).alias(f"v{i}") for i, c in enumerate(f(F.col("p_size").cast("double")))])
    ORACLE_SQL[name] = "SELECT p_partkey, " + ", ".join(f"round({p}, 9) AS v{i}" for i, p in enumerate(parts)) + " FROM part"


@query("cast_safe", "SELECT p_partkey, p_size::SMALLINT AS s, p_size::DOUBLE AS f, p_partkey::VARCHAR AS t, (p_retailprice::DECIMAL(15,2))::VARCHAR AS m, TRY_CAST(p_name AS INT) AS n FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", F.col("p_size").cast("smallint").alias("s"), F.col("p_size").cast("double").alias("f"), F.col("p_partkey").cast("string").alias("t"), F.col("p_retailprice").cast("decimal(15,2)").cast("string").alias("m"), F.col("p_name").try_cast("int").alias("n"))


@query("table_helpers", "SELECT n_nationkey AS k, 7 AS seven, n_nationkey * 2 AS twice FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3")
def _(s, d):
    n = read(s, d, "nation").withColumn("seven", F.lit(7)).withColumn("twice", F.col("n_nationkey") * 2).drop("n_name", "n_regionkey")
    return R.limit(R.order_by(n, [("n_nationkey", "asc")]), 5, 3).withColumnRenamed("n_nationkey", "k")


@query("distinct_keep_all", "SELECT l_returnflag, count(*) > 0 AS one FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    return R.distinct(read(s, d, "lineitem"), ["l_returnflag"], keep_all=True).select("l_returnflag", F.col("l_orderkey").isNotNull().alias("one"))
