"""The 22 TPC-H queries on tables with all columns, made here, against DuckDB."""

from decimal import Decimal

import duckdb
import pytest

from veldt.plans import tpch
from veldt.session import Session

#: Fixed by the benchmark: nations in the order of their keys, with their regions.
NATIONS = "ALGERIA 0,ARGENTINA 1,BRAZIL 1,CANADA 1,EGYPT 4,ETHIOPIA 0,FRANCE 3,GERMANY 3,INDIA 2,INDONESIA 2,IRAN 4,IRAQ 4,JAPAN 2,JORDAN 4,KENYA 0,MOROCCO 0,MOZAMBIQUE 0,PERU 1,CHINA 2,ROMANIA 3,SAUDI ARABIA 4,VIETNAM 2,RUSSIA 3,UNITED KINGDOM 3,UNITED STATES 1"
REGIONS = "AFRICA,AMERICA,ASIA,EUROPE,MIDDLE EAST"


def made(con):
    """Values by hashes of the keys; few sizes, types, brands and containers, so that every query finds rows."""
    con.execute("CREATE MACRO r(a, b, n) AS CAST(hash(a * 1000003 + b) % n AS INTEGER)")
    con.execute("CREATE MACRO pick(a, b, t) AS string_split(t, ',')[r(a, b, len(string_split(t, ','))) + 1]")
    con.execute("CREATE MACRO money(a, b, low, n) AS CAST((low * 100 + r(a, b, n * 100)) / 100.0 AS DECIMAL(15,2))")
    con.execute("CREATE MACRO phone(k, n) AS (10 + n) || '-555-' || r(k, 9, 9000)")
    con.execute(f"CREATE TABLE region AS SELECT i AS r_regionkey, string_split('{REGIONS}', ',')[i + 1] AS r_name, 'x' AS r_comment FROM range(5) t(i)")
    con.execute(f"CREATE TABLE nation AS SELECT i AS n_nationkey, regexp_replace(string_split('{NATIONS}', ',')[i + 1], ' [0-9]$', '') AS n_name, CAST(right(string_split('{NATIONS}', ',')[i + 1], 1) AS INTEGER) AS n_regionkey, 'x' AS n_comment FROM range(25) t(i)")
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, 'Supplier#' || i AS s_name, 'street ' || r(i, 1, 99) AS s_address, i % 25 AS s_nationkey, phone(i, i % 25) AS s_phone, money(i, 2, -999, 9999) AS s_acctbal, CASE WHEN i % 9 = 0 THEN 'slow Customer with Complaints' ELSE 'fine' END AS s_comment FROM range(1, 51) t(i)")
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, pick(i, 1, 'forest,green,blue') || ' ' || pick(i, 2, 'green,azure') AS p_name, 'Manufacturer#' || (1 + r(i, 3, 5)) AS p_mfgr, 'Brand#' || pick(i, 4, '12,23,34,45') AS p_brand, pick(i, 5, 'STANDARD,PROMO,ECONOMY,MEDIUM') || ' ' || pick(i, 6, 'POLISHED,ANODIZED') || ' ' || pick(i, 7, 'BRASS,STEEL') AS p_type, CAST(pick(i, 8, '15,23,5,9,3,14,49,2') AS INTEGER) AS p_size, pick(i, 9, 'SM CASE,MED BOX,MED BAG,LG BOX') AS p_container, money(i, 10, 900, 1000) AS p_retailprice, 'x' AS p_comment FROM range(1, 241) t(i)")
    con.execute("CREATE TABLE partsupp AS SELECT i AS ps_partkey, 1 + (i + 13 * j) % 50 AS ps_suppkey, 1 + r(i, j, 999) AS ps_availqty, money(i, 20 + j, 1, 1000) AS ps_supplycost, 'x' AS ps_comment FROM range(1, 241) t(i), range(4) u(j)")
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 'Customer#' || i AS c_name, 'road ' || r(i, 1, 99) AS c_address, i % 25 AS c_nationkey, phone(i, i % 25) AS c_phone, money(i, 2, -999, 9999) AS c_acctbal, pick(i, 3, 'BUILDING,MACHINERY,FURNITURE') AS c_mktsegment, 'x' AS c_comment FROM range(1, 301) t(i)")
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, 3 * r(i, 1, 100) + 1 + r(i, 2, 2) AS o_custkey, pick(i, 3, 'F,O,P') AS o_orderstatus, money(i, 4, 1000, 200000) AS o_totalprice, DATE '1992-01-01' + r(i, 5, 2400) AS o_orderdate, pick(i, 6, '1-URGENT,2-HIGH,3-MEDIUM,4-NOT SPECIFIED,5-LOW') AS o_orderpriority, 'Clerk#' || r(i, 7, 9) AS o_clerk, 0 AS o_shippriority, pick(i, 8, 'quick special plain requests,none,special,requests') AS o_comment FROM range(1, 3001) t(i)")
    con.execute("CREATE TABLE lineitem AS SELECT *, s_date + 1 + r(l_orderkey, 90 + l_linenumber, 30) AS l_receiptdate FROM (SELECT o_orderkey AS l_orderkey, p AS l_partkey, 1 + (p + 13 * r(o_orderkey, 30 + j, 4)) % 50 AS l_suppkey, CAST(j AS INTEGER) AS l_linenumber, CAST(CASE WHEN o_orderkey % 20 = 0 THEN 45 + r(o_orderkey, 40 + j, 6) ELSE 1 + r(o_orderkey, 40 + j, 50) END AS DECIMAL(15,2)) AS l_quantity, money(o_orderkey, 50 + j, 900, 50000) AS l_extendedprice, CAST(r(o_orderkey, 60 + j, 11) / 100.0 AS DECIMAL(15,2)) AS l_discount, CAST(r(o_orderkey, 70 + j, 9) / 100.0 AS DECIMAL(15,2)) AS l_tax, pick(o_orderkey, 80 + j, 'R,A,N') AS l_returnflag, pick(o_orderkey, 81 + j, 'O,F') AS l_linestatus, o_orderdate + 1 + r(o_orderkey, 100 + j, 121) AS s_date, o_orderdate + 30 + r(o_orderkey, 110 + j, 61) AS l_commitdate, pick(o_orderkey, 120 + j, 'DELIVER IN PERSON,NONE') AS l_shipinstruct, pick(o_orderkey, 130 + j, 'MAIL,SHIP,AIR,AIR REG') AS l_shipmode, 'x' AS l_comment FROM (SELECT *, 1 + r(o_orderkey, 20 + j, 240) AS p FROM orders, range(1, 9) u(j) WHERE j <= 1 + r(o_orderkey, 10, 8)) x) y")
    con.execute("ALTER TABLE lineitem RENAME s_date TO l_shipdate")


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    con, folder = duckdb.connect(), tmp_path_factory.mktemp("tpch")
    made(con)
    s = Session(spark, None)
    names = s.create_tables(tpch.SCHEMA)
    for t in names:
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    s = Session(spark, str(folder), s.schemas)
    held = {r.name for r in spark.catalog.listTables()}
    for t in names:
        s.load_table(t)
    yield s, con
    for t in set(names) - held:
        spark.catalog.dropTempView(t)


def value(x):
    return float(x) if isinstance(x, (Decimal, int)) else x


@pytest.mark.parametrize("name", list(tpch.TEXTS))
def test_query(both, name):
    s, con = both
    got = tpch.query(s.spark, name)
    want = con.execute(tpch.TEXTS[name])
    assert got.columns == [c[0] for c in want.description]
    a, b = ([tuple(map(value, r)) for r in rows] for rows in (got.collect(), want.fetchall()))
    assert len(a) == len(b) > 0 and all(x is not None for x in a[0])
    for r, w in zip(a, b, strict=True):
        assert all(x == pytest.approx(y, rel=1e-6, abs=1e-6) if isinstance(x, float) else x == y for x, y in zip(r, w, strict=True)), (r, w)
