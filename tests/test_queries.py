"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewell.queries import core, sections, sheets  # noqa: F401 - sheets and sections add their queries to core's

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v).removesuffix(" 00:00:00")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_same_rows_as_sql(spark, sql, name):
    got = core.QUERIES[name](spark, SF)
    exp = sql.execute(core.SQL[name])
    names = [d[0] for d in exp.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, exp.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_growth_scan_is_pruned(spark):
    plan = core.QUERIES["growth_yoy"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "c_acctbal" not in plan and "Python" not in plan


def test_number_format_all_has_every_order(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert core.QUERIES["number_format_all"](spark, SF).select("o_orderkey").exceptAll(orders.select("o_orderkey")).isEmpty()
    assert core.QUERIES["number_format_all"](spark, SF).count() == orders.count()
