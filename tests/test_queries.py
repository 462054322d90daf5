"""Every table query against DuckDB at the smallest scale, and the flagship."""

import duckdb
import pytest

from quillon import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return [cols[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cur = duck.execute(queries.ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_flagship(spark):
    f = queries.flagship(spark, DIR)
    got = f.collect()
    assert len({x.family for x in got}) >= 4 and [(x.file.split("/"), x.code) for x in got] == sorted((x.file.split("/"), x.code) for x in got)


def test_plans_keep_pushdown_and_broadcasts(spark):
    """Filters and columns reach the scan, and rules add no shuffle."""
    plan = queries.QUERIES["q_ref_integrity"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan and "LessThanOrEqual(p_size,40)" in plan
    plan = queries.QUERIES["q_rule_in"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
