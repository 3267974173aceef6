"""Registered queries against their SQL on the smallest tables."""

import math

import pytest

from conftest import SF_SMALL
from ledgerlens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_sql(spark, name):
    import duckdb

    from ledgerlens.sources.tables import TABLES
    build, sql = QUERIES[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = build(spark, SF_SMALL)
    want = con.execute(sql)
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]

    def line(row):
        return tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in row)
    assert sorted(map(repr, map(line, got.select(*names).collect()))) == sorted(map(repr, map(line, want.fetchall())))


def test_one_query_per_operator_and_native_plans(spark):
    from ledgerlens.llm.queries import QUERIES as Q
    assert sorted(int(n[2:].split("_")[0]) for n in Q) == list(range(1, 14))
    for n in ("op1_", "op4_", "op7_", "op8_"):
        name = next(k for k in Q if k.startswith(n))
        plan = Q[name][0](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
