"""Every query with an oracle matches DuckDB on sf0.01 (rows, columns, values)."""

import hashlib
import json
import math

import pytest

from ledgerlens.plans.catalog import QUERIES as CATALOG

SQL = {name: q.sql for name, q in CATALOG.items() if q.sql is not None}
QUERIES = {name: q.build for name, q in CATALOG.items()}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return v if isinstance(v, (int, str, bool)) else str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


def test_every_query_registered_with_docs():
    assert len(QUERIES) >= 60
    for name, fn in QUERIES.items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    from conftest import SF_ORACLE
    df = QUERIES[name](spark, SF_ORACLE)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)
