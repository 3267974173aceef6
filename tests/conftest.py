import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import build_session, remove_scratch
    s = build_session("local[*]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ll-test-ckpt-", dir="/tmp")})
    yield s
    remove_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from ledgerlens.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


def grid_df(spark, rows, file_id="f.xlsx", sheet="S"):
    """Grid DataFrame from a list of rows (lists of cells, None = empty)."""
    data = [(file_id, 0, sheet, i, list(r)) for i, r in enumerate(rows) if r is not None]
    return spark.createDataFrame(data, "file_id string, sheet_pos int, sheet string, row_idx bigint, "
                                       "cells array<string>")
