"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from check_oracle import TABLES, compare

from tideline.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
# A measure that SQL lacks, compared with the rule in tests/test_neardup.py.
WITHOUT_TWIN = ("near_dup_matching_blocks",)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, rows, _, note = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert ok or name in WITHOUT_TWIN, note or "no SQL twin"
    assert not note, note
    assert rows >= 0
