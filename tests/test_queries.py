"""Every library query that has SQL gives the rows that DuckDB gives."""

import os

import compare
import pytest

from colorjobs.plans import case_queries as queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.SQL:
        assert compare.differences(df, con, queries.SQL[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_resolve_palette_takes_near_targets(spark):
    near = {(r.file, r.hex): r.target for r in queries.QUERIES["suggest"](spark, SF).where("kind = 'near'").collect()}
    got = {(r.file, r.hex): r.target for r in queries.QUERIES["resolve_palette"](spark, SF).collect()}
    assert near and all(got[k] == target for k, target in near.items())
