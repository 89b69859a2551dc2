"""Every registered query gives the rows of its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    if isinstance(value, float):
        return repr(value)
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_twin(spark, twin, name):
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted([tuple(shown(r[c]) for c in columns) for r in df.collect()], key=repr)
    cursor = twin.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([tuple(shown(r[i]) for i in at) for r in cursor.fetchall()], key=repr)
