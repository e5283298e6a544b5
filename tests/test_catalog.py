from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, queries
from cairnlake.plans.text_catalog import QUERIES
from cairnlake.plans.text_oracles import ORACLES
from check_queries import rows_of

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the analytics tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_of_the_catalog_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, db, name):
    columns, got = rows_of(queries()[name](spark, str(FOLDER)).toPandas())
    expected_columns, expected = rows_of(db.sql(ORACLES[name]).df())
    assert columns == expected_columns
    assert got == expected
    assert got
