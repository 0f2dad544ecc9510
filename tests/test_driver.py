"""Every registered query against its SQL twin on the smallest driver tables."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as contract
from waxgraph.sources import xml_dumps

SF_DIR = Path("/root/testdata/sf0.001")
ORACLES = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rounded(rows):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    found = contract.queries()[name](spark, str(SF_DIR))
    answer = duck.execute(ORACLES[name])
    columns = sorted(column[0] for column in answer.description)
    assert sorted(found.columns) == columns
    order = [[column[0] for column in answer.description].index(c) for c in columns]
    want = rounded([tuple(row[i] for i in order) for row in answer.fetchall()])
    assert rounded(map(tuple, found.select(*[f"`{c}`" for c in columns]).collect())) == want


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {row.kind for row in rows} == {"Artist", "Group", "Release", "Label"}
    assert [row.degree for row in rows if row.kind == "Label"] == sorted(
        (row.degree for row in rows if row.kind == "Label"), reverse=True
    )


def test_audit_has_one_row_per_file(spark):
    row = xml_dumps.audit(spark.read.parquet(f"{SF_DIR}/lineitem.parquet")).first()
    assert row.file == "lineitem.parquet" and row.rows == 6000 and row.bytes > 0
