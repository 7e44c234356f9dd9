"""The registered queries against their SQL, and without SQL that they give a row for each row of their table."""

import os

import pytest

from tests.compare import compare, connect
from tidewater.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    compare(spark, connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_row_for_row(spark, name):
    ids = [r[0] for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
