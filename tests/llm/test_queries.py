"""The operators' queries against their SQL on the smallest tables, and that nothing else needs them."""

import os
import re
from pathlib import Path

import duckdb
import pytest

from tests.test_queries import SF, TABLES, rows
from vellumine.llm import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    relation = con.sql(catalog.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {m[0] for q in names if (m := re.match(r"op\d+", q))} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_nothing_else_imports_it():
    root = Path(__file__).parents[2]
    for path in (root / "vellumine").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
