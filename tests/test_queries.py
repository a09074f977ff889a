"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from vellumine.plans.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    relation = duck.sql(oracle_sql()[name])
    want = rows(relation.columns, relation.fetchall())
    assert got == want


def test_plans(spark):
    """One shuffle where rows must meet, none where a document is enough."""

    def plan(name):
        return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    for name in ("text_to_markdown", "heading_levels", "dehyphenate_paragraphs", "flate_roundtrip", "image_links"):
        assert "Exchange" not in plan(name), name
    # small texts are dealt to all cores before files are made of them; decoding them needs no more
    assert plan("pdf_roundtrip_text").count("Exchange") == plan("pdf_roundtrip_text").count("Exchange RoundRobinPartitioning") == 1
    assert plan("weighted_median_size").count("Exchange hashpartitioning") <= 2
    assert "ReadSchema: struct<event_type:string,value:double>" in plan("x_histogram")
