"""Registered queries against their SQL on the smallest tables, and what their plans may hold."""

import math
import os

import duckdb
import pytest

from preflens.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = (
    "ranking_report rating_report auc timestamp_split neg_per_positive cooccurrence sar_topk diversity doc_topk "
    "dot_score_topk edge_split target_encode next_item_rows libffm"
).split()
NAMES = list(registry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-6))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    text = registry.oracle_sql().get(name)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    if text is None:
        return
    expected = con.execute(text)
    assert columns == sorted(d[0] for d in expected.description)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(con.execute(f"SELECT {quoted} FROM ({text})").fetchall(), key=repr)
    assert len(rows) == len(want)
    assert all(same(a, b) for x, y in zip(rows, want) for a, b in zip(x, y))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["ranking_report", "sar_scores", "serendipity", "target_encode"])
def test_plan(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "Join Cross" not in plan and "Join Inner\n" not in plan


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert fixtures.sql("SELECT 1") == "SELECT 1"
