"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    other = duck.sql(registry.SQL[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in other.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_closure_ends_in_orders(spark):
    ends = registry.QUERIES["rule_closure"](spark, SF).where("b LIKE 'orders:%'")
    assert {r.kind for r in ends.selectExpr("split(a, ':')[0] AS kind").distinct().collect()} == {"region", "nation", "customer", "part"}


def test_stale_below_every_drifted_node(spark):
    found = registry.QUERIES["check_upstream_stale"](spark, SF)
    drifted = registry.QUERIES["check_silent_drift"](spark, SF).selectExpr("node_id AS up")
    below = registry._deps(spark, SF).join(drifted, "up").selectExpr("down AS id").join(registry.t.nodes(spark, SF).where("status NOT IN ('deprecated', 'planned')"), "id", "left_semi")
    assert found.where("detail LIKE 'customer:%'").count() > 0
    assert below.join(found.selectExpr("node_id AS id"), "id", "left_anti").count() == 0


def test_change_adds_all_customers(spark):
    added = registry.QUERIES["graph_change_apply"](spark, SF).where("note = 'added'")
    assert added.count() == registry.t.table(spark, SF, "customer").count()
