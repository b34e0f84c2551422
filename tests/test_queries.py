"""Every query of the catalogue against its DuckDB statement."""

import pytest
from pyspark.sql import functions as F
from oracle import connect, differences

from tidemark.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 247
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_children_are_exchanged_once_and_distinct_where_wanted(spark):
    """Rows shown in two lists are one row, in numeric order; equal children stand once in the lists that want it. Before, each list had rows of its own."""
    from tidemark.plans.pages import with_children

    parents = spark.createDataFrame([(1,), (2,)], "k long")
    rows = spark.createDataFrame([(1, 10), (1, 9), (1, 100), (1, 9), (1, None)], "k long, n long")
    n = F.coalesce(F.col("n").cast("string"), F.lit(""))
    out = with_children(parents, "k", {("a", "b"): (rows, ["n"], [n, F.concat(F.lit("x"), n)]), "c": (rows, ["n"], n)}, once=("c",))
    assert sorted(map(tuple, out.collect())) == [(1, ["", "9", "9", "10", "100"], ["x", "x9", "x9", "x10", "x100"], ["", "9", "10", "100"]), (2, [], [], [])]


def test_zero_filled_share_works_its_facts_out_once(spark):
    """Null groups and parts as a join would have them; the rows of the facts are made once, before they were made three times."""
    from tidemark.operators.relational import zero_filled_share

    made = spark.sparkContext.accumulator(0)
    one = F.udf(lambda v: made.add(1) or v, "long")
    rows = [("x", "a", 1), ("x", "b", 3), ("y", "a", 5), (None, "a", 7), ("y", None, 9), ("z", "b", 0)]
    facts = spark.createDataFrame(rows, "g string, p string, v long").withColumn("v", one("v"))
    got = {tuple(r) for r in zero_filled_share(facts, "g", "p", "v").collect()}
    assert got == {("x", "a", 1, 25.0), ("x", "b", 3, 75.0), ("y", "a", 5, 100.0), ("y", "b", 0, 0.0), ("z", "a", 0, 0.0), ("z", "b", 0, 0.0), (None, "a", 0, 0.0), (None, "b", 0, 0.0)}
    assert made.value == len(rows)
