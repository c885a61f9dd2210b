"""Every registered query against its SQL, and its plan against what must not be in one."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries
from queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name, capsys):
    df = QUERIES[name](spark, sf)
    got = oracle.spark_rows(df)
    assert oracle.difference(got, oracle.sql_rows(duck, ORACLES[name])) is None
    df.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "PythonUDF" not in plan


def test_entry(spark):
    assert entry(spark).count() > 30


def test_registries_agree():
    assert set(ORACLES) == set(QUERIES) <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())
