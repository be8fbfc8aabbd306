"""Every query against its SQL on the smallest tables, and its plan."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = entry.SMALL


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = df.toPandas()
    if name in entry.oracle_sql():
        assert compare(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "category", "provider", "model", "prompt", "body"]
    assert df.count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["module_scope"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "EqualTo(lang,fr)" in plan and "text" not in plan.split("ReadSchema")[-1]
    plan = entry.queries()["search_tasks"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ts:" not in plan.split("ReadSchema")[-1]


def test_calls_take_one_pass_over_the_lines(spark):
    from workload import data

    found = data.calls(spark, entry.SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Lines are looked up by their length where they are, not shuffled by it.
    assert sum("text:string" in line for line in plan.splitlines() if "ReadSchema" in line) == 1
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    lines, last = data.method_rows(spark, entry.SMALL).count(), data.documents(spark, entry.SMALL).where("text is not null").count()
    assert found.count() == 2 * lines - last
