import pytest

from quern.plans import registry
from tests.parity import connection, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck_rows(duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_retrieval_plan_is_an_equality_join(spark):
    plan = registry.QUERIES["r02_answer_retrieval"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
