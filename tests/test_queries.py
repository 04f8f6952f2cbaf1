import pytest

from foldlight.plans import journal_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_agrees_with_its_sql(spark, duck, rows, name):
    found, wanted = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from foldlight.sources.projection import journal

    plan = journal(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double,props:string>" in plan
