import __spark_entry__


def test_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert __spark_entry__.entry(spark).limit(1).count() == 1
