import __spark_entry__ as entry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_eligible_plans_scan_two_columns(spark, sf):
    plan = entry.queries()["s1_table_scan"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
