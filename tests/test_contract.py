import __spark_entry__ as contract


def test_registry():
    queries, twins = contract.queries(), contract.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 90 and len(twins) > 75


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r["label"] for r in rows] == sorted(r["label"] for r in rows) and abs(sum(r["pct"] for r in rows) - 100) < 0.1
