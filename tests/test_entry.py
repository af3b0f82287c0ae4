"""The driver's contract."""

import __spark_entry__


def test_registry():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 48
    assert all(callable(f) for f in queries.values()) and all(isinstance(s, str) for s in oracles.values())
