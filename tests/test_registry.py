"""The registered queries and their SQL belong together."""

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert all(callable(q) for q in queries.values())


def test_every_operator_query_is_there_or_none():
    found = {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert found in (set(), {f"op{n}" for n in range(1, 14)})
