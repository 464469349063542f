"""The problems' queries on the smallest tables, against SQL where there is one."""

import pytest

from corpusloom.llm import queries

from oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    names, rows = spark_rows(queries.QUERIES[name](spark, sf))
    assert rows and len(names) == len(set(names))
    if name in queries.ORACLES:
        assert (names, rows) == sql_rows(sf, queries.ORACLES[name])
