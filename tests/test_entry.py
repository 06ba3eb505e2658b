import pytest

import __spark_entry__
from oracle_check import compare

pytest.importorskip("duckdb")


def test_every_query_gives_the_rows_of_its_sql(spark):
    names = set(__spark_entry__.search_queries())
    assert names == set(__spark_entry__.search_sql())
    results = list(compare(spark, "/root/testdata/sf0.001", names))
    assert [(name, problem) for name, problem, *_ in results if problem] == []
    assert all(rows for _, _, rows, *_ in results)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert [row.result_number for row in rows] == list(range(1, 11))
