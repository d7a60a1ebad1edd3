import pytest

import __spark_entry__ as entry_points
from cueloom.plans import file_queries, text_queries
from tests.comparing import same_rows

QUERIES = {**text_queries.QUERIES, **file_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **file_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_entry_and_registration(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_points.queries()) and set(entry_points.oracle_sql()) <= set(entry_points.queries())
