"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from conftest import DATA, same_rows

from sparkweave import queries as Q

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    same_rows(Q.queries()[name](spark, DATA), duck, SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["node_id", "entity_type", "occurrences", "degree"] and df.count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
