from collections import Counter

import pytest

from tests.conftest import SF
from tessella import queries as engine


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_matches_sql(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    got = df.collect()
    sql = engine.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert Counter(tuple(plain(r[c]) for c in order) for r in got) == Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
