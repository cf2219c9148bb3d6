"""Every query that SQL can express gives the rows of its SQL."""

import math
from decimal import Decimal

import pytest

from lorekeep import plans


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 8)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(name, spark, data, duck):
    frame = plans.QUERIES[name](spark, data)
    said = duck.execute(plans.ORACLE[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, said.fetchall())


def test_queries_without_sql_run(spark, data):
    for name in sorted(set(plans.QUERIES) - set(plans.ORACLE)):
        assert plans.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
