import pytest

from lorekeep.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, data, duck):
    frame = QUERIES[name](spark, data)
    said = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in said.description]
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(said.fetchall())
