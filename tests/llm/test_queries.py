"""The registered queries against their SQL, over whole tables."""

import pytest

from haulbook.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in duck.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in duck.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == want


def test_all_are_registered():
    names = set(registry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
