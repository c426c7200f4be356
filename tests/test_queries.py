"""Every query with SQL gives the same rows as DuckDB on the small tables; the others run."""

import pytest
from compare import assert_same

from loam.plans import registry

QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tiny, name):
    assert_same(QUERIES[name](spark, tiny), tiny, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    rows = df.collect()
    # Columns are named once, rows are there (the small tables hold no item with a file), and no key is null.
    assert len(set(df.columns)) == len(df.columns) and (rows or name in ("captured_files",))
    assert all(r[k] is not None for r in rows for k in df.columns if k in ("page_id", "doc_id", "event_id", "url"))
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES[name](spark, tiny).collect()))


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
