"""Every registered query of the engine against its SQL, over the smallest tables."""

import pytest

from lexmill.plans import catalog

from .oracle import DATA, duck, rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in catalog.ORACLE_SQL:
        want = duck(catalog.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
