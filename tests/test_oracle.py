"""Every registered query against its SQL on the smallest data set."""

import pytest

from tastelake.plans.registry import load_all
from tastelake.sources.views import Views
from tests.compare import difference, duck, duck_rows, spark_rows, type_notes

FOLDER = "/root/testdata/sf0.001"
ENTRIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.check_sql is not None])
def test_matches_sql(spark, con, name):
    entry = ENTRIES[name]
    df = entry.build(Views(spark, FOLDER))
    names, mine = spark_rows(df)
    sql_names, theirs, kinds = duck_rows(con, entry.check_sql)
    assert names == sql_names
    assert type_notes(df, kinds) == []
    assert difference(mine, theirs) is None


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    extra = set(e.queries()) - set(ENTRIES)
    assert set(ENTRIES) <= set(e.queries())
    if e.WITH_TEXT:
        from importlib import import_module

        assert extra == set(import_module("tastelake.llm.queries").QUERIES) | {"pipeline"}
    else:
        assert not extra
