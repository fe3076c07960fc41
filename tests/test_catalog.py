import pytest

from corpusloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(same):
    """The flagship's rows, one by one, on the tables it names."""
    import __spark_entry__ as e

    same(lambda spark, sf: e.entry(spark), catalog.ORACLES["search_bm25_prefix"])
    assert set(e.oracle_sql()) <= set(e.queries())


def test_additions_that_cannot_be_imported_leave_the_rest(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def without(name, *more):
        if name.startswith("corpusloom.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *more)

    monkeypatch.setattr(builtins, "__import__", without)
    assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES)
