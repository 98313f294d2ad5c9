import pytest

import __spark_entry__ as entry
from oracle import same_rows
from orrery import queries as engine


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_query_equals_sql(spark, data, name):
    same_rows(spark, data, engine.QUERIES[name], engine.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_query_without_sql_has_rows(spark, data, name):
    assert engine.QUERIES[name](spark, data).count() > 0


def test_entry_has_one_row(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_trip_counts_of_the_fixtures(spark, data):
    from orrery.functions import clean
    from orrery.sources.tables import trips

    raw = trips(spark, data)
    if raw.count() == 1000:
        assert clean.clean_trips(raw).count() == 672
        assert clean.with_duration(clean.clean_trips(raw)).count() == 663
