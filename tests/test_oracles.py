"""Every named query against its SQL counterpart, and the survey's own counts."""

import collections

import pytest

from __spark_entry__ import entry
from echocite.plans.catalog import CATALOG
from oracle.queries import ORACLES
from tools.compare import connect, rows_of


def rows(df):
    return collections.Counter(tuple(map(repr, r)) for r in df.collect())


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(CATALOG) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, db, sf_dir, name):
    df = CATALOG[name](spark, sf_dir)
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = rows_of(columns, cursor.fetchall())
    assert rows_of(df.columns, df.collect()) == theirs
    assert theirs


def test_entry(spark):
    assert entry(spark).count() > 0
