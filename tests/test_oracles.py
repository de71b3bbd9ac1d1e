"""Every query with SQL gives the rows of its SQL."""

import pytest
from compare import SF, same

from corpusloom.plans.oracles import oracle_sql
from corpusloom.plans.queries import queries


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, SF, queries()[name], oracle_sql()[name])
