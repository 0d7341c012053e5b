"""Each query of the package against its SQL on the smallest tables."""

import pytest

from strandloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).columns
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
