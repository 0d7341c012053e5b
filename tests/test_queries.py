"""Each query of the core against its SQL on the smallest tables."""

import pytest

from strandloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__

    assert "kmer_counts" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
