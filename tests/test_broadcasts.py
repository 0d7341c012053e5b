"""Rows that are cut from texts are many times larger than the files that the optimizer sees: joins of them go without the driver."""

import __spark_entry__
import pytest

NAMES = [
    "mask_convention",
    "mask_most_ones",
    "graph_degrees",
    "graph_unary_links",
    "pareto_bound_runs",
    "pareto_bound_zeros",
    "overlap_classes",
    "mask_presolve",
    "mask_fewest_runs_approximately",
    "continued",
    "graph_isolated_paths",
    "mask_fewest_runs_decoded",
    "mask_fewest_runs",
    "superstring_sizes",
    "global_greedy_decoded",
    "pareto_decoded",
    "strings_joined_decoded",
    "superstring_both_masks",
    "superstring_quality",
]


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_broadcast(spark, sf_dir, name):
    """Every broadcast of a table raises here."""
    at = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(at)
    spark.conf.set(at, "1b")
    try:
        assert __spark_entry__.queries()[name](spark, sf_dir).collect()
    finally:
        spark.conf.set(at, before)
