"""Paths of any depth are walked; cycles are told."""

import pytest

from terrapath.operators import paths


def test_deep_path_is_walked(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(71)], "id long, parent long")
    got = paths.backtrace(tree, tree.filter("id = 70").select("id")).collect()
    assert sorted((r["depth"], r["id"]) for r in got) == [(d, 70 - d) for d in range(71)]


def test_cycle_is_an_error(spark):
    tree = spark.createDataFrame([(9, 0), (0, 1), (1, 2), (2, 0)], "id long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        paths.backtrace(tree, tree.filter("id = 9").select("id"))
