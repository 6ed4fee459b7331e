import pytest

from dwellspark import registry


@pytest.mark.parametrize("name", ["standardize_days", "pattern_heatmap"])
def test_long_rows_are_read_from_where_they_were_written_once(spark, name):
    assert any("/patterns/" in f for f in registry.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles())
