import numpy as np

from dwellspark.operators import patterns as pt


def test_a_key_of_one_block_is_grouped_without_tables_of_links(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(key, day, rng.normal(size=3).tolist()) for key, n in (("a", 40), ("b", 3), ("c", 12)) for day in range(n)]
    days = spark.createDataFrame(rows, "key string, day int, vector array<double>")
    want = {(r.key, r.day): r.label for r in pt.density_groups(days, block_days=7).filter("key <> 'b'").collect()}
    monkeypatch.setattr(pt, "density_links", lambda *a: 1 / 0)
    got = {(r.key, r.day): r.label for r in pt.density_groups(days).collect()}
    assert {at: label for at, label in got.items() if at[0] != "b"} == want
    assert [got["b", d] for d in range(3)] == [-1] * 3
