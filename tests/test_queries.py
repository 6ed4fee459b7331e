"""Registered queries against their SQL, and plans that must not degrade."""

import json
import math
from decimal import Decimal

import duckdb
import pytest

from dwellspark import registry
from dwellspark.operators import patterns as pt

SMALL = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


def shown(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    mine = sorted((tuple(shown(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    theirs = sorted((tuple(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted(names) == cols and mine == theirs


def test_ratios_sum_to_one(spark):
    assert registry.QUERIES["vector_quality"](spark, SMALL).first().ok


def test_splits_are_written_and_read(spark):
    got = registry.QUERIES["write_splits"](spark, SMALL)
    assert {r.split for r in got.select("split").distinct().collect()} == {"train", "valid", "test"}


def test_maps_are_geojson(spark):
    rows = registry.QUERIES["map_features"](spark, SMALL).groupBy("hashvin").count().collect()
    docs = {}
    for r in registry.QUERIES["map_documents"](spark, SMALL).collect():
        docs.setdefault(r.hashvin, []).extend(json.loads(r.json)["features"])
    assert {r.hashvin: r["count"] for r in rows} == {v: len(f) for v, f in docs.items()}
    for f in (f for d in docs.values() for f in d):
        at = f["geometry"]["coordinates"]
        assert len(at) == 2 and all(len(p) == 2 for p in at) if f["geometry"]["type"] == "LineString" else all(isinstance(x, float) for x in at)


def test_days_lie_with_their_nearest_centre(spark):
    days = spark.createDataFrame([("v", i, [float(i % 3) * 10 + i % 5 * 0.1, float(i % 2) * 0.1]) for i in range(60)] + [("w", i, [float(i)]) for i in range(3)], "key string, day int, vector array<double>")
    rows = pt.day_kmeans(days, ks=(3, 4), restarts=4).collect()
    assert {r.key for r in rows} == {"v"} and len(rows) == 120
    at = {r.day: r.label for r in rows if r.k == 3}
    assert len({(i % 3, at[i]) for i in range(60)}) == 3  # the three clumps, each with a label of its own
    scores = {b: pt.label_distances(spark.createDataFrame([("v", d, label, [float(d % 3), 1.0]) for d, label in at.items()], "key string, day int, label int, vector array<double>"), ["key"], b).collect() for b in (7, 2000)}
    shown = lambda rs: sorted((r.x, r.lx, r.ly, round(r.d, 9)) for r in rs)
    assert shown(scores[7]) == shown(scores[2000]) and len(scores[7]) == 180


def test_scaled_vectors_are_the_long_ones(spark):
    long = spark.createDataFrame([("v", 1, "a", 1.0), ("v", 2, "a", 3.0), ("v", 2, "b", 4.0), ("w", 1, "c", 2.0)], "key string, day int, feature string, value double")
    got = {(r.key, r.day): r.vector for r in pt.scaled(pt.dense(long)).collect()}
    assert got == {("v", 1): [-1.0, -1.0], ("v", 2): [1.0, 1.0], ("w", 1): [0.0]}


def test_models_score_every_row(spark):
    rows = registry.QUERIES["candidate_classifier"](spark, SMALL).collect()
    assert rows and all(0 <= r.proba <= 1 and r.label in (0.0, 1.0) for r in rows)
    assert registry.QUERIES["model_dtype_parity"](spark, SMALL).first().max_gap >= 0
    assert registry.QUERIES["permutation_importance"](spark, SMALL).filter("n > 0 AND deviation >= 0").count() > 50


def test_probabilities_sum_to_one(spark):
    assert all(abs(r.p_sum - 1) < 1e-9 for r in registry.QUERIES["batch_score"](spark, SMALL).select("p_sum").collect())


@pytest.mark.parametrize("name", ["daily_bins", "candidates", "bin_place_minutes", "history_in_window"])
def test_no_nested_loops_and_no_python(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
