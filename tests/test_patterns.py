"""Day patterns: scaling with zeros, density groups in blocks, seeding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.operators import patterns as pt
from dwellspark.plans import patterns as plans

SMALL = "/root/testdata/sf0.001"


def clumps(n, rng, key="v", spread=0.2):
    return [(key, i, [float(x) for x in np.eye(4)[i % 4] * 6 + spread * rng.normal(size=4)]) for i in range(n)]


def test_standard_scores_count_absent_days_as_zero(spark):
    rows = [("v", d, "often", float(d)) for d in range(1, 31)] + [("v", 7, "once", 1.0), ("v", 3, "same", 2.0), ("w", 1, "lone", 0.1)] + [("w", d, "flat", 0.1) for d in range(1, 8)]
    long = spark.createDataFrame(rows, "key string, day int, feature string, value double")
    got = {(r.key, r.day, r.feature): r for r in pt.standardize(long).collect()}
    x = np.zeros(30)
    x[6] = 1
    assert got["v", 7, "once"].z == pytest.approx((1 - x.mean()) / x.std()) and got["v", 7, "once"].z == pytest.approx(5.385164807)
    assert got["v", 7, "once"].z_absent == pytest.approx(-x.mean() / x.std())
    assert abs(got["w", 3, "flat"].z) < 1e-12 and got["w", 3, "flat"].z_absent == pytest.approx(-0.1)  # no deviation: scaled by 1
    wide = {(r.key, r.day): r.vector for r in pt.scaled(pt.dense(long)).collect()}
    names = {k: sorted({f for key, _, f, _ in rows if key == k}) for k in "vw"}
    absent = {(r.key, r.feature): r.z_absent for r in got.values()}
    for (key, day), vector in wide.items():
        here = [got[key, day, f].z if (key, day, f) in got else absent[key, f] for f in names[key]]
        assert here == pytest.approx(vector, abs=1e-9)


def test_vectors_hold_shares_and_moves(spark):
    features = {r.feature for r in plans.day_features(spark, SMALL).select("feature").distinct().collect()}
    assert {"trans_count_total", "unique_clusters_visited"} <= features and any(f.startswith("trans__") for f in features) and any(f[0].isdigit() for f in features)
    sizes = plans.day_vectors(spark, SMALL).select("key", F.size("vector").alias("n")).distinct().collect()
    held = {r.key: r.n for r in plans.day_features(spark, SMALL).groupBy("key").agg(F.countDistinct("feature").alias("n")).collect()}
    assert {r.key: r.n for r in sizes} == held


def brute_groups(rows, share=0.9, neighbours=3, least=5):
    day, x = np.array([d for _, d, _ in rows]), np.array([v for _, _, v in rows])
    far = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    np.fill_diagonal(far, np.inf)
    core = np.sort(far, axis=1)[:, neighbours - 1]
    eps = np.quantile(core, share)
    linked = np.maximum(far, np.maximum(core[:, None], core)) <= eps + 1e-9
    label = day.copy()
    while True:
        after = np.minimum(label, np.where(linked, label, 10**9).min(axis=1))
        if (after == label).all():
            break
        label = after
    return {int(d): int(g) if (label == g).sum() >= least else -1 for d, g in zip(day, label)}


@pytest.mark.parametrize("block", [7, 25, 2000])
def test_density_groups_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    rows = clumps(90, rng) + [("v", 500 + i, [20.0 + 0.3 * i, 0.0, 0.0, 0.0]) for i in range(25)] + [("v", 900, [50.0, 50.0, 0.0, 0.0])]
    few = [("w", i, [float(i), 0.0, 0.0, 0.0]) for i in range(3)]
    days = spark.createDataFrame(rows + few, "key string, day int, vector array<double>")
    got = {(r.key, r.day): r.label for r in pt.density_groups(days, block_days=block).collect()}
    assert {d: label for (k, d), label in got.items() if k == "v"} == brute_groups(rows)
    assert [got["w", i] for i in range(3)] == [-1, -1, -1]
    core = pt.core_distances(days, 3, block)
    links = pt.density_links(days.join(core, ["key", "day"]).withColumn("eps", F.lit(5.0)), block)
    blocks = -(-len(rows) // block)
    assert links.count() <= len(rows) * (blocks + 1)  # not a row per pair
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def inertia(x, label):
    return sum(((x[label == g] - x[label == g].mean(axis=0)) ** 2).sum() for g in np.unique(label))


def lloyd(x, k, rng):
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(100):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.stack([x[label == g].mean(axis=0) if (label == g).any() else c[g] for g in range(k)])
    return inertia(x, label)


def test_seeding_is_no_worse_than_random_starts(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK_DAYS", 60)  # several blocks a key
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=2) * 12 + 0.4 * rng.normal(size=(n, 2)) for n in (80, 40, 20, 10, 6, 4)])
    days = spark.createDataFrame([("v", i, v.tolist()) for i, v in enumerate(x)], "key string, day int, vector array<double>")
    got = pt.day_kmeans(days, ks=(4, 6), restarts=2).collect()
    for k in (4, 6):
        label = np.array([r.label for r in sorted((r for r in got if r.k == k), key=lambda r: r.day)])
        assert len(label) == len(x) and inertia(x, label) <= 1.0001 * np.median([lloyd(x, k, rng) for _ in range(10)])


def test_equal_days_are_clustered(spark):
    days = spark.createDataFrame([("v", i, [1.0, 2.0]) for i in range(9)] + [("w", i, [float(i > 3)]) for i in range(8)], "key string, day int, vector array<double>")
    got = pt.day_kmeans(days, ks=(3,), restarts=2).collect()
    assert len(got) == 17 and len({r.label for r in got if r.key == "v"}) == 1 and len({(r.day > 3, r.label) for r in got if r.key == "w"}) == 2


def test_keys_of_one_block_are_clustered_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(f"v{v}", i, (rng.normal(size=5) + 4 * (i % 4) * np.eye(5)[v % 5]).tolist()) for v in range(4) for i in range(20 + 9 * v)] + [("few", i, [float(i)] * 5) for i in range(4)]
    days = spark.createDataFrame(rows, "key string, day int, vector array<double>")
    monkeypatch.setattr(pt, "written", lambda df, folder, keep=pt.written: wrote.append(df.columns) or keep(df, folder))
    found = {}
    for block in (2000, 15):
        monkeypatch.setattr(pt, "BLOCK_DAYS", block)
        wrote = []
        found[block] = {(r.key, r.k, r.day): r.label for r in pt.day_kmeans(days, ks=(3, 4, 6), restarts=3).collect()}
        assert (len(wrote) <= 2) == (block == 2000)  # the days and their numbers, no table of runs, rounds or centres
    assert found[2000].keys() == found[15].keys() and {k for key, k, _ in found[2000] if key == "few"} == {3}
    x = {(key, day): np.array(v) for key, day, v in rows}
    for key, k in {(key, k) for key, k, _ in found[15]}:
        of = [np.array([label for (a, b, _), label in sorted(f.items()) if (a, b) == (key, k)]) for f in found.values()]
        points = np.stack([v for (a, _), v in sorted(x.items()) if a == key])
        assert inertia(points, of[0]) == pytest.approx(inertia(points, of[1]), rel=1e-9)


def test_vectors_are_scaled_before_they_are_made(spark):
    rng = np.random.default_rng(5)
    rows = [(f"v{v}", d, f"f{f}", float(rng.integers(1, 5))) for v in range(3) for d in range(9) for f in range(7) if rng.random() < 0.5] + [("one", 1, "f", 2.0)]
    long = spark.createDataFrame(rows, "key string, day int, feature string, value double").repartition(3)
    want = {(r.key, r.day): r.vector for r in pt.scaled(pt.dense(long)).collect()}
    got = pt.standard_vectors(long)
    assert {(r.key, r.day): r.vector for r in got.collect()} == {at: pytest.approx(v, abs=1e-12) for at, v in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "try_element_at" not in plan  # no row or look-up per day and component
    x = {(key, day): {f: v for k, d, f, v in rows if (k, d) == (key, day)} for key, day, _, _ in rows}
    names = {key: sorted({f for k, _, f, _ in rows if k == key}) for key, *_ in rows}
    assert {(r.key, r.day): r.vector for r in pt.dense(long).collect()} == {at: [h.get(f, 0.0) for f in names[at[0]]] for at, h in x.items()}


def test_keys_of_one_block_are_scored_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(key, i, rng.normal(size=3).tolist()) for key, n in (("a", 30), ("b", 90)) for i in range(n)]
    days = spark.createDataFrame(rows, "key string, day int, vector array<double>")
    labels = spark.createDataFrame([(key, k, i, i * i % k) for key, i, _ in rows for k in (1, 3, 4)], "key string, k int, day int, label int")
    want = {(r.key, r.k): r for r in pt.cluster_scores(labels.join(days, ["key", "day"]), "key", "k").collect()}
    for block in (2000, 40):
        monkeypatch.setattr(pt, "BLOCK_DAYS", block)
        table = pt.scores_by_k(labels, days)
        got = {(r.key, r.k): r for r in table.collect()}
        assert got.keys() == want.keys() and len(got) == 4
        for at, r in got.items():
            assert [r[c] for c in r.__fields__[2:]] == pytest.approx([want[at][c] for c in r.__fields__[2:]], rel=1e-9)
        assert ("Generate" in table._jdf.queryExecution().executedPlan().toString()) == (block == 40)


def test_every_two_blocks_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    days = spark.createDataFrame([("v", i, i % 3, x[i].tolist()) for i in range(60)], "key string, day int, label int, vector array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for block in (9, 2000):
        got = pt.label_distances(days, ["key"], block)
        for r in got.collect():
            others = [j for j in range(60) if j % 3 == r.ly and j != r.x]
            assert r.lx == r.x % 3 and r.d == pytest.approx(far[r.x, others].mean(), rel=1e-9)
        assert got.count() == 180 and "__one" in got._jdf.queryExecution().executedPlan().toString()
