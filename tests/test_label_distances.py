import numpy as np
import pytest

from dwellspark.operators import patterns as pt


def test_many_blocks_meet_without_copies_of_their_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(90, 3)), rng.integers(0, 3, 90)
    label[:2] = 7, 8  # of one day each
    rows = [("v", i, int(label[i]), x[i].tolist()) for i in range(90)] + [("few", i, i % 2, x[i].tolist()) for i in range(9)]
    days = spark.createDataFrame(rows, "key string, day int, label int, vector array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    wrote = []
    monkeypatch.setattr(pt, "written", lambda df, folder, keep=pt.written: wrote.append(keep(df, folder)) or wrote[-1])
    monkeypatch.setattr(pt, "CELLS", 64)  # sums leave a task more than once
    got = pt.label_distances(days, ["key"], 4)
    found = {(r.key, r.x, r.lx, r.ly): r.d for r in got.collect()}
    want = {}
    for key, n, of in (("v", 90, label), ("few", 9, np.arange(9) % 2)):
        for i in range(n):
            for y in set(of[:n].tolist()):
                others = [j for j in range(n) if of[j] == y and j != i]
                if others:
                    want[key, i, int(of[i]), y] = pytest.approx(far[i, others].mean(), rel=1e-9)
    assert found == want and got.count() == len(want)
    held = [r for r in wrote[0].collect()]
    assert sum(len(r.day) for r in held) == 90 and len(held) > pt.MANY_BLOCKS  # every vector once, whatever the number of blocks
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()


def test_scores_do_not_depend_on_the_way_blocks_meet(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(key, k, i, int(rng.integers(0, k)), rng.normal(size=4).tolist()) for key in "ab" for k in (2, 3) for i in range(40)]
    days = spark.createDataFrame(rows, "key string, k int, day int, label int, vector array<double>")
    scores = []
    for many in (0, 8):
        monkeypatch.setattr(pt, "MANY_BLOCKS", many)
        scores.append({(r.key, r.k): list(r)[2:] for r in pt.cluster_scores(days, "key", "k").collect()})
    assert scores[0].keys() == scores[1].keys() and all(scores[0][at] == pytest.approx(v, rel=1e-9) for at, v in scores[1].items())


def test_distances_to_centres_are_taken_once(spark, monkeypatch):
    rows = [("a", i, i % 3, [float(i), float(i % 5)]) for i in range(30)]
    days = spark.createDataFrame(rows, "key string, day int, label int, vector array<double>")
    wrote = []
    monkeypatch.setattr(pt, "written", lambda df, folder, keep=pt.written: wrote.append(df) or keep(df, folder))
    r = pt.cluster_scores(days, "key").first()
    assert len(wrote) == 1 and wrote[0].count() == 3  # a row per label, of which every two meet
    assert r.silhouette is not None and r.calinski_harabasz > 0 and r.davies_bouldin > 0
