"""Models: inputs, fits per vehicle against numpy, importance, and the tables that are written."""

import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dwellspark import registry
from dwellspark.operators import cleaning as cl
from dwellspark.operators import models as md
from dwellspark.operators import series as sr
from dwellspark.plans import candidates as candidate_plans
from dwellspark.plans import models as plans
from dwellspark.sources import fleet, sinks

SMALL = "/root/testdata/sf0.001"


def numpy_logit(x, y, ridge):
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    sd[~(sd > 0)] = 1
    a = np.column_stack([np.ones(len(y)), np.where(np.isnan(x), 0, (x - mean) / sd)])
    beta, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[0] = 0
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ beta))
        beta = beta + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * beta)
    return beta


@pytest.mark.parametrize("block", [13, 4000])
def test_models_per_vehicle_equal_numpy(spark, block):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for v, n in (("a", 40), ("b", 90), ("c", 300)):
        x = rng.normal(size=(n, 3)) * [1, 10, 0] + [0, 5, 7]
        y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=n) > 0.5).astype(float)
        x[rng.random(n) < 0.1, 0] = np.nan
        want[v] = numpy_logit(x, y, 1.0)
        rows += [(v, i, *[None if np.isnan(t) else float(t) for t in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    rows += [("one label", i, 1.0, 2.0, 3.0, 1.0) for i in range(5)] + [("alone", 0, None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "hashvin string, row_id int, f double, g double, h double, label double").repartition(3)
    got = {r.hashvin: r for r in md.keyed_logit(df, ["f", "g", "h"], block_rows=block).collect()}
    for v in "abc":
        assert got[v].status == "trained" and got[v].coefficients == pytest.approx(want[v], abs=1e-7)
    assert all(got[v].status == "skipped" and got[v].coefficients is None for v in ("one label", "alone"))
    scored = md.keyed_scores(md.keyed_logit(df, ["f", "g", "h"]), df, ["f", "g", "h"])
    assert scored.filter("hashvin IN ('one label', 'alone') AND proba IS NOT NULL").count() == 0 and scored.count() == len(rows)
    hits = scored.filter("hashvin = 'c'").agg(F.avg(((F.col("proba") > 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert hits > 0.7


def test_models_read_the_helpers_columns(spark):
    table = candidate_plans.scoring_table(spark, SMALL)
    numeric, texts = plans.model_inputs(table, plans.SCORING_META)
    assert sorted(numeric + texts) == sorted(cl.model_columns(table.columns, plans.SCORING_META)) and len(numeric + texts) > 30
    assert {"cand_source", "daily_bin_1_place", "time_band", "candidate_cluster"} <= set(texts) and "rank" not in numeric and "label" not in numeric
    model, rows, numeric, texts = plans._fit_places(spark, SMALL)
    place_table = candidate_plans.multiclass_table(spark, SMALL)
    assert sorted(numeric + texts) == sorted(cl.model_columns(place_table.columns, plans.PLACE_META))
    assert {c.removesuffix("_filled").removesuffix("_index") for c in model.stages[-2].getInputCols()} == set(numeric + texts)
    scores = md.batch_score(model, rows)
    assert scores.count() == rows.count()


def test_summary_tells_which_vehicles_have_a_model(spark):
    rows = registry.QUERIES["metrics_summary"](spark, SMALL).collect()
    models, table, _ = plans.vehicle_fits(spark, SMALL)
    labels = {r.hashvin: r.n for r in table.filter("split = 'train'").groupBy("hashvin").agg(F.countDistinct("label").alias("n")).collect()}
    assert {r.hashvin for r in rows} == set(labels)
    assert all((r.status == "skipped_training") == (labels[r.hashvin] < 2) and (r.accuracy is None or 0 <= r.accuracy <= 1) for r in rows)
    assert any(r.status == "trained" and r.auc is not None for r in rows)
    places = registry.QUERIES["vehicle_place_models"](spark, SMALL).collect()
    assert places and all(r.proba is None or 0 <= r.proba <= 1 for r in places)


def test_importance_finds_the_feature_that_matters(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i % 2}", i, float(a), float(b), "even" if a > 0 else "odd", float(a > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "hashvin string, row_id int, matters double, noise double, word string, label double")
    model = md.place_classifier(df, ["matters", "noise"], trees=5)
    out = {(r.hashvin, r.feature): r for r in md.permutation_importance(model, df, ["matters", "noise"], shuffles=4).collect()}
    assert len(out) == 4
    for v in ("v0", "v1"):
        assert out[v, "matters"].importance > 0.2 > abs(out[v, "noise"].importance) and out[v, "matters"].deviation >= 0 and out[v, "matters"].n == 200
    moved = md.shifted(df, ["matters"], 3, block_rows=50)
    per = moved.groupBy("hashvin", "shuffle").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("__new.matters").alias("values"), F.sum((F.col("__new.matters") == F.col("matters")).cast("int")).alias("same")).collect()
    assert len(per) == 6 and all((r.n, r["values"], r.same) == (200, 200, 0) for r in per)


@pytest.mark.parametrize("name", ["place_classifier", "boosted_regressor", "forest_regressor", "feature_impact", "save_load_model", "export_scoring_set", "vehicle_models", "k_metric_table"])
def test_model_queries_return_rows(spark, name):
    rows = registry.QUERIES[name](spark, SMALL).collect()
    assert rows
    if name == "save_load_model":
        assert all(r.first == r.again for r in rows)
    if name == "feature_impact":
        assert {r["rank"] for r in rows} == {1, 2, 3, 4, 5}


def test_leaderboard_has_sizes_and_times(spark):
    rows = registry.QUERIES["leaderboard"](spark, SMALL).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and {r.model for r in rows} == {"logistic", "forest", "boosted"}
    assert all(r.fit_seconds > 0 and r.score_seconds > 0 and r.parameters > 10 and r.n_features > 30 and 0 <= r.test_balanced <= 1 for r in rows)


# splits by selection ---------------------------------------------------------------------


@pytest.mark.parametrize("bins,few", [(4096, 10_000), (8, 3), (2, 1)])
def test_rows_at_places_are_selected(spark, monkeypatch, bins, few):
    monkeypatch.setattr(sr, "BINS", bins)
    monkeypatch.setattr(sr, "FEW_ROWS", few)
    rng = np.random.default_rng(bins)
    rows = [(int(a) * 1_000_003, int(b)) for a, b in zip(rng.integers(-40, 40, 700), rng.integers(0, 10**9, 700))] + [(5, 5)] * 9
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    places = [0, 1, 17, 349, 350, 707, 708]
    assert sr.order_statistics(df, places, "a", "b") == [sorted(rows)[p] for p in places]


def test_splits_of_odd_tables(spark):
    shares = {"s": ((0.6, 0.2, 0.2), ("train", "valid", "test"))}
    split = lambda df: {r.id: r.s for r in sr.time_cut_split(df, shares, "t").collect()}
    times = spark.range(10).select("id", F.expr("timestamp_ntz'2024-10-27 02:30:00' + make_dt_interval(0, 0, 10 - id)").alias("t"))
    assert split(times) == {i: "train" if i >= 4 else "valid" if i >= 2 else "test" for i in range(10)}
    absent = times.withColumn("t", F.when(F.col("id") >= 3, F.col("t")))
    assert split(absent) == {i: "train" if i < 3 or i > 6 else "valid" if i > 4 else "test" for i in range(10)}
    assert split(times.limit(1)) == {0: "train"} and split(times.filter("false")) == {}
    plan = sr.time_cut_split(times, shares, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan


# files -----------------------------------------------------------------------------------


def test_vectors_are_filed_by_size(spark, tmp_path):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 500).cast("string"))).alias("hashvin"), F.expr("timestamp_ntz'2024-01-01 06:00:00' + make_dt_interval(cast(id % 200 AS int))").alias("date06"), (F.col("id") % 24).cast("int").alias("bin"), F.rand(1).alias("minutes"))
    path = str(tmp_path / "vectors")
    sinks.write_vectors(rows, f"file://{path}", file_rows=4_000)
    files = sorted((tmp_path / "vectors").glob("*.parquet"))
    metas = [pq.read_metadata(f) for f in files]
    assert sum(m.num_rows for m in metas) == 60_000 and max(m.num_rows for m in metas) <= 4_000 and len(files) <= 25
    bounds = [m.row_group(g).column(0).statistics for m in metas for g in range(m.num_row_groups)]
    assert sum(b.min <= "v250" <= b.max for b in bounds) <= 3  # the others are skipped
    assert sum(b.min <= "hot" <= b.max for b in bounds) >= 5  # a hot vehicle spans files
    plan = spark.read.parquet(f"file://{path}").filter("hashvin = 'v250'")
    assert "EqualTo(hashvin,v250)" in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 80


def test_upsert_touches_its_keys_alone(spark, tmp_path):
    path = tmp_path / "importance"
    table = lambda rows: spark.createDataFrame(rows, "hashvin string, feature string, importance double")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(f"file://{path}").select("hashvin", "feature", "importance").collect())
    sinks.upsert(table([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)]), f"file://{path}")
    before = {f: f.stat().st_mtime_ns for f in (path / "hashvin=b").glob("*.parquet")}
    for _ in range(2):
        sinks.upsert(table([("a", "z", 9.0), ("c", "x", 4.0)]), f"file://{path}")
        assert read() == [("a", "z", 9.0), ("b", "x", 3.0), ("c", "x", 4.0)]
    assert before == {f: f.stat().st_mtime_ns for f in (path / "hashvin=b").glob("*.parquet")} and before


def test_broken_rows_go_to_quarantine(spark, tmp_path):
    good = "1,a,inactive,I_1,2024-01-01 00:00:00,2024-01-01 01:00:00,60.0,35.0,139.0,50.0,49.0"
    lines = [good, good.replace("60.0", "sixty"), good.replace("1,a", "2,"), "3,a,inactive", "", good.replace("60.0", "5.0"), good.replace("2024-01-01 00:00:00", "yesterday")]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    out = fleet.read_sessions(spark, f"file://{tmp_path}/in.csv", 20, "csv", quarantine=f"file://{tmp_path}/bad", header=False)
    assert [r.session_id for r in out.collect()] == [1]
    bad = spark.read.parquet(f"file://{tmp_path}/bad").collect()
    assert sorted(r.reason for r in bad) == ["missing hashvin", "unparsed", "unparsed", "unparsed"] and lines[1] in {r.broken_record for r in bad}
    out.write.parquet(f"file://{tmp_path}/p")
    again = fleet.read_sessions(spark, f"file://{tmp_path}/p", 20)
    assert again.count() == 1 and "GreaterThanOrEqual(duration_minutes,20.0)" in again._jdf.queryExecution().executedPlan().toString()


def test_map_documents_are_chunked(spark):
    index = {r.hashvin: r for r in registry.QUERIES["map_collections"](spark, SMALL).collect()}
    docs = registry.QUERIES["map_documents"](spark, SMALL).collect()
    per = {}
    for r in docs:
        features = json.loads(r.json)["features"]
        assert len(features) == r.features <= 25 and {"title", "place", "start_soc", "soc_change", "position", "link", "duration_text"} <= set(features[0]["properties"])
        per.setdefault(r.hashvin, []).append(r.features)
    assert {v: sum(n) for v, n in per.items()} == {v: r.features for v, r in index.items() if r.features} and max(map(len, per.values())) > 1
    assert all(len(per.get(v, [])) <= r.chunks for v, r in index.items())
    assert all((r.center_lat, r.center_lon) == sinks.DEFAULT_CENTER for r in index.values() if not r.features) and any(not r.features for r in index.values())


def test_head_documents_hold_delays(spark):
    docs = [json.loads(r.json) for r in registry.QUERIES["head_documents"](spark, SMALL).collect()]
    places = [p for d in docs for p in d["places"]]
    assert places and all(0 <= p["delay_h"] <= 24 and p["source"] in ("after_charge", "anytime") and "p_start" in p for p in places)


def test_metrics_are_written_for_vehicles_and_fleet(spark):
    got = {(r.hashvin, r.metric): r.value for r in registry.QUERIES["write_metrics"](spark, SMALL).collect()}
    assert ("(all)", "top1") in got and ("(all)", "accuracy@0.5") in got and {m for v, m in got if v != "(all)"} >= {"top1", "balanced", "n"}


def test_keys_of_one_block_are_fitted_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 2))
    rows = [("abc"[i % 3], i, float(a), float(b), float(a + b + rng.normal() > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "hashvin string, row_id int, f double, g double, label double")
    monkeypatch.setattr(md, "written", lambda df, folder, keep=md.written: wrote.append(df.columns) or keep(df, folder))
    found = {}
    for block in (4000, 11):
        wrote = []
        found[block] = {r.hashvin: r for r in md.keyed_logit(df, ["f", "g"], block_rows=block).collect()}
        assert (len(wrote) <= 4) == (block == 4000)  # no table per round
    for v in "abc":
        one, other = found[4000][v], found[11][v]
        assert one.coefficients == pytest.approx(other.coefficients, abs=1e-9) and (one.status, one.rounds, one.n) == (other.status, other.rounds, other.n)


def test_importance_and_impact_equal_whole_scoring(spark):
    """A component of the assembled vector is altered: the same as altering the column and running every stage again."""
    rng = np.random.default_rng(3)
    words = ["even", "odd", None, "new"]
    rows = [(f"v{i % 3}", i, float(a) if i % 7 else None, float(i % 2), words[(i * i) % (3 if i < 90 else 4)], float((a > 0) + (i % 2))) for i, a in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "hashvin string, row_id int, matters double, flag double, word string, label double")
    columns = ["matters", "flag", "word"]
    model = md.place_classifier(df.filter("row_id < 90"), columns[:2], ["word"], trees=5)
    moved = md.shifted(df, columns, 3)
    hits = lambda rows: model.transform(rows).groupBy("hashvin").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("hit"))
    base = {r.hashvin: r.hit for r in hits(df).collect()}
    got = {(r.hashvin, r.feature): r for r in md.permutation_importance(model, df, columns, shuffles=3).collect()}
    assert len(got) == 9
    for c in columns:
        drops = [{r.hashvin: base[r.hashvin] - r.hit for r in hits(moved.filter(F.col("shuffle") == s).withColumn(c, F.col(f"__new.{c}"))).collect()} for s in range(3)]
        for v in base:
            per = [d[v] for d in drops]
            assert got[v, c].importance == pytest.approx(np.mean(per)) and got[v, c].deviation == pytest.approx(np.std(per, ddof=1)) and got[v, c].n == 40
    train = df.filter("row_id < 90")
    impact = {(r.row_id, r.feature): r.impact for r in md.feature_impact(model, df, train, columns[:2], ["word"], top=3).collect()}
    usual = {"flag": train.agg(F.percentile("flag", 0.5)).first()[0], "word": train.agg(F.mode("word", True)).first()[0]}
    p = {r.row_id: (int(r.prediction), r.probability) for r in model.transform(df).collect()}
    for c, value in usual.items():
        for r in model.transform(df.withColumn(c, F.lit(value))).collect():
            k, was = p[r.row_id]
            assert impact[r.row_id, c] == pytest.approx(was[k] - r.probability[k])


def test_upsert_by_parts_has_few_folders(spark, tmp_path):
    path = tmp_path / "parts"
    table = lambda rows: spark.createDataFrame(rows, "hashvin string, importance double")
    read = lambda: {r.hashvin: r.importance for r in spark.read.parquet(f"file://{path}").collect()}
    sinks.upsert(table([(f"v{i}", float(i)) for i in range(300)]), f"file://{path}", parts=8)
    for _ in range(2):
        sinks.upsert(table([("v7", -1.0), ("new", 5.0)]), f"file://{path}", parts=8)
        assert read() == {f"v{i}": float(i) for i in range(300)} | {"v7": -1.0, "new": 5.0}
        assert spark.read.parquet(f"file://{path}").count() == 301
    assert len([p for p in path.iterdir() if p.name.startswith("part=")]) == 8
