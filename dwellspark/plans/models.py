"""Pooled models over the fleet's tables, and the writers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cleaning as cl
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import series as sr
from ..operators.patterns import work_folder, written
from ..sources import fleet, sinks
from . import candidates as candidate_plans
from . import daily as daily_plans
from . import places as place_plans
from .base import Family
from .inputs import ordered, sessions
from .metrics import MAP_CHUNK, map_rows, scored
from .series import daily as daily_series

family = Family()

#: Trees and rounds of the registered models.  GBT rounds run one after another (some 0.4 s each at
#: any small size), so the regressor takes 60 instead of the operator's 400.
CANDIDATE_ROUNDS, PLACE_TREES, REGRESSION_ROUNDS = 20, 30, 60

#: Columns of the scoring table that no model reads: keys, the label, and the rank, which puts the truth first.
SCORING_META = ["session_uid", "hashvin", "split", "true_cluster", "label", "rank"]
PLACE_META = ["session_uid", "split", "y_class"]


def model_inputs(table, meta):
    """(numeric, texts): all columns but ``meta``, by type."""
    names = cl.model_columns(table.columns, meta)
    texts = [c for c in names if table.schema[c].dataType.typeName() == "string"]
    return [c for c in names if c not in texts], texts


def candidate_rows(spark, d):
    """(rows, numeric, texts): the scoring table, each charge with its candidate places, and the columns that models read."""
    t = candidate_plans.scoring_table(spark, d)
    numeric, texts = model_inputs(t, SCORING_META)
    rows = t.select(F.xxhash64("session_uid", "candidate_cluster").alias("row_id"), "session_uid", "hashvin", "split", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in numeric], *texts)
    return written(rows, work_folder(rows)), numeric, texts


def place_rows(spark, d):
    """(rows, numeric, texts): the multiclass table with the HEAD rank of the true place as its label (0: OTHER)."""
    charges = ordered(spark, d).select("session_uid", "session_id", "hashvin", F.col("next_long_inactive_cluster").alias("place"))
    ranks = charges.join(place_plans.heads(spark, d).select("hashvin", "place", "head_rank"), ["hashvin", "place"], "left")
    ranks = ranks.select("session_uid", "hashvin", F.col("session_id").alias("row_id"), F.coalesce("head_rank", F.lit(0)).cast("double").alias("label"))
    table = candidate_plans.multiclass_table(spark, d)
    numeric, texts = model_inputs(table, PLACE_META)
    t = table.join(ranks, "session_uid")
    rows = t.select("row_id", "session_uid", "hashvin", F.col("split").alias("split8"), "label", *[F.col(c).cast("double").alias(c) for c in numeric], *texts)
    return written(rows, work_folder(rows)), numeric, texts


def lagged(spark, d):
    x = sr.lag_vectors(daily_series(spark, d), 4)
    return x.select(F.xxhash64("series", "t").alias("row_id"), "series", "t", "target", F.year("t").alias("year"), *[F.col("lags")[i].alias(f"lag_{i + 1}") for i in range(4)])


LAGS = [f"lag_{i}" for i in range(1, 5)]


def _fit_places(spark, d):
    rows, numeric, texts = place_rows(spark, d)
    return md.place_classifier(rows.filter("split8 = 'train'"), numeric, texts, trees=PLACE_TREES), rows, numeric, texts


@family.query()
def candidate_classifier(spark, d):
    rows, numeric, texts = candidate_rows(spark, d)
    model = md.candidate_classifier(rows.filter("split = 'train'"), numeric, texts, trees=CANDIDATE_ROUNDS)
    return md.batch_score(model, rows.filter("split = 'test'")).select("session_uid", "candidate_cluster", "label", "proba")


@family.query()
def place_classifier(spark, d):
    model, rows, _, _ = _fit_places(spark, d)
    return md.batch_score(model, rows.filter("split8 = 'test'")).select("session_uid", "label", "prediction", "max_proba")


@family.query()
def batch_score(spark, d):
    model, rows, _, _ = _fit_places(spark, d)
    return md.batch_score(model, rows).select("session_uid", "prediction", "proba", "max_proba", F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("p_sum"))


def vehicle_fits(spark, d):
    """(models, rows, numeric): a logistic model of the candidates per vehicle, fitted on its training rows."""
    rows, numeric, _ = candidate_rows(spark, d)
    return md.keyed_logit(rows.filter("split = 'train'"), numeric), rows, numeric


@family.query()
def vehicle_models(spark, d):
    """The coefficients of every vehicle's own model, a row per feature; vehicles with one label have none."""
    models, _, numeric = vehicle_fits(spark, d)
    names = F.array(*map(F.lit, ["(constant)", *numeric]))
    pairs = F.arrays_zip(names.alias("feature"), F.col("coefficients").alias("coefficient"))
    return models.filter("coefficients IS NOT NULL").select("hashvin", "status", "n", F.explode(pairs).alias("c")).select("hashvin", "status", "n", "c.feature", "c.coefficient")


@family.query()
def vehicle_place_models(spark, d):
    """Every vehicle's own place models, one class against the rest: test rows with the likeliest class of their vehicle."""
    rows, numeric, _ = place_rows(spark, d)
    train = rows.filter("split8 = 'train'")
    classes = train.select("hashvin", F.col("label").alias("class")).distinct()
    own = train.join(classes, "hashvin").withColumn("label", (F.col("label") == F.col("class")).cast("double"))
    models = md.keyed_logit(own, numeric, ("hashvin", "class"))
    asked = rows.filter("split8 = 'test'").join(models.select("hashvin", "class").distinct(), "hashvin")
    scored = md.keyed_scores(models, asked, numeric, ("hashvin", "class"))
    # a vehicle's only class is certain
    likely = F.max_by(F.struct("class", "proba"), F.struct(F.coalesce("proba", F.lit(1.0)), -F.col("class"))).alias("b")
    return scored.groupBy("session_uid", "hashvin", "label").agg(likely).select("session_uid", "hashvin", "label", F.col("b.class").alias("prediction"), F.col("b.proba").alias("proba"))


def _regression(model, rows):
    out = model.transform(rows).select(F.col("target").alias("truth"), "prediction")
    return mt.regression(out)


@family.query()
def boosted_regressor(spark, d):
    rows = lagged(spark, d)
    model = md.boosted_regressor(rows.filter("year < 2000"), LAGS, rounds=REGRESSION_ROUNDS, step=0.1)
    return _regression(model, rows.filter("year >= 2000"))


@family.query()
def forest_regressor(spark, d):
    rows = lagged(spark, d)
    return _regression(md.forest_regressor(rows.filter("year < 2000"), LAGS), rows.filter("year >= 2000"))


@family.query()
def model_dtype_parity(spark, d):
    """How far a forest's predictions move when its inputs are cut to single precision."""
    rows = lagged(spark, d)
    return md.precision_gap(md.forest_regressor(rows.filter("year < 2000"), LAGS), rows.filter("year >= 2000"), LAGS)


@family.query()
def permutation_importance(spark, d):
    """Mean and deviation of every feature's importance per vehicle, put in place in a table by vehicle."""
    model, rows, numeric, texts = _fit_places(spark, d)
    out = md.permutation_importance(model, rows.filter("split8 = 'test'"), [*numeric, *texts])
    path = _folder(rows, "importance")
    sinks.upsert(out, path, parts=sinks.PARTS)
    return spark.read.schema("feature string, importance double, deviation double, n bigint, hashvin string").parquet(path).select("feature", "importance", "deviation", "n", "hashvin")


@family.query()
def leaderboard(spark, d):
    rows, numeric, texts = candidate_rows(spark, d)
    return md.leaderboard(rows.filter("split = 'train'"), rows.filter("split = 'test'"), numeric, texts)


@family.query()
def feature_impact(spark, d):
    model, rows, numeric, texts = _fit_places(spark, d)
    return md.feature_impact(model, rows.filter("split8 = 'test'"), rows.filter("split8 = 'train'"), numeric, texts)


@family.query()
def metrics_summary(spark, d):
    """A row per vehicle: how its own model's fit ended, rows, and the top-1 accuracy, AUC and coverage on its test rows (null without a model)."""
    models, rows, numeric = vehicle_fits(spark, d)
    test = md.keyed_scores(models, rows.filter("split = 'test'"), numeric).filter("proba IS NOT NULL")
    top = mt.session_top1(test.withColumn("place", F.col("candidate_cluster"))).groupBy("hashvin").agg(F.avg("label").alias("accuracy"), F.count(F.lit(1)).alias("n_test"))
    found = mt.candidate_coverage(test, ["hashvin"]).select("hashvin", "coverage")
    out = models.select("hashvin", F.when(F.col("status") == "skipped", "skipped_training").otherwise(F.col("status")).alias("status"), "n", "positives", "rounds")
    out = out.join(top, "hashvin", "left").join(mt.auc(test, ["hashvin"]).select("hashvin", "auc"), "hashvin", "left").join(found, "hashvin", "left")
    return out.select("hashvin", "status", "n", "positives", "rounds", F.coalesce("n_test", F.lit(0)).alias("n_test"), "accuracy", "auc", "coverage")


def _folder(df, name: str) -> str:
    return f"{work_folder(df)}/{name}-{uuid.uuid4().hex}"


@family.query()
def write_splits(spark, d):
    df = ordered(spark, d).select("session_uid", "hashvin", "charge_start_time", "next_long_inactive_cluster", "split")
    path = _folder(df, "splits")
    sinks.write_splits(df, path)
    return spark.read.parquet(path)


@family.query()
def write_vectors(spark, d):
    df = daily_plans.daily_behavior_vectors(spark, d)
    path = _folder(df, "vectors")
    sinks.write_vectors(df, path)
    return spark.read.parquet(path)


@family.query()
def write_metrics(spark, d):
    """Every metric of every vehicle, and of the fleet ('(all)'), as JSON lines."""
    s, head = scored(spark, d), place_plans.heads(spark, d)
    per = mt.accuracies(s, head, ["hashvin"])
    whole = mt.accuracies(s.withColumn("fleet", F.lit("(all)")), head, ["fleet"]).withColumnRenamed("fleet", "hashvin")
    names = ["top1", "top1_head", "balanced", "balanced_head"]
    long = lambda df: df.unpivot("hashvin", [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
    sizes = s.groupBy("hashvin").agg(F.count(F.lit(1)).cast("double").alias("value")).select("hashvin", F.lit("n").alias("metric"), "value")
    taus = mt.threshold_metrics(s).select(F.lit("(all)").alias("hashvin"), F.explode(F.array(*[F.struct(F.concat(F.lit(f"{c}@"), F.col("tau").cast("string")).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("coverage", "accuracy")])).alias("m"))
    df = long(per).unionByName(long(whole)).unionByName(sizes).unionByName(taus.select("hashvin", "m.*")).filter("value IS NOT NULL")
    path = _folder(df, "metrics")
    sinks.write_metrics(df, path)
    return spark.read.schema("hashvin string, metric string, value double").json(path)


@family.query()
def head_documents(spark, d):
    return sinks.head_details(place_plans.head_details_json(spark, d))


@family.query()
def map_documents(spark, d):
    return sinks.geojson(map_rows(spark, d), MAP_CHUNK)


@family.query()
def save_load_model(spark, d):
    """Predictions of a saved and reloaded model, beside those of the first."""
    model, rows, _, _ = _fit_places(spark, d)
    path = _folder(rows, "model")
    sinks.save_model(model, path)
    a = model.transform(rows).select("session_uid", F.col("prediction").alias("first"))
    b = sinks.load_model(path).transform(rows).select("session_uid", F.col("prediction").alias("again"))
    return a.join(b, "session_uid")


@family.query()
def export_scoring_set(spark, d):
    """Test rows with the truth and the predictions of two models."""
    rows = lagged(spark, d)
    train, test = rows.filter("year < 2000"), rows.filter("year >= 2000")
    a = md.forest_regressor(train, LAGS).transform(test).select("series", "t", "target", F.col("prediction").alias("prediction_a"))
    b = md.boosted_regressor(train, LAGS, rounds=REGRESSION_ROUNDS, step=0.1).transform(test).select("series", "t", F.col("prediction").alias("prediction_b"))
    path = _folder(rows, "scoring")
    a.join(b, ["series", "t"]).write.parquet(path)
    return spark.read.parquet(path)
