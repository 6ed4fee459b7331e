"""Models: Spark ML pipelines pooled over the fleet, and logistic models per vehicle.

Features are relative to the vehicle already (distances, shares, ranks), so vehicles can
share a model; classes of the place model are HEAD ranks for the same reason.  Models per
vehicle are fitted all at once: each round sums every vehicle's normal equations over blocks of
its rows and solves them by vehicle, so no loop runs over vehicles and none is gathered whole.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .patterns import forget, work_folder, written

#: Categories of a text that trees tell apart, at most; rows of a block of a vehicle.
MOST_BINS, BLOCK_ROWS = 256, 4_000


def assembled(numeric: Sequence[str], texts: Sequence[str] = ()) -> list:
    """Stages from columns to ``features``: texts are indexed, missing numbers take the median."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in texts]
    stages.append(Imputer(inputCols=list(numeric), outputCols=[f"{c}_filled" for c in numeric], strategy="median"))
    return [*stages, VectorAssembler(inputCols=[f"{c}_filled" for c in numeric] + [f"{c}_index" for c in texts], outputCol="features", handleInvalid="keep")]


def enough_labels(rows: DataFrame, label: str) -> bool:
    return rows.select(label).distinct().limit(2).count() == 2


def candidate_classifier(rows: DataFrame, numeric: Sequence[str], texts: Sequence[str] = (), trees: int = 20) -> PipelineModel | None:
    """"Is this the place": None where there are not both labels."""
    if not enough_labels(rows, "label"):
        return None
    return Pipeline(stages=[*assembled(numeric, texts), GBTClassifier(labelCol="label", maxIter=trees, maxDepth=4, maxBins=MOST_BINS, seed=42)]).fit(rows)


def place_classifier(rows: DataFrame, numeric: Sequence[str], texts: Sequence[str] = (), trees: int = 30) -> PipelineModel | None:
    """The HEAD rank (0 for OTHER) of the place; None with fewer than two classes."""
    if not enough_labels(rows, "label"):
        return None
    return Pipeline(stages=[*assembled(numeric, texts), RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=6, maxBins=MOST_BINS, seed=42)]).fit(rows)


def boosted_regressor(rows: DataFrame, numeric: Sequence[str], label: str = "target", rounds: int = 400, step: float = 0.05) -> PipelineModel:
    return Pipeline(stages=[*assembled(numeric), GBTRegressor(labelCol=label, maxDepth=6, maxIter=rounds, stepSize=step, seed=42)]).fit(rows)


def forest_regressor(rows: DataFrame, numeric: Sequence[str], label: str = "target", trees: int = 50) -> PipelineModel:
    return Pipeline(stages=[*assembled(numeric), RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=5, minInstancesPerNode=2, seed=42)]).fit(rows)


def batch_score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with prediction, p (per class), proba (of class 1) and max_proba."""
    out = model.transform(rows).withColumn("p", vector_to_array("probability"))
    return out.withColumns({"proba": F.col("p")[1], "max_proba": F.array_max("p")})


def _parts(model: PipelineModel) -> tuple[PipelineModel, Model, dict[str, int]]:
    """The stages of ``assembled``, the classifier, and each column's place (from 1) in the vector between them."""
    *first, last = model.stages
    return PipelineModel(first), last, {c.rpartition("_")[0]: i + 1 for i, c in enumerate(first[-1].getInputCols())}


def _altered(rows: DataFrame, columns: Sequence[str], places: dict[str, int], new: str, keep: Sequence[str], changed: bool = False) -> DataFrame:
    """A row per row and column of ``columns``, named ``feature``, with ``features``: the vector ``x``, in which that column's component comes from ``new``.

    With ``changed`` rows that this would leave as they are have none.
    """
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(places.get(c, 0)).alias("at")) for c in columns])).alias("f")
    each = rows.select(*keep, "x", new, named).select(*keep, "x", new, "f.feature", "f.at")
    x, y, at = F.col("x"), F.col(new), F.col("at")
    if changed:
        each = each.filter((at > 0) & (F.try_element_at("x", at) != F.try_element_at(new, at)))
    vector = F.when(at > 0, F.concat(F.slice(x, 1, at - 1), F.slice(y, at, 1), F.slice(x, at + 1, F.size(x)))).otherwise(x)
    return each.select(*keep, "feature", array_to_vector(vector).alias("features"))


def shifted(rows: DataFrame, columns: Sequence[str], shuffles: int, seed: int = 42, by: Sequence[str] = ("hashvin",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` once per shuffle (``shuffle``) with ``__new``: the ``columns`` of another row of the same ``by``.

    Rows stand in one order by a hash within blocks of each ``by``, and a shuffle is a cyclic
    shift of a block, so each gives every row's values once and no two give a row the same ones (where the
    block has more rows than shuffles).
    """
    blocks = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__blocks"))
    dealt = rows.join(blocks, [*by]).withColumn("__b", F.pmod(F.xxhash64("row_id", F.lit(seed + 1)), F.col("__blocks")))
    here = W.partitionBy(*by, "__b")
    placed = dealt.withColumns({"__i": F.row_number().over(here.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id")) - 1, "__n": F.count(F.lit(1)).over(here)}).drop("__blocks")
    a = placed.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    a = a.withColumn("__from", F.pmod(F.col("__i") + 1 + F.floor(F.col("shuffle") * (F.col("__n") - 1) / shuffles), F.col("__n")))
    b = placed.select(*[F.col(c).alias(c) for c in by], F.col("__b").alias("__b"), F.struct(*columns).alias("__new"), F.col("__i").alias("__from"))
    return a.join(b, [*by, "__b", "__from"]).drop("__i", "__n", "__b", "__from")


def permutation_importance(model: PipelineModel, rows: DataFrame, columns: Sequence[str], shuffles: int = 5, seed: int = 42) -> DataFrame:
    """(hashvin, feature, importance, deviation, n): mean and deviation, over paired shuffles, of a vehicle's loss of accuracy when a feature is another row's."""
    prepare, last, places = _parts(model)
    hit = (F.col("prediction") == F.col("label")).cast("int")
    asked = last.transform(prepare.transform(rows).select("row_id", "hashvin", "label", "features")).select("row_id", "hashvin", "label", hit.alias("hit"), vector_to_array("features").alias("x"))
    asked = written(asked, work_folder(rows))
    vehicles = asked.groupBy("hashvin").agg(F.count(F.lit(1)).alias("n")).withColumn("feature", F.explode(F.array(*map(F.lit, columns))))
    moved = shifted(asked, ["x"], shuffles, seed).withColumn("y", F.col("__new.x"))
    # a row whose value is the same in the other row is hit or missed as before
    other = last.transform(_altered(moved, columns, places, "y", ["hashvin", "label", "hit", "shuffle"], changed=True))
    lost = other.groupBy("hashvin", "feature", "shuffle").agg(F.sum(F.col("hit") - hit).alias("lost")).groupBy("hashvin", "feature").agg(F.collect_list("lost").alias("lost"))
    some = F.coalesce("lost", F.array().cast("array<bigint>"))
    drops = F.concat(F.transform(some, lambda v: v / F.col("n")), F.array_repeat(F.lit(0.0), shuffles - F.size(some)))
    out = vehicles.join(lost, ["hashvin", "feature"], "left").withColumn("drops", drops)
    mean = F.aggregate("drops", F.lit(0.0), lambda a, v: a + v) / shuffles
    out = out.withColumn("importance", mean)
    square = F.aggregate("drops", F.lit(0.0), lambda a, v: a + (v - F.col("importance")) * (v - F.col("importance")))
    return out.select("hashvin", "feature", "importance", F.sqrt(square / max(shuffles - 1, 1)).alias("deviation"), "n")


def precision_gap(model: PipelineModel, rows: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(n, mean_gap, max_gap): differences of a model's predictions on its inputs and on inputs cut to single precision."""
    single = rows.withColumns({c: F.col(c).cast("float").cast("double") for c in numeric})
    a = model.transform(rows).select("row_id", F.col("prediction").alias("a"))
    b = model.transform(single).select("row_id", F.col("prediction").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return a.join(b, "row_id").agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def leaderboard(train: DataFrame, test: DataFrame, numeric: Sequence[str], texts: Sequence[str] = (), trees: int = 50, rounds: int = 20) -> DataFrame:
    """(model, test_accuracy, test_balanced, fit_seconds, score_seconds, n_train, n_test, n_features, parameters, rank), best first."""
    fits = {
        "logistic": LogisticRegression(labelCol="label", maxIter=100),
        "forest": RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=5, maxBins=MOST_BINS, seed=42),
        "boosted": GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=4, maxBins=MOST_BINS, seed=42),
    }
    n_train, n_test, rows = train.count(), test.count(), []
    for name, fit in fits.items():
        began = time.monotonic()
        model = Pipeline(stages=[*assembled(numeric, texts), fit]).fit(train)
        fitted = time.monotonic()
        per = model.transform(test).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("int")).alias("hits")).collect()  # a row per class
        last = model.stages[-1]
        size = sum(t.numNodes for t in last.trees) if name != "logistic" else last.numFeatures + 1
        hits, n = sum(r.hits for r in per), sum(r.n for r in per)
        rows.append((name, hits / n if n else None, sum(r.hits / r.n for r in per) / len(per) if per else None, fitted - began, time.monotonic() - fitted, n_train, n_test, len(numeric) + len(texts), int(size)))
    out = train.sparkSession.createDataFrame(rows, "model string, test_accuracy double, test_balanced double, fit_seconds double, score_seconds double, n_train bigint, n_test bigint, n_features int, parameters bigint")
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("test_accuracy"), "model")))  # three rows


def keyed_logit(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ("hashvin",), label: str = "label", ridge: float = 1.0, rounds: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, status, n, positives, coefficients, mean, sd, rounds): a logistic model per key, by iteratively reweighted least squares.

    Features are filled with the key's mean, scaled by the key's mean and deviation (0 counts
    as 1), and ``coefficients`` (the constant first) are for those; ``ridge`` penalises all but the constant.  A key
    with one label is ``skipped`` with null coefficients, one that ``rounds`` do not settle is ``unsettled``.

    Rows are packed once into blocks of a key.  A key of one block is fitted where the block is.  Of others, a round gives every block its key's coefficients, adds up
    the normal equations of the blocks, and solves them by key; settled keys take no further part.
    """
    folder, ks, d = work_folder(rows), list(keys), len(features)
    rows = rows.filter(F.col(label).isNotNull())
    whole = rows.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("positives"), F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in features]).alias("mean"),
        F.array(*[F.coalesce(F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)), F.lit(1.0)) for c in features]).alias("sd"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"),
    )
    whole = written(whole, folder)
    both = whole.filter("positives > 0 AND positives < n")
    x = F.array(*[F.coalesce((F.col(c).cast("double") - F.col("mean")[i]) / F.col("sd")[i], F.lit(0.0)) for i, c in enumerate(features)])
    row = F.struct(F.col(label).cast("double").alias("y"), x.alias("x")).alias("row")
    dealt = rows.join(both.select(*ks, "mean", "sd", "blocks"), ks).select(*ks, "blocks", F.pmod(F.xxhash64(*rows.columns), F.col("blocks")).alias("block"), row)
    packed = dealt.groupBy(*ks, "blocks", "block").agg(F.collect_list("row").alias("rows"))
    packed = written(packed.select(*ks, "blocks", F.transform("rows", lambda r: r["y"]).alias("y"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("x")), folder)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in ks)

    penalty = np.full(d + 1, ridge)
    penalty[0] = 0

    def normal(y: np.ndarray, flat: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.column_stack([np.ones(len(y)), np.asarray(flat).reshape(len(y), -1)])
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        return a.T @ (np.asarray(y) - p), (a * (p * (1 - p))[:, None]).T @ a

    def moved_by(gradient: np.ndarray, hessian: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, bool]:
        step = np.linalg.solve(hessian + np.diag(penalty + 1e-9), gradient - penalty * beta)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-300))  # no leap out of the range of the curve
        return beta + step, bool(np.abs(step).max() < 1e-9)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            out: dict = {k: some[k].astype(object) for k in ks} | {"beta": [], "rounds": [], "status": []}
            for y, flat in zip(some["y"], some["x"]):
                beta, still, i = np.zeros(d + 1), False, 0
                while i < rounds and not still:
                    beta, still = moved_by(*normal(y, flat, beta), beta)
                    i += 1
                for name, value in zip(("beta", "rounds", "status"), (beta, i, "trained" if still else "unsettled")):
                    out[name].append(value)
            yield pd.DataFrame(out)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            out: dict = {k: some[k].astype(object) for k in ks} | {"gradient": [], "hessian": []}
            for y, flat, beta in zip(some["y"], some["x"], some["beta"]):
                gradient, hessian = normal(y, flat, beta)
                out["gradient"].append(gradient)
                out["hessian"].append(hessian.ravel())
            yield pd.DataFrame(out)

    def solved(parts: pd.DataFrame) -> pd.DataFrame:
        gradient = np.sum(np.stack(parts["gradient"].to_numpy()), axis=0)
        hessian = np.sum(np.stack(parts["hessian"].to_numpy()), axis=0).reshape(d + 1, d + 1)
        beta, still = moved_by(gradient, hessian, np.asarray(parts["beta"].iloc[0]))
        return pd.DataFrame([(*parts[ks].iloc[0], beta, still)], columns=[*ks, "beta", "still"])

    zero = F.array_repeat(F.lit(0.0), d + 1)
    fits = written(packed.filter("blocks = 1").drop("blocks").mapInPandas(fitted, f"{kinds}, beta array<double>, rounds int, status string"), folder)
    open_, settled, i = written(both.filter("blocks > 1").select(*ks, zero.alias("beta")), folder), [], 0
    while i < rounds and not open_.isEmpty():
        i += 1
        sums = packed.join(open_, ks).select(*ks, "y", "x", "beta").mapInPandas(equations, f"{kinds}, gradient array<double>, hessian array<double>")
        moved = written(sums.join(open_, ks).groupBy(*ks).applyInPandas(solved, f"{kinds}, beta array<double>, still boolean"), folder)
        forget(open_)
        settled.append(moved.filter("still").select(*ks, "beta", F.lit(i).alias("rounds"), F.lit("trained").alias("status")))
        open_ = written(moved.filter("NOT still").drop("still"), folder)
    for part in [open_.select(*ks, "beta", F.lit(i).alias("rounds"), F.lit("unsettled").alias("status")), *settled]:
        fits = fits.unionByName(part)
    out = whole.drop("blocks").join(fits, ks, "left")
    return out.select(*ks, F.coalesce("status", F.lit("skipped")).alias("status"), "n", "positives", F.col("beta").alias("coefficients"), "mean", "sd", "rounds")


def keyed_scores(models: DataFrame, rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ("hashvin",)) -> DataFrame:
    """``rows`` with proba by their key's model; null where it has none."""
    x = F.array(*[F.coalesce((F.col(c).cast("double") - F.col("mean")[i]) / F.col("sd")[i], F.lit(0.0)) for i, c in enumerate(features)])
    z = F.aggregate(F.zip_with(F.slice("coefficients", 2, len(features)), x, lambda b, v: b * v), F.col("coefficients")[0], lambda s, v: s + v)
    return rows.join(models.select(*keys, "coefficients", "mean", "sd"), list(keys), "left").withColumn("proba", 1 / (1 + F.exp(-z))).drop("coefficients", "mean", "sd")


def feature_impact(model: PipelineModel, rows: DataFrame, train: DataFrame, numeric: Sequence[str], texts: Sequence[str] = (), top: int = 5) -> DataFrame:
    """(row_id, feature, impact): change of the top class's probability when a feature takes its usual training value (median, or most frequent text); the ``top`` largest per row.

    A label without a probability is an error.
    """
    columns = [*numeric, *texts]
    usual = train.agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(c) for c in numeric], *[F.mode(c, True).alias(c) for c in texts]).first()
    prepare, last, places = _parts(model)
    single = train.sparkSession.createDataFrame([tuple(usual[c] for c in columns)], ", ".join(f"`{c}` {'double' if c in numeric else 'string'}" for c in columns))
    usual_x = prepare.transform(single).select(vector_to_array("features")).first()[0]  # one row
    asked = last.transform(prepare.transform(rows).select("row_id", "features"))
    asked = asked.select("row_id", F.col("prediction").cast("int").alias("k"), vector_to_array("probability").alias("p"), vector_to_array("features").alias("x"))
    if asked.filter("k >= size(p)").limit(1).count():
        raise ValueError("a predicted label has no probability")
    altered = _altered(asked.withColumn("y", F.array(*map(F.lit, usual_x))), columns, places, "y", ["row_id", "k", "p"])
    out = last.transform(altered.withColumnsRenamed({"p": "__p"})).select("row_id", "feature", (F.element_at("__p", F.col("k") + 1) - F.element_at(vector_to_array("probability"), F.col("k") + 1)).alias("impact"))
    w = W.partitionBy("row_id").orderBy(F.desc(F.abs("impact")), "feature")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
