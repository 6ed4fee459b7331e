"""Evaluation of scored classes, scored candidates and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hit() -> Column:
    return (F.col("y_class") == F.col("y_pred")).cast("double")


def accuracies(scored: DataFrame, head: DataFrame, by: list[str]) -> DataFrame:
    """top1 and balanced accuracy over all rows and over rows whose truth is in ``head`` (null if none).

    scored: by.., hashvin, y_class, y_pred.  head: hashvin, place.
    """
    marked = scored.join(head.select("hashvin", F.col("place").alias("y_class"), F.lit(True).alias("in_head")), ["hashvin", "y_class"], "left")
    per = marked.groupBy(*by, "y_class", "in_head").agg(F.avg(hit()).alias("recall"), F.sum(hit()).alias("hits"), F.count(F.lit(1)).alias("n"))
    in_head = F.col("in_head").isNotNull()
    return per.groupBy(*by).agg(
        (F.sum("hits") / F.sum("n")).alias("top1"), (F.sum(F.when(in_head, F.col("hits"))) / F.sum(F.when(in_head, F.col("n")))).alias("top1_head"),
        F.avg("recall").alias("balanced"), F.avg(F.when(in_head, F.col("recall"))).alias("balanced_head"),
    )


def head_recalls(scored: DataFrame, head: DataFrame) -> DataFrame:
    """(hashvin, head_rank, place, recall): null for places that no row has."""
    per = scored.groupBy("hashvin", F.col("y_class").alias("place")).agg(F.avg(hit()).alias("recall"))
    return head.select("hashvin", "head_rank", "place").join(per, ["hashvin", "place"], "left")


def head_confusion(scored: DataFrame, head: DataFrame) -> DataFrame:
    """(hashvin, truth_rank, pred_rank, n) for all pairs of a vehicle's HEAD places."""
    t, p = (head.select("hashvin", F.col("head_rank").alias(f"{x}_rank"), F.col("place").alias(x)) for x in ("truth", "pred"))
    n = scored.groupBy("hashvin", F.col("y_class").alias("truth"), F.col("y_pred").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return t.join(p, "hashvin").join(n, ["hashvin", "truth", "pred"], "left").na.fill(0, ["n"]).select("hashvin", "truth_rank", "pred_rank", "n")


def threshold_metrics(scored: DataFrame, taus=(0.5, 0.7, 0.9)) -> DataFrame:
    """(tau, coverage, accuracy, n) of rows whose probability reaches tau."""
    x = scored.select("proba", hit().alias("hit"), F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    over = F.col("proba") >= F.col("tau")
    return x.groupBy("tau").agg(F.avg(over.cast("double")).alias("coverage"), F.avg(F.when(over, F.col("hit"))).alias("accuracy"), F.count_if(over).alias("n"))


def class_stats(scored: DataFrame, head: DataFrame, keys: tuple[str, ...] = ("y_class",)) -> DataFrame:
    """Per class: is_head, count and share, counts by split, hits and misses on test, accuracy."""
    is_head = head.select(F.col("place").alias("y_class")).distinct().withColumn("is_head", F.lit(True))
    test = F.col("split") == "test"
    x = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "valid", "test")],
        F.count_if(test & (F.col("y_class") == F.col("y_pred"))).alias("hits"), F.count_if(test & (F.col("y_class") != F.col("y_pred"))).alias("misses"),
    )
    other = W.partitionBy(*[k for k in keys if k != "y_class"])
    x = x.withColumns({"share": F.col("n") / F.sum("n").over(other), "accuracy": F.try_divide("hits", F.col("hits") + F.col("misses"))})
    return x.join(is_head, "y_class", "left").withColumn("is_head", F.coalesce("is_head", F.lit(False)))


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by.., auc) from average ranks of ``proba``; null with one class only."""
    w = W.partitionBy(*by).orderBy("proba")
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, "proba"))
    x = scored.withColumn("r", F.rank().over(w) + (ties - 1) / 2)
    s = x.groupBy(*by).agg(F.sum(F.when(F.col("label") == 1, F.col("r"))).alias("s"), F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("q"))
    return s.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def session_top1(scored: DataFrame) -> DataFrame:
    """Each session's candidate with the highest probability; the first by place on ties."""
    w = W.partitionBy("session_uid").orderBy(F.desc("proba"), "place")
    return scored.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def candidate_coverage(scored: DataFrame, by: list[str]) -> DataFrame:
    per = scored.groupBy(*by, "session_uid").agg(F.max("label").alias("found"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.avg("found").alias("coverage"), F.avg("n").alias("mean_candidates"))


def regression(rows: DataFrame, *by: str) -> DataFrame:
    """rmse, mae and r2 of (truth, prediction)."""
    e = F.col("truth") - F.col("prediction")
    g = rows.groupBy(*by) if by else rows
    return g.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop("truth") * F.count("truth"))).alias("r2"))


def residual_histogram(rows: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n): residuals in ``bins`` equal steps between the least and the most."""
    x = rows.select((F.col("truth") - F.col("prediction")).alias("e"))
    span = x.agg(F.min("e").alias("a"), F.max("e").alias("b"))
    x = x.join(F.broadcast(span))
    place = F.least(F.lit(bins - 1), F.floor((F.col("e") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)))
    return x.select(F.when(F.col("b") > F.col("a"), place).otherwise(0).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys that ``new`` has, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
