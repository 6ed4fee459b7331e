"""Day patterns: scaling, keyed k-means, density groups, quality scores and profiles.

Days are rows (key, day, vector) with ``key`` a vehicle; all vehicles are clustered in
one job.  Distances are taken within a key only; where all pairs of a key are needed
(silhouette, core distances, links), its days are dealt to blocks, a task compares two blocks with
numpy, and only sums, nearest distances or one link per day leave it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Days of a block; a task holds one, or compares two.
BLOCK_DAYS = 2_000
#: Numbers that a task compares at once.
CELLS = 1 << 22
#: Blocks of a key that meet in groups of copies; more meet as a Cartesian product.
MANY_BLOCKS = 8
#: Blocks of a file of that product, some.
FILE_BLOCKS = 4


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def standardize(long: DataFrame) -> DataFrame:
    """Rows (key, day, feature, value) with z, scaled per key and feature over all days of the key, and z_absent, what a day without the feature has.

    A day that lacks a feature counts as 0: the moments of the rows that exist are merged
    with those of so many zeros, and no row is made for them.  A deviation of 0 counts as 1.
    """
    z = lambda x: (x - F.col("mean")) / F.col("sd")
    return long.join(scales(long), ["key", "feature"]).withColumns({"z": z(F.col("value")), "z_absent": z(F.lit(0.0))}).drop("mean", "sd")


def mean_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """Component-wise means of ``vector`` by ``keys``, as arrays."""
    parts = rows.select(*keys, F.posexplode("vector").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def written(df: DataFrame, folder: str) -> DataFrame:
    """The table written to the shared folder and reread, which cuts its lineage."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that no later step reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def work_folder(df: DataFrame) -> str:
    """A folder that all executors share: under spark.checkpoint.dir, or local where that is unset in a local session."""
    context = df.sparkSession.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{top.rstrip('/')}/patterns" if top else f"file://{tempfile.mkdtemp(prefix='spark-patterns-')}"


def placed(days: DataFrame) -> DataFrame:
    """(key, day, vector) of days with ``held``, their (i, x), and ``base``, what a component has that is not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, held = batch["base"], batch["held"]
            flat, starts = base.flatten().to_numpy(zero_copy_only=False).copy(), np.asarray(base.offsets)[:-1] - base.offsets[0].as_py()
            sizes = np.diff(np.asarray(held.offsets))
            pairs = held.flatten()
            flat[np.repeat(starts, sizes) + pairs.field("i").to_numpy(zero_copy_only=False)] = pairs.field("x").to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(starts, len(flat)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["day"], pa.ListArray.from_arrays(offsets, pa.array(flat))], ["key", "day", "vector"])

    kinds = ", ".join(f"{c} {days.schema[c].dataType.simpleString()}" for c in ("key", "day"))
    return days.select("key", "day", "held", "base").mapInArrow(run, f"{kinds}, vector array<double>")


def dense(long: DataFrame) -> DataFrame:
    """(key, day, vector) of long rows (key, day, feature, value): a component per feature of the key, in order of its name, 0 where a day lacks it."""
    order = W.partitionBy("key").orderBy("feature")
    names = long.select("key", "feature").distinct().select("key", "feature", (F.row_number().over(order) - 1).alias("i"))
    base = names.groupBy("key").agg(F.array_repeat(F.lit(0.0), F.count(F.lit(1)).cast("int")).alias("base"))
    days = long.join(names, ["key", "feature"]).groupBy("key", "day").agg(F.collect_list(F.struct("i", F.coalesce("value", F.lit(0.0)).alias("x"))).alias("held"))
    return placed(days.join(base, "key"))


def scales(long: DataFrame) -> DataFrame:
    """(key, feature, mean, sd) over all days of a key, of which those without the feature count as 0."""
    days = long.select("key", "day").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("days"))
    held = long.groupBy("key", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).join(days, "key")
    mean = F.col("n") * F.col("m") / F.col("days")
    spread = F.sqrt((F.col("n") * F.col("v") + F.col("m") * F.col("m") * F.col("n") * (F.col("days") - F.col("n")) / F.col("days")) / F.col("days"))
    return held.select("key", "feature", mean.alias("mean"), F.when(spread == 0, 1.0).otherwise(spread).alias("sd"))


def standard_vectors(long: DataFrame) -> DataFrame:
    """``scaled(dense(long))``, scaled by the moments of the long rows before vectors are made."""
    order = W.partitionBy("key").orderBy("feature")
    scale = scales(long).select("key", "feature", "mean", "sd", (F.row_number().over(order) - 1).alias("i"))
    absent = F.array_sort(F.collect_list(F.struct("i", (-F.col("mean") / F.col("sd")).alias("z"))))
    base = scale.groupBy("key").agg(absent["z"].alias("base"))
    z = ((F.col("value") - F.col("mean")) / F.col("sd")).alias("x")
    days = long.join(scale, ["key", "feature"]).groupBy("key", "day").agg(F.collect_list(F.struct("i", z)).alias("held"))
    return placed(days.join(base, "key"))


def scaled(days: DataFrame) -> DataFrame:
    """(key, day, vector) scaled per key and component by mean and population deviation (0 counts as 1)."""
    parts = days.select("key", F.posexplode("vector").alias("i", "x")).groupBy("key", "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    scale = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "mean", "sd"))).alias("scale"))
    one = lambda x, s: (x - s["mean"]) / F.when(s["sd"] == 0, 1.0).otherwise(s["sd"])
    return days.join(scale, "key").select("key", "day", F.zip_with("vector", "scale", one).alias("vector"))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b`` by one product of matrices; what lies within its rounding error counts as 0."""
    middle = a.mean(axis=0) if len(a) else 0.0
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    far = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    far[far < 1e-13 * (aa.max(initial=0.0) + bb.max(initial=0.0))] = 0
    return far


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``centres`` to each of ``vectors``, and its squared distance."""
    label, d2 = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    step = max(1, CELLS // max(1, len(centres)))
    for at in range(0, len(vectors), step):
        far = squares(vectors[at : at + step], centres)
        label[at : at + step] = far.argmin(axis=1)
        d2[at : at + step] = far.min(axis=1)
    return label, d2


def drawn(hashes: np.ndarray, run: int, turn: int) -> np.ndarray:
    """A number in (0, 1) for each hash, other for each run and turn."""
    x = hashes.view(np.uint64) + np.uint64((run * 1000 + turn + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def reclustered(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of weighted candidates: each drawn by weight and squared distance to those before, then moved to their means."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < k:
        lot = weights * nearest(candidates, candidates[chosen])[1]
        chosen.append(int(rng.choice(len(candidates), p=lot / lot.sum())) if lot.sum() > 0 else chosen[0])
    centres = candidates[chosen]
    for _ in range(20):
        one = np.eye(k)[nearest(candidates, centres)[0]] * weights[:, None]
        moved = np.where(one.sum(axis=0)[:, None] > 0, one.T @ candidates / np.maximum(one.sum(axis=0), 1e-300)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def lloyd(vectors: np.ndarray, weights: np.ndarray, centres: np.ndarray, rounds: int, rtol: float, atol: float, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Centres (run, k, component) of several runs moved to the means of their ``weights`` (run, day) until they are still, and which runs are.

    A still run ends with its ``last`` centres or those before them.
    """
    k, size = centres.shape[1:]
    centres, open_ = centres.copy(), np.arange(len(centres))
    for _ in range(rounds):
        old = centres[open_]
        label = squares(vectors, old.reshape(-1, size)).reshape(len(vectors), len(open_), k).argmin(axis=2)
        one = (label[:, :, None] == np.arange(k)) * weights[open_].T[:, :, None]
        n = one.sum(axis=0)[:, :, None]
        moved = np.where(n > 0, (one.reshape(len(vectors), -1).T @ vectors).reshape(old.shape) / np.maximum(n, 1e-300), old)
        still = (np.abs(moved - old) <= atol + rtol * np.abs(old)).all(axis=(1, 2))
        centres[open_] = moved if last else np.where(still[:, None, None], old, moved)
        open_ = open_[~still]
        if not len(open_):
            break
    settled = np.ones(len(centres), bool)
    settled[open_] = False
    return centres, settled


def lots_of(d2: np.ndarray, hashes: np.ndarray, run: int, turn: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The days with the highest lots of a turn of seeding, and those lots."""
    some = np.flatnonzero(d2 > 0)
    lot = np.log(drawn(hashes[some], run, turn)) / d2[some]
    top = np.argsort(-lot, kind="stable")[:wanted]
    return some[top], lot[top]


def kmeans_of_block(vectors: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ks: list[int], rounds: int, seed: int, turns: int, wanted: int) -> dict[int, np.ndarray]:
    """Labels by k of one key's days, all in one block: the seeding, steps and choice of ``day_kmeans``, with all restarts of a k at once.

    ``starts`` holds the order number of every day in every restart.  Vectors of more components than days are turned into as many, which
    keeps all distances.
    """
    if len(vectors) < vectors.shape[1]:
        vectors = np.linalg.qr((vectors - vectors.mean(axis=0)).T, mode="r").T
    far, restarts = squares(vectors, vectors), starts.shape[1]
    pools, weights = [], np.zeros((restarts, len(vectors)))
    for run in range(restarts):
        pool = np.array([starts[:, run].argmin()])
        for turn in range(turns):
            pool = np.concatenate([pool, lots_of(far[:, pool].min(axis=1), hashes, run, turn, wanted)[0]])
        np.add.at(weights[run], pool[far[:, pool].argmin(axis=1)], 1.0)
        pools.append(pool)
    size = max(map(len, pools))
    held = np.stack([np.pad(p, (0, size - len(p)), mode="edge") for p in pools])
    lot = np.take_along_axis(weights, held, axis=1) * (np.arange(size) < np.array([[len(p)] for p in pools]))
    out, every = {}, np.arange(restarts)
    for k in ks:
        uniform = np.stack([np.random.default_rng([seed, run, k]).random(k) for run in range(restarts)])
        drawn_by = lambda w, j: ((w.cumsum(axis=1) / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)) <= uniform[:, j : j + 1]).sum(axis=1).clip(max=size - 1)
        chosen = [drawn_by(lot, 0)]
        d2 = far[held[every, chosen[0]][:, None], held]
        for j in range(1, k):
            more = lot * d2
            chosen.append(np.where(more.sum(axis=1) > 0, drawn_by(more, j), chosen[0]))
            d2 = np.minimum(d2, far[held[every, chosen[-1]][:, None], held])
        centres = vectors[held[every[:, None], np.stack(chosen, axis=1)]]
        centres = lloyd(vectors, weights, centres, 20, 1e-5, 1e-8, last=False)[0]
        centres, settled = lloyd(vectors, np.ones_like(weights), centres, rounds, 0, 1e-9, last=True)
        if not settled.all():
            raise RuntimeError(f"k-means needs more than {rounds} rounds")
        d2 = squares(vectors, centres.reshape(restarts * k, -1)).reshape(len(vectors), restarts, k)
        best = np.round(d2.min(axis=2).sum(axis=0), 9).argmin()
        out[k] = d2[:, best].argmin(axis=1)
    return out


def kmeans_of_blocks(days: DataFrame, ks: tuple[int, ...], restarts: int, rounds: int, seed: int, turns: int) -> DataFrame:
    """``day_kmeans`` of keys (key, day, vector, h) that a block holds whole."""
    key_type, day_type = (days.schema[c].dataType.simpleString() for c in ("key", "day"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(restarts - 1)), lambda run: F.xxhash64("h", run))

    def work(here: pd.DataFrame) -> pd.DataFrame:
        here = here.sort_values("day", kind="stable")
        fit = [k for k in ks if k < len(here)]
        vectors, order = np.stack(here["vector"].to_numpy()), np.stack(here["starts"].to_numpy())
        labels = kmeans_of_block(vectors, here["h"].to_numpy(), order, fit, rounds, seed, turns, 2 * max(ks))
        day, n = np.tile(here["day"].to_numpy(), len(fit)), len(fit) * len(here)
        return pd.DataFrame({"key": pd.Series([here["key"].iloc[0]] * n, dtype=object), "k": np.repeat(np.array(fit, np.int32), len(here)), "day": day, "label": np.concatenate([labels[k] for k in fit]).astype(np.int32)})

    return days.withColumn("starts", starts).groupBy("key").applyInPandas(work, f"key {key_type}, k int, day {day_type}, label int")


def day_kmeans(days: DataFrame, ks: tuple[int, ...] = tuple(range(3, 11)), restarts: int = 10, rounds: int = 300, seed: int = 42, turns: int = 3) -> DataFrame:
    """(key, k, day, label): per key and k the labels of the restart with least inertia.

    Seeding (k-means||): a restart of a key begins with one day and in each of ``turns``
    turns adds twice the largest k of days, drawn by their squared distance to those it has.  A
    day's lot is the logarithm of a hash over its squared distance, and the highest lots win, so
    blocks pass on their highest and no total is needed.  The candidates, weighted by the days
    nearest to them, are clustered to each k in one task.

    Lloyd's steps run for all keys, ks and restarts at once, until no centre of any moves;
    runs that are settled take no further part.  A k needs more than k days.  Raises if
    ``rounds`` are not enough.  A key of one block is clustered where the block is, by the same draws and
    steps, and passes on labels only.  Of keys with more blocks, a task gets a block of a key's days and the centres of its runs,
    and passes on sums by label; one task per run adds those up.  Tables of earlier steps are deleted.
    """
    folder = work_folder(days)
    days = written(days.select("key", "day", "vector"), folder)  # counted first, then clustered
    n = days.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sizes = n.filter(F.col("n") > min(ks)).select("key", F.ceil(F.col("n") / BLOCK_DAYS).cast("int").alias("blocks"))
    sizes = written(sizes, folder)
    blocks = sizes.filter("blocks > 1")
    hashed = days.select("key", "day", "vector", F.xxhash64("day", F.lit(seed)).alias("h"))
    whole = kmeans_of_blocks(hashed.join(sizes.filter("blocks = 1").select("key"), "key"), ks, restarts, rounds, seed, turns)
    if blocks.isEmpty():
        return whole
    dealt = hashed.join(blocks, "key").select("key", "day", "vector", "h", F.pmod(F.xxhash64("day"), F.col("blocks")).cast("int").alias("block"))
    dealt = written(dealt, folder)
    key_type, day_type = (days.schema[c].dataType.simpleString() for c in ("key", "day"))
    run_type = f"key {key_type}, k int, run int"
    wanted = 2 * max(ks)

    def met(runs: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on each block of days with all runs of its key."""
        everywhere = runs.join(blocks, "key").select(*runs.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return dealt.groupBy("key", "block").cogroup(everywhere.groupBy("key", "block")).applyInPandas(work, schema)

    def lots(turn: int):
        def work(here: pd.DataFrame, pools: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(here):
                vectors, hashes = np.stack(here["vector"].to_numpy()), here["h"].to_numpy()
                for r in pools.itertuples():
                    found = lots_of(nearest(vectors, np.stack(r.candidates))[1], hashes, r.run, turn, wanted)
                    out += [(r.key, r.run, lot, vectors[i]) for i, lot in zip(*found)]
            return pd.DataFrame(out, columns=["key", "run", "lot", "vector"])

        return work

    def nearby(here: pd.DataFrame, pools: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here):
            vectors = np.stack(here["vector"].to_numpy())
            for r in pools.itertuples():
                candidates = np.stack(r.candidates)
                out.append((r.key, r.run, candidates.ravel(), np.bincount(nearest(vectors, candidates)[0], minlength=len(candidates)).astype(float)))
        return pd.DataFrame(out, columns=["key", "run", "flat", "weights"])

    def seeds(parts: pd.DataFrame) -> pd.DataFrame:
        key, run = parts["key"].iloc[0], int(parts["run"].iloc[0])
        weights = np.sum(np.stack(parts["weights"].to_numpy()), axis=0)
        candidates = np.asarray(parts["flat"].iloc[0]).reshape(len(weights), -1)
        made = [(key, k, run, list(reclustered(candidates, weights, k, np.random.default_rng([seed, run, k])))) for k in ks if k < weights.sum()]
        return pd.DataFrame(made, columns=["key", "k", "run", "centres"])

    runs = blocks.select("key", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("run"))
    # the first candidate of a restart: the day with the least hash for it, found by partial minima
    one = dealt.select("key", "vector", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("run"), "h").groupBy("key", "run").agg(F.min_by("vector", F.xxhash64("h", "run")).alias("v"))
    pools = written(runs.join(one, ["key", "run"]).select("key", "run", F.array("v").alias("candidates")), folder)
    for turn in range(turns):
        best = met(pools, lots(turn), f"key {key_type}, run int, lot double, vector array<double>").groupBy("key", "run").agg(F.slice(F.sort_array(F.collect_list(F.struct("lot", "vector")), asc=False), 1, wanted).alias("best"))
        more = F.concat("candidates", F.coalesce(F.transform("best", lambda b: b["vector"]), F.array().cast("array<array<double>>")))
        grown = written(pools.join(best, ["key", "run"], "left").select("key", "run", more.alias("candidates")), folder)
        forget(pools)
        pools = grown
    weighed = met(pools, nearby, f"key {key_type}, run int, flat array<double>, weights array<double>")
    open_, settled = written(weighed.groupBy("key", "run").applyInPandas(seeds, f"{run_type}, centres array<array<double>>"), folder), None
    forget(pools)

    def sums(here: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here):
            vectors = np.stack(here["vector"].to_numpy())
            for r in runs.itertuples():
                centres = np.stack(r.centres)
                one = np.eye(r.k)[nearest(vectors, centres)[0]]
                out.append((r.key, r.k, r.run, (one.T @ vectors).ravel(), one.sum(axis=0), centres.ravel()))
        return pd.DataFrame(out, columns=["key", "k", "run", "total", "n", "old"])

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        k = int(parts["k"].iloc[0])
        total, n, old = np.sum(np.stack(parts["total"].to_numpy()), axis=0).reshape(k, -1), np.sum(np.stack(parts["n"].to_numpy()), axis=0)[:, None], parts["old"].iloc[0].reshape(k, -1)
        new = np.where(n > 0, total / np.maximum(n, 1), old)
        return pd.DataFrame([(*parts[["key", "k", "run"]].iloc[0], list(new), bool(np.allclose(new, old, rtol=0, atol=1e-9)))], columns=["key", "k", "run", "centres", "still"])

    for _ in range(rounds):
        parts = met(open_, sums, f"{run_type}, total array<double>, n array<double>, old array<double>")
        moved = written(parts.groupBy("key", "k", "run").applyInPandas(merged, f"{run_type}, centres array<array<double>>, still boolean"), folder)
        done = moved.filter("still").drop("still")
        settled = done if settled is None else settled.unionByName(done)
        open_ = moved.filter("NOT still").drop("still")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"k-means needs more than {rounds} rounds")

    def labelled(here: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here):
            vectors = np.stack(here["vector"].to_numpy())
            for r in runs.itertuples():
                label, d2 = nearest(vectors, np.stack(r.centres))
                out.append((r, label, d2))
        times = lambda f, kind: np.repeat(np.array([f(r) for r, _, _ in out], kind), len(here))
        whole = lambda i, kind: np.concatenate([x[i] for x in out]).astype(kind) if out else np.zeros(0, kind)
        day = np.tile(here["day"].to_numpy(), len(out))
        return pd.DataFrame({"key": pd.Series(times(lambda r: r.key, object), dtype=object), "k": times(lambda r: r.k, np.int32), "run": times(lambda r: r.run, np.int32), "day": day, "label": whole(1, np.int32), "d2": whole(2, np.float64)})

    last = written(met(settled, labelled, f"{run_type}, day {day_type}, label int, d2 double"), folder)
    cost = last.groupBy("key", "k", "run").agg(F.sum("d2").alias("cost"))
    best = cost.groupBy("key", "k").agg(F.min_by("run", F.struct(F.round("cost", 9), "run")).alias("run"))
    return whole.unionByName(last.join(best, ["key", "k", "run"]).select("key", "k", "day", "label"))


def block_pairs(rows: DataFrame, block_days: int):
    """Rows (key, day, ...) of every two blocks of a key together, each pair of blocks once: groups (key, __one, __other) for ``applyInPandas``."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_days).cast("int").alias("__blocks"))
    dealt = rows.join(blocks, "key").withColumn("__b", F.pmod(F.xxhash64("day"), F.col("__blocks")).cast("int"))
    mine = dealt.select(*rows.columns, F.col("__b").alias("__one"), F.explode(F.sequence(F.col("__b"), F.col("__blocks") - 1)).alias("__other"))
    again = [F.col(c).alias(c) for c in rows.columns]  # columns of their own, since both sides are one table
    theirs = dealt.select(*again, F.explode(F.sequence(F.lit(0), F.col("__b"))).alias("__one"), F.col("__b").alias("__other"))
    group = ["key", "__one", "__other"]
    return mine.groupBy(*group).cogroup(theirs.groupBy(*group))


def distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Euclidean distances (to nine digits) of some rows of ``a``, from each i on, to all of ``b``."""
    step = max(1, CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        yield i, np.round(np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2)), 9)


def core_distances(days: DataFrame, neighbours: int = 3, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(key, day, core): the distance of each day to its ``neighbours``-th nearest other day; days of a key with fewer are left out.

    Each pair of blocks gives each of its days the least distances within it, which merge.
    """

    def least(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            va, vb = np.stack(a["vector"].to_numpy()), np.stack(b["vector"].to_numpy())
            across = np.full((neighbours, len(b)), np.inf)
            for i, far in distances(va, vb):
                if key[1] == key[2]:  # one block with itself, in one order
                    far[np.arange(len(far)), i + np.arange(len(far))] = np.inf
                out += [(key[0], day, near[np.isfinite(near)]) for day, near in zip(a["day"].iloc[i : i + len(far)], np.sort(far, axis=1)[:, :neighbours])]
                across = np.sort(np.concatenate([across, far]), axis=0)[:neighbours]
            if key[1] != key[2]:
                out += [(key[0], day, near[np.isfinite(near)]) for day, near in zip(b["day"], across.T)]
        return pd.DataFrame(out, columns=["key", "day", "near"])

    key_type, day_type = (days.schema[c].dataType.simpleString() for c in ("key", "day"))

    def ordered(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return least(key, a.sort_values("day", kind="stable"), b.sort_values("day", kind="stable"))

    near = block_pairs(days.select("key", "day", "vector"), block_days).applyInPandas(ordered, f"key {key_type}, day {day_type}, near array<double>")
    merged = near.groupBy("key", "day").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, neighbours).alias("near"))  # a few per block
    return merged.filter(F.size("near") == neighbours).select("key", "day", F.col("near")[neighbours - 1].alias("core"))


def density_links(days: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(key, a, b): links that join what days (key, day, vector, core, eps) within mutual reachability ``eps`` join.

    A pair of blocks gives each of its days one link at most, to the least day that it reaches in the two.
    """

    def joined(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": pd.Series([], dtype=object), "a": a["day"].iloc[:0], "b": a["day"].iloc[:0]})
        same = key[1] == key[2]
        a = a.sort_values("day", kind="stable")
        b = a if same else b.sort_values("day", kind="stable")
        ca, cb, eps = a["core"].to_numpy(), b["core"].to_numpy(), a["eps"].iloc[0] + 1e-9
        linked = np.zeros((len(a), len(b)), bool)
        for i, far in distances(np.stack(a["vector"].to_numpy()), np.stack(b["vector"].to_numpy())):
            linked[i : i + len(far)] = (far <= eps) & (ca[i : i + len(far), None] <= eps) & (cb <= eps)
        day = np.concatenate([a["day"].to_numpy(), [] if same else b["day"].to_numpy()]).astype(a["day"].dtype)
        order = np.argsort(day, kind="stable")
        label = np.empty(len(day), np.int64)
        label[order] = np.arange(len(day))  # places in the order of days
        mine, theirs = np.arange(len(a)), np.arange(len(a)) if same else len(a) + np.arange(len(b))
        far_off = len(day)
        while True:
            before = label.copy()
            label[mine] = np.minimum(label[mine], np.where(linked, label[theirs], far_off).min(axis=1))
            label[theirs] = np.minimum(label[theirs], np.where(linked, label[mine][:, None], far_off).min(axis=0))
            while (label[order[label]] < label).any():
                label = label[order[label]]
            if (label == before).all():
                break
        least = day[order[label]]
        told = least != day
        return pd.DataFrame({"key": pd.Series([key[0]] * int(told.sum()), dtype=object), "a": day[told], "b": least[told]})

    key_type, day_type = (days.schema[c].dataType.simpleString() for c in ("key", "day"))
    return block_pairs(days, block_days).applyInPandas(joined, f"key {key_type}, a {day_type}, b {day_type}")


def groups_of_block(vectors: np.ndarray, day: np.ndarray, share: float, neighbours: int, least: int) -> np.ndarray:
    """The labels of ``density_groups`` of one key's days, all in one block and in order."""
    n = len(day)
    if n <= neighbours:
        return np.full(n, -1, day.dtype)
    far = np.concatenate([part for _, part in distances(vectors, vectors)])
    np.fill_diagonal(far, np.inf)
    core = np.partition(far, neighbours - 1, axis=1)[:, neighbours - 1]
    eps = np.quantile(core, share) + 1e-9
    linked = (far <= eps) & (core[:, None] <= eps) & (core <= eps)
    label = np.arange(n)
    while True:
        before = label
        label = np.minimum(label, np.where(linked, label, n).min(axis=1))
        while (label[label] < label).any():
            label = label[label]
        if (label == before).all():
            break
    return np.where(np.bincount(label, minlength=n)[label] >= least, day[label], -1)


def density_groups(days: DataFrame, share: float = 0.9, neighbours: int = 3, least: int = 5, rounds: int = 1000, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(key, day, label): groups of days linked at mutual reachability up to the key's cut-off, -1 for small ones.

    The core distance of a day is that to its third-nearest other day; the cut-off is
    a quantile of the core distances.  Labels are the least day of the group.  A key of one block is grouped where
    the block is.  Pairs of days of others are met in
    blocks, twice: for the core distances, then for the links.  Raises if ``rounds`` don't settle the labels.
    """
    folder = work_folder(days)
    days = written(days.select("key", "day", "vector"), folder)
    large = written(days.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_days).select("key"), folder)
    some = large.isEmpty()
    key_type, day_type = (days.schema[c].dataType.simpleString() for c in ("key", "day"))

    def work(here: pd.DataFrame) -> pd.DataFrame:
        here = here.sort_values("day", kind="stable")
        label = groups_of_block(np.stack(here["vector"].to_numpy()), here["day"].to_numpy(), share, neighbours, least)
        return pd.DataFrame({"key": here["key"], "day": here["day"], "label": label})

    whole = (days if some else days.join(large, "key", "left_anti")).groupBy("key").applyInPandas(work, f"key {key_type}, day {day_type}, label {day_type}")
    if some:
        return whole
    days = days.join(large, "key")
    core = written(core_distances(days, neighbours, block_days), folder)
    eps = core.groupBy("key").agg(F.percentile("core", share).alias("eps"))
    links = density_links(days.join(core, ["key", "day"]).join(eps, "key").filter("core <= eps + 1e-9"), block_days)
    edges = written(links.unionByName(links.select("key", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder)
    labels = written(days.select("key", "day", F.col("day").alias("label")), folder)
    for _ in range(rounds):
        near = edges.join(labels.select("key", F.col("day").alias("b"), F.col("label").alias("l")), ["key", "b"]).groupBy("key", F.col("a").alias("day")).agg(F.min("l").alias("l"))
        lower = labels.join(near, ["key", "day"], "left").withColumn("label", F.least("label", "l"))
        up = lower.select("key", F.col("day").alias("label"), F.col("label").alias("l2"))
        after = written(lower.select("key", "day", "label").join(up, ["key", "label"]).select("key", "day", F.least("label", "l2").alias("label")), folder)
        changed = after.join(labels.withColumnRenamed("label", "old"), ["key", "day"]).filter("label <> old").limit(1).count()
        forget(labels)
        labels = after
        if not changed:
            break
    else:
        raise RuntimeError(f"the groups need more than {rounds} rounds")
    size = F.count(F.lit(1)).over(W.partitionBy("key", "label"))
    return whole.unionByName(labels.withColumn("n", size).select("key", "day", F.when(F.col("n") >= least, F.col("label")).otherwise(F.lit(-1)).alias("label")))


def block_sums(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums of the distances of each day of block ``a`` to the days of ``b`` by its labels, how many they are, and the same of ``b`` to ``a``, or None for ``same`` blocks.

    Blocks hold day, vector, codes (places of their days' labels) and labels.  A day does not meet itself.
    """
    ea, eb = np.eye(len(a["labels"]))[a["codes"]], np.eye(len(b["labels"]))[b["codes"]]
    sums, counts, back = np.zeros((len(ea), eb.shape[1])), np.tile(eb.sum(axis=0), (len(ea), 1)), None if same else np.zeros((len(eb), ea.shape[1]))
    middle = a["vector"].mean(axis=0)
    va, vb = a["vector"] - middle, b["vector"] - middle
    aa, bb, twice = (va * va).sum(axis=1), (vb * vb).sum(axis=1), np.ascontiguousarray(-2 * vb.T)
    step = max(1, CELLS // 16 // len(eb))  # as ``squares``, in one array that stays in a core's cache
    for at in range(0, len(ea), step):
        part = slice(at, at + step)
        far = va[part] @ twice
        far += aa[part, None]
        far += bb
        far[far < 1e-13 * (aa.max() + bb.max())] = 0
        np.sqrt(far, out=far)
        if same:
            other = a["day"][part, None] != b["day"][None, :]
            far, counts[part] = far * other, other @ eb
        else:
            back += far.T @ ea[part]
        sums[part] = far @ eb
    return sums, counts, back


def block_of(day: np.ndarray, label: np.ndarray, vector: np.ndarray) -> dict[str, np.ndarray]:
    labels, codes = np.unique(label, return_inverse=True)
    return {"day": day, "label": label, "vector": vector, "labels": labels, "codes": codes}


def crowd_distances(dealt: DataFrame, ks: list[str]) -> DataFrame:
    """``label_distances`` of keys with many blocks, of rows (keys, __blocks, __b, day, label, vector).

    A block becomes one row of a table in the shared folder, and the table meets itself as a Cartesian product: a task reads a few blocks
    and, one after another, those that they meet, so no vector is shuffled once per block.  A task adds up the sums of its blocks.
    """
    names = ("day", "label", "flat")
    n = dealt.select(*ks, "__b").distinct().count()
    packed = dealt.repartition(-(-n // FILE_BLOCKS), *ks, "__b").groupBy(*ks, "__b").agg(F.collect_list(F.struct("day", "label", "vector")).alias("h"))
    table = written(packed.select(*ks, "__b", F.col("h.day").alias("day"), F.col("h.label").alias("label"), F.flatten("h.vector").alias("flat")), work_folder(dealt))
    mine = table.select(*ks, F.col("__b").alias("__one"), *names)
    theirs = table.select(*[F.col(k).alias(f"__{k}") for k in ks], F.col("__b").alias("__other"), *[F.col(c).alias(f"__{c}") for c in names])
    met = F.col("__one") <= F.col("__other")
    for k in ks:
        met = met & (F.col(k) == F.col(f"__{k}"))
    pairs = mine.join(theirs.hint("shuffle_replicate_nl"), met).drop(*[f"__{k}" for k in ks])
    kinds = {c: dealt.schema[c].dataType.simpleString() for c in (*ks, "day", "label")}
    keyed = ", ".join(f"{k} {kinds[k]}" for k in ks)

    def rows_of(held: dict) -> pd.DataFrame:
        out = []
        for at, (block, sums) in held.items():
            labels = np.array(sorted(sums), block["label"].dtype)
            total, n = (np.stack([sums[x][i] for x in labels.tolist()], axis=1).ravel() for i in (0, 1))
            out.append((*at, block["day"], block["label"], labels, total, n.astype(np.int64)))
        return pd.DataFrame(out, columns=[*ks, "__b", "day", "label", "labels", "total", "n"])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cells = {}, 0
        for frame in frames:
            for r in frame.to_dict("records"):
                key = [r[k] for k in ks]
                one, other = (block_of(r[f"{s}day"], r[f"{s}label"], r[f"{s}flat"].reshape(len(r[f"{s}day"]), -1)) for s in ("", "__"))
                sums, counts, back = block_sums(one, other, r["__one"] == r["__other"])
                sides = [(r["__one"], one, other, sums, counts)]
                if back is not None:
                    sides.append((r["__other"], other, one, back, np.tile(np.bincount(one["codes"]), (len(back), 1))))
                for b, block, of, total, n in sides:
                    into = held.setdefault((*key, b), ({c: block[c].copy() for c in ("day", "label")}, {}))[1]
                    for j, x in enumerate(of["labels"].tolist()):
                        if x not in into:
                            into[x] = np.zeros(len(total)), np.zeros(len(total))
                            cells += len(total)
                        into[x][0][:] += total[:, j]
                        into[x][1][:] += n[:, j]
                if cells > CELLS:
                    yield rows_of(held)
                    held, cells = {}, 0
        yield rows_of(held)

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        labels = np.unique(np.concatenate(parts["labels"].to_list()))
        first = parts.iloc[0]
        total, n = np.zeros((len(first["day"]), len(labels))), np.zeros((len(first["day"]), len(labels)), np.int64)
        for r in parts.itertuples():
            at = np.searchsorted(labels, r.labels)
            total[:, at] += r.total.reshape(len(total), -1)
            n[:, at] += r.n.reshape(len(total), -1)
        i, j = np.nonzero(n)
        return pd.DataFrame({**{k: [first[k]] * len(i) for k in ks}, "x": first["day"][i], "lx": first["label"][i], "ly": labels[j], "d": total[i, j] / n[i, j]})

    partial = f"{keyed}, __b int, day array<{kinds['day']}>, label array<{kinds['label']}>, labels array<{kinds['label']}>, total array<double>, n array<bigint>"
    return pairs.mapInPandas(work, partial).groupBy(*ks, "__b").applyInPandas(merged, f"{keyed}, x {kinds['day']}, lx {kinds['label']}, ly {kinds['label']}, d double")


def label_distances(rows: DataFrame, ks: list[str], block_days: int = BLOCK_DAYS) -> DataFrame:
    """(keys, x, lx, ly, d): mean distance of each day x to the other days of each label of its key.

    A key's days are dealt to blocks by a hash; every two blocks meet once, and their distances
    come from products of matrices and are summed by day and label for both.  Blocks of a key meet in groups, for which each is copied
    once per block; where those would be more than ``MANY_BLOCKS``, by ``crowd_distances``.
    """
    blocks = rows.groupBy(*ks).agg(F.ceil(F.count(F.lit(1)) / block_days).cast("int").alias("__blocks"))
    every = rows.join(blocks, ks).withColumn("__b", F.pmod(F.xxhash64("day"), F.col("__blocks")).cast("int"))
    crowds = not blocks.filter(F.col("__blocks") > MANY_BLOCKS).isEmpty()
    dealt = every.filter(F.col("__blocks") <= MANY_BLOCKS) if crowds else every
    mine = dealt.select(*ks, F.col("__b").alias("__one"), F.explode(F.sequence(F.col("__b"), F.col("__blocks") - 1)).alias("__other"), "day", "label", "vector")
    theirs = dealt.select(*[F.col(k).alias(k) for k in ks], F.explode(F.sequence(F.lit(0), F.col("__b"))).alias("__one"), F.col("__b").alias("__other"), *[F.col(c).alias(c) for c in ("day", "label", "vector")])
    group = [*ks, "__one", "__other"]
    day_type, label_type = rows.schema["day"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in ks] + [f"x {day_type}", f"lx {label_type}", f"ly {label_type}", "total double", "n bigint"])

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        one, other = (block_of(t["day"].to_numpy(), t["label"].to_numpy(), np.stack(t["vector"].to_numpy())) for t in (a, b))
        sums, counts, back = block_sums(one, other, key[-2] == key[-1])  # equal days lie in one block
        out = []
        for t, labels, total, n in [(a, other["labels"], sums, counts)] + ([] if back is None else [(b, one["labels"], back, np.tile(np.bincount(one["codes"]), (len(b), 1)))]):
            i, j = np.nonzero(n)
            out.append(pd.DataFrame({**{k: [v] * len(i) for k, v in zip(ks, key)}, "x": t["day"].to_numpy()[i], "lx": t["label"].to_numpy()[i], "ly": labels[j], "total": total[i, j], "n": n[i, j].astype(np.int64)}))
        return pd.concat(out)

    summed = mine.groupBy(*group).cogroup(theirs.groupBy(*group)).applyInPandas(compare, schema)
    few = summed.groupBy(*ks, "x", "lx", "ly").agg((F.sum("total") / F.sum("n")).alias("d"))
    return few.unionByName(crowd_distances(every.filter(F.col("__blocks") > MANY_BLOCKS), ks)) if crowds else few


def cluster_scores(rows: DataFrame, *keys: str) -> DataFrame:
    """silhouette, calinski_harabasz and davies_bouldin of labelled vectors, by ``keys``.

    rows: keys, day, label, vector.  Null where there is one label only.
    """
    ks = list(keys)
    centre = mean_vectors(rows, *ks, "label").withColumnRenamed("vector", "centre")
    whole = mean_vectors(rows, *ks).withColumnRenamed("vector", "middle")
    near = rows.join(centre, [*ks, "label"]).withColumn("d2", squared(F.col("vector"), F.col("centre")))
    spread = near.groupBy(*ks, "label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"))
    parts = written(spread.join(centre, [*ks, "label"]).join(whole, ks), work_folder(rows))  # a row per label, read several times
    between = parts.groupBy(*ks).agg(F.sum(F.col("n") * squared(F.col("centre"), F.col("middle"))).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    ch = between.select(*ks, F.when(F.col("labels") > 1, (F.col("b") / (F.col("labels") - 1)) / (F.col("w") / (F.col("n") - F.col("labels")))).alias("calinski_harabasz"))
    p, q = (parts.select(*ks, F.col("label").alias(f"label_{x}"), F.col("s").alias(f"s_{x}"), F.col("centre").alias(f"c_{x}")) for x in "pq")
    ratio = (F.col("s_p") + F.col("s_q")) / F.sqrt(squared(F.col("c_p"), F.col("c_q")))
    db = p.join(q, ks).filter("label_p <> label_q").groupBy(*ks, "label_p").agg(F.max(ratio).alias("r")).groupBy(*ks).agg(F.avg("r").alias("davies_bouldin"))
    pair = label_distances(rows, ks)
    own, other = F.max(F.when(F.col("lx") == F.col("ly"), F.col("d"))), F.min(F.when(F.col("lx") != F.col("ly"), F.col("d")))
    per = pair.groupBy(*ks, "x").agg(own.alias("a"), other.alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    sil = per.groupBy(*ks).agg(F.avg(s).alias("silhouette"))
    return sil.join(ch, ks).join(db, ks)


def scores_of(far: np.ndarray, vectors: np.ndarray, label: np.ndarray) -> tuple[float | None, ...] | None:
    """(silhouette, calinski_harabasz, davies_bouldin) of labelled vectors with distances ``far``; None where there is one label only."""
    labels, of = np.unique(label, return_inverse=True)
    if len(labels) < 2:
        return None
    one = np.eye(len(labels))[of]
    n, rows = one.sum(axis=0), np.arange(len(of))
    sums = far @ one
    own = sums[rows, of] / np.maximum(n[of] - 1, 1)
    mean = sums / n
    mean[rows, of] = np.inf
    other = mean.min(axis=1)
    s = np.where(n[of] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    centres = (one.T @ vectors) / n[:, None]
    d2 = ((vectors - centres[of]) ** 2).sum(axis=1)
    between = (n * ((centres - vectors.mean(axis=0)) ** 2).sum(axis=1)).sum() / (len(labels) - 1)
    within = d2.sum() / (len(of) - len(labels)) if len(of) > len(labels) else 0.0
    spread = (np.sqrt(d2) @ one) / n
    apart = np.sqrt(squares(centres, centres))
    np.fill_diagonal(apart, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (spread[:, None] + spread) / apart
    return s.mean(), between / within if within > 0 else None, ratio.max(axis=1).mean()


def scores_by_k(labels: DataFrame, days: DataFrame) -> DataFrame:
    """``cluster_scores`` by key and k of labels (key, k, day, label) of days (key, day, vector).

    A key whose days fit one block is scored for all k where its days are, so no vector is made once per k; others
    are scored by pairs of blocks.
    """
    folder = work_folder(days)
    n = days.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = written(n.filter(F.col("n") > BLOCK_DAYS).select("key"), folder)
    key_type = days.schema["key"].dataType.simpleString()
    names = ["key", "k", "silhouette", "calinski_harabasz", "davies_bouldin"]

    def work(here: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(of):
            here = here.sort_values("day", kind="stable")
            vectors = np.stack(here["vector"].to_numpy())
            far = np.sqrt(squares(vectors, vectors))
            for k, rows in of.groupby("k"):
                at = here["day"].searchsorted(rows["day"])
                found = scores_of(far[np.ix_(at, at)], vectors[at], rows["label"].to_numpy())
                if found:
                    out.append((here["key"].iloc[0], k, *found))
        return pd.DataFrame(out, columns=names)

    some = large.isEmpty()
    if not some:
        labels = written(labels, folder)
    whole, of = (df if some else df.join(large, "key", "left_anti") for df in (days.select("key", "day", "vector"), labels))
    scored = whole.groupBy("key").cogroup(of.groupBy("key")).applyInPandas(work, f"key {key_type}, k int, silhouette double, calinski_harabasz double, davies_bouldin double")
    if some:
        return scored
    rest = labels.join(large, "key").join(days, ["key", "day"])
    return scored.unionByName(cluster_scores(rest, "key", "k").select(*names))


def average_ranks(scores: DataFrame, *keys: str) -> DataFrame:
    """Average-tie ranks of the three scores (davies_bouldin ascending), their mean, and whether the row is its key's first minimum."""
    order = {"silhouette": F.desc("silhouette"), "calinski_harabasz": F.desc("calinski_harabasz"), "davies_bouldin": F.asc("davies_bouldin")}
    ranks = {}
    for c, o in order.items():
        ties = F.count(F.lit(1)).over(W.partitionBy(*keys, c))
        ranks[f"rank_{c}"] = F.rank().over(W.partitionBy(*keys).orderBy(o)) + (ties - 1) / 2
    out = scores.withColumns(ranks)
    out = out.withColumn("mean_rank", sum((F.col(r) for r in ranks), F.lit(0.0)) / 3)
    return out.withColumn("best", F.row_number().over(W.partitionBy(*keys).orderBy("mean_rank", "k")) == 1)


def profiles(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, label, feature, mean) of long rows (key, day, feature, value); label -1 is left out."""
    kept = labels.filter("label <> -1")
    days = kept.groupBy("key", "label").agg(F.count(F.lit(1)).alias("days"))
    sums = long.join(kept, ["key", "day"]).groupBy("key", "label", "feature").agg(F.sum("value").alias("total"))
    return sums.join(days, ["key", "label"]).select("key", "label", "feature", (F.col("total") / F.col("days")).alias("mean"), "days")


def pattern_sizes(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("key", "label").agg(F.count(F.lit(1)).alias("days"))
    return n.withColumn("share", F.col("days") / F.sum("days").over(W.partitionBy("key")))


def nearest_days(long: DataFrame, labels: DataFrame, n: int = 3) -> DataFrame:
    """(key, label, rank, day): the days of long rows (key, day, feature, value) nearest to their pattern's mean, equally near ones by day.

    Values and squared distances count to nine digits.  Both are whole numbers here: of a pattern of N days, N times a value less
    the sum of the pattern's values, squared and summed, is N * N times the distance.  So days that are equally near are equal whatever the order of the sums.
    A day that lacks a feature counts as 0: its distance is that of the mean from 0, with the features that the
    day has put right, so no row is made for the others.
    """
    kept = labels.filter("label <> -1")
    days = kept.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    x = long.select("key", "day", "feature", F.round(F.coalesce("value", F.lit(0.0)) * 1e9).cast("bigint").alias("x")).join(kept, ["key", "day"])
    centre = x.groupBy("key", "label", "feature").agg(F.sum("x").alias("s"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    base = centre.groupBy("key", "label").agg(F.sum(whole("s") * whole("s")).alias("base")).join(days, ["key", "label"])
    # what the features of a day add to N * N times its distance, over N: x * (N * x - 2 * s)
    held = x.join(centre, ["key", "label", "feature"]).join(days, ["key", "label"])
    more = held.groupBy("key", "label", "day").agg(F.sum(whole("x") * (F.col("n") * F.col("x") - 2 * F.col("s")).cast("decimal(19,0)")).alias("more"))
    squares = more.join(base, ["key", "label"]).withColumns({"t": F.expr("base + n * more"), "unit": F.expr("CAST(n AS DECIMAL(19,0)) * n * 1000000000")})
    d2 = squares.withColumn("d2", F.expr("(2 * t + unit) div (2 * unit)"))
    return d2.withColumn("rank", F.row_number().over(W.partitionBy("key", "label").orderBy("d2", "day"))).filter(F.col("rank") <= n).select("key", "label", "rank", "day")
