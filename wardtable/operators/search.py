"""Parameter search, trials, feature elimination and permutation importance.

The driver only decides what to fit next; every fit and every score is Spark work
on one persisted table. Independent candidates run as concurrent jobs.
"""

from __future__ import annotations

import itertools
import json
import logging
import math
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardtable.functions.expressions import col
from wardtable.functions.tables import literal_table
from wardtable.operators import evaluate, models
from wardtable.operators.models import FEATURES, SEED
from wardtable.operators.ordered import HASH_BITS, hash_number

# --- parameter spaces -------------------------------------------------------


@dataclass(frozen=True)
class Uniform:
    """``low`` up to ``low + width``."""

    low: float
    width: float

    def draw(self, rng):
        return float(self.low + self.width * rng.random_sample())


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def draw(self, rng):
        a, b = np.log(self.low), np.log(self.high)
        return float(np.exp(a + (b - a) * rng.random_sample()))


@dataclass(frozen=True)
class IntRange:
    """Whole numbers from ``low`` to ``high``, ``high`` left out."""

    low: int
    high: int

    def draw(self, rng):
        return int(rng.randint(self.low, self.high))


def _draw(space, rng):
    return space.draw(rng) if hasattr(space, "draw") else list(space)[rng.randint(len(space))]


def grid_candidates(space: dict[str, Sequence]) -> list[dict]:
    """Every combination of a space of lists."""
    for name, values in space.items():
        if isinstance(values, str) or not isinstance(values, (list, tuple)):
            raise ValueError(f"grid parameter {name} needs a list of values")
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*space.values())]


def random_candidates(space: dict, n: int, seed: int = SEED) -> list[dict]:
    """``n`` repeatable draws; lists are drawn from evenly."""
    rng = np.random.RandomState(seed)
    return [{name: _draw(s, rng) for name, s in space.items()} for _ in range(n)]


# --- cross-validation -------------------------------------------------------

METRICS = ["f1", "roc_auc", "accuracy", "recall"]


def _in_threads(spark: SparkSession, work: Sequence[Callable], threads: int) -> list:
    """Runs driver calls that submit Spark jobs side by side, results in order."""
    if threads <= 1:
        return [w() for w in work]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]


def cross_validate(
    df: DataFrame, family: str, params: dict, label: str, fold: str = "fold", key: str | None = None
) -> list[dict]:
    """Metrics of one candidate per fold: fit without the fold, score on it.

    The fold predictions are united, so that one job computes every metric of every fold.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # a handful of numbers
    scored = None
    for f in folds:
        model = models.fit(df.filter(col(fold) != f), family, params, label, key)
        part = models.score_rows(model, df.filter(col(fold) == f), label, [fold])
        scored = part if scored is None else scored.unionByName(part)
    rows = evaluate.compare_models(scored, label, "prediction", "score", by=[fold]).collect()
    return [{**r.asDict(), "fold": r[fold]} for r in rows]


def search(
    df: DataFrame,
    family: str,
    candidates: Sequence[dict],
    label: str,
    fold: str = "fold",
    refit: str = "f1",
    key: str | None = None,
    threads: int = 4,
) -> list[dict]:
    """One row per candidate: mean and deviation of each metric over the folds, and rank."""
    for c in candidates:
        models.ignored_parameters(family, c)  # fails on a bad name before any job
    results = _in_threads(
        df.sparkSession, [lambda c=c: cross_validate(df, family, c, label, fold, key) for c in candidates], threads
    )
    rows = []
    for i, (c, per_fold) in enumerate(zip(candidates, results)):
        row = {"candidate": i, "model": family, "params": _text(c)}
        for m in METRICS:
            values = [r[m] for r in per_fold if r[m] is not None]
            row[f"mean_{m}"] = float(np.mean(values)) if values else None
            row[f"std_{m}"] = float(np.std(values)) if values else None
        rows.append(row)
    best_first = sorted((r[f"mean_{refit}"] for r in rows if r[f"mean_{refit}"] is not None), reverse=True)
    for r in rows:
        v = r[f"mean_{refit}"]
        r["rank"] = best_first.index(v) + 1 if v is not None else None
    return rows


def _text(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


_CV_SCHEMA = "candidate int, model string, params string, " + ", ".join(
    f"mean_{m} double, std_{m} double" for m in METRICS
) + ", rank int"


def search_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    names = [p.split(" ")[0] for p in _CV_SCHEMA.split(", ")]
    return literal_table(spark, [tuple(r[n] for n in names) for r in rows], _CV_SCHEMA)


def cv_search(
    df: DataFrame,
    families: dict[str, dict],
    label: str,
    n_iter: int | None = None,
    fold: str = "fold",
    refit: str = "f1",
    seed: int = SEED,
    key: str | None = None,
    threads: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Searches each family; returns the summary and every candidate's result.

    ``families`` maps a family to its space. With ``n_iter`` the space is sampled, otherwise
    every combination is tried. Summary: ``model, best_score, best_params, elapsed_time``.
    """
    spark = df.sparkSession
    plans = {
        f: grid_candidates(space) if n_iter is None else random_candidates(space, n_iter, seed)
        for f, space in families.items()
    }
    summary, table = [], []
    for family, candidates in plans.items():
        start = time.time()
        rows = search(df, family, candidates, label, fold, refit, key, threads)
        best = min(rows, key=lambda r: (r["rank"] is None, r["rank"], r["candidate"]))
        summary.append((family, best[f"mean_{refit}"], best["params"], time.time() - start))
        table += rows
    schema = "model string, best_score double, best_params string, elapsed_time double"
    return literal_table(spark, summary, schema), search_table(spark, table)


# --- trials with two objectives ---------------------------------------------

# The ranges of the three families of the two-objective study.
TRIAL_SPACES = {
    "random_forest": {
        "n_estimators": IntRange(50, 501), "max_depth": IntRange(3, 21), "min_samples_split": IntRange(2, 11),
        "min_samples_leaf": IntRange(1, 11), "bootstrap": [True, False],
    },
    "gradient_boosting": {
        "n_estimators": IntRange(50, 401), "max_depth": IntRange(3, 16), "learning_rate": LogUniform(0.01, 0.2),
        "subsample": Uniform(0.6, 0.4), "colsample_bytree": Uniform(0.6, 0.4), "gamma": Uniform(0.0, 0.5),
        "min_child_weight": IntRange(1, 11), "reg_alpha": LogUniform(0.01, 10.0), "reg_lambda": LogUniform(0.01, 10.0),
        "scale_pos_weight": IntRange(1, 11),
    },
    "svc": {"C": Uniform(0.1, 9.9), "kernel": ["linear", "rbf", "poly"], "gamma": Uniform(0.001, 0.999)},
}

# Fixed value: the trials of each family in that study.
N_TRIALS = 250

LOG = logging.getLogger(__name__)
TRIAL_SCHEMA = "trial_id int, model string, params string, state string, f1 double, log_loss double"


def run_trials(
    train: DataFrame,
    validation: DataFrame,
    family: str,
    space: dict,
    n_trials: int,
    label: str,
    seed: int = SEED,
    key: str | None = None,
    from_labels: bool = False,
    log_path: str | None = None,
    threads: int = 4,
    objective: Callable[[dict], tuple[float, float]] | None = None,
) -> DataFrame:
    """Trial log: F1 (to maximise) and log-loss (to minimise) per sampled candidate.

    ``objective`` replaces fitting and scoring: it gets the sampled parameters and returns both values. A
    failed trial is logged as such, its error goes to the log of this module, and the study goes on. With
    ``log_path`` each finished trial is appended to that parquet table, so a lost driver loses no results.
    """
    candidates = random_candidates(space, n_trials, seed)
    for c in candidates if objective is None else ():
        models.ignored_parameters(family, c)
    spark = train.sparkSession

    def one(i: int, c: dict) -> tuple:
        try:
            if objective is not None:
                f1, loss = objective(dict(c))
                return logged((i, family, _text(c), "COMPLETE", float(f1), float(loss)))
            model = models.fit(train, family, c, label, key)
            scored = models.score_rows(model, validation, label).withColumn("model", F.lit(family))
            if from_labels:
                scored = scored.withColumn("score", F.col("prediction").cast("double"))
            row = evaluate.compare_models(scored, label, "prediction", "score").first()
            result = (i, family, _text(c), "COMPLETE", row["f1"], row["log_loss"])
        except Exception:
            LOG.exception("trial %s of %s failed: %s", i, family, _text(c))
            result = (i, family, _text(c), "FAIL", None, None)
        return logged(result)

    def logged(result: tuple) -> tuple:
        if log_path:
            literal_table(spark, [result], TRIAL_SCHEMA).write.mode("append").parquet(log_path)
        return result

    rows = _in_threads(spark, [lambda i=i, c=c: one(i, c) for i, c in enumerate(candidates)], threads)
    return literal_table(spark, rows, TRIAL_SCHEMA)


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def complete_trials(log: DataFrame) -> DataFrame:
    return log.filter(F.col("state") == "COMPLETE")


def _leaf_boxes(tree, values: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of a regression tree: first and end number of the values of each parameter, and the prediction."""
    low, high, said = [], [], []
    todo = [(tree._java_obj.rootNode(), [0] * len(values), [len(v) for v in values])]
    while todo:
        node, lo, hi = todo.pop()
        if node.getClass().getSimpleName() == "LeafNode":
            low.append(lo), high.append(hi), said.append(node.prediction())
            continue
        split = node.split()
        j = split.featureIndex()
        cut = int(np.searchsorted(values[j], split.threshold(), side="right"))
        todo.append((node.leftChild(), lo, [*hi[:j], cut, *hi[j + 1 :]]))
        todo.append((node.rightChild(), [*lo[:j], cut, *lo[j + 1 :]], hi))
    return np.array(low), np.array(high), np.array(said, dtype="f8")


def box_variances(
    low: np.ndarray, high: np.ndarray, said: np.ndarray, weights: Sequence[np.ndarray]
) -> tuple[float, list[float]]:
    """Variance of a function that is constant on boxes, and the variance of its mean along each parameter.

    Box ``i`` takes values ``low[i, j]`` up to ``high[i, j]`` (left out) of parameter ``j``, whose values weigh ``weights[j]``;
    parameters count as independent. The mean along a parameter has all others averaged out.
    """
    sums = [np.concatenate([[0.0], np.cumsum(w)]) for w in weights]
    sides = np.stack([s[high[:, j]] - s[low[:, j]] for j, s in enumerate(sums)], axis=1)
    volume = sides.prod(axis=1)
    mean = float(volume @ said)
    own = []
    for j, w in enumerate(weights):
        others = np.delete(sides, j, axis=1).prod(axis=1) * (said - mean)
        steps = np.zeros(len(w) + 1)
        np.add.at(steps, low[:, j], others)
        np.add.at(steps, high[:, j], -others)
        own.append(float(w @ np.cumsum(steps)[:-1] ** 2))
    return float(volume @ (said - mean) ** 2), own


def parameter_influence(log: DataFrame, objective: str = "f1", seed: int = SEED, trees: int = 64) -> DataFrame:
    """``(parameter, influence, share)``: how much of the objective's variance each parameter explains by itself.

    A forest learns the objective from the parameters; text values become level numbers, a missing value is 0. Each tree is
    taken apart into its leaf boxes, over which the variance is decomposed, with each parameter's values weighing as often
    as they were tried. ``share`` is the mean over the trees of the part of the variance that the parameter alone explains (the
    rest belongs to combinations), ``influence`` the same scaled to a sum of 1. One tree learns from every trial, more learn from
    samples. Without any variance all is 0; a log without complete trials gives no rows.
    """
    rows = complete_trials(log).select("params", objective)
    maps = rows.select(F.from_json("params", "map<string,string>").alias("m"), col(objective).cast("double").alias("y"))
    # At most one value per trial and parameter.
    found = maps.select(F.explode("m").alias("name", "value")).groupBy("name", "value").count().collect()
    schema = "parameter string, influence double, share double"
    if not found:
        return literal_table(log.sparkSession, [], schema)
    n = maps.count()
    names = sorted({r["name"] for r in found})
    columns, values, weights = [], [], []
    for name in names:
        text = F.try_element_at(F.col("m"), F.lit(name))
        tried = {r["value"]: r["count"] for r in found if r["name"] == name and r["value"] is not None}
        levels = sorted(tried)
        if all(_is_number(v) for v in levels):
            place = {v: float(v) for v in levels}
            number = text.try_cast("double")
        else:
            place = {v: float(i + 1) for i, v in enumerate(levels)}
            number = F.array_position(F.array(*map(F.lit, levels)), text).cast("double")
        columns.append(F.coalesce(number, F.lit(0.0)))
        often = {}
        for v, times in [*tried.items(), (None, n - sum(tried.values()))]:
            if times:
                at = place.get(v, 0.0)
                often[at] = often.get(at, 0) + times
        values.append(np.array(sorted(often)))
        weights.append(np.array([often[v] / n for v in sorted(often)]))
    data = maps.select(array_to_vector(F.array(*columns)).alias(FEATURES), "y")
    forest = RandomForestRegressor(
        featuresCol=FEATURES, labelCol="y", numTrees=trees, maxDepth=models.MAX_TREE_DEPTH, bootstrap=trees > 1,
        maxBins=max(32, *map(len, values)), featureSubsetStrategy="all", seed=seed,
    ).fit(data)
    shares = np.zeros(len(names))
    for tree in forest.trees:
        total, own = box_variances(*_leaf_boxes(tree, values), weights)
        if total > 0:
            shares += np.array(own) / total / trees
    scaled = shares / (shares.sum() or 1.0)
    return literal_table(log.sparkSession, [(k, float(i), float(v)) for k, i, v in zip(names, scaled, shares)], schema)


# --- recursive feature elimination ------------------------------------------


def _subset(df: DataFrame, keep: Sequence[int], width: int) -> DataFrame:
    if len(keep) == width:
        return df
    sliced = VectorSlicer(inputCol=FEATURES, outputCol="_slice", indices=list(keep)).transform(df)
    return sliced.drop(FEATURES).withColumnRenamed("_slice", FEATURES)


def _eliminate(df: DataFrame, family: str, params: dict, label: str, width: int, at_least: int, step: int):
    """Feature subsets from all down to ``at_least``, dropping the weakest each time, with models."""
    keep = list(range(width))
    while True:
        data = _subset(df, keep, width)
        model = models.fit(data, family, params, label)
        yield list(keep), model
        if len(keep) <= at_least:
            return
        weights = models.importances(model)
        weights += [0.0] * (len(keep) - len(weights))
        drop = min(step, len(keep) - at_least)
        weakest = sorted(range(len(keep)), key=lambda i: (weights[i], i))[:drop]
        keep = [k for i, k in enumerate(keep) if i not in weakest]


def eliminate_features(
    df: DataFrame,
    features: Sequence[str],
    family: str,
    params: dict,
    label: str,
    fold: str = "fold",
    step: int = 1,
    at_least: int = 1,
    threads: int = 4,
) -> tuple[list[str], DataFrame]:
    """Recursive elimination with cross-validation; the feature count with the best mean F1 wins.

    Inside each fold features are dropped by their own weights and every subset is scored on
    the held-out rows; one more run on all rows then picks the features. Returns them and
    ``(model, n_features, mean_f1)``. Equal scores go to fewer features.
    """
    width = len(features)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())

    def one(f):
        train, held = df.filter(col(fold) != f), df.filter(col(fold) == f)
        scored = None
        for keep, model in _eliminate(train, family, params, label, width, at_least, step):
            part = models.score_rows(model, _subset(held, keep, width), label).withColumn(
                "n_features", F.lit(len(keep))
            )
            scored = part if scored is None else scored.unionByName(part)
        rows = evaluate.class_scores(scored, label, "prediction", by=["n_features"]).collect()
        return {r["n_features"]: r["f1"] for r in rows}

    per_fold = _in_threads(df.sparkSession, [lambda f=f: one(f) for f in folds], threads)
    sizes = sorted(per_fold[0])
    means = {n: float(np.mean([s[n] for s in per_fold])) for n in sizes}
    best = min(sizes, key=lambda n: (-means[n], n))
    chosen = list(range(width))
    for keep, _ in _eliminate(df, family, params, label, width, best, step):
        chosen = keep
    table = literal_table(
        df.sparkSession, [(family, n, means[n]) for n in sizes], "model string, n_features int, mean_f1 double"
    )
    return [features[i] for i in chosen], table


# --- permutation importance -------------------------------------------------


#: Rows of each hash that one task sorts, and ranges of a hash counted for so many rows.
ALIGNED_ROWS, RANGES = 200_000, 16


def _aligned_places(counts: pa.Table, sides: int, ranges: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Groups of consecutive ranks from the rows per side and range of its hash.

    Groups end where ranges of side 0 end. Returns the first and last group that a range has ranks in, the first rank of each group (and
    the number of rows), and per side the rank at which the first range with rows in a group begins.
    """
    side, at, often = (counts.column(i).to_numpy() for i in range(3))
    filled = np.zeros((sides, ranges), dtype="i8")
    filled[side, at] = often
    ends = filled.cumsum(axis=1)
    begins = ends - filled
    n = int(ends[0, -1])
    home = begins[0][filled[0] > 0]
    cut = np.flatnonzero(np.diff(home // ALIGNED_ROWS, prepend=-1))
    firsts = np.append(home[cut], n) if n else np.array([0, 0])
    s, r = np.nonzero(filled)
    low = np.searchsorted(firsts[:-1], begins[s, r], side="right") - 1
    high = np.searchsorted(firsts[:-1], ends[s, r] - 1, side="right") - 1
    starts = np.full((sides, len(firsts) - 1), n)
    for k in (low, high):
        np.minimum.at(starts, (s, k), begins[s, r])
    # A range that covers whole groups between its first and last one starts them, too.
    for i in np.flatnonzero(high - low > 1):
        starts[s[i], low[i] : high[i] + 1] = np.minimum(starts[s[i], low[i] : high[i] + 1], begins[s[i], r[i]])
    places = pa.table({"_side": pa.array(s, "int32"), "_range": pa.array(r, "int64"), "_low": pa.array(low, "int32"), "_high": pa.array(high, "int32")})
    return places, firsts, starts


def permutation_importance(
    model: models.Fitted,
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str,
    repeats: int = 10,
    seed: int = SEED,
) -> DataFrame:
    """Mean drop of F1 when one feature is shuffled, ``(feature, importance, deviation)``.

    A repeat is one permutation of the rows: the row at a rank of one hash takes its values from the row at this rank of another
    hash. ``key`` is unique. Ranks follow from the number of rows per range of a hash (``RANGES`` numbers for each ``ALIGNED_ROWS``
    rows and hash reach the driver): one shuffle takes the rows to groups of consecutive ranks, where those of every hash are
    sorted. The donor row serves all features of its repeat, and each row is scored once per feature and repeat.
    """
    width, sides = len(features), repeats + 1
    plain = evaluate.class_scores(
        models.score_rows(model, df, label), label, "prediction"
    ).first()["f1"]
    hashes = F.array(*[hash_number(col(key), F.lit(seed + s)) for s in range(sides)])
    bits = max(0, math.ceil(math.log2(max(df.count(), 1) / ALIGNED_ROWS * RANGES)))
    ranged = F.shiftright("_hash", HASH_BITS - bits).alias("_range")
    counts = df.select(F.posexplode(hashes).alias("_side", "_hash")).groupBy("_side", ranged).count().toArrow()
    places, firsts, starts = _aligned_places(counts, sides, 1 << bits)

    base = df.select(hashes.alias("_hashes"), col(label).cast("double").alias("_label"), vector_to_array(FEATURES).alias("_x"))
    dealt = base.select(F.posexplode("_hashes").alias("_side", "_hash"), "_label", "_x").select("*", ranged)
    dealt = dealt.join(F.broadcast(df.sparkSession.createDataFrame(places)), ["_side", "_range"]).select(
        F.explode(F.sequence("_low", "_high")).alias("_group"), "_side", "_hash", "_label", "_x"
    )

    def aligned(group: tuple, rows: pa.Table) -> pa.Table:
        at = group[0].as_py()
        labels = rows["_label"].combine_chunks()
        side, number, y = rows["_side"].to_numpy(), rows["_hash"].to_numpy(), labels.to_numpy(zero_copy_only=False)
        x = rows["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        def ranked(s: int) -> np.ndarray:
            mine = np.flatnonzero(side == s)
            order = np.argsort(number[mine], kind="stable")
            same = np.diff(number[mine[order]]) == 0
            if same.any():  # rows with one hash: by their values, so that reruns agree
                order = np.lexsort((y[mine], *x[mine].T[::-1], number[mine]))
            skip = firsts[at] - starts[s][at]
            return mine[order][skip : skip + firsts[at + 1] - firsts[at]]

        home = ranked(0)
        donors = np.stack([x[ranked(s)] for s in range(1, sides)], axis=1)
        ends = [pa.array(np.arange(0, n * size + 1, size, dtype="i4")) for n, size in ((len(home) * repeats, width), (len(home), repeats))]
        others = pa.ListArray.from_arrays(ends[1], pa.ListArray.from_arrays(ends[0], pa.array(donors.ravel())))
        own = pa.ListArray.from_arrays(pa.array(np.arange(0, len(home) * width + 1, width, dtype="i4")), pa.array(x[home].ravel()))
        return pa.table({"_label": labels.take(pa.array(home)), "_x": own, "_others": others})

    pairs = dealt.repartition(len(firsts) - 1, "_group").groupBy("_group").applyInArrow(
        aligned, "_label double, _x array<double>, _others array<array<double>>"
    )
    numbers = F.sequence(F.lit(0), F.lit(width - 1))
    cases = pairs.select("_label", "_x", F.posexplode("_others").alias("_r", "_other")).withColumn("_i", F.explode(numbers))
    mixed = F.array(*[F.when(F.col("_i") == i, F.col("_other")[i]).otherwise(F.col("_x")[i]) for i in range(width)])
    rows = cases.select("_r", "_i", F.col("_label").alias(label), array_to_vector(mixed).alias(FEATURES))
    scored = models.score_rows(model, rows, label, ["_r", "_i"])
    names = F.array(*[F.lit(f) for f in features])
    losses = evaluate.class_scores(scored, label, "prediction", by=["_r", "_i"]).select(
        F.element_at(names, F.col("_i") + 1).alias("feature"), (F.lit(plain) - F.col("f1")).alias("drop")
    )
    return losses.groupBy("feature").agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("deviation")
    )
