"""Classifier families by name, on ``pyspark.ml``.

``fit`` takes a table with a feature vector and a 0/1 label and returns a fitted
model whose ``transform`` adds ``prediction`` and ``probability``. Parameter names
are the usual ones of single-machine libraries; they are translated, and those
without a counterpart are listed by ``ignored_parameters`` instead of being dropped
silently.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import col
from wardtable.operators.boosting import Settings, fit_trees
from wardtable.operators.neighbors import knn_classify

SEED = 99
FEATURES = "features"
MAX_TREE_DEPTH = 30  # the deepest tree the library grows; stands in for "unlimited"


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector and label in one row; a missing feature value is an error."""
    vector = array_to_vector(F.array(*[col(c).cast("double") for c in features]))
    return df.select(*[col(k) for k in keep], vector.alias(FEATURES), col(label).cast("double").alias(label))


# --- feature maps and weights -----------------------------------------------


def _rows_of(x: pa.Array) -> np.ndarray | None:
    """The vectors of a batch as rows of a matrix; none without rows."""
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), len(flat) // len(x)) if len(x) else None


def _lists_of(m: np.ndarray) -> pa.Array:
    starts = np.arange(len(m) + 1, dtype="i4") * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.ascontiguousarray(m).ravel()))


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: a linear model on them acts like one with an RBF kernel.

    The projection follows from ``seed`` alone, so every task draws the same one.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "mapped column", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "mapped size", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "projection seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=FEATURES, outputCol="mapped", gamma=1.0, components=128, seed=SEED):
        super().__init__()
        self._setDefault(inputCol=FEATURES, outputCol="mapped", gamma=1.0, components=128, seed=SEED)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        gamma, size, seed = get("gamma"), get("components"), get("seed")

        @F.arrow_udf("array<double>")
        def project(x: pa.Array) -> pa.Array:
            m = _rows_of(x)
            if m is None:
                return x
            rng = np.random.RandomState(seed)
            w = rng.normal(scale=math.sqrt(2 * gamma), size=(m.shape[1], size))
            b = rng.uniform(0, 2 * math.pi, size=size)
            return _lists_of(math.sqrt(2.0 / size) * np.cos(m @ w + b))

        mapped = array_to_vector(project(vector_to_array(col(get("inputCol")))))
        return dataset.withColumn(get("outputCol"), mapped)


class PolynomialMap(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Features of at most ``components`` numbers whose products follow the kernel (gamma x.z + coef0)^degree.

    Where all weighted monomials fit into ``components`` they are taken and the kernel is exact. Else each factor is a
    count sketch and their convolution is the sketch of the product (tensor sketch): right on average, with an error that
    falls with the root of ``components``. The signs and places follow from ``seed`` alone.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "mapped column", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "factor of the product", TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "constant added to the product", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "power", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "mapped size at most", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "sketch seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=FEATURES, outputCol="mapped", gamma=1.0, coef0=0.0, degree=3, components=512, seed=SEED):
        super().__init__()
        self._setDefault(inputCol=FEATURES, outputCol="mapped", gamma=1.0, coef0=0.0, degree=3, components=512, seed=SEED)
        self._set(**self._input_kwargs)
        if self.getOrDefault("coef0") < 0 or self.getOrDefault("degree") < 1 or self.getOrDefault("components") < 1:
            raise ValueError("coef0 is not negative, degree and components are at least 1")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        gamma, coef0, degree, size, seed = (get(n) for n in ("gamma", "coef0", "degree", "components", "seed"))

        @F.arrow_udf("array<double>")
        def mapped(x: pa.Array) -> pa.Array:
            m = _rows_of(x)
            if m is None:
                return x
            m = m * math.sqrt(gamma)
            if coef0:
                m = np.hstack([m, np.full((len(m), 1), math.sqrt(coef0))])
            wide = m.shape[1]
            if math.comb(wide + degree - 1, degree) <= size:
                return _lists_of(_monomials(m, degree))
            rng = np.random.RandomState(seed)
            product = np.ones((len(m), size // 2 + 1), dtype="c16")
            for _ in range(degree):
                place, sign = rng.randint(size, size=wide), rng.choice([-1.0, 1.0], size=wide)
                sketch = np.zeros((len(m), size))
                np.add.at(sketch.T, place, (m * sign).T)
                product *= np.fft.rfft(sketch, axis=1)
            return _lists_of(np.fft.irfft(product, n=size, axis=1))

        return dataset.withColumn(get("outputCol"), array_to_vector(mapped(vector_to_array(col(get("inputCol"))))))


def _monomials(m: np.ndarray, degree: int) -> np.ndarray:
    """All monomials of a degree, each times the root of how often it occurs in the power of a sum."""
    out = []
    for chosen in itertools.combinations_with_replacement(range(m.shape[1]), degree):
        often = math.factorial(degree)
        for k in set(chosen):
            often //= math.factorial(chosen.count(k))
        out.append(math.sqrt(often) * np.prod(m[:, list(chosen)], axis=1))
    return np.stack(out, axis=1)


class Bits(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """1 for features above a threshold, else 0 (also for NaN); a missing value is an error."""

    outputCol = Param(Params._dummy(), "outputCol", "vector of bits", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "greatest number that is no bit", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, outputCol="binary", threshold=0.0, width=1):
        super().__init__()
        self._setDefault(outputCol="binary", threshold=0.0, width=1)
        self._set(**self._input_kwargs)

    def bits(self) -> list[Column]:
        """One column for each feature."""
        width, values = self.getOrDefault("width"), vector_to_array(col(FEATURES))
        out = []
        for i in range(width):
            v = F.get(values, F.lit(i))
            bit = (v > self.getOrDefault("threshold")) & ~F.isnan(v)
            wrong = v.isNull() if i else v.isNull() | (F.size(values) != width)
            out.append(F.when(wrong, F.raise_error(F.lit("a feature value is missing")).cast("boolean")).otherwise(bit))
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bits = [b.cast("double") for b in self.bits()]
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(F.array(*bits)))


def _alike(df: DataFrame, bits: Bits, label: str) -> DataFrame:
    """A few weighted rows with as many rows of each class, and as many ones of each of its features, as ``df`` has.

    Bernoulli likelihoods are made of these counts alone. The rows of a class are nested: the k-th has ones where the k largest
    counts are, and weighs the difference to the next count.
    """
    one = [F.count_if(b).alias(f"c{i}") for i, b in enumerate(bits.bits())]
    rows = []
    counted = df.groupBy(col(label).cast("double")).agg(F.count(F.lit(1)).alias("n"), *one)
    for y, n, *counts in counted.collect():  # one row per class
        levels = sorted({n, *counts, 0}, reverse=True)
        rows += [(y, float(high - low), [float(c >= high) for c in counts]) for high, low in itertools.pairwise(levels)]
    table = df.sparkSession.createDataFrame(rows, "label double, weight double, bits array<double>").coalesce(1)
    return table.select("label", "weight", array_to_vector("bits").alias(bits.getOrDefault("outputCol")))


class EvenPrior(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Takes the classes' prior out of the scores of a fitted model that adds log-likelihoods to it."""

    logPrior = Param(Params._dummy(), "logPrior", "logarithms of the learnt prior", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, logPrior=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        low, high = self.getOrDefault("logPrior")
        raw = vector_to_array(col("rawPrediction"))
        margin = (raw[1] - F.lit(high)) - (raw[0] - F.lit(low))
        p = 1 / (1 + F.exp(-margin))
        return dataset.withColumn("probability", F.array(1 - p, p)).withColumn("prediction", (p > 0.5).cast("double"))


def class_weights(df: DataFrame, label: str, mode: str | float | None, out: str = "weight") -> DataFrame:
    """``balanced``: n / (2 * rows of the class); a number: that factor on positives."""
    if mode is None:
        return df
    if mode == "balanced":
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(col(label) == 1).alias("p")).first()
        n, p = row["n"], row["p"]
        pos, neg = n / (2.0 * max(p, 1)), n / (2.0 * max(n - p, 1))
    else:
        pos, neg = float(mode), 1.0
    return df.withColumn(out, F.when(col(label) == 1, F.lit(pos)).otherwise(F.lit(neg)))


def _gamma(df: DataFrame, gamma, width: int) -> float:
    """``auto`` is 1/width; ``scale`` divides further by the variance over all cells."""
    if gamma == "auto":
        return 1.0 / width
    if gamma in (None, "scale"):
        cells = df.select(F.explode(vector_to_array(col(FEATURES))).alias("v"))
        variance = cells.agg(F.var_pop("v")).first()[0] or 1.0
        return 1.0 / (width * variance)
    return float(gamma)


# --- families ---------------------------------------------------------------

# Parameters that have no counterpart here: engine choices, or internals of one solver.
IGNORED = {
    "logistic_regression": {"solver", "random_state"},
    "random_forest": {"min_samples_split", "n_jobs"},
    "svc": {"probability", "random_state"},
    "decision_tree": {"min_samples_split"},
    "bernoulli_bayes": set(),
    "gradient_boosting": {
        "min_samples_split", "objective", "eval_metric", "verbosity", "nthread",
    },
    "sgd_classifier": {"early_stopping"},
    "knn_classifier": {"algorithm", "leaf_size"},
}
KNOWN = {
    "logistic_regression": {"C", "penalty", "max_iter", "l1_ratio", "class_weight"},
    "random_forest": {
        "criterion", "n_estimators", "max_depth", "min_samples_leaf", "bootstrap", "class_weight", "random_state",
        "max_bins",
    },
    "svc": {"C", "kernel", "gamma", "coef0", "degree", "class_weight", "max_iter", "components"},
    "decision_tree": {"criterion", "max_depth", "min_samples_leaf", "random_state", "max_bins"},
    "bernoulli_bayes": {"alpha", "fit_prior", "binarize"},
    "gradient_boosting": {
        "n_estimators", "learning_rate", "max_depth", "subsample", "colsample_bytree", "gamma", "min_child_weight",
        "reg_alpha", "reg_lambda", "scale_pos_weight", "seed", "random_state", "max_bins",
    },
    "sgd_classifier": {"loss", "alpha", "max_iter"},
    "knn_classifier": {"n_neighbors", "weights", "metric"},
}
FAMILIES = sorted(KNOWN)
# Values that are offered, the default first.
VALUES = {
    "svc": {"kernel": ("rbf", "linear", "poly")},
    "sgd_classifier": {"loss": ("hinge", "log_loss")},
}


def ignored_parameters(family: str, params: dict) -> list[str]:
    """Parameters that are accepted but change nothing; unknown ones are an error."""
    unknown = set(params) - KNOWN[family] - IGNORED[family]
    if unknown:
        raise ValueError(f"{family} has no parameter {sorted(unknown)}")
    if (params.get("max_depth") or 0) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {params['max_depth']} is not offered: {MAX_TREE_DEPTH} is the deepest")
    for name, offered in VALUES.get(family, {}).items():
        if params.get(name, offered[0]) not in offered:
            raise ValueError(f"{family} offers {name} {offered}, not {params[name]}")
    return sorted(set(params) & IGNORED[family])


@dataclass
class Fitted:
    """A fitted model and what was left out of its parameters."""

    family: str
    params: dict
    model: object
    ignored: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


class _Neighbors:
    """k nearest training rows as a model."""

    def __init__(self, train: DataFrame, key: str, label: str, width: int, params: dict):
        self.train, self.key, self.label, self.width, self.params = train, key, label, width, params

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        plain = [d.withColumn("_a", vector_to_array(col(FEATURES))) for d in (self.train, df)]
        votes = knn_classify(
            plain[0], plain[1], self.key, "_a", self.label, self.width,
            int(p.get("n_neighbors", 5)), p.get("weights", "uniform"), p.get("metric", "euclidean"),
        )
        return df.join(votes.withColumnRenamed("score", "_score"), self.key, "left").withColumn(
            "probability", F.array(1 - F.col("_score"), F.col("_score"))
        ).drop("_score")


#: Parts whose margins come from a machine fitted on the other parts.
MARGIN_FOLDS = 3
#: Mapped cells up to which the rows are kept and the machines are fitted side by side; each fit keeps a copy of its own of them.
TOGETHER_CELLS = 20_000_000


def _kernel_map(df: DataFrame, p: dict, width: int) -> list[Transformer]:
    """Feature map of bounded width on which a linear machine acts like one with the kernel."""
    kernel = p.get("kernel", "rbf")
    if kernel == "linear":
        return []
    gamma = _gamma(df, p.get("gamma"), width)
    if kernel == "rbf":
        return [FourierFeatures(outputCol="mapped", gamma=gamma, components=int(p.get("components", 128)))]
    if kernel == "poly":
        degree, size = int(p.get("degree", 3)), int(p.get("components", 512))
        return [PolynomialMap(gamma=gamma, coef0=float(p.get("coef0", 0.0)), degree=degree, components=size)]
    raise ValueError(f"kernel {kernel} is not offered")


def _with_probability(data: DataFrame, maps: list, svm: LinearSVC, label: str, key: str | None, cells: int) -> PipelineModel:
    """A machine fitted on all rows, and the logistic curve from a margin to a probability.

    The curve is learnt on margins of rows that their machine has not seen: each of ``MARGIN_FOLDS`` parts is scored by a machine
    fitted on the others. Parts follow from a hash of the key, or of the features without one.

    A fit holds its rows mapped, in blocks, until it ends. With more than ``TOGETHER_CELLS`` mapped ``cells`` the fits come one
    after the other and map the rows themselves, so that one copy is held at a time and not five.
    """
    for m in maps:
        data = m.transform(data)
    own = F.xxhash64(col(key).cast("string")) if key else F.xxhash64(vector_to_array(col(FEATURES)))
    part = F.pmod(own, F.lit(MARGIN_FOLDS))
    source = svm.getFeaturesCol()
    weight = [svm.getWeightCol()] if svm.isDefined("weightCol") and svm.getWeightCol() else []
    rows = data.select(source, label, *weight, part.alias("_part"))
    together = cells <= TOGETHER_CELLS
    if together:
        rows = rows.persist()

    def one(k: int | None):
        if k is None:
            return svm.fit(rows)
        others, mine = rows.filter(F.col("_part") != k), rows.filter(F.col("_part") == k)
        if others.isEmpty():
            others = mine  # all rows are in one part
        return svm.copy().fit(others).transform(mine).select("margin", label)

    wanted = [None, *range(MARGIN_FOLDS)]
    if together:
        rows.count()
        # The fits do not depend on each other and run side by side, as in a cross-validation.
        with ThreadPool(MARGIN_FOLDS + 1) as pool:
            machine, *scored = pool.map(inheritable_thread_target(data.sparkSession)(one), wanted)
    else:
        machine, *scored = [one(k) for k in wanted]
    margins = functools.reduce(DataFrame.unionByName, scored)
    curve = LogisticRegression(
        featuresCol="margin", labelCol=label, predictionCol="_platt", rawPredictionCol="_platt_raw",
        probabilityCol="probability", standardization=False,
    )
    fitted = PipelineModel([*maps, machine, curve.fit(margins)])
    if together:
        rows.unpersist()
    return fitted


def _mapped_width(maps: list, width: int) -> int:
    """Width of the features that the machine sees."""
    for m in maps:
        size = m.getOrDefault("components")
        if isinstance(m, PolynomialMap):
            degree = m.getOrDefault("degree")
            size = min(size, math.comb(width + (m.getOrDefault("coef0") > 0) + degree - 1, degree))
        width = size
    return width


_NEED_WIDTH = ("svc", "knn_classifier", "sgd_classifier", "bernoulli_bayes")


def fit(df: DataFrame, family: str, params: dict | None, label: str, key: str | None = None) -> Fitted:
    """Fit one model of a family. ``df`` has the feature vector and the label."""
    p = dict(params or {})
    ignored = ignored_parameters(family, p)
    width = df.schema[FEATURES].metadata.get("ml_attr", {}).get("num_attrs") if family in _NEED_WIDTH else None
    if family in _NEED_WIDTH and width is None:
        first = df.select(F.size(vector_to_array(col(FEATURES)))).first()
        width = first[0] if first else 0
    if family == "knn_classifier":
        if key is None:
            raise ValueError("neighbours need a row key")
        return Fitted(family, p, _Neighbors(df, key, label, width, p), ignored)

    if family == "gradient_boosting":
        names = KNOWN[family] - {"random_state"}
        given = {k: v for k, v in p.items() if k in names and v is not None}
        settings = Settings(**{"seed": int(p.get("random_state", SEED)), **given})
        return Fitted(family, p, PipelineModel([fit_trees(df, FEATURES, label, key, settings)]), ignored)

    mode = p.get("class_weight")
    data = class_weights(df, label, mode)
    weight = {"weightCol": "weight"} if mode is not None else {}
    cols = {"featuresCol": FEATURES, "labelCol": label, **weight}
    seed = int(p.get("random_state", p.get("seed", SEED)))

    if family == "logistic_regression":
        penalty = p.get("penalty", "l2")
        ratio = {"l1": 1.0, "l2": 0.0, "elasticnet": float(p.get("l1_ratio", 0.5)), None: 0.0}[penalty]
        reg = 0.0 if penalty is None else 1.0 / (float(p.get("C", 1.0)) * max(df.count(), 1))
        stages = [
            LogisticRegression(
                **cols, regParam=reg, elasticNetParam=ratio, maxIter=int(p.get("max_iter", 100)), standardization=False
            )
        ]
    elif family in ("random_forest", "decision_tree"):
        impurity = "gini" if p.get("criterion", "gini") == "gini" else "entropy"
        depth = p.get("max_depth")
        tree = {
            **cols, "impurity": impurity, "maxDepth": MAX_TREE_DEPTH if depth is None else int(depth), "maxBins": int(p.get("max_bins", 32)),
            "minInstancesPerNode": int(p.get("min_samples_leaf", 1)), "seed": seed, "maxMemoryInMB": 1024,
        }
        if family == "random_forest":
            stages = [
                RandomForestClassifier(
                    **tree, numTrees=int(p.get("n_estimators", 100)), bootstrap=bool(p.get("bootstrap", True))
                )
            ]
        else:
            stages = [DecisionTreeClassifier(**tree)]
    elif family == "svc":
        maps, n = _kernel_map(data, p, width), df.count()
        svm = LinearSVC(
            featuresCol="mapped" if maps else FEATURES, labelCol=label, rawPredictionCol="margin", predictionCol="prediction",
            regParam=1.0 / (float(p.get("C", 1.0)) * max(n, 1)), maxIter=int(p.get("max_iter", 100)), standardization=False,
            **weight,
        )
        return Fitted(family, p, _with_probability(data, maps, svm, label, key, n * _mapped_width(maps, width)), ignored)
    elif family == "bernoulli_bayes":
        bits = Bits(threshold=float(p.get("binarize", 0.0)), width=width)
        bayes = NaiveBayes(
            featuresCol="binary", labelCol="label", weightCol="weight", modelType="bernoulli", smoothing=float(p.get("alpha", 1.0))
        )
        learnt = [bits, bayes.fit(_alike(data, bits, label))]
        if not p.get("fit_prior", True):
            pi = [float(v) for v in learnt[-1].pi.toArray()]
            learnt.append(EvenPrior(logPrior=[*pi, *[0.0] * (2 - len(pi))]))
        return Fitted(family, p, PipelineModel(learnt), ignored)
    elif family == "sgd_classifier":
        loss, alpha = p.get("loss", "hinge"), float(p.get("alpha", 1e-4))
        if loss == "hinge":
            svm = LinearSVC(**cols, rawPredictionCol="margin", regParam=alpha, maxIter=int(p.get("max_iter", 100)), standardization=False)
            cells = df.count() * width
            return Fitted(family, p, _with_probability(data, [], svm, label, key, cells), ignored)
        elif loss == "log_loss":
            stages = [LogisticRegression(**cols, regParam=alpha, maxIter=int(p.get("max_iter", 100)), standardization=False)]
        else:
            raise ValueError(f"loss {loss} is not offered")
    else:
        raise ValueError(f"unknown family {family}")
    return Fitted(family, p, Pipeline(stages=stages).fit(data), ignored)


def load(path: str, family: str = "", params: dict | None = None) -> Fitted:
    return Fitted(family, dict(params or {}), PipelineModel.load(path), [])


def score_rows(model: Fitted, df: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep, label, prediction, score``: predicted class and positive-class probability."""
    out = model.transform(df)
    kind = dict(out.dtypes).get("probability")
    if kind is None:
        score = F.lit(None).cast("double")
    elif kind.startswith("array"):
        score = F.col("probability")[1]
    else:
        score = vector_to_array(F.col("probability"))[1]
    return out.select(
        *[col(k) for k in keep], col(label).cast("int").alias(label), F.col("prediction").cast("int").alias("prediction"),
        score.alias("score"),
    )


def importances(model: Fitted) -> list[float]:
    """Weight of each feature: absolute coefficient or tree importance."""
    for stage in model.model.stages:
        if hasattr(stage, "featureImportances"):
            return [float(v) for v in stage.featureImportances.toArray()]
        if hasattr(stage, "coefficients"):
            return [abs(float(v)) for v in stage.coefficients.toArray()]
    raise ValueError(f"{model.family} has no feature weights")


# --- principal components ---------------------------------------------------


def principal_components(
    df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[float]]:
    """Centred principal components ``PC1..PCk`` and their share of the variance.

    Each component's largest loading is made positive, so results repeat across runs.
    """
    vectors = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_raw").transform(
        df.select(*[col(c) for c in keep], *[col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
    )
    centre = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=False).fit(vectors)
    centred = centre.transform(vectors)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    parts = model.transform(centred).withColumn("_a", vector_to_array("_pc"))
    scores = parts.select(
        *[col(c) for c in keep], *[(F.col("_a")[i] * F.lit(signs[i])).alias(f"PC{i + 1}") for i in range(k)]
    )
    return scores, [float(v) for v in model.explainedVariance.toArray()]
