"""Models to be explained: Spark ML fits, and scorers that explainers can call.

A scorer offers the same function twice: ``proba`` as a Spark column (native
arithmetic for linear models, Arrow batches otherwise) and ``predict`` /
``gradient`` on NumPy batches for kernels that run inside tasks.  Exported
weights are as large as the model parameters, never as large as the data.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowaudit.functions import arrays as A
from flowaudit.functions.vectors import matrix


def np_softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def np_sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


# wider linear scores run as one matrix product per Arrow batch: hundreds of additions in
# one expression would slow down planning more than the batches cost
NATIVE_WIDTH = 16


class Scorer:
    """Class scores of feature vectors."""

    classes: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def proba(self, features: Column) -> Column:
        predict = self.predict

        @F.pandas_udf("array<double>")
        def score(batch: pd.Series) -> pd.Series:
            return pd.Series(list(predict(matrix(batch))))

        return score(features)


@dataclass(frozen=True)
class LinearScorer(Scorer):
    """weights[feature][class], bias[class]; link identity, softmax or sigmoid (one logit, two classes)."""

    weights: tuple
    bias: tuple
    link: str = "softmax"

    @property
    def classes(self) -> int:
        return 2 if self.link == "sigmoid" else len(self.bias)

    def logits(self, features: Column) -> Column:
        outs = []
        for c, b in enumerate(self.bias):
            z = F.lit(float(b))
            for i, w in enumerate(self.weights):
                if w[c]:
                    z = z + F.lit(float(w[c])) * F.get(features, F.lit(i))
            outs.append(z)
        return F.array(*outs)

    def proba(self, features: Column) -> Column:
        if len(self.weights) > NATIVE_WIDTH:
            return super().proba(features)
        z = self.logits(features)
        if self.link == "identity":
            return z
        if self.link == "softmax":
            return A.softmax(z)
        return A.let(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get(z, F.lit(0)))), lambda p: F.array(F.lit(1.0) - p, p))

    def predict_logits(self, x):
        return x @ np.asarray(self.weights, dtype=float) + np.asarray(self.bias, dtype=float)

    def predict(self, x):
        return self._linked(self.predict_logits(x))

    def _linked(self, z):
        if self.link == "identity":
            return z
        if self.link == "softmax":
            return np_softmax(z)
        p = np_sigmoid(z[:, :1])
        return np.hstack([1.0 - p, p])

    def predict_in_order(self, x):
        """As ``predict``, adding up in the order of the columns of ``proba``, so that ties are ties there and here."""
        if len(self.weights) > NATIVE_WIDTH:
            return self.predict(x)
        z = np.empty((len(x), len(self.bias)))
        for c, b in enumerate(self.bias):
            z[:, c] = float(b)
            for i, w in enumerate(self.weights):
                if w[c]:
                    z[:, c] += float(w[c]) * x[:, i]
        return self._linked(z)

    def gradient_signs(self, x, target):
        """Probability of each row's ``target`` and the signs of its gradient."""
        if self.link != "sigmoid":
            return self.predict(x)[np.arange(len(x)), target], np.sign(self.gradient(x, target))
        w = np.asarray(self.weights, dtype=float)
        p = np_sigmoid(x @ w + np.asarray(self.bias, dtype=float))[:, 0]
        own = target == 1
        return np.where(own, p, 1.0 - p), (np.where(own, 1.0, -1.0) * (p * (1 - p) > 0))[:, None] * np.sign(w[:, 0])

    def slope_along(self, x, start, target, weighted_nodes, softmax=True):
        """Weighted sum of the gradients at some shares of the way from ``start`` to ``x``; None where it takes more than one number a row."""
        if self.link != "sigmoid" or not softmax:
            return None
        w = np.asarray(self.weights, dtype=float)[:, 0]
        first, way, total = start @ w + float(self.bias[0]), (x - start) @ w, np.zeros(len(x))
        for share, place in weighted_nodes:
            p = np_sigmoid(first + place * way)
            q = 1.0 - p
            q *= p
            q *= share
            total += q
        return np.where(target == 1, total, -total)[:, None] * w

    def gradient(self, x, target, softmax=True):
        w = np.asarray(self.weights, dtype=float)
        rows = np.arange(len(x))
        if self.link == "sigmoid":
            p = np_sigmoid(x @ w + np.asarray(self.bias))[:, 0]
            s = np.where(target == 1, 1.0, -1.0) * (p * (1 - p) if softmax else 1.0)
            return s[:, None] * w[:, 0][None, :]
        if self.link == "identity" or not softmax:
            return w.T[target]
        p = np_softmax(self.predict_logits(x))
        pt = p[rows, target][:, None]
        return pt * (w.T[target] - p @ w.T)


@dataclass(frozen=True)
class MlpScorer(Scorer):
    """Feed-forward net with sigmoid hidden layers and a softmax output."""

    layers: tuple = field(repr=False)  # ((W[in, out], b[out]), ...)

    @property
    def classes(self) -> int:
        return len(self.layers[-1][1])

    def activations(self, x):
        """Inputs of every layer and pre-activations."""
        ins, pre = [x], []
        for n, (w, b) in enumerate(self.layers):
            pre.append(ins[-1] @ w + b)
            if n < len(self.layers) - 1:
                ins.append(np_sigmoid(pre[-1]))
        return ins, pre

    def predict_logits(self, x):
        return self.activations(x)[1][-1]

    def predict(self, x):
        return np_softmax(self.predict_logits(x))

    def gradient(self, x, target, softmax=True):
        ins, pre = self.activations(x)
        rows = np.arange(len(x))
        g = np.zeros((len(x), self.classes))
        if softmax:
            p = np_softmax(pre[-1])
            pt = p[rows, target]
            g = -pt[:, None] * p
            g[rows, target] += pt
        else:
            g[rows, target] = 1.0
        for n in range(len(self.layers) - 1, -1, -1):
            g = g @ self.layers[n][0].T
            if n:
                g = g * ins[n] * (1.0 - ins[n])
        return g


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # (nodes, outputs)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            go_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)


@dataclass(frozen=True)
class TreeScorer(Scorer):
    """Sum of weighted trees, then ``link``: identity (forest), softmax over class margins, or the boosted logit of two classes."""

    trees: tuple = field(repr=False)
    weights: tuple = field(repr=False)
    link: str = "identity"

    @property
    def classes(self) -> int:
        return 2 if self.link == "boosted" else self.trees[0].value.shape[1]

    def predict_raw(self, x):
        out = 0.0
        for t, w in zip(self.trees, self.weights):
            out = out + w * t.value[t.leaf_of(x)]
        return out

    def predict(self, x):
        raw = self.predict_raw(x)
        if self.link == "identity":
            return raw
        if self.link == "softmax":
            return np_softmax(raw)
        p = np_sigmoid(2.0 * raw[:, :1])
        return np.hstack([1.0 - p, p])


@dataclass(frozen=True)
class OneVsRestScorer(Scorer):
    """Positive probabilities of one binary scorer per class, renormalised."""

    parts: tuple = field(repr=False)

    @property
    def classes(self) -> int:
        return len(self.parts)

    def predict(self, x):
        p = np.column_stack([s.predict(x)[:, 1] for s in self.parts])
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / self.classes)


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("_vec", array_to_vector(features))


def fit(estimator, df: DataFrame, features: str = "features", label: str = "y"):
    """Fit any Spark ML classifier on an array column."""
    train = with_vector(df, features).select("_vec", F.col(label).cast("double").alias("_label"))
    return estimator.copy({estimator.featuresCol: "_vec", estimator.labelCol: "_label"}).fit(train)


def random_forest(df: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42, **kw):
    return fit(RandomForestClassifier(numTrees=trees, maxDepth=depth, impurity="gini", seed=seed), df, **kw)


def boosted_trees(df: DataFrame, classes: int, rounds: int = 300, depth: int = 8, rate: float = 0.1,
                  subsample: float = 0.8, seed: int = 42, features: str = "features", label: str = "y", **kw):
    """Gradient-boosted trees for all classes at once (softmax loss), on binned features."""
    from flowaudit.operators import boosting

    train = df.withColumnsRenamed({features: "features", label: "y"})
    return boosting.fit(train, boosting.Boosting(classes, rounds, depth, rate, subsample, seed=seed, **kw))


def _one_vs_rest(binary):
    return OneVsRest(classifier=binary)


def feed_forward(df: DataFrame, width: int, classes: int, hidden: tuple = (64, 32), iterations: int = 100,
                 seed: int = 42, **kw):
    return fit(MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=iterations, seed=seed),
               df, **kw)


def random_fourier(features: Column, width: int, components: int = 128, gamma: float = 1.0, seed: int = 42) -> Column:
    """cos features whose inner product approximates the kernel exp(-gamma |x-y|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, components))
    b = rng.uniform(0.0, 2.0 * np.pi, components)
    scale = np.sqrt(2.0 / components)

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        return pd.Series(list(scale * np.cos(matrix(batch) @ w + b)))

    return project(features)


def kernel_svm(df: DataFrame, width: int, components: int = 128, gamma: float = 1.0, iterations: int = 50,
               seed: int = 42):
    """RBF machine: random Fourier features and one linear SVM per class.

    Returns ``(model, map)``; apply ``map`` to the features before ``transform``.
    """
    lift = lambda c: random_fourier(c, width, components, gamma, seed)
    lifted = df.withColumn("features", lift(F.col("features")))
    return fit(_one_vs_rest(LinearSVC(maxIter=iterations)), lifted), lift


def single_feature_classifier(df: DataFrame, index: int, iterations: int = 100):
    """The biased model: logistic regression that sees one feature only."""
    one = df.withColumn("features", F.array(F.get("features", F.lit(index))))
    return fit(LogisticRegression(maxIter=iterations), one)


def perturbation_detector(real: DataFrame, shuffled: DataFrame, rounds: int = 50, depth: int = 3, seed: int = 42):
    """Boosted trees telling real rows (0) from marginally shuffled rows (1)."""
    both = real.select("features", F.lit(0).alias("y")).union(shuffled.select("features", F.lit(1).alias("y")))
    return fit(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed), both)


def pad_probabilities(proba: Column, model_labels: list[int], classes: int) -> Column:
    """Reorder a model's class probabilities to all class ids; absent classes get 0."""
    place = {c: i for i, c in enumerate(model_labels)}
    return F.array(*[F.get(proba, F.lit(place[c])) if c in place else F.lit(0.0) for c in range(classes)])


def score(model, df: DataFrame, features: str = "features") -> DataFrame:
    """JVM-side scoring: adds ``proba array<double>`` and ``pred``.

    One-vs-rest models give raw scores only; they pass through a sigmoid
    (boosted: 2 x raw) and are renormalised.  Models fitted on histograms are scored in Arrow batches.
    """
    if hasattr(model, "scorer"):
        return df.withColumn("proba", model.scorer.proba(F.col(features))).withColumn("pred", A.argmax(F.col("proba")).cast("int"))
    out = model.transform(with_vector(df, features))
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        factor = 2.0 if "GBT" in type(model.models[0]).__name__ else 1.0
        s = F.transform(vector_to_array("rawPrediction"), lambda v: 1.0 / (1.0 + F.exp(-v * factor)))
        p = A.let(s, lambda x: A.let(A.total(x), lambda t: F.transform(x, lambda v: v / t)))
    out = out.withColumn("proba", p).withColumn("pred", F.col("prediction").cast("int"))
    return out.drop("_vec", "rawPrediction", "probability", "prediction")


def _saved_trees(model, value_of) -> tuple[Tree, ...]:
    """The trees of a fitted ensemble from its saved node rows: one job, whatever the number of nodes.

    Node numbers count each tree from its root, so they are places in its arrays.
    """
    from pyspark.sql import SparkSession

    from flowaudit.functions.tables import shared_folder

    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), n["split"]["numCategories"].alias("categories"),
        n["split"]["leftCategoriesOrThreshold"].alias("cut")).orderBy("treeID", "id").toPandas()
    if (rows["categories"] > 0).any():
        raise TypeError("no export of categorical splits")
    out = []
    for _, t in rows.groupby("treeID", sort=True):
        inner = (t["left"] >= 0).to_numpy()
        cut = np.array([c[0] if i else -1.0 for c, i in zip(t["cut"], inner)], dtype=float)
        feature = np.where(inner, t["feature"].to_numpy(), -1)
        value = np.array([value_of(p, s) for p, s in zip(t["prediction"], t["stats"])], dtype=float)
        out.append(Tree(feature, cut, t["left"].to_numpy(), t["right"].to_numpy(), value))
    return tuple(out)


def _class_share(classes: int):
    def read(_, stats):
        v = np.asarray(stats, dtype=float)
        return v / v.sum() if v.sum() > 0 else np.full(classes, 1.0 / classes)

    return read


def export(model) -> Scorer:
    """The fitted Spark ML model as a scorer usable inside tasks."""
    if hasattr(model, "scorer"):
        return model.scorer
    name = type(model).__name__
    if name == "RandomForestClassificationModel":
        trees = _saved_trees(model, _class_share(model.numClasses))
        return TreeScorer(trees, (1.0 / len(trees),) * len(trees))
    if name == "GBTClassificationModel":
        trees = _saved_trees(model, lambda prediction, _: [prediction])
        return TreeScorer(trees, tuple(model.treeWeights), "boosted")
    if name == "MultilayerPerceptronClassificationModel":
        sizes = model.getLayers()
        flat, at, layers = np.array(model.weights.toArray()), 0, []
        for n_in, n_out in zip(sizes, sizes[1:]):
            w = flat[at : at + n_in * n_out].reshape(n_in, n_out)
            at += n_in * n_out
            layers.append((w, flat[at : at + n_out]))
            at += n_out
        return MlpScorer(tuple(layers))
    if name == "LogisticRegressionModel":
        if model.numClasses == 2 and model.coefficientMatrix.numRows == 1:
            w = model.coefficients.toArray()
            return LinearScorer(tuple((float(v),) for v in w), (float(model.intercept),), "sigmoid")
        w = model.coefficientMatrix.toArray().T
        return LinearScorer(tuple(map(tuple, w)), tuple(model.interceptVector.toArray()))
    if name == "OneVsRestModel":
        return OneVsRestScorer(tuple(export(m) for m in model.models))
    raise TypeError(f"no export for {name}")
