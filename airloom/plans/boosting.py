"""Boosted regression trees from histograms, several models in the same passes.

Inputs are binned once. A tree grows level by level: one pass sums the gradients of all rows by
(model, node, feature, bin), and the best split of each node follows from the sums. The leaves'
values come from the same sums, so a tree of depth d takes d passes, however many models (horizons)
grow side by side. The passes are many and short, so they run on an RDD of binned partitions: the
plan of a DataFrame would be made anew for each. A partition keeps its rows' bins (one byte each),
labels and predictions so far.

Gradients are rounded to a power of two that makes all sums exact: splits depend neither on the
order of partitions nor on repeated tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.session import shared_dir

#: Rounds after which the partitions' state is written to the checkpoint folder, which cuts its lineage.
CHECKPOINT_ROUNDS = 50
#: Rows that a partition of a model holds at least, if it has so many: a pass starts a task for each.
PARTITION_ROWS = 50_000
#: Histograms of a pass that the driver sums itself, in bytes over all partitions; larger ones are
#: summed by (model, feature) in a shuffle, and only splits reach the driver.
DIRECT_BYTES = 32 << 20


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. Rows go left up to and including the
    cut. ``cover`` counts the training rows, ``gain`` is that of the split."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def leaf(self) -> int:
        for column, value in zip((self.feature, self.cut, self.left, self.right, self.value, self.cover, self.gain), (-1, 0, 0, 0, 0.0, 0.0, 0.0)):
            column.append(value)
        return len(self.feature) - 1

    def walk(self, inputs: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(inputs), np.int64), np.arange(len(inputs))
        while (inner := feature[at] >= 0).any():
            below = inputs[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(below, left[at], right[at]), at)
        return at


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    left: tuple[float, float]  # sums of gradients and rows
    right: tuple[float, float]


def best_splits(gradients: np.ndarray, rows: np.ndarray, penalty: float, least: float, first: int = 0) -> list[Split | None]:
    """Of histograms (node, feature, bin), the split of each node with the largest second-order gain
    G²/(H + penalty); of equal ones the first feature and bin. None where no split gains anything."""
    g_left, h_left = np.cumsum(gradients, axis=2), np.cumsum(rows, axis=2)
    g_all, h_all = g_left[:, :, -1:], h_left[:, :, -1:]
    g_right, h_right = g_all - g_left, h_all - h_left
    with np.errstate(divide="ignore", invalid="ignore"):  # without penalty, an empty side divides by zero
        gain = (g_left**2 / (h_left + penalty) + g_right**2 / (h_right + penalty) - g_all**2 / (h_all + penalty)) / 2
    gain = np.where((h_left >= least) & (h_right >= least) & (h_left > 0) & (h_right > 0), gain, -np.inf)
    out = []
    for node in range(len(gain)):
        feature, cut = np.unravel_index(np.argmax(gain[node]), gain[node].shape)
        at = node, feature, cut
        out.append(Split(
            float(gain[at]), first + int(feature), int(cut), (float(g_left[at]), float(h_left[at])), (float(g_right[at]), float(h_right[at]))
        ) if gain[at] > 1e-12 else None)
    return out


class HistBoost(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Squared error, ``regLambda`` as penalty of leaf values, ``subsamplingRate`` of the rows in each round."""

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of an input, 256 at most", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows that a round sees", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "penalty of squared leaf values", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "rows on either side of a split", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100, maxDepth=6, stepSize=0.1,
                 subsamplingRate=1.0, maxBins=256, regLambda=1.0, minChildWeight=1.0, seed=42):
        super().__init__()
        self._setDefault(maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=1.0, maxBins=256, regLambda=1.0, minChildWeight=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        return fit_together([(dataset, self)])[0]


class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """``trees`` is JSON: the base value, and for each tree its nodes; cuts are values of the inputs."""

    trees = Param(Params._dummy(), "trees", "base value and trees as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    def parsed(self) -> tuple[float, list[Tree]]:
        stored = json.loads(self.getOrDefault(self.trees))
        return stored["base"], [Tree(**t) for t in stored["trees"]]

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the gain of all splits."""
        stored = json.loads(self.getOrDefault(self.trees))
        out = np.zeros(stored["inputs"])
        for t in stored["trees"]:
            inner = np.array(t["feature"]) >= 0
            np.add.at(out, np.array(t["feature"])[inner], np.array(t["gain"])[inner])
        return DenseVector(out / max(out.sum(), 1e-300))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, trees = self.parsed()

        @F.pandas_udf("double")
        def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            values = [np.array(t.value) for t in trees]
            for part in parts:
                inputs, out = np.array(part.tolist(), float), np.full(len(part), base)
                for tree, value in zip(trees, values, strict=True) if len(part) else ():
                    out += value[tree.walk(inputs)]
                yield pd.Series(out)

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))


@dataclass
class _Grown:
    """One model while it grows: the frontier lists the nodes of the last level that may still split."""

    cuts: list[np.ndarray]
    base: float
    scale: float
    tree: Tree = field(default_factory=Tree)
    frontier: list[int] = field(default_factory=lambda: [0])
    done: list[Tree] = field(default_factory=list)


def _binned(dataset: DataFrame, features: str, label: str, cuts: list[np.ndarray], base: float, number: int) -> RDD:
    """One element for each partition: (model, bins, labels, predictions so far)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.stack([np.searchsorted(c, flat[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bins.tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["bins", "labels"]
                )

    rows = dataset.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
    width = len(cuts)

    def gathered(parts):
        found = list(parts)
        if found:
            bins = np.frombuffer(b"".join(r.bins for r in found), np.uint8).reshape(-1, width)
            labels = np.frombuffer(b"".join(r.labels for r in found), np.float64)
            yield number, bins, labels, np.full(len(labels), base)

    return rows.mapInArrow(run, "bins binary, labels binary").rdd.mapPartitions(gathered)


def _histograms(index: int, states, growing, n_bins: int, rate: float, seed: int, round_: int):
    """Sums of gradients and rows by (frontier node, feature, bin) of one partition."""
    for number, bins, labels, margin in states:
        tree, frontier, scale = growing[number]
        if not frontier:
            continue
        place = np.full(len(tree.feature), -1)
        place[frontier] = np.arange(len(frontier))
        at = place[tree.walk(bins)] if len(tree.feature) > 1 else np.zeros(len(bins), np.int64)
        seen = at >= 0
        if rate < 1:
            seen &= np.random.default_rng((seed, round_, number, index)).random(len(bins)) < rate
        at, bins = at[seen] * n_bins, bins[seen]
        gradient = np.rint((margin[seen] - labels[seen]) * scale)
        shape, size = (len(frontier), bins.shape[1], n_bins), len(frontier) * n_bins
        sums, rows = np.empty(shape), np.empty(shape)
        for f in range(bins.shape[1]):
            key = at + bins[:, f]
            sums[:, f] = np.bincount(key, gradient, size).reshape(-1, n_bins)
            rows[:, f] = np.bincount(key, minlength=size).reshape(-1, n_bins)
        yield number, sums, rows


def _moved(states, trees):
    """The partitions with a finished tree's values added to their predictions."""
    for number, bins, labels, margin in states:
        tree = trees[number]
        yield number, bins, labels, margin + np.array(tree.value)[tree.walk(bins)]


def fit_together(tasks: Sequence[tuple[DataFrame, HistBoost]]) -> list[BoostedTreesModel]:
    """Fit one model for each (rows, estimator), all in the same passes.

    The estimators share their settings but for the label, and their inputs have equal length. Each
    input is binned by quantiles of its task's rows (all values, if there are fewer than bins). Rows
    with a null label are left out. A task's input should be a written table, which gives a repeated
    task the same rows in the same order.
    """
    one = tasks[0][1]
    settings = {p: one.getOrDefault(p) for p in ("maxIter", "maxDepth", "stepSize", "subsamplingRate", "maxBins", "regLambda", "minChildWeight", "seed")}
    if any(e.getOrDefault(p) != v for _, e in tasks for p, v in settings.items()):
        raise ValueError("models that grow together need equal settings")
    n_bins, penalty, step = settings["maxBins"], settings["regLambda"], settings["stepSize"]
    if not 2 <= n_bins <= 256:
        raise ValueError("maxBins must be from 2 to 256")
    spark = tasks[0][0].sparkSession
    shared_dir(spark)  # sets the checkpoint folder where the session has none

    growing, parts = [], []
    for number, (dataset, estimator) in enumerate(tasks):
        features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
        rows = dataset.where(F.col(label).isNotNull())
        head = rows.select(vector_to_array(features).alias("x")).first()
        if head is None:
            raise ValueError(f"no rows with {label}")
        marks = [i / n_bins for i in range(1, n_bins)]
        x = vector_to_array(features)
        stats = rows.agg(
            F.avg(label).alias("mean"), F.count(F.lit(1)).alias("n"), (F.max(label) - F.min(label)).alias("spread"),
            *[F.percentile_approx(F.get(x, F.lit(i)), marks, 10_000).alias(f"q{i}") for i in range(len(head.x))],
        ).first()
        cuts = [np.unique(np.array(stats[f"q{i}"], float)) for i in range(len(head.x))]
        # Predictions stay near the labels' range; a sum of n gradients must stay below 2^53.
        scale = 2.0 ** np.floor(np.log2(2.0**50 / (stats["n"] * max(4 * float(stats["spread"]), 1e-9))))
        growing.append(_Grown(cuts, float(stats["mean"]), scale))
        rows = rows.coalesce(max(1, -(-stats["n"] // PARTITION_ROWS)))
        parts.append(_binned(rows, features, label, cuts, float(stats["mean"]), number))

    state = spark.sparkContext.union(parts).persist()
    partitions, width, stale = state.getNumPartitions(), len(growing[0].cuts), None
    for round_ in range(settings["maxIter"]):
        for g in growing:
            g.tree, g.frontier = Tree(), [0]
        for _level in range(settings["maxDepth"]):
            asked = [(g.tree, g.frontier, g.scale) for g in growing]
            if not any(f for _, f, _ in asked):
                break
            splits = _pass(state, asked, n_bins, width, partitions, settings, round_)
            for g, found in zip(growing, splits, strict=True):
                _grow(g, found, penalty, step)
        if stale is not None:
            stale.unpersist()
        trees = [g.tree for g in growing]
        for g in growing:
            g.done.append(g.tree)
        if round_ + 1 < settings["maxIter"]:
            stale = state
            state = state.mapPartitions(lambda states, trees=trees: _moved(states, trees)).persist()
            if (round_ + 1) % CHECKPOINT_ROUNDS == 0:
                state.checkpoint()
    state.unpersist()
    if stale is not None:
        stale.unpersist()
    return [_model(g, e) for g, (_, e) in zip(growing, tasks, strict=True)]


def _pass(state: RDD, asked, n_bins: int, width: int, partitions: int, settings: dict, round_: int) -> list[list[Split | None]]:
    """The best split of each frontier node of each model."""
    rate, seed, penalty, least = (settings[p] for p in ("subsamplingRate", "seed", "regLambda", "minChildWeight"))

    def sums(index, states):
        return _histograms(index, states, asked, n_bins, rate, seed, round_)

    def decide(number, gradients, rows, first=0):
        return best_splits(gradients / asked[number][2], rows, penalty, least, first)

    found = state.mapPartitionsWithIndex(sums)
    size = 16 * n_bins * width * sum(len(f) for _, f, _ in asked) * partitions
    if size <= DIRECT_BYTES:
        totals: dict = {}
        for number, gradients, rows in found.collect():  # at most DIRECT_BYTES
            have = totals.get(number)
            totals[number] = (gradients, rows) if have is None else (have[0] + gradients, have[1] + rows)
        return [decide(n, *totals[n]) if n in totals else [] for n in range(len(asked))]
    by_feature = found.flatMap(lambda h: [((h[0], f), (h[1][:, f : f + 1], h[2][:, f : f + 1])) for f in range(width)])
    summed = by_feature.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), numPartitions=min(partitions, width * len(asked)))
    decided = sorted(summed.map(lambda kv: (kv[0], decide(kv[0][0], *kv[1], kv[0][1]))).collect(), key=lambda x: x[0])  # one split a node and feature
    out: list[list[Split | None]] = [[None] * len(f) for _, f, _ in asked]
    for (number, _feature), splits in decided:
        for i, s in enumerate(splits):
            if s and (out[number][i] is None or s.gain > out[number][i].gain):
                out[number][i] = s
    return out


def _grow(g: _Grown, splits: list[Split | None], penalty: float, step: float) -> None:
    tree, after = g.tree, []
    for node, split in zip(g.frontier, splits, strict=True):
        if split is None:
            continue
        sides = []
        for gradient, rows in (split.left, split.right):
            at = tree.leaf()
            tree.value[at], tree.cover[at] = -step * gradient / (rows + penalty), rows
            sides.append(at)
        tree.feature[node], tree.cut[node], tree.gain[node] = split.feature, split.bin, split.gain
        tree.left[node], tree.right[node] = sides
        if node == 0:
            tree.cover[0] = split.left[1] + split.right[1]
        after += sides
    g.frontier = after


def _model(g: _Grown, estimator: HistBoost) -> BoostedTreesModel:
    trees = []
    for t in g.done:
        cut = [float(g.cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.cut, strict=True)]
        trees.append({**vars(t), "cut": cut})
    model = BoostedTreesModel()
    stored = json.dumps({"base": g.base, "inputs": len(g.cuts), "trees": trees})
    return model._set(featuresCol=estimator.getFeaturesCol(), predictionCol=estimator.getPredictionCol(), trees=stored)
