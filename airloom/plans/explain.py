"""Which features a model leans on."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.config import SAMPLE_ROWS
from airloom.operators.latest import sample_tail
from airloom.operators.ordered import Series
from airloom.plans.boosting import BoostedTreesModel
from airloom.plans.training import ranked
from airloom.session import scratch, settled


def linear_importance(model: PipelineModel, sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution ``coefficient * (value - mean)``: exact for linear models.

    Two aggregates over the sample, whatever its size.
    """
    weights = dict(zip(features, model.stages[-1].coefficients))
    filled = sample.na.fill(0.0, list(features))
    means = filled.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    centred = filled.join(F.broadcast(means), F.lit(True), "left")
    wide = centred.agg(*[F.avg(F.abs(F.lit(float(weights[f])) * (F.col(f) - F.col(f"_m_{f}")))).alias(f) for f in features])
    return _long(wide, features)


def impurity_importance(model: PipelineModel, sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of the impurity reduction (of the gain) of all splits in the fitted trees."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    rows = list(zip(features, values))
    return sample.sparkSession.createDataFrame(rows, "feature string, importance double")


def tree_importance(model: PipelineModel, sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute attribution of each feature over the sample."""
    found = attributions(model, sample, features)
    wide = found.agg(*[F.avg(F.abs(F.get("attributions", F.lit(i)))).alias(f) for i, f in enumerate(features)])
    return _long(wide, features)


TREE_TABLE = "tree int, node int, left int, right int, feature int, cut double, value double, cover double"


def tree_table(model: PipelineModel, spark: SparkSession) -> tuple[float, DataFrame]:
    """A fitted model's base value and its trees, one row for each node (leaf: feature -1).

    A prediction is the base plus the values of the leaves a row ends in, one for each tree. ``cover``
    is the number of training rows at the node. Spark's own models are read from their stored form.
    """
    trees = model.stages[-1]
    if isinstance(trees, BoostedTreesModel):
        base, parsed = trees.parsed()
        rows = [
            (i, n, t.left[n], t.right[n], t.feature[n], t.cut[n], t.value[n], float(t.cover[n]))
            for i, t in enumerate(parsed) for n in range(len(t.feature))
        ]
        return base, spark.createDataFrame(rows, TREE_TABLE)
    path = scratch(spark, "trees")
    trees.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" not in data.columns:  # a single tree
        data = data.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    weights = [float(w) for w in getattr(trees, "treeWeights", [1.0])]
    share = [w / len(weights) if "Forest" in type(trees).__name__ else w for w in weights]
    node = F.col("nodeData")
    leaf = node["leftChild"] < 0
    table = data.select(
        F.col("treeID").cast("int").alias("tree"), node["id"].cast("int").alias("node"), node["leftChild"].cast("int").alias("left"),
        node["rightChild"].cast("int").alias("right"), F.when(leaf, -1).otherwise(node["split"]["featureIndex"]).cast("int").alias("feature"),
        F.when(leaf, 0.0).otherwise(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
        (node["prediction"] * F.get(F.array(*map(F.lit, share)), F.col("treeID").cast("int"))).alias("value"), node["rawCount"].cast("double").alias("cover"),
    )
    return 0.0, table


@dataclass(frozen=True)
class Paths:
    """All leaves: value (leaves), and the features on the way to each (leaves, most): inputs in
    (low, high] stay on it, ``share`` is that of the training rows. Filled up with neutral entries."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @property
    def mean(self) -> float:
        """The prediction if nothing is known, less the base: leaves weighted by their training rows."""
        return float((self.value * self.share.prod(axis=1)).sum())


def leaf_paths(rows: Sequence) -> Paths:
    """The leaves of a collected tree table, whose size is the model's."""
    nodes = {(r.tree, r.node): r for r in rows}
    below = {(r.tree, c) for r in rows if r.feature >= 0 for c in (r.left, r.right)}
    leaves = []
    todo = [(r, {}) for at, r in sorted(nodes.items()) if at not in below]
    while todo:
        node, way = todo.pop()
        if node.feature < 0:
            leaves.append((node.value, way))
            continue
        low, high, share = way.get(node.feature, (-np.inf, np.inf, 1.0))
        for child, ends in ((node.left, (low, min(high, node.cut))), (node.right, (max(low, node.cut), high))):
            to = nodes[node.tree, child]
            todo.append((to, {**way, node.feature: (*ends, share * (to.cover / node.cover if node.cover else 0.0))}))
    most = max([1, *(len(way) for _, way in leaves)])
    filled = [[(f, *v) for f, v in way.items()] + [(0, -np.inf, np.inf, 1.0)] * (most - len(way)) for _, way in leaves]
    table = np.array(filled, float).reshape(len(leaves), most, 4)
    return Paths(np.array([v for v, _ in leaves], float), table[:, :, 0].astype(int), table[:, :, 1], table[:, :, 2], table[:, :, 3])


def path_attributions(paths: Paths, inputs: np.ndarray) -> np.ndarray:
    """Shapley values of one row: how much each input moves the prediction away from the mean.

    A leaf's share in a coalition is the product over its path of 1 or 0 (known inputs on or off the
    path) and of the training share (unknown inputs). Weighing coalitions by size is integrating that
    product over t with every input known at odds t; it is a polynomial, so a few Gauss points are exact.
    """
    at = inputs[paths.feature]
    on = ((at > paths.low) & (at <= paths.high)).astype(float)
    moved = np.zeros_like(on)
    points, weights = np.polynomial.legendre.leggauss(-(-paths.feature.shape[1] // 2))
    for point, weight in zip((points + 1) / 2, weights / 2, strict=True):
        part = paths.share * (1 - point) + on * point
        # the product without each factor, from the left and from the right: a share may be 0
        left = np.cumprod(np.hstack([np.ones((len(part), 1)), part[:, :-1]]), axis=1)
        right = np.cumprod(np.hstack([np.ones((len(part), 1)), part[:, :0:-1]]), axis=1)[:, ::-1]
        moved += weight * left * right
    moved *= (on - paths.share) * paths.value[:, None]
    return np.bincount(paths.feature.ravel(), moved.ravel(), len(inputs))


def attributions(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``attributions`` (one value for each feature, summing to the prediction less
    ``expected``) and ``expected``, the mean prediction of the training rows, for any tree model.

    Null features count as 0, as in training. The trees are as large as the model and go to every task.
    """
    base, table = tree_table(model, df.sparkSession)
    paths = leaf_paths(table.collect())  # as many rows as the model has nodes

    @F.pandas_udf("array<double>")
    def explained(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([path_attributions(paths, np.array(x, float)).tolist() for x in part])

    inputs = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return df.withColumns({"attributions": explained(inputs), "expected": F.lit(base + paths.mean)})


def permutation_importance(model: PipelineModel, sample: DataFrame, features: Sequence[str], label: str, seed: int = 42, bucket_rows: int = 50_000) -> DataFrame:
    """How much the RMSE grows when one feature is shuffled between the rows of the sample.

    Rows trade places inside random buckets of about ``bucket_rows`` rows, so no task ranks the whole
    sample, whatever its size and however many rows are equal. All features are scored in one pass
    over rows times features.
    """
    inputs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    base = sample.where(F.col(label).isNotNull()).select(F.col(label).alias("_y"), *inputs)
    base = settled(base.withColumn("_n", F.monotonically_increasing_id()), "sample")
    buckets = -(-base.count() // bucket_rows) or 1
    rows = base.withColumn("_bucket", F.pmod(F.xxhash64("_n"), F.lit(buckets)))
    place = Window.partitionBy("_bucket")
    given = rows.withColumn("_place", F.row_number().over(place.orderBy("_n")))
    shuffled = rows.withColumn("_place", F.row_number().over(place.orderBy(F.xxhash64("_n", F.lit(seed)), "_n")))
    other = shuffled.select("_bucket", "_place", *[F.col(f).alias(f"_s_{f}") for f in features])
    both = given.join(other, ["_bucket", "_place"])
    which = F.explode(F.array(F.lit(""), *[F.lit(f) for f in features]))
    mixed = both.withColumn("feature", which).select(
        "_y", "feature", *[F.when(F.col("feature") == f, F.col(f"_s_{f}")).otherwise(F.col(f)).alias(f) for f in features]
    )
    error = F.col("prediction") - F.col("_y")
    scores = model.transform(mixed).groupBy("feature").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    start = F.broadcast(scores.where("feature = ''").select(F.col("rmse").alias("_base")))
    return scores.where("feature <> ''").join(start, F.lit(True)).select("feature", (F.col("rmse") - F.col("_base")).alias("importance"))


def _long(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def importance(model: PipelineModel, table: DataFrame, series: Series, features: Sequence[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """Ranked features of one model on the newest ``n`` rows of each series."""
    sample = sample_tail(table, series, n)
    linear = hasattr(model.stages[-1], "coefficients")
    return ranked((linear_importance if linear else tree_importance)(model, sample, features))


def importance_all(
    models: Mapping[int, PipelineModel], table: DataFrame, series: Series, features: Sequence[str], n: int = SAMPLE_ROWS
) -> DataFrame:
    """Ranked features of the model of every horizon."""
    parts = [importance(m, table, series, features, n).withColumn("horizon_hours", F.lit(h)) for h, m in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("horizon_hours", F.desc("importance"), "feature")
