"""Training, comparing and scoring forecasts with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.config import HORIZONS, MIN_TRAIN_ROWS, TEST_SHARE
from airloom.functions.advice import advisory
from airloom.functions.scalars import clamp_round
from airloom.operators.drift import split_tail
from airloom.operators.latest import latest_row
from airloom.operators.ordered import Layout, Series, with_rows
from airloom.operators.predicates import min_rows_guard
from airloom.operators.schema import select_features
from airloom.plans.boosting import HistBoost, fit_together
from airloom.session import settled

# Model settings.
RIDGE_ALPHA = 1.0
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "seed": 42}
BOOST = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42}


def ridge(train: DataFrame, label: str, alpha: float = RIDGE_ALPHA):
    """Ridge with penalty ``alpha`` on the raw coefficients.

    Spark divides the penalty by the row count and by the label deviation, so both go into
    ``regParam``. The normal-equation solver needs one pass and up to 4096 features.
    """
    n, spread = train.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    return LinearRegression(
        featuresCol="features", labelCol=label, elasticNetParam=0.0, standardization=False, solver="normal",
        regParam=alpha * (spread or 0.0) / max(n, 1),
    )


def forest(train: DataFrame, label: str, **changes):
    return RandomForestRegressor(featuresCol="features", labelCol=label, **{**FOREST, **changes})


def boost(train: DataFrame, label: str, **changes):
    return HistBoost(featuresCol="features", labelCol=label, **{**BOOST, **changes})


Maker = Callable[[DataFrame, str], object]

#: Fits that run side by side on the cluster.
FITS_AT_ONCE = 4


def _together(make: Maker) -> bool:
    """Whether models of all labels grow in the same passes."""
    return make is boost or getattr(make, "together", False)


MODELS: dict[str, Maker] = {"ridge": ridge, "random_forest": forest, "boosted_trees": boost}


def fit(train: DataFrame, features: Sequence[str], label: str, make: Maker) -> PipelineModel:
    """Assemble and fit; null features count as 0, as in serving."""
    filled = train.na.fill(0.0, list(features))
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), make(filled, label)]
    return Pipeline(stages=stages).fit(filled)


def fit_each(trains: Mapping[str, DataFrame], features: Sequence[str], make: Maker) -> dict[str, PipelineModel]:
    """One model for each label and its rows. Boosted trees of all labels grow in the same passes."""
    filled = {label: train.na.fill(0.0, list(features)) for label, train in trains.items()}
    makers = {label: make(rows, label) for label, rows in filled.items()}
    if not all(isinstance(m, HistBoost) for m in makers.values()):
        return {label: fit(trains[label], features, label, lambda _rows, label: makers[label]) for label in trains}
    inputs = VectorAssembler(inputCols=list(features), outputCol="features")
    models = fit_together([(inputs.transform(filled[label]), makers[label]) for label in trains])
    return {label: PipelineModel([inputs, model]) for label, model in zip(trains, models, strict=True)}


def reg_metrics(df: DataFrame, key: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows, RMSE, MAE and R2 per key, in one pass; R2 is null for a constant label."""
    error = F.col(label) - F.col(prediction)
    return df.groupBy(*key).agg(
        F.count(error).alias("rows"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(label) * F.count(error))).alias("r2"),
    )


def best_models(metrics: DataFrame) -> DataFrame:
    """The model with the smallest RMSE per horizon, the first name on ties."""
    order = F.struct("rmse", "model_name")
    return metrics.groupBy("horizon_hours").agg(F.min(order).alias("b")).select("horizon_hours", "b.model_name", "b.rmse")


def model_report(metrics: DataFrame) -> DataFrame:
    """All models by horizon and RMSE, the best ones marked."""
    best = best_models(metrics).select("horizon_hours", F.col("model_name").alias("_best"))
    out = metrics.join(best, "horizon_hours").withColumn("is_best", F.col("model_name") == F.col("_best"))
    return out.drop("_best").orderBy("horizon_hours", "rmse", "model_name")


def train_summary(metrics: DataFrame) -> DataFrame:
    """Models per horizon, and in total where the horizon is null."""
    return metrics.rollup("horizon_hours").agg(F.count(F.lit(1)).alias("models"))


def train_grid(
    table: DataFrame,
    series: Series,
    target: str = "aqi",
    horizons: Sequence[int] = tuple(HORIZONS),
    models: Mapping[str, Maker] = MODELS,
    features: Sequence[str] | None = None,
    least: int = MIN_TRAIN_ROWS,
    layout: Layout | None = None,
) -> tuple[DataFrame, dict[tuple[str, int], PipelineModel]]:
    """Every model for every horizon: metrics table, and the fitted models.

    The last fifth of each series tests what the first four fifths train, all series pooled. The
    features and the targets of all horizons are made in one pass and written to the shared folder
    once. A handful of driver threads starts the fits, each of which is distributed; boosted trees of
    all horizons are one fit.
    """
    enough = min_rows_guard(table, series.key, least)
    features = list(features or select_features(enough.drop(*series.key, *series.ties), target))
    labels = {h: f"{target}_target_{h}h" for h in horizons}
    ahead = with_rows(
        enough, series, lambda w: {n: F.lead(target, h).over(w) for h, n in labels.items()}, after=max(horizons), layout=layout
    )
    kept = dict.fromkeys([*series.key, *series.order, *features, *labels.values()])
    ahead = settled(ahead.select(*kept), "training")
    trains, tests = {}, {}
    for label in labels.values():
        split = settled(split_tail(ahead.where(F.col(label).isNotNull()), series, TEST_SHARE, True), "split")
        trains[label], tests[label] = split.where(~F.col("in_tail")), split.where("in_tail")
    # The fits do not depend on each other; each is distributed, and the driver's threads only start them.
    jobs = {name: [list(labels.values())] if _together(make) else [[x] for x in labels.values()] for name, make in models.items()}

    def work(name: str, some: list[str]) -> dict[str, PipelineModel]:
        return fit_each({x: trains[x] for x in some}, features, models[name])

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        waiting = {name: [pool.submit(copy_context().run, work, name, some) for some in parts] for name, parts in jobs.items()}
        made = {name: {k: m for w in found for k, m in w.result().items()} for name, found in waiting.items()}
    fitted, scores = {}, []
    for h, label in labels.items():
        for name in models:
            fitted[name, h] = model = made[name][label]
            scored = model.transform(tests[label].na.fill(0.0, features))
            row = reg_metrics(scored, (), label).first()
            scores.append((name, h, row.rows, row.rmse, row.mae, row.r2))
    schema = "model_name string, horizon_hours int, rows long, rmse double, mae double, r2 double"
    return table.sparkSession.createDataFrame(scores, schema), fitted


def score(
    table: DataFrame,
    series: Series,
    models: Mapping[int, PipelineModel],
    features: Sequence[str],
) -> DataFrame:
    """Forecast of every series from its newest row: one advised row per series and horizon.

    Features are matched by name; a missing column or value counts as 0.
    """
    newest = latest_row(table, series)
    have = set(newest.columns)
    inputs = newest.select(
        *series.key, series.ts, *[(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in features]
    )
    # the newest rows are found once; one model after the other adds its column to them
    made = {h: f"_p{i}" for i, h in enumerate(models)}
    for h, model in models.items():
        inputs = model.transform(inputs).select(*inputs.columns, clamp_round("prediction").alias(made[h]))
    rows = F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.col(c).alias("prediction")) for h, c in made.items()])
    every = inputs.select(*series.key, series.ts, F.explode(rows).alias("_p")).select(*series.key, series.ts, "_p.*")
    found = advisory("prediction")
    return every.withColumns({n: found[n] for n in ("level", "color", "advice")})


def ranked(importance: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Features by importance, largest first."""
    order = F.col("importance").desc(), F.col("feature")
    if key:
        return importance.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return importance.orderBy(*order)
