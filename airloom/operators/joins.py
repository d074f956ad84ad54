"""Point-in-time, range, merge, fallback and lookup joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.config import LEVELS, TTL_HOURS
from airloom.functions.advice import advisory
from airloom.operators.ordered import CHUNK_ROWS, Layout, Series, first_rows, join_back, with_nearest
from airloom.operators.schema import quoted


def pit_join(
    requests: DataFrame,
    features: DataFrame,
    key: Sequence[str],
    request_ts: str,
    feature_ts: str,
    cols: Sequence[str],
    ttl_hours: float = TTL_HOURS,
    ties: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    layout: Layout | None = None,
) -> DataFrame:
    """For each request the newest feature row of its key at or before its time, at most ``ttl_hours`` old.

    Both sides go into one ordered stream per key, features before requests at equal times, and
    each request takes the last feature seen: one shuffle of each side, no pairs, never a look
    ahead. ``ties`` order feature rows with equal times, the last one counts; without them the values
    decide. A request with a null in its key finds nothing. Keys with very many rows are cut by time
    like every ordered operator.
    """
    ties = list(ties) or list(cols)
    held = F.struct(F.col(feature_ts).alias("_at"), *[F.col(c) for c in cols])
    own = list(requests.columns)
    ask = requests.select(
        *[F.col(k) for k in key],
        F.col(request_ts).alias("_ts"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in own]).alias("_request"),
    )
    give = features.select(
        *[F.col(k) for k in key],
        F.col(feature_ts).alias("_ts"),
        F.lit(0).alias("_side"),
        *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)],
        held.alias("_feature"),
    )
    both = ask.unionByName(give, allowMissingColumns=True)
    series = Series(tuple(key), "_ts", ("_side", *[f"_t{i}" for i in range(len(ties))]), chunk_rows)
    found = with_nearest(both, series, {"_last": "_feature"}, layout=layout).where(F.col("_side") == 1)
    fresh = F.col("_last._at") >= F.col("_ts") - F.make_dt_interval(secs=F.lit(ttl_hours * 3600.0))
    for k in key:
        fresh = fresh & F.col(f"_request.{quoted(k)}").isNotNull()
    return found.select(
        *[F.col(f"_request.{quoted(c)}") for c in own],
        F.when(fresh, F.col("_last._at")).alias("feature_ts"),
        *[F.when(fresh, F.col(f"_last.{quoted(c)}")).alias(c) for c in cols],
    )


def source_merge(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Two feeds into one reading per key, partial where one is missing.

    Columns of both feeds take the value of the left one unless it is null, so a feed that lists
    columns it has no values for cannot wipe out the other one.
    """
    shared = [c for c in left.columns if c in right.columns and c not in key]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    out = left.join(renamed, list(key), "full_outer")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in shared}).drop(*[f"_r_{c}" for c in shared])


def advisory_lookup(df: DataFrame, aqi: str, levels=LEVELS) -> DataFrame:
    """Add level, color, advice and the shown value.

    The level table is a configured handful of rows, so the range join is a CASE chain inside the
    scan stage: no join, no shuffle, and it works on streams.
    """
    found = advisory(aqi, levels)
    return df.withColumns({n: found[n] for n in ("level", "color", "advice", "shown")})


def multi_horizon_advice(df: DataFrame, horizons: Mapping[int, str], keep: Sequence[str]) -> DataFrame:
    """``{hours: prediction column}`` to one advised row per horizon."""
    long = df.select(
        *keep,
        F.explode(F.array(*[
            F.struct(F.lit(h).alias("horizon_hours"), F.col(c).alias("prediction")) for h, c in horizons.items()
        ])).alias("_one"),
    ).select(*keep, "_one.*")
    return advisory_lookup(long, "prediction")


def online_lookup(requests: DataFrame, features: DataFrame, series: Series, cols: Sequence[str]) -> DataFrame:
    """The newest feature row of each requested key; unknown keys and missing features are null."""
    newest = first_rows(features, series.key, series.descending())
    have = [c for c in cols if c in features.columns]
    out = join_back(requests.select(*series.key).distinct(), newest.select(*series.key, series.ts, *have), series.key)
    missing = {c: F.lit(None).cast("double") for c in cols if c not in have}
    return out.withColumns(missing) if missing else out


def best_model_join(best: DataFrame, metrics: DataFrame) -> DataFrame:
    """The metadata of the best model of each horizon."""
    return best.join(metrics, ["model_name", "horizon_hours"])


def fallback_source(primary: DataFrame, secondary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``primary``; keys it does not have come from ``secondary``."""
    known = primary.select(*key).distinct()
    names = {k: f"_k{i}" for i, k in enumerate(key)}
    right = known.withColumnsRenamed(names)
    missing: Column = F.lit(True)
    for k, n in names.items():
        missing = missing & secondary[k].eqNullSafe(right[n])
    rest = secondary.join(right, missing, "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def lineage(catalogue: DataFrame, name: str | None = None) -> DataFrame:
    """Feature and its direct dependencies with their source and category; unknown ones are null."""
    wanted = catalogue.where(F.col("name") == name) if name else catalogue
    edges = wanted.select(F.col("name").alias("feature"), F.explode("dependencies").alias("dependency"))
    nodes = catalogue.select(F.col("name").alias("dependency"), "source", "category")
    return edges.join(nodes, "dependency", "left").select("feature", "dependency", "source", "category")
