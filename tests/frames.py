"""Seeded small frames for the tests."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

START = datetime(2026, 4, 1)


def hours(n, start=START):
    return [start + timedelta(hours=i) for i in range(n)]


def readings(sizes, seed=7, nulls=0.2, gaps=0.1):
    """Hourly readings for ``{city: rows}`` with nulls, missing hours and tied values."""
    rng = np.random.default_rng(seed)
    parts = []
    for city, n in sizes.items():
        ts = np.array(hours(int(n * (1 + 2 * gaps)) + 2))
        ts = ts[np.sort(rng.choice(len(ts), n, replace=False))]
        part = pd.DataFrame({"city": city, "ts": ts})
        for col, scale in (("aqi", 50), ("pm25", 20), ("pm10", 30)):
            v = np.round(np.abs(rng.normal(scale, scale / 2, n)), 0)
            part[col] = np.where(rng.random(n) < nulls, np.nan, v)
        parts.append(part)
    out = pd.concat(parts, ignore_index=True)
    out["id"] = range(len(out))
    return out.sample(frac=1, random_state=seed).reset_index(drop=True)


def plain(value):
    """A pandas cell as the Python value Spark expects, NaN as None."""
    if value is None or (isinstance(value, float) and np.isnan(value)) or value is pd.NaT:
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if isinstance(value, np.generic) else value


def nulled(spark, pdf, schema):
    """A Spark frame with NaN turned into null."""
    return spark.createDataFrame([tuple(map(plain, row)) for row in pdf.itertuples(index=False)], schema)


READING = "city string, ts timestamp, aqi double, pm25 double, pm10 double, id long"


def table(spark, sizes, **kw):
    pdf = readings(sizes, **kw)
    return pdf, nulled(spark, pdf, READING)


def collected(df, *order):
    return df.orderBy(*order).toPandas()
