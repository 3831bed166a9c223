"""Climate, soil and detection layers: temporal statistics, seasons, wide and long forms, metadata of negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_null
from .quantiles import exact_percentiles

# Months of the seasons.
SEASONS = {"djf": (12, 1, 2), "mam": (3, 4, 5), "jja": (6, 7, 8), "son": (9, 10, 11)}


def temporal_stats(cube: DataFrame, cell: str, v: str) -> DataFrame:
    p = F.percentile(v, F.array(F.lit(0.1), F.lit(0.9)))
    out = cube.groupBy(cell).agg(F.avg(v).alias(f"{v}_mean"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.stddev_pop(v).alias(f"{v}_std"), p.alias("__p"))
    return out.select("*", F.col("__p")[0].alias(f"{v}_p10"), F.col("__p")[1].alias(f"{v}_p90")).drop("__p")


def seasonal_means(cube: DataFrame, cell: str, v: str, include_dec: bool = True, percentiles: bool = False) -> DataFrame:
    """Season means; a season without months is NULL. percentiles: the 10th and 90th of each season as well."""
    months = {k: m if include_dec or k != "djf" else (1, 2) for k, m in SEASONS.items()}
    inside = {k: F.when(F.col("month").isin(*m), F.col(v)) for k, m in months.items()}
    more = [F.percentile(x, p).alias(f"{v}_{k}_p{round(100 * p)}") for k, x in inside.items() for p in (0.1, 0.9)] if percentiles else []
    return cube.groupBy(cell).agg(*(F.avg(x).alias(f"{v}_{k}") for k, x in inside.items()), *more)


def monthly_wide(cube: DataFrame, cell: str, v: str) -> DataFrame:
    return cube.groupBy(cell).agg(*(F.max(F.when(F.col("month") == m, F.col(v))).alias(f"{v}_{m:02d}") for m in range(1, 13)))


def monthly_long(wide: DataFrame, cell: str, v: str) -> DataFrame:
    out = wide.unpivot([cell], [f"{v}_{m:02d}" for m in range(1, 13)], "name", v)
    return out.where(F.col(v).isNotNull()).select(cell, F.substring("name", -2, 2).cast("int").alias("month"), v)


# What stands for no data in rasters.
RASTER_SENTINELS = (-9999.0, -999.0, -99.0, -9.0, 9999.0, 999.0, 99.0, 9.0)


def layer_statistics(df: DataFrame, v: str, sentinels: tuple[float, ...] = RASTER_SENTINELS) -> DataFrame:
    """One row of statistics of the finite values that are no sentinel; skew and kurt for more than 10 values."""
    clean = df.select(to_null(F.col(v).cast("double"), sentinels).alias("x"))
    q1, med, q3 = exact_percentiles(clean, ["x"], [0.25, 0.5, 0.75])["x"]
    x, number = F.col("x"), lambda y: F.lit(y).cast("double")
    many = F.count(x) > 10
    return clean.agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.avg(x).alias("mean"), F.max(x).alias("hi"), F.stddev_pop(x).alias("sd"), number(med).alias("median"),
        number(q1).alias("q25"), number(q3).alias("q75"), number(None if q1 is None else q3 - q1).alias("iqr"),
        F.when(many, F.skewness(x)).alias("skew"), F.when(many, F.kurtosis(x)).alias("kurt"), (100 * F.count_if(x.isNull()) / F.count("*")).alias("pct_nodata"),
    )


def fill_negative_metadata(df: DataFrame) -> DataFrame:
    """Columns that only detections have get neutral values where fire = 0."""
    # What stands in for a detection's metadata.
    neutral = {"frp": 0.0, "daynight": "U", "country": "AOI", "confidence_normalized": "0"}
    for c, v in neutral.items():
        have = F.col(c) if c in df.columns else F.lit(None).cast("double" if isinstance(v, float) else "string")
        df = df.withColumn(c, F.when(F.col("fire") == 0, F.coalesce(have, F.lit(v))).otherwise(have))
    return df
