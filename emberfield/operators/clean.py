"""Statistics-driven cleaning: winsorising, outlier flags, imputation. Statistics of all columns are one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from .grid import focal
from .quantiles import exact_percentiles


def stats_row(df: DataFrame, columns: list[str], p: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row: for each column a struct of n, mean, std_pop, std_samp, skew, distinct and the percentiles p."""
    q = exact_percentiles(df, columns, list(p))
    return df.agg(*(F.struct(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_pop"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skew"),
        F.array(*(F.lit(v).cast("double") for v in q[c])).alias("p"),
    ).alias(c) for c in columns))


def winsorise_iqr(df: DataFrame, columns: list[str], factor: float = 1.5, least: int = 10) -> DataFrame:
    """Caps at q1 - f iqr and q3 + f iqr; columns of fewer than `least` values or no spread stay."""
    s = stats_row(df, columns).select(*(F.col(c).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(s))
    for c in columns:
        q1, q3, n = F.col(f"__{c}.p")[0], F.col(f"__{c}.p")[2], F.col(f"__{c}.n")
        iqr = q3 - q1
        out = out.withColumn(c, F.when((n >= least) & (iqr > 0), clip(F.col(c), q1 - factor * iqr, q3 + factor * iqr)).otherwise(F.col(c)))
    return out.select(*df.columns)


def winsorise_percentile(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    s = stats_row(df, columns, (low, high)).select(*(F.col(c).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(s))
    for c in columns:
        out = out.withColumn(c, clip(F.col(c), F.col(f"__{c}.p")[0], F.col(f"__{c}.p")[1]))
    return out.select(*df.columns)


def outlier_flags(df: DataFrame, column: str, method: str = "iqr", k: float | None = None) -> DataFrame:
    """df with is_outlier by iqr (1.5), z (3, sample), mad (3.5) or percentile (1 and 99)."""
    x = F.col(column)
    if method == "mad":
        m = exact_percentiles(df, [column], [0.5])[column][0]
        d = exact_percentiles(df.select(F.abs(x - F.lit(m)).alias("d")), ["d"], [0.5])["d"][0] if m is not None else None
        flag = F.abs(0.6745 * (x - F.lit(m)) / F.lit(d)) > (k or 3.5) if d else F.lit(False)
        out = df
    else:
        s = stats_row(df, [column], (0.25, 0.5, 0.75, 0.01, 0.99)).select(F.col(column).alias("__s"))
        out = df.crossJoin(F.broadcast(s))
        p = F.col("__s.p")
        if method == "iqr":
            f, iqr = k or 1.5, p[2] - p[0]
            flag = (x < p[0] - f * iqr) | (x > p[2] + f * iqr)
        elif method == "z":
            flag = F.abs((x - F.col("__s.mean")) / F.nullif(F.col("__s.std"), F.lit(0.0))) > (k or 3.0)
        else:
            flag = (x < p[3]) | (x > p[4])
    return out.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).select(*df.columns, "is_outlier")


def mean_or_median(df: DataFrame, columns: list[str], closeness: float = 0.1) -> DataFrame:
    """Fills NULL with the mean if |mean - median| / std (sample) is at most closeness, else with the median."""
    s = stats_row(df, columns).select(*(F.col(c).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(s))
    for c in columns:
        mean, med, sd = F.col(f"__{c}.mean"), F.col(f"__{c}.p")[1], F.col(f"__{c}.std")
        near = F.coalesce(F.abs(mean - med) / F.nullif(sd, F.lit(0.0)) <= closeness, F.lit(True))
        out = out.withColumn(c, F.coalesce(F.col(c), F.when(near, mean).otherwise(med)))
    return out.select(*df.columns)


def fill_with(df: DataFrame, columns: list[str], how: str, most_missing: float | None = None) -> DataFrame:
    """Fills NULL with mean, median or mode (smallest on ties); with most_missing only columns of 0 < share <= it."""
    q = exact_percentiles(df, columns, [0.5]) if how == "median" else {}
    if how == "mode":  # of counts, so that a column of many values is not gathered
        q = {c: [r[0] if (r := df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()) else None] for c in columns}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    stat = {"mean": F.avg, "median": lambda c: F.lit(q[c][0]).cast("double"), "mode": lambda c: F.lit(q[c][0]).cast(kinds[c])}[how]
    s = df.agg(*(F.struct(stat(c).alias("v"), F.avg(F.col(c).isNull().cast("int")).alias("miss")).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(s))
    for c in columns:
        value = F.col(f"__{c}.v")
        if most_missing is not None:
            value = F.when(F.col(f"__{c}.miss") <= most_missing, value)
        out = out.withColumn(c, F.coalesce(F.col(c), value))
    return out.select(*df.columns)


def fill_from_cell(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """NULL becomes the mean of its cell, else the mean of all: partial sums and a join on the cell."""
    per = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.avg(column).alias("__cell"))
    every = df.agg(F.avg(column).alias("__all"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    out = df.join(per, same, "left").crossJoin(F.broadcast(every)).withColumn(column, F.coalesce(column, "__cell", "__all"))
    return out.select(*df.columns)


def range_to_null(x: Column, low: float | None, high: float | None) -> Column:
    return F.when(x.between(low if low is not None else float("-inf"), high if high is not None else float("inf")), x)


@dataclass(frozen=True)
class Decision:
    """What impute_smart does with a column."""

    column: str
    categorical: bool
    symmetric: bool
    low: float | None
    high: float | None
    fill: float | None
    missing_share: float


def decide(df: DataFrame, column: str, max_fill: float = 0.05) -> Decision:
    """One profile aggregation decides: categorical (n >= 20, integers, few uniques), symmetric (|skew| < 0.5, or n < 10), outlier bounds."""
    x = F.col(column)
    r = df.agg(
        F.count("*").alias("rows"), F.count(x).alias("n"), F.count_distinct(x).alias("u"), F.bool_and(x == F.floor(x)).alias("whole"), F.skewness(x).alias("skew"),
        F.avg(x).alias("mean"),
    ).first()
    if not r["n"]:
        return Decision(column, False, True, None, None, None, 1.0)
    q = exact_percentiles(df, [column], [0.25, 0.5, 0.75])[column]
    categorical = bool(r["n"] >= 20 and r["whole"] and r["u"] <= 20 and r["u"] < 0.05 * r["n"])
    symmetric = r["n"] < 10 or r["skew"] is None or abs(r["skew"]) < 0.5
    iqr = q[2] - q[0]
    low, high = (None, None) if categorical or iqr <= 0 else (q[0] - 1.5 * iqr, q[2] + 1.5 * iqr)
    mode = df.agg(F.mode(x, True)).first()[0] if categorical else None  # few distinct values
    return Decision(column, categorical, symmetric, low, high, mode if categorical else r["mean"] if symmetric else q[1], 1 - r["n"] / r["rows"])


def _fill_rest(df: DataFrame, column: str, d: Decision, max_fill: float) -> tuple[DataFrame, Decision]:
    """Missing values, up to a share of max_fill, take the mode, mean or median of what the treatment of outliers left."""
    if d.fill is None or not 0 < d.missing_share <= max_fill:
        return df, d
    if not d.categorical and d.low is not None:
        d = replace(d, fill=df.agg(F.avg(column)).first()[0] if d.symmetric else exact_percentiles(df, [column], [0.5])[column][0])
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(float(d.fill)))), d


def impute_smart(df: DataFrame, column: str, max_fill: float = 0.05) -> tuple[DataFrame, Decision]:
    """Outliers become the mean (symmetric) or median of the rest; then missing values are filled, only up to a share of max_fill."""
    d, x = decide(df, column), F.col(column)
    if d.low is not None:
        inside = x.between(d.low, d.high)
        rest = df.where(inside)
        value = rest.agg(F.avg(x)).first()[0] if d.symmetric else exact_percentiles(rest, [column], [0.5])[column][0]
        df = df.withColumn(column, F.when(x.isNull() | inside, x).otherwise(F.lit(value)))
    return _fill_rest(df, column, d, max_fill)


def impute_smart_grid(grid: DataFrame, column: str, max_fill: float = 0.05) -> tuple[DataFrame, Decision]:
    """impute_smart for a grid (r, c): outliers become the mean of the valid cells around them that are no outliers, and stay where
    there are none."""
    d, x = decide(grid, column), F.col(column)
    if d.low is not None:
        inside = x.between(d.low, d.high)
        grid = focal(grid.withColumn("__v", F.when(inside, x)), "__v", F.avg("v"), "__m", center=False)
        grid = grid.withColumn(column, F.when(x.isNull() | inside, x).otherwise(F.coalesce("__m", x))).drop("__v", "__m")
    return _fill_rest(grid, column, d, max_fill)


def impute_coordinates(df: DataFrame, lat: str, lon: str, key: str, k: int = 5) -> DataFrame:
    """Missing coordinates become the mean of the k points nearest the mean point."""
    c = df.agg(F.avg(lat).alias("__a"), F.avg(lon).alias("__o"))
    near = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).crossJoin(F.broadcast(c)).orderBy(F.pow(F.col(lat) - F.col("__a"), 2) + F.pow(F.col(lon) - F.col("__o"), 2), key).limit(k)
    v = near.agg(F.avg(lat).alias("__a"), F.avg(lon).alias("__o"))
    return df.crossJoin(F.broadcast(v)).withColumn(lat, F.coalesce(lat, "__a")).withColumn(lon, F.coalesce(lon, "__o")).drop("__a", "__o")
