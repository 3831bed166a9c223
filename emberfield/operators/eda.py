"""Statistical tests. Moments and counts are Spark aggregations; distribution functions run on the driver on single numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bands, normal_quantile
from .features import correlations
from .quantiles import exact_percentiles
from .tables import ranked


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def _gammaq(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_pvalue(t: float, dof: float) -> float:
    """Two-sided."""
    return _betainc(dof / 2, 0.5, dof / (dof + t * t))


def chi2_pvalue(x: float, dof: int) -> float:
    return _gammaq(dof / 2, x / 2)


def point_biserial(df: DataFrame, column: str, y: str) -> dict[str, float | None]:
    """r and its two-sided p; None where they aren't defined (fewer than 3 rows, or no spread)."""
    n, r = df.where(F.col(column).isNotNull() & F.col(y).isNotNull()).agg(F.count("*"), F.try_divide(F.covar_pop(column, y), F.stddev_pop(column) * F.stddev_pop(y))).first()
    if n < 3 or r is None:
        return {"r": r, "p": None}
    return {"r": r, "p": 0.0 if r * r >= 1 else t_pvalue(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)}


def two_sample_t(df: DataFrame, column: str, y: str) -> dict[str, float | None]:
    """Equal variances; None where a class has fewer than two values or there is no spread."""
    g = {r[0]: r for r in df.where(F.col(y).isin(0, 1)).groupBy(y).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v")).collect()}
    a, b = g.get(1), g.get(0)
    if not a or not b or min(a["n"], b["n"]) < 2:
        return {"t": None, "p": None}
    pooled = ((a["n"] - 1) * a["v"] + (b["n"] - 1) * b["v"]) / (a["n"] + b["n"] - 2)
    if not pooled:
        return {"t": None, "p": None}
    t = (a["m"] - b["m"]) / math.sqrt(pooled * (1 / a["n"] + 1 / b["n"]))
    return {"t": t, "p": t_pvalue(t, a["n"] + b["n"] - 2)}


def chi_square(df: DataFrame, a: str, b: str, correction: bool = False) -> DataFrame:
    """One row (chi2, dof, p); `correction`: each difference of a 2 x 2 table is up to 1/2 smaller."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra, cb, t = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb")), n.agg(F.sum("n").alias("t"))
    cells = ra.crossJoin(cb).join(n, ["a", "b"], "left").crossJoin(F.broadcast(t))  # levels x levels, not rows
    e = F.col("na") * F.col("nb") / F.col("t")
    gap = F.abs(F.coalesce("n", F.lit(0)) - e)
    less = F.pow(gap - F.least(F.lit(0.5), gap), 2) / e
    r = cells.agg(F.sum(gap * gap / e).alias("x"), F.sum(less).alias("y"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("dof")).first()
    x = r["y"] if correction and r["dof"] == 1 else r["x"]
    return df.sparkSession.createDataFrame([(x, r["dof"], chi2_pvalue(x, r["dof"]) if r["dof"] else None)], "chi2 double, dof long, p double")


def variability(cv: Column) -> Column:
    """A label of the coefficient of variation in percent."""
    return bands(cv, [15, 35, 50], ["low", "moderate", "high", "very high"])


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, skew, kurt, cv, skew_label, variability, normal): |skew| < 0.5 is symmetric; normal by skew, kurtosis and mean near median."""
    med = exact_percentiles(df, columns, [0.5])
    parts = [F.struct(F.lit(c).alias("column"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt"), (100 * F.stddev_samp(c) / F.avg(c)).alias("cv"),
                      (F.abs(F.avg(c) - F.lit(med[c][0]).cast("double")) / F.stddev_samp(c)).alias("gap")) for c in columns]
    out = df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    label = F.when(F.abs("skew") < 0.5, "symmetric").when(F.col("skew") > 0, "right").otherwise("left")
    out = out.withColumn("skew_label", label).withColumn("variability", variability(F.abs("cv")))
    return out.withColumn("normal", (F.abs("skew") < 0.5) & (F.abs("kurt") < 0.5) & (F.col("gap") < 0.1)).drop("gap")


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_r2(y, x).alias("r2"))


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density at evenly spaced points, from at most 4096 weighted bins of the column; bandwidth n^(-1/5) std."""
    s = df.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 4096
    bins = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(s)).groupBy(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(4095)).alias("b")).agg(F.count("*").alias("w"))
    at = df.sparkSession.range(points).crossJoin(F.broadcast(s)).select((F.col("lo") + F.col("id") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"), "n", "lo", (F.pow("n", F.lit(-0.2)) * F.col("sd")).alias("h"), ((F.col("hi") - F.col("lo")) / 4096).alias("width"))
    z = (F.col("x") - (F.col("lo") + (F.col("b") + 0.5) * F.col("width"))) / F.col("h")
    return at.crossJoin(F.broadcast(bins)).groupBy("x").agg((F.sum(F.col("w") * F.exp(-z * z / 2)) / F.first(F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def castable_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, share) of values that read as numbers."""
    parts = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).cast("string").try_cast("double").isNotNull().cast("int")).alias("share")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def qq_points(df: DataFrame, column: str, key: str, bins: int = 200) -> DataFrame:
    """(theoretical, sample) at `bins` even probabilities; sample is the exact interpolated quantile."""
    some = df.select(F.col(column).cast("double").alias("x"), F.col(key).alias("k")).where("x is not null")
    n = some.count()
    at = {k: (k + 0.5) / bins * (n - 1) for k in range(bins if n else 0)}
    wanted = sorted({r for p in at.values() for r in (math.floor(p), math.ceil(p))})
    places = df.sparkSession.createDataFrame([(r + 1,) for r in wanted], "rank long")
    rows = ranked(some, [], [F.col("x"), F.col("k")], "rank").join(F.broadcast(places), "rank").select("rank", "x").collect()
    x = {r["rank"] - 1: r["x"] for r in rows}
    out = [((k + 0.5) / bins, x[math.floor(p)] + (x[math.ceil(p)] - x[math.floor(p)]) * (p - math.floor(p))) for k, p in at.items()]
    return df.sparkSession.createDataFrame(out, "p double, sample double").select(normal_quantile(F.col("p")).alias("theoretical"), "sample")


def shapiro_wilk(df: DataFrame, column: str, key: str, most: int = 5000) -> dict[str, float | None]:
    """W and p of Shapiro and Wilk by Royston's approximation (1995), on at most `most` rows by a hash of the key; at least 20 rows.
    None where all values are equal."""
    x = np.sort(np.array([r[0] for r in df.where(F.col(column).isNotNull()).orderBy(F.xxhash64(F.col(key)), key).limit(most).select(column).collect()], dtype=float))
    if len(x) < 20:
        raise ValueError("at least 20 values are needed")
    w, p = royston(x)
    return {"w": w, "p": p}


def royston(x: np.ndarray) -> tuple[float | None, float | None]:
    """W and p of sorted values, twelve or more for p."""
    n = len(x)
    if x[0] == x[-1]:
        return None, None
    normal = NormalDist()
    m = np.array([normal.inv_cdf((k + 0.625) / (n + 0.25)) for k in range(n)])
    u, c = 1 / math.sqrt(n), m / math.sqrt(m @ m)
    # Coefficients of the published polynomials in u and ln n.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
    next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
    mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], math.log(n)), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], math.log(n)))
    a = m / math.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2))
    a[-1], a[-2], a[0], a[1] = last, next_, -last, -next_
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    return w, 1 - normal.cdf((math.log(max(1e-300, 1 - w)) - mean) / sd)


def recommendations(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(topic, detail): imbalance (share of label 1 below 0.3 or above 0.7), skewed (|skew| above 1), outliers (over 10 % beyond 1.5
    interquartile ranges) and collinear pairs (|r| above 0.85, "a, b")."""
    spark = df.sparkSession
    q = exact_percentiles(df, columns, [0.25, 0.75])
    far = lambda c: (F.col(c) < q[c][0] - 1.5 * (q[c][1] - q[c][0])) | (F.col(c) > q[c][1] + 1.5 * (q[c][1] - q[c][0]))
    r = df.agg(F.avg(F.col(y).cast("double")).alias("__y"), *(F.struct(F.skewness(c).alias("skew"), (F.avg(far(c).cast("int")) if q[c][0] is not None else F.lit(0.0)).alias("far")).alias(c) for c in columns)).first()
    out = [("imbalance", y)] if r["__y"] is not None and not 0.3 <= r["__y"] <= 0.7 else []
    out += [("skewed", c) for c in columns if abs(r[c]["skew"] or 0) > 1]
    out += [("outliers", c) for c in columns if (r[c]["far"] or 0) > 0.1]
    if len(columns) > 1:
        out += [("collinear", f"{p['a']}, {p['b']}") for p in correlations(df, columns).collect() if p["r"] is not None and abs(p["r"]) > 0.85]
    return spark.createDataFrame(out, "topic string, detail string")
