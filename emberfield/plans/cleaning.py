"""Queries: climate layers, cleaning, outliers, imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean as C, features as X, layers as L
from .registry import query, rounded


@query("a01_temporal_stats", """
, f AS (SELECT cell, month, coalesce(prec, avg(prec) OVER (PARTITION BY cell), avg(prec) OVER ()) AS x FROM climate)
SELECT cell, round(avg(x), 4) AS prec_mean, round(min(x), 4) AS prec_min, round(max(x), 4) AS prec_max, round(stddev_pop(x), 4) AS prec_std, round(quantile_cont(x, 0.1), 4) AS prec_p10, round(quantile_cont(x, 0.9), 4) AS prec_p90 FROM f GROUP BY cell""", "climate")
def temporal(t):
    return rounded(L.temporal_stats(C.fill_from_cell(t.climate, ["cell"], "prec"), "cell", "prec"), 4)


SEASON = {"djf": "12, 1, 2", "mam": "3, 4, 5", "jja": "6, 7, 8", "son": "9, 10, 11"}


@query("a02_seasonal_means", "SELECT cell, " + ", ".join(f"round(avg(tmax) FILTER (WHERE month IN ({m})), 4) AS tmax_{k}, " + ", ".join(f"round(quantile_cont(tmax, {q}) FILTER (WHERE month IN ({m})), 4) AS tmax_{k}_p{p}" for q, p in ((0.1, 10), (0.9, 90))) for k, m in SEASON.items()) + " FROM climate GROUP BY cell", "climate")
def seasonal(t):
    return rounded(L.seasonal_means(t.climate, "cell", "tmax", percentiles=True), 4)


@query("a03_monthly_pivot", "SELECT cell, " + ", ".join(f"max(CASE WHEN month = {m} THEN tmin END) AS tmin_{m:02d}" for m in range(1, 13)) + " FROM climate GROUP BY cell", "climate")
def monthly(t):
    return L.monthly_wide(t.climate, "cell", "tmin")


@query("a04_cube_to_long", "SELECT cell, month, tmin FROM climate WHERE tmin IS NOT NULL", "climate")
def to_long(t):
    return L.monthly_long(L.monthly_wide(t.climate, "cell", "tmin"), "cell", "tmin")


@query("c13_cell_mean_impute", "SELECT cell, month, round(coalesce(prec, avg(prec) OVER (PARTITION BY cell), avg(prec) OVER ()), 4) AS prec FROM climate", "climate")
def cell_mean(t):
    return rounded(C.fill_from_cell(t.climate.select("cell", "month", "prec"), ["cell"], "prec"), 4)


STATS = """, s AS (SELECT cell, avg(tmax) AS tmax_mean, max(tmax) AS tmax_max, avg(tmin) AS tmin_mean, min(tmin) AS tmin_min, avg(prec) AS prec_mean, stddev_pop(prec) AS prec_std, quantile_cont(prec, 0.1) AS prec_p10,
avg(tmax) FILTER (WHERE month IN (6, 7, 8)) AS tj, avg(tmax) FILTER (WHERE month IN (12, 1, 2)) AS td, avg(prec) FILTER (WHERE month IN (6, 7, 8)) AS pj, avg(prec) FILTER (WHERE month IN (12, 1, 2)) AS pd FROM climate GROUP BY cell)
"""


def cell_stats(t):
    out = L.temporal_stats(t.climate, "cell", "tmax").join(L.temporal_stats(t.climate, "cell", "tmin"), "cell").join(L.temporal_stats(t.climate, "cell", "prec"), "cell")
    return out.join(L.seasonal_means(t.climate, "cell", "tmax"), "cell").join(L.seasonal_means(t.climate, "cell", "prec"), "cell")


@query("e01_climate_derived", STATS + "SELECT cell, round(tmax_mean - tmin_mean, 4) AS t_range, round(12 * prec_mean, 4) AS prec_total, round(tmax_mean / (prec_mean + 1), 4) AS dryness_index, round((tj / (pj + 1)) / (td / (pd + 1)), 4) AS dryness_season_ratio FROM s", "climate")
def derived(t):
    return rounded(X.climate_derived(cell_stats(t)).select("cell", "t_range", "prec_total", "dryness_index", "dryness_season_ratio"), 4)


@query("e02_climate_features", STATS + """SELECT cell, round(tmax_max - tmin_min, 4) AS annual_temp_range, round(tmax_mean, 4) AS avg_tmax, round(tmin_mean, 4) AS avg_tmin, round(tmax_mean - tmin_mean, 4) AS diurnal_temp_range,
round(12 * prec_mean, 4) AS total_annual_precip, round(prec_std, 4) AS precip_variability, round(prec_p10, 4) AS dry_season_intensity, round(tmax_mean * (1 - prec_p10 / (12 * prec_mean + 1e-6)), 4) AS heat_dryness_index, round(tmax_mean / (12 * prec_mean + 1e-6), 4) AS drought_index FROM s""", "climate")
def climate_features(t):
    names = ["annual_temp_range", "avg_tmax", "avg_tmin", "diurnal_temp_range", "total_annual_precip", "precip_variability", "dry_season_intensity", "heat_dryness_index", "drought_index"]
    return rounded(X.climate_features(X.climate_derived(cell_stats(t))).select("cell", *names), 4)


IQR = """
, v AS (SELECT r, c, CASE WHEN z = -9999 THEN NULL ELSE CASE WHEN c = 3 THEN z * 3 ELSE z END END AS z FROM dem), s AS (SELECT quantile_cont(z, 0.25) AS q1, quantile_cont(z, 0.75) AS q3 FROM v)
"""


def spiked(t):
    z = S.to_null(F.col("z"), S.SENTINELS)
    return t.dem.select("r", "c", F.when(F.col("c") == 3, z * 3).otherwise(z).alias("z"))


@query("c01_iqr_winsorise", IQR + "SELECT r, c, round(CASE WHEN z < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) WHEN z > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE z END, 4) AS z FROM v, s", "dem")
def iqr(t):
    return rounded(C.winsorise_iqr(spiked(t), ["z"]), 4)


@query("c02_percentile_winsorise", """, s AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS b FROM features)
SELECT id, round(CASE WHEN price < a THEN a WHEN price > b THEN b ELSE price END, 4) AS price FROM features, s""", "features")
def percentile(t):
    return rounded(C.winsorise_percentile(t.features.select("id", "price"), ["price"]), 4)


@query("c03_outliers_iqr", IQR + "SELECT r, c, coalesce(z < q1 - 1.5 * (q3 - q1) OR z > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM v, s", "dem")
def flag_iqr(t):
    return C.outlier_flags(spiked(t), "z", "iqr").drop("z")


@query("c03_outliers_z", ", s AS (SELECT avg(price) AS m, stddev_samp(price) AS d FROM features) SELECT id, abs((price - m) / d) > 1.8 AS is_outlier FROM features, s", "features")
def flag_z(t):
    return C.outlier_flags(t.features.select("id", "price"), "price", "z", 1.8).drop("price")


@query("c03_outliers_mad", ", m AS (SELECT median(price) AS m FROM features), d AS (SELECT median(abs(price - m)) AS d FROM features, m) SELECT id, abs(0.6745e0 * (price - m) / d) > 1.2e0 AS is_outlier FROM features, m, d", "features")
def flag_mad(t):
    return C.outlier_flags(t.features.select("id", "price"), "price", "mad", 1.2).drop("price")


@query("c03_outliers_percentile", ", s AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS b FROM features) SELECT id, price < a OR price > b AS is_outlier FROM features, s", "features")
def flag_pct(t):
    return C.outlier_flags(t.features.select("id", "price"), "price", "percentile").drop("price")


@query("c04_outlier_cooccurrence", """
, s AS (SELECT quantile_cont(price, 0.01) AS pa, quantile_cont(price, 0.99) AS pb, quantile_cont(quantity, 0.01) AS qa, quantile_cont(quantity, 0.99) AS qb FROM features),
f AS (SELECT CAST(price < pa OR price > pb AS INT) AS p, CAST(quantity < qa OR quantity > qb AS INT) AS q FROM features, s)
SELECT CAST(sum(p) AS BIGINT) AS price, CAST(sum(q) AS BIGINT) AS quantity, CAST(sum(p * q) AS BIGINT) AS both, CAST(count(*) FILTER (WHERE p + q > 0) AS BIGINT) AS any_outlier FROM f""", "features")
def cooccurrence(t):
    df = C.outlier_flags(t.features.select("id", "price", "quantity"), "price", "percentile").withColumnRenamed("is_outlier", "p")
    df = C.outlier_flags(df, "quantity", "percentile").withColumnRenamed("is_outlier", "q")
    p, q = F.col("p").cast("int"), F.col("q").cast("int")
    return df.agg(F.sum(p).alias("price"), F.sum(q).alias("quantity"), F.sum(p * q).alias("both"), F.count_if(p + q > 0).alias("any_outlier"))


@query("c05_mean_or_median", """, s AS (SELECT avg(z) AS m, median(z) AS d, stddev_samp(z) AS sd FROM dem) SELECT r, c, round(coalesce(z, CASE WHEN abs(m - d) / sd <= 0.1 THEN m ELSE d END), 4) AS z FROM dem, s""", "dem")
def mean_median(t):
    return rounded(C.mean_or_median(t.dem.select("r", "c", "z"), ["z"]), 4)


@query("c06_mode_fill", """, n AS (SELECT r, c, CASE WHEN c % 9 = 0 THEN NULL ELSE kind END AS kind FROM dem), m AS (SELECT kind AS k FROM n WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) SELECT r, c, coalesce(kind, k) AS kind FROM n, m""", "dem")
def mode_fill(t):
    return C.fill_with(t.dem.select("r", "c", F.when(F.col("c") % 9 != 0, F.col("kind")).alias("kind")), ["kind"], "mode")


@query("c07_categorical_detector", "SELECT count(DISTINCT quantity) <= 20 AND count(DISTINCT quantity) < 0.05 * count(quantity) AS quantity, count(DISTINCT season) <= 20 AND count(DISTINCT season) < 0.05 * count(season) AS season FROM features", "features")
def categorical(t):
    got = {c: C.decide(t.features, c).categorical for c in ("quantity", "season")}
    return t.spark.range(1).select(*(F.lit(v).alias(k) for k, v in got.items()))


@query("c08_symmetry", "SELECT abs((avg(pow(x - m, 3))) / pow(stddev_pop(x), 3)) < 0.5 AS symmetric FROM (SELECT price AS x, avg(price) OVER () AS m FROM features)", "features")
def symmetry(t):
    return t.features.agg((F.abs(F.skewness("price")) < 0.5).alias("symmetric"))


SYM = """, o AS (SELECT *, z BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v, s), m AS (SELECT abs(avg(pow(z - a, 3)) / pow(stddev_pop(z), 3)) < 0.5 AS sym FROM (SELECT z, avg(z) OVER () AS a FROM v WHERE z IS NOT NULL))"""
FILLED = """, f AS (SELECT CASE WHEN (SELECT sym FROM m) THEN avg(z) ELSE median(z) END AS fill, avg(CASE WHEN z IS NULL THEN 1.0 ELSE 0 END) AS miss FROM t)
SELECT r, c, round(CASE WHEN z IS NULL AND miss <= 0.05 THEN fill ELSE z END, 4) AS z FROM t, f"""


@query("c09_smart_impute", IQR + SYM + """, k AS (SELECT CASE WHEN (SELECT sym FROM m) THEN avg(z) FILTER (WHERE inside) ELSE median(z) FILTER (WHERE inside) END AS x FROM o),
t AS (SELECT r, c, CASE WHEN z IS NULL OR inside THEN z ELSE x END AS z FROM o, k)""" + FILLED, "dem")
def smart(t):
    return rounded(C.impute_smart(spiked(t), "z")[0], 4)


@query("c09_smart_impute_grid", IQR + SYM + """, t AS (SELECT a.r, a.c, CASE WHEN any_value(a.z) IS NULL OR bool_or(a.inside) THEN max(a.z) ELSE coalesce(avg(b.z) FILTER (WHERE b.inside), max(a.z)) END AS z
FROM o a LEFT JOIN o b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c)""" + FILLED, "dem")
def smart_grid(t):
    return rounded(C.impute_smart_grid(spiked(t), "z")[0], 4)


@query("c10_coordinate_impute", """
, p AS (SELECT sid, CASE WHEN sid % 50 = 0 THEN NULL ELSE latitude END AS latitude, CASE WHEN sid % 50 = 0 THEN NULL ELSE longitude END AS longitude FROM stations), m AS (SELECT avg(latitude) AS a, avg(longitude) AS o FROM p),
k AS (SELECT avg(latitude) AS a, avg(longitude) AS o FROM (SELECT latitude, longitude FROM p, m WHERE latitude IS NOT NULL ORDER BY pow(latitude - a, 2) + pow(longitude - o, 2), sid LIMIT 5))
SELECT sid, round(coalesce(latitude, a), 6) AS latitude, round(coalesce(longitude, o), 6) AS longitude FROM p, k""", "stations")
def coordinates(t):
    hole = lambda c: F.when(F.col("sid") % 50 != 0, F.col(c)).alias(c)
    return rounded(C.impute_coordinates(t.stations.select("sid", hole("latitude"), hole("longitude")), "latitude", "longitude", "sid"), 6)


@query("c11_median_fill", "SELECT r, c, round(coalesce(z, (SELECT median(z) FROM dem)), 4) AS z FROM dem", "dem")
def median_fill(t):
    return rounded(C.fill_with(t.dem.select("r", "c", "z"), ["z"], "median"), 4)


@query("c12_threshold_fill", "SELECT sid, slope FROM stations", "stations")
def threshold_fill(t):
    return C.fill_with(t.stations.select("sid", "slope"), ["slope"], "median", 0.05)


@query("c14_range_clamp", "SELECT soil_id, CASE WHEN bsat BETWEEN 0 AND 100 THEN bsat END AS bsat, CASE WHEN clay >= 0 THEN clay END AS clay FROM soil", "soil")
def clamp(t):
    return t.soil.select("soil_id", C.range_to_null(F.col("bsat"), 0, 100).alias("bsat"), C.range_to_null(F.col("clay"), 0, None).alias("clay"))


@query("c16_negative_metadata", "SELECT sid, 0e0 AS frp, 'U' AS daynight, 'AOI' AS country, '0' AS confidence_normalized FROM stations", "stations")
def metadata(t):
    return L.fill_negative_metadata(t.stations.select("sid", F.lit(0).alias("fire"))).select("sid", "frp", "daynight", "country", "confidence_normalized")


@query("c17_layer_coordinates", "SELECT sid, latitude AS latitude_clim, longitude AS longitude_clim FROM stations", "stations")
def layer_coordinates(t):
    df = t.stations.select("sid", "latitude", "longitude", F.when(F.col("sid") % 2 == 0, F.col("latitude")).alias("latitude_clim"), F.lit(None).cast("double").alias("longitude_clim"))
    return df.select("sid", *(F.coalesce(f"{c}_clim", c).alias(f"{c}_clim") for c in ("latitude", "longitude")))


@query("c18_texture_total", "SELECT soil_id, sand + silt + clay AS texture_total, sand + silt + clay > 120 OR sand + silt + clay < 60 AS texture_flag FROM soil", "soil")
def texture_total(t):
    total = reduce(lambda a, b: a + b, map(F.col, ("sand", "silt", "clay")))
    return t.soil.select("soil_id", total.alias("texture_total"), ((total > 120) | (total < 60)).alias("texture_flag"))


@query("a20_layer_statistics", """, v AS (SELECT CASE WHEN z NOT IN (-9999, -999, -99, -9, 9999, 999, 99, 9) THEN z END AS z FROM dem), m AS (SELECT avg(z) AS m, stddev_pop(z) AS s FROM v)
SELECT CAST(count(z) AS BIGINT) AS n, round(min(z), 4) AS lo, round(avg(z), 4) AS mean, round(max(z), 4) AS hi, round(stddev_pop(z), 4) AS sd, round(median(z), 4) AS median, round(quantile_cont(z, 0.25), 4) AS q25, round(quantile_cont(z, 0.75), 4) AS q75, round(quantile_cont(z, 0.75) - quantile_cont(z, 0.25), 4) AS iqr,
round(avg(pow((z - m.m) / m.s, 3)), 4) AS skew, round(avg(pow((z - m.m) / m.s, 4)) - 3, 4) AS kurt, round(100.0 * (count(*) - count(z)) / count(*), 4) AS pct_nodata FROM v, m""", "dem")
def layer_stats(t):
    return rounded(L.layer_statistics(t.dem, "z"), 4)


