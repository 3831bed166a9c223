"""Queries: scans, projections, filters, joins by key, aggregations, windows, samples, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import spatial, tables as T
from ..operators.quantiles import exact_percentiles
from .registry import query, rounded

FIRE_GROUPS = """
SELECT month, type, CAST(count(*) AS BIGINT) AS n, round(avg(frp), 4) AS frp_mean, round(stddev_samp(frp), 4) AS frp_std, round(max(frp), 4) AS frp_max
FROM fires WHERE latitude BETWEEN 22 AND 36 AND longitude BETWEEN -6 AND 10 GROUP BY month, type"""


@query("a13_fire_groups", FIRE_GROUPS, "fires")
def fire_groups(t):
    inside = t.fires.where("latitude between 22 and 36 and longitude between -6 and 10")
    out = inside.groupBy("month", "type").agg(F.count("*").alias("n"), F.avg("frp").alias("frp_mean"), F.stddev_samp("frp").alias("frp_std"), F.max("frp").alias("frp_max"))
    return rounded(out, 4)


@query("s11_column_pruned_scan", "SELECT round(min(latitude), 4) AS lo, round(max(latitude), 4) AS hi FROM fires", "fires")
def pruned(t):
    return rounded(t.fires.agg(F.min("latitude").alias("lo"), F.max("latitude").alias("hi")), 4)


@query("p01_numeric_coercion", "SELECT id, TRY_CAST(acq_time AS DOUBLE) AS t, TRY_CAST(confidence AS DOUBLE) AS c FROM fires", "fires")
def coercion(t):
    return t.fires.select("id", S.coerce(F.col("acq_time")).alias("t"), S.coerce(F.col("confidence")).alias("c"))


@query("p02_drop_missing", "SELECT r, c, z FROM dem WHERE z IS NOT NULL", "dem")
def drop_missing(t):
    return t.dem.select("r", "c", "z").na.drop(subset=["z"])


@query("p03_keep_list", "SELECT soil_id, sand, silt, clay, ph_water FROM soil", "soil")
def keep_list(t):
    return T.keep_columns(t.soil, ["SOIL_ID", "sand", "Silt", "CLAY", "PH_WATER", "sand"])


@query("p04_low_information", "SELECT id, latitude, longitude, frp FROM fires", "fires")
def low_information(t):
    df = t.fires.select("id", "latitude", "longitude", "frp", "month", F.lit("sat").alias("satellite"), F.lit(1).alias("scan"))
    return T.drop_uninformative(df, ["scan"], ["satellite", "month"])


@query("p05_token_pruning", "SELECT prec FROM climate", "climate")
def token_pruning(t):
    df = t.climate.select("prec", F.col("tmax").alias("tmax_mean"), F.col("tmin").alias("prec_total"), F.col("cell").alias("grid_index"))
    return T.drop_by_token(df, ["prec"])


@query("p06_confidence_filter", "SELECT id, confidence FROM fires WHERE confidence IN ('n', 'h')", "fires")
def confidence(t):
    score = S.coerce(F.col("confidence"))
    return t.fires.where(F.when(score.isNotNull(), score >= 50).otherwise(F.col("confidence").isin("n", "h"))).select("id", "confidence")


@query("p07_type_filter", "SELECT id, type FROM fires WHERE type IS DISTINCT FROM 2", "fires")
def type_filter(t):
    return t.fires.where(~F.equal_null("type", F.lit(2))).select("id", "type")


@query("p08_filter_relax", "SELECT id, 1 AS filter_relaxed FROM fires", "fires")
def filter_relax(t):
    return T.relax_if_empty(t.fires.select("id", "frp"), F.col("frp") > 1e9).select("id", "filter_relaxed")


@query("p09_bounding_box", "SELECT id FROM fires WHERE latitude BETWEEN 25 AND 30 AND longitude BETWEEN 0 AND 5", "fires")
def bounding_box(t):
    return t.fires.where(F.col("latitude").between(25, 30) & F.col("longitude").between(0, 5)).select("id")


@query("p10_min_latitude", "SELECT sid FROM stations WHERE latitude >= (SELECT min(latitude) + 5 FROM fires)", "stations", "fires")
def min_latitude(t):
    low = t.fires.agg((F.min("latitude") + 5).alias("lo"))
    return t.stations.crossJoin(F.broadcast(low)).where("latitude >= lo").select("sid")


@query("p11_lower_whisker", "SELECT id, frp FROM fires WHERE frp >= (SELECT quantile_cont(frp, 0.25) - 0.5 * (quantile_cont(frp, 0.75) - quantile_cont(frp, 0.25)) FROM fires)", "fires")
def whisker(t):
    return T.lower_whisker(t.fires.select("id", "frp"), "frp", 0.5)


@query("p13_multiselect", "SELECT id FROM fires WHERE country IN ('west') AND month IN (1, 2) AND type IN (0, 3)", "fires")
def multiselect(t):
    return t.fires.where(F.col("country").isin("west") & F.col("month").isin(1, 2) & F.col("type").isin(0, 3)).select("id")


@query("p14_validity", "SELECT CAST(count(*) FILTER (WHERE NOT coalesce(latitude BETWEEN 21 AND 36, false)) AS BIGINT) AS bad_lat, CAST(count(*) FILTER (WHERE NOT coalesce(longitude BETWEEN -7 AND 11, false)) AS BIGINT) AS bad_lon FROM fires", "fires")
def validity(t):
    bad = lambda c, a, b: F.count_if(~F.coalesce(F.col(c).between(a, b), F.lit(False)))
    return t.fires.agg(bad("latitude", 21, 36).alias("bad_lat"), bad("longitude", -7, 11).alias("bad_lon"))


@query("p16_metadata_lookup", "SELECT kind, r, c FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY r, c) AS k FROM dem) WHERE k = 1", "dem")
def metadata(t):
    return T.keep_first(t.dem, ["kind"], ["r", "c"]).select("kind", "r", "c")


@query("k06_paged_view", "SELECT id, frp FROM fires ORDER BY id LIMIT 25 OFFSET 50", "fires")
def paged(t):
    return t.fires.select("id", "frp").orderBy("id").offset(50).limit(25)


# joins by key
@query("j01_exact_key_join", """
, s AS (SELECT CAST(round(latitude * 2) AS BIGINT) AS ky, CAST(round(longitude * 2) AS BIGINT) AS kx, elevation, row_number() OVER (PARTITION BY round(latitude * 2), round(longitude * 2) ORDER BY sid) AS k FROM stations)
SELECT id, s.elevation AS elevation_soil, s.k IS NOT NULL AS matched FROM fires f
LEFT JOIN s ON CAST(round(f.latitude * 2) AS BIGINT) = s.ky AND CAST(round(f.longitude * 2) AS BIGINT) = s.kx AND s.k = 1""", "fires", "stations")
def exact_key(t):
    key = lambda df: df.withColumn("ky", F.round(F.col("latitude") * 2).cast("long")).withColumn("kx", F.round(F.col("longitude") * 2).cast("long"))
    out = spatial.exact_left_join(key(t.fires).select("id", "ky", "kx"), key(t.stations).select("sid", "ky", "kx", "elevation"), ["ky", "kx"], ["sid"], "soil")
    return out.select("id", "elevation_soil", "matched")


@query("j04_fill_only_missing", """
SELECT d.r, d.c, coalesce(CASE WHEN d.z > 0 THEN d.z END, CAST(s.elevation AS DOUBLE)) AS z FROM dem d LEFT JOIN stations s ON s.sid = d.r * 40 + d.c""", "dem", "stations")
def fill_missing(t):
    base = t.dem.select((F.col("r") * 40 + F.col("c")).cast("long").alias("sid"), "r", "c", F.when(F.col("z") > 0, F.col("z")).alias("z"))
    return spatial.fill_missing_from(base, t.stations.select("sid", F.col("elevation").alias("z")), "sid", ["z"]).select("r", "c", "z")


@query("j09_month_cube_sample", "SELECT f.id, c.prec, c.tmax FROM fires f LEFT JOIN climate c ON c.cell = f.user_id % 25 AND c.month = f.month + 5", "fires", "climate")
def month_cube(t):
    f = t.fires.select("id", (F.col("user_id") % 25).cast("int").alias("cell"), (F.col("month") + 5).alias("month"))
    return f.join(t.climate, ["cell", "month"], "left").select("id", "prec", "tmax")


@query("j10_dimension_lookup", "SELECT sid, s.soil_id, sand, clay, texture FROM stations s LEFT JOIN soil o ON o.soil_id = s.soil_id", "stations", "soil")
def dimension(t):
    # the dimension is the fixed list of soil units: its size does not follow the points
    return t.stations.select("sid", "soil_id").join(T.keep_first(t.soil, ["soil_id"], ["texture"]), "soil_id", "left").select("sid", "soil_id", "sand", "clay", "texture")


@query("j11_legend_mapping", """
SELECT r, c, CASE WHEN r % 3 = 0 THEN NULL ELSE coalesce(a.n_name, b.r_name) END AS label FROM dem
LEFT JOIN nation a ON a.n_nationkey = c LEFT JOIN region b ON b.r_regionkey = r % 7""", "dem")
def legend(t):
    first, second = t.nation.select(F.col("n_nationkey").alias("c"), "n_name"), t.region.select(F.col("r_regionkey").alias("g"), "r_name")
    out = t.dem.select("r", "c", (F.col("r") % 7).alias("g")).join(first, "c", "left").join(second, "g", "left")
    return out.select("r", "c", F.when(F.col("r") % 3 != 0, F.coalesce("n_name", "r_name")).alias("label"))


@query("j14_positional_concat", "SELECT d.r, d.c, d.z, p.p_size AS size FROM dem d JOIN part p ON p.p_partkey = d.r * 40 + d.c", "dem")
def positional(t):
    return t.dem.withColumn("k", (F.col("r") * 40 + F.col("c")).cast("long")).join(t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size")), "k").select("r", "c", "z", "size")


@query("j15_score_tables", "SELECT a.cluster, a.n, b.m FROM (SELECT cluster, CAST(count(*) AS BIGINT) AS n FROM features GROUP BY 1) a LEFT JOIN (SELECT cluster, round(avg(price), 3) AS m FROM features WHERE fire = 1 GROUP BY 1) b USING (cluster)", "features")
def scores(t):
    f = t.features
    a, b = f.groupBy("cluster").agg(F.count("*").alias("n")), f.where("fire = 1").groupBy("cluster").agg(F.round(F.avg("price"), 3).alias("m"))
    return a.join(b, "cluster", "left")


@query("j17_outer_align", "SELECT coalesce(a.cell, b.soil_id) AS cell, a.tmax, b.sand FROM (SELECT cell, max(tmax) AS tmax FROM climate GROUP BY cell) a FULL JOIN soil b ON a.cell = b.soil_id", "climate", "soil")
def outer(t):
    return t.climate.groupBy("cell").agg(F.max("tmax").alias("tmax")).join(t.soil.select(F.col("soil_id").alias("cell"), "sand"), "cell", "full")


# aggregations
@query("a05_duplicate_mean", "SELECT CAST(round(latitude * 2) AS BIGINT) AS ky, CAST(round(longitude * 2) AS BIGINT) AS kx, round(avg(frp), 6) AS frp, CAST(count(*) AS BIGINT) AS n FROM fires GROUP BY 1, 2", "fires")
def duplicate_mean(t):
    k = [F.round(F.col("latitude") * 2).cast("long").alias("ky"), F.round(F.col("longitude") * 2).cast("long").alias("kx")]
    return rounded(t.fires.groupBy(*k).agg(F.avg("frp").alias("frp"), F.count("*").alias("n")), 6)


@query("a06_mean_or_first", "SELECT month, country, round(avg(frp), 4) AS frp_mean, round(max(frp), 4) AS frp_max, arg_min(event_type, id) AS event_type FROM fires GROUP BY 1, 2", "fires")
def mean_or_first(t):
    return rounded(t.fires.groupBy("month", "country").agg(F.avg("frp").alias("frp_mean"), F.max("frp").alias("frp_max"), F.min_by("event_type", "id").alias("event_type")), 4)


@query("a07_top_categories", "SELECT brand, CAST(count(*) AS BIGINT) AS n FROM dem GROUP BY 1 ORDER BY n DESC, brand LIMIT 12", "dem")
def top_categories(t):
    return t.dem.groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(12)


@query("a08_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS \"count\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM features" for c in ("quantity", "price", "tax")), "features")
def describe(t):
    return rounded(T.summary(t.features, ["quantity", "price", "tax"]), 4)


@query("a09_datetime_summary", "SELECT CAST(count(ts) AS BIGINT) AS n, min(ts) AS lo, max(ts) AS hi, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM fires", "fires")
def datetimes(t):
    return t.fires.agg(F.count("ts").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("a10_missing_profile", """SELECT 'z' AS "column", CAST(count(*) FILTER (WHERE z IS NULL) AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS "rows", round(100.0 * count(*) FILTER (WHERE z IS NULL) / count(*), 4) AS pct FROM dem
UNION ALL SELECT 'brand', CAST(count(*) FILTER (WHERE brand IS NULL) AS BIGINT), CAST(count(*) AS BIGINT), round(100.0 * count(*) FILTER (WHERE brand IS NULL) / count(*), 4) FROM dem""", "dem")
def missing(t):
    return rounded(T.missing_profile(t.dem, ["z", "brand"]), 4, "pct")


@query("a11_sentinel_profile", """SELECT "column", value, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'clay' AS "column", clay AS value FROM soil UNION ALL SELECT 'z', z FROM dem) WHERE value IN (-9, -99, -999, -9999) GROUP BY 1, 2""", "soil", "dem")
def sentinels(t):
    both = T.unpivot(t.soil.select("clay"), [], ["clay"]).unionByName(T.unpivot(t.dem.select("z"), [], ["z"]))
    return both.where(F.col("value").isin(-9.0, -99.0, -999.0, -9999.0)).groupBy("column", "value").agg(F.count("*").alias("n"))


@query("a12_crosstab", """
, x AS (SELECT flag, CAST(count(*) FILTER (WHERE fire = 0) AS BIGINT) AS "0", CAST(count(*) FILTER (WHERE fire = 1) AS BIGINT) AS "1" FROM features GROUP BY flag)
SELECT flag, "0", "1", "0" + "1" AS "All" FROM x UNION ALL SELECT 'All', CAST(sum("0") AS BIGINT), CAST(sum("1") AS BIGINT), CAST(sum("0") + sum("1") AS BIGINT) FROM x""", "features")
def crosstab(t):
    return T.crosstab(t.features, "flag", "fire", [0, 1])


@query("a14_argmax_group", """SELECT (SELECT month FROM fires GROUP BY month ORDER BY count(*) DESC, month LIMIT 1) AS peak_month, (SELECT event_type FROM fires GROUP BY event_type ORDER BY avg(frp) DESC LIMIT 1) AS top_type""", "fires")
def argmax(t):
    peak = t.fires.groupBy("month").agg(F.count("*").alias("n")).agg(F.max_by("month", F.struct("n", -F.col("month"))).alias("peak_month"))
    top = t.fires.groupBy("event_type").agg(F.avg("frp").alias("m")).agg(F.max_by("event_type", "m").alias("top_type"))
    return peak.crossJoin(F.broadcast(top))


@query("a15_fire_rate", "SELECT cluster, CAST(sum(y_true) AS BIGINT) AS fires, CAST(count(*) AS BIGINT) AS n, round(100 * avg(y_true), 2) AS rate FROM scored WHERE cluster <> -1 GROUP BY cluster", "scored")
def fire_rate(t):
    return t.scored.where("cluster <> -1").groupBy("cluster").agg(F.sum("y_true").alias("fires"), F.count("*").alias("n"), F.round(100 * F.avg("y_true"), 2).alias("rate"))


@query("a16_time_series", """
, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM fires GROUP BY 1), a AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM fires)
SELECT CAST(g.day AS DATE) AS day, CAST(coalesce(d.n, 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM a) g LEFT JOIN d ON d.day = CAST(g.day AS DATE)""", "fires")
def series(t):
    f = t.fires
    days = f.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(f.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("a17_histogram", """
, l AS (SELECT min(price) AS lo, max(price) AS hi FROM features)
SELECT CAST(least(floor((price - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM features, l GROUP BY 1""", "features")
def hist(t):
    return T.histogram(t.features, "price", 50)


@query("a25_percentiles", "SELECT unnest([5, 10, 25, 50, 75, 90, 95]) AS p, unnest(list_transform(quantile_cont(price, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]), lambda x: round(x, 4))) AS value FROM features", "features")
def percentiles(t):
    ps = [5, 10, 25, 50, 75, 90, 95]
    v = exact_percentiles(t.features, ["price"], [p / 100 for p in ps])["price"]
    return rounded(t.spark.createDataFrame(list(zip(ps, v, strict=True)), "p int, value double"), 4)


@query("a26_uniqueness", "SELECT CAST(count(DISTINCT brand) AS BIGINT) AS brands, round(count(DISTINCT z) / CAST(count(z) AS DOUBLE), 6) AS z_ratio FROM dem", "dem")
def uniqueness(t):
    return rounded(t.dem.agg(F.count_distinct("brand").alias("brands"), (F.count_distinct("z") / F.count("z")).alias("z_ratio")), 6)


@query("a28_cluster_ranges", " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, round(min({c}), 4) AS lo, round(avg({c}), 4) AS mean, round(max({c}), 4) AS hi FROM features GROUP BY cluster" for c in ("quantity", "price", "season")), "features")
def cluster_ranges(t):
    long = T.unpivot(t.features, ["cluster"], ["quantity", "price", "season"], "feature")
    return rounded(long.groupBy("cluster", "feature").agg(F.min("value").alias("lo"), F.avg("value").alias("mean"), F.max("value").alias("hi")), 4)


@query("a29_before_after", """
SELECT 'raw' AS stage, CAST(count(z) AS BIGINT) AS n, round(avg(z), 4) AS mean, round(count(z) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM dem
UNION ALL SELECT 'clean', CAST(count(v) AS BIGINT), round(avg(v), 4), round(count(v) / CAST(count(*) AS DOUBLE), 6) FROM (SELECT CASE WHEN z <> -9999 THEN z END AS v FROM dem)""", "dem")
def before_after(t):
    raw = t.dem.select("z")
    clean = raw.select(S.to_null(F.col("z"), S.SENTINELS).alias("z"))
    one = lambda df, name: df.agg(F.lit(name).alias("stage"), F.count("z").alias("n"), F.round(F.avg("z"), 4).alias("mean"), F.round(F.count("z") / F.count("*"), 6).alias("coverage"))
    return one(raw, "raw").unionByName(one(clean, "clean"))


@query("a30_code_names", "SELECT CASE type WHEN 0 THEN 'vegetation' WHEN 1 THEN 'volcano' WHEN 2 THEN 'static' WHEN 3 THEN 'offshore' ELSE 'Type ' || type END AS name, CAST(count(*) AS BIGINT) AS n FROM fires GROUP BY 1", "fires")
def code_names(t):
    names = F.array(*map(F.lit, S.TYPE_NAMES))
    return t.fires.groupBy(F.coalesce(F.get(names, F.col("type")), F.concat(F.lit("Type "), F.col("type").cast("string"))).alias("name")).agg(F.count("*").alias("n"))


# order-dependent operators
@query("w01_fill_along_time", """
SELECT cell, month, coalesce(last_value(prec IGNORE NULLS) OVER a, first_value(prec IGNORE NULLS) OVER b) AS prec FROM climate
WINDOW a AS (PARTITION BY cell ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY cell ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "climate")
def fill_along(t):
    return T.fill_along(t.climate.select("cell", "month", "prec"), ["cell"], "month", "prec")


@query("w02_fill_row_order", """
SELECT r, c, coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(z IGNORE NULLS) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS z FROM dem""", "dem")
def fill_rows(t):
    return T.fill_along(t.dem.select("r", "c", "z"), ["r"], "c", "z")


@query("w03_keep_first", "SELECT user_id, type, min(id) AS id FROM fires GROUP BY 1, 2", "fires")
def keep_first(t):
    return T.keep_first(t.fires.select("user_id", "type", "id"), ["user_id", "type"], ["id"])


@query("w04_gap_fill", """
, x AS (SELECT r, c, z, max(CASE WHEN z IS NOT NULL THEN c END) OVER a AS pa, last_value(z IGNORE NULLS) OVER a AS va, min(CASE WHEN z IS NOT NULL THEN c END) OVER b AS pb, first_value(z IGNORE NULLS) OVER b AS vb FROM dem
WINDOW a AS (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY r ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT r, c, coalesce(z, CASE WHEN c - pa <= 2 AND (pb IS NULL OR c - pa <= pb - c) THEN va WHEN pb - c <= 2 THEN vb END) AS z FROM x""", "dem")
def gap_fill(t):
    return T.fill_nearest(t.dem.select("r", "c", "z"), ["r"], "c", "z", 2)


@query("w07_cdf_ranks", "SELECT r, c, round((row_number() OVER (ORDER BY z, r, c) - 0.5) / count(*) OVER (), 6) AS p FROM dem WHERE z IS NOT NULL", "dem")
def cdf(t):
    return rounded(T.cdf_ranks(t.dem.select("r", "c", "z"), "z", [F.col("r"), F.col("c")]).drop("z"), 6)


# samples and order
@query("t01_top_n", "SELECT id, frp FROM fires ORDER BY frp DESC, id LIMIT 20", "fires")
def top_n(t):
    return t.fires.select("id", "frp").orderBy(F.desc("frp"), "id").limit(20)


@query("t02_uniform_sample")
def uniform(t):
    return T.sample_n(t.fires.select("id", "frp"), "id", 500, 7)


@query("t03_stratified_sample")
def stratified(t):
    return T.stratified_sample(t.fires.select("id", "type"), "type", "id", 500)


@query("t04_undersample")
def undersample(t):
    return T.undersample(t.features.select("id", "fire"), "fire", "id")


@query("t05_grid_snap", """
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY round(latitude / 0.5e0), round(longitude / 0.5e0) ORDER BY id) AS k FROM fires) WHERE k = 1""", "fires")
def grid_snap(t):
    return T.grid_snap(t.fires, "latitude", "longitude", 0.5, "id").select("id")


@query("t06_stride", "SELECT r, c, z FROM dem WHERE r % 3 = 0 AND c % 3 = 0", "dem")
def stride(t):
    return t.dem.where("r % 3 = 0 and c % 3 = 0").select("r", "c", "z")


@query("t07_row_cap", "SELECT r, c FROM dem ORDER BY r, c LIMIT 100", "dem")
def row_cap(t):
    return t.dem.select("r", "c").orderBy("r", "c").limit(100)


# set operations
@query("u01_union_by_name", "SELECT id, latitude, frp, CAST(NULL AS DOUBLE) AS elevation FROM fires UNION ALL SELECT sid, latitude, NULL, elevation FROM stations", "fires", "stations")
def union_by_name(t):
    return T.union_all(t.fires.select("id", "latitude", "frp"), t.stations.select(F.col("sid").alias("id"), "latitude", "elevation"))


@query("u02_union_common", "SELECT latitude, longitude FROM fires UNION ALL SELECT latitude, longitude FROM stations", "fires", "stations")
def union_common(t):
    return T.union_common(t.fires.select("id", "latitude", "longitude"), t.stations.select("sid", "latitude", "longitude"))


@query("u03_key_difference", "SELECT sid FROM stations WHERE sid NOT IN (SELECT user_id FROM fires)", "stations", "fires")
def difference(t):
    return t.stations.join(t.fires.select(F.col("user_id").alias("sid")).distinct(), "sid", "left_anti").select("sid")


@query("u04_mask_union", "SELECT id FROM features WHERE price > 90000 OR quantity > 49 OR discount > 0.099", "features")
def masks(t):
    return t.features.where((F.col("price") > 90000) | (F.col("quantity") > 49) | (F.col("discount") > 0.099)).select("id")


# scalar functions
@query("f01_hhmm", "SELECT id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + CASE WHEN acq_time IS NULL THEN INTERVAL 0 MINUTE ELSE to_minutes(CAST(hour(ts) * 60 + minute(ts) AS INTEGER)) END AS at FROM fires", "fires")
def hhmm(t):
    return t.fires.select("id", S.timestamp_of(F.col("acq_date"), F.col("acq_time")).alias("at"))


@query("f02_date_parts", "SELECT id, month, strftime(ts, '%Y-%m') AS label FROM fires", "fires")
def date_parts(t):
    d = F.try_to_timestamp("acq_date", F.lit("yyyy-MM-dd"))
    return t.fires.select("id", F.coalesce(F.month(d), F.lit(1)).alias("month"), F.date_format(d, "yyyy-MM").alias("label"))


@query("f03_month_from_name", "SELECT id, CAST(regexp_extract('prec_' || strftime(ts, '%Y-%m') || '.tif', '(19|20)[0-9]{2}-([0-9]{2})', 2) AS INT) AS m FROM fires", "fires")
def month_name(t):
    name = F.concat(F.lit("prec_"), F.date_format("ts", "yyyy-MM"), F.lit(".tif"))
    return t.fires.select("id", F.regexp_extract(name, r"(19|20)\d{2}-(\d{2})", 2).cast("int").alias("m"))


@query("f04_haversine", "SELECT id, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT id, pow(sin((radians(latitude) - radians(28)) / 2), 2) + cos(radians(28)) * cos(radians(latitude)) * pow(sin(radians(longitude - 3) / 2), 2) AS a FROM fires)", "fires")
def haversine(t):
    return rounded(t.fires.select("id", S.haversine_km(F.lit(28.0), F.lit(3.0), F.col("latitude"), F.col("longitude")).alias("km")), 6)


@query("f05_planar", "SELECT id, round(sqrt(pow(latitude - 28, 2) + pow(longitude - 3, 2)) * 111, 6) AS km FROM fires", "fires")
def planar(t):
    return rounded(t.fires.select("id", S.planar_km(F.col("latitude"), F.col("longitude"), F.lit(28.0), F.lit(3.0)).alias("km")), 6)


@query("f06_destination", "SELECT id, round(latitude + 10 * sin(0.5) / 111, 6) AS lat, round(longitude + 10 * cos(0.5) / (111 * greatest(1e-6, cos(radians(latitude)))), 6) AS lon FROM fires", "fires")
def destination(t):
    lat, lon = S.destination(F.col("latitude"), F.col("longitude"), F.lit(10.0), F.lit(0.5))
    return rounded(t.fires.select("id", lat.alias("lat"), lon.alias("lon")), 6)


@query("f07_coordinate_key", "SELECT id, CAST(round(latitude * 1e5) AS BIGINT) AS ky, CAST(round(longitude * 1e5) AS BIGINT) AS kx, printf('%.5f', latitude) || '_' || printf('%.5f', longitude) AS latlon_key FROM fires", "fires")
def coordinate_key(t):
    ky, kx = S.coord_key(F.col("latitude"), F.col("longitude"))
    return t.fires.select("id", ky.alias("ky"), kx.alias("kx"), S.coord_text(F.col("latitude"), F.col("longitude")).alias("latlon_key"))


@query("f08_first_part", "SELECT r, c, CASE WHEN r % 2 = 0 THEN brand ELSE kind END AS code FROM dem", "dem")
def first_part(t):
    code = F.when(F.col("r") % 2 == 0, F.concat_ws(" // ", "brand", "kind")).otherwise(F.concat(F.lit(" // "), F.col("kind")))
    return t.dem.select("r", "c", S.first_part(code).alias("code"))


@query("f09_digits", "SELECT r, c, CAST(regexp_extract(brand, '([0-9]+)', 1) AS INT) AS digits FROM dem", "dem")
def digits(t):
    return t.dem.select("r", "c", S.digits_of(F.col("brand")).cast("int").alias("digits"))


@query("f10_prefix_class", "SELECT r, c, CASE substr(regexp_extract(brand, '([0-9]+)', 1), 1, 1) WHEN '1' THEN 'tree' WHEN '2' THEN 'shrub' ELSE 'other' END AS name FROM dem", "dem")
def prefix_class(t):
    p = F.substring(S.digits_of(F.col("brand")), 1, 1)
    return t.dem.select("r", "c", F.when(p == "1", "tree").when(p == "2", "shrub").otherwise("other").alias("name"))


@query("f11_label01", "SELECT doc_id, quality AS a, toxic AS b FROM labels")
def label01(t):
    text = F.when(F.col("quality") == 1, F.lit(" Yes")).otherwise("no ")
    return t.labels.select("doc_id", S.label01(text).alias("a"), S.label01(F.col("toxic")).alias("b"))


@query("f13_unit_conversion", "SELECT cell, month, round(CASE WHEN (SELECT median(tmax + 273.15e0) FROM climate) > 150 THEN tmax + 273.15e0 - 273.15e0 ELSE tmax END, 4) AS tmax FROM climate", "climate")
def units(t):
    k = t.climate.select("cell", "month", (F.col("tmax") + 273.15).alias("tmax"))
    med = exact_percentiles(k, ["tmax"], [0.5])["tmax"][0]
    return rounded(k.select("cell", "month", F.when(F.lit(med) > 150, F.col("tmax") - 273.15).otherwise(F.col("tmax")).alias("tmax")), 4)


@query("f14_log1p", "SELECT cell, month, round(ln(1 + greatest(prec - 14, 0)), 6) AS x FROM climate WHERE prec IS NOT NULL UNION ALL SELECT cell, month, NULL FROM climate WHERE prec IS NULL", "climate")
def log1p(t):
    return rounded(t.climate.select("cell", "month", S.log1p_nonnegative(F.col("prec") - 14).alias("x")), 6)


@query("f16_clip", "SELECT soil_id, CASE WHEN bsat > 100 THEN 100 WHEN bsat < 20 THEN 20 ELSE bsat END AS bsat FROM soil", "soil")
def clip(t):
    return t.soil.select("soil_id", S.clip(F.col("bsat"), 20.0, 100.0).alias("bsat"))


@query("f17_bands", "SELECT id, CASE WHEN proba >= 0.7 THEN 'High' WHEN proba >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk, CASE WHEN quantity < 5 THEN 0 WHEN quantity < 15 THEN 1 WHEN quantity < 30 THEN 2 ELSE 3 END AS slope_class FROM scored", "scored")
def bands(t):
    return t.scored.select("id", S.bands(F.col("proba"), [0.4, 0.7], ["Low", "Medium", "High"]).alias("risk"), S.bands(F.col("quantity"), [5, 15, 30], [0, 1, 2, 3]).alias("slope_class"))


@query("f18_texture", "SELECT soil_id, CASE WHEN clay >= 40 THEN 'clay' WHEN sand >= 70 AND clay < 15 THEN 'sand' WHEN silt >= 50 AND clay < 27 THEN 'silt' WHEN clay >= 27 THEN 'clay loam' ELSE 'loam' END AS texture FROM soil", "soil")
def texture(t):
    return t.soil.select("soil_id", S.texture_class(F.col("clay"), F.col("sand"), F.col("silt")).alias("texture"))


@query("f19_short_hash", "SELECT r, c, substr(md5(brand), 1, 8) AS h FROM dem", "dem")
def short_hash(t):
    return t.dem.select("r", "c", S.short_hash(F.col("brand")).alias("h"))


@query("f20_sentinels", "SELECT r, c, CASE WHEN z IN (-9999, -9, -7) THEN NULL ELSE z END AS z FROM dem", "dem")
def sentinel_null(t):
    return t.dem.select("r", "c", S.to_null(F.col("z"), S.SENTINELS).alias("z"))


@query("f21_clean_text", "SELECT r, c, CASE WHEN r % 5 = 0 THEN NULL ELSE brand END AS b FROM dem", "dem")
def clean_text(t):
    return t.dem.select("r", "c", S.clean_text(F.when(F.col("r") % 5 == 0, F.lit("None")).otherwise(F.col("brand"))).alias("b"))


@query("f22_normal_quantile", "SELECT id, round(sqrt(2) * (2 * proba - 1) * (1 - (2 * proba - 1) * (2 * proba - 1) / 3), 6) AS q FROM scored", "scored")
def quantile(t):
    return rounded(t.scored.select("id", S.normal_quantile(F.col("proba")).alias("q")), 6)


@query("f25_hex_rgb", "SELECT n_nationkey, [n_nationkey * 10 % 256, n_nationkey * 7 % 256, 15] AS rgb FROM nation")
def hex_rgb(t):
    h = F.format_string("#%02x%02x0f", F.col("n_nationkey") * 10 % 256, F.col("n_nationkey") * 7 % 256)
    return t.nation.select("n_nationkey", S.hex_rgb(h).alias("rgb"))
