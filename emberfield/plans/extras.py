"""Queries: further samplers, summaries, sources and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import eda as E, features as X2, grid as G, layers as L, ml as M, risk as R, sampling as N, spatial as X, tables as T
from ..session import shared_dir
from ..sources import ascii_grid, io
from .modelling import place, vectors
from .registry import query, rounded
from .spatial_grid import A, HAVERSINE, zones


@query("a19_layer_json", "SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(z) AS BIGINT) AS n, round(100.0 * count(z) / count(*), 4) AS coverage FROM dem", "dem")
def layer_json(t):
    s = t.dem.agg(F.count("*").alias("cells"), F.count("z").alias("n"), F.round(100 * F.count("z") / F.count("*"), 4).alias("coverage"))
    text = io.summary_json(s)
    return t.spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "cells long, n long, coverage double").alias("x")).select("x.*")


@query("a27_negative_distances", ", d AS (SELECT s.sid, min(sqrt(pow(f.latitude - s.latitude, 2) + pow(f.longitude - s.longitude, 2))) * 111 AS km FROM stations s, fires f GROUP BY s.sid) SELECT round(min(km), 6) AS min_km, round(median(km), 6) AS median_km, round(avg(km), 6) AS mean_km FROM d", "stations", "fires")
def negative_distances(t):
    return rounded(N.distance_metrics(t.stations.withColumnRenamed("sid", "nid"), t.fires), 6)


@query("n03_polygon_centroids", f", p AS (SELECT zone AS sid, (y0 + y1) / 2 AS latitude, (x0 + x1) / 2 AS longitude FROM areas WHERE zone NOT IN (SELECT zone FROM areas JOIN fires f ON f.longitude > x0 AND f.longitude < x1 AND f.latitude > y0 AND f.latitude < y1)) SELECT CAST(sid AS BIGINT) AS nid, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM p s WHERE NOT EXISTS (SELECT 1 FROM fires f WHERE {HAVERSINE.format(a=A)} < 250)", "areas", "fires")
def centroids(t):
    return rounded(N.polygon_centroids(zones(t, "areas"), t.fires, 100, 250.0), 6)


@query("n04_polygon_grid", f", g AS (SELECT DISTINCT i, j FROM (SELECT unnest(range(30, 80)) AS i), (SELECT unnest(range(-20, 30)) AS j) JOIN zones ON j * 0.5e0 > x0 AND j * 0.5e0 < x1 AND i * 0.5e0 > y0 AND i * 0.5e0 < y1), s AS (SELECT i, j, i * 0.5e0 AS latitude, j * 0.5e0 AS longitude FROM g) SELECT CAST(count(*) AS BIGINT) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM fires f WHERE {HAVERSINE.format(a=A)} < 8)", "zones", "fires")
def polygon_grid(t):
    return N.polygon_grid(zones(t), t.fires, 8.0, 0.5).agg(F.count("*").alias("n"))


@query("n07_adaptive_band", "SELECT CAST(100 AS BIGINT) AS n, true AS in_band")
def adaptive(t):
    neg, low, high = N.adaptive_band(t.fires, 100, 5.0, 40.0)
    d = N.distance_metrics(neg, t.fires)
    return neg.agg(F.count("*").alias("n")).crossJoin(d.select((F.col("min_km") >= 0.8 * low).alias("in_band")))


@query("n11_post_adjust", "SELECT CAST(300 AS BIGINT) AS n")
def post_adjust(t):
    first = N.random_in_box(t.fires, 200, 5.0, seed=1)
    more = N.random_in_box(t.fires, 100, 5.0, seed=2).withColumn("nid", F.col("nid") + (1 << 40))
    return T.keep_first(T.union_all(first, more), ["latitude", "longitude"], ["nid"]).agg(F.count("*").alias("n"))


@query("u05_aoi_minus_buffers", f"SELECT sid FROM stations s WHERE EXISTS (SELECT 1 FROM zones WHERE longitude > x0 AND longitude < x1 AND latitude > y0 AND latitude < y1) AND NOT EXISTS (SELECT 1 FROM fires f WHERE {HAVERSINE.format(a=A)} < 10)", "stations", "zones", "fires")
def minus_buffers(t):
    inside = X.points_in_polygons(t.stations, zones(t), "sid", "zone").select("sid").distinct()
    return X.farther_than(t.stations.join(inside, "sid", "left_semi"), t.fires, "sid", "id", 10.0, S.haversine_km).select("sid")


@query("c15_despeckle", "SELECT a.r, a.c, round(CASE WHEN max(a.z) IS NOT NULL THEN median(b.z) END, 4) AS z FROM dem a JOIN dem b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY a.r, a.c", "dem")
def despeckle(t):
    return rounded(G.median_filter(t.dem.select("r", "c", "z"), "z", 2), 4)


@query("c19_geometry_repair", "SELECT zone FROM zones WHERE zone % 4 <> 3", "zones")
def repair(t):
    broken = zones(t).withColumn("ring", F.when(F.col("zone") % 4 == 3, F.slice("ring", 1, 3)).otherwise(F.col("ring")))
    return broken.where(X.valid_ring("ring")).select("zone")


@query("w05_focal_window", "SELECT a.r, a.c, round(avg(b.z), 4) AS m FROM dem a JOIN dem b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY a.r, a.c", "dem")
def focal(t):
    return rounded(G.focal(t.dem.select("r", "c", "z"), "z", F.avg("v"), "m", 2).select("r", "c", "m"), 4)


@query("w06_k_per_key", "SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY frp DESC, id) AS k FROM fires) WHERE k <= 3", "fires")
def k_per_key(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("frp"), "id")
    return t.fires.select("user_id", "id", "frp").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "id")


@query("h05_normality_w")
def normality(t):
    r = E.shapiro_wilk(t.features, "price", "id")
    return t.spark.createDataFrame([(round(r["w"], 6), round(r["p"], 6))], "w double, p double")


@query("h06_qq_points", ", q AS (SELECT unnest(range(0, 100)) AS k, unnest(quantile_cont(price, [" + ", ".join(str((k + 0.5) / 100) for k in range(100)) + "])) AS s FROM features), x AS (SELECT 2 * (k + 0.5e0) / 100 - 1 AS x, s FROM q) SELECT round(sqrt(2e0) * x * (1 - x * x / 3), 6) AS theoretical, round(s, 6) AS sample FROM x", "features")
def qq(t):
    return rounded(E.qq_points(t.features, "price", "id", 100), 6)


@query("h07_normality_heuristic", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN abs(k) < 0.5 THEN 'symmetric' WHEN k > 0 THEN 'right' ELSE 'left' END AS skew_label, CASE WHEN cv < 15 THEN 'low' WHEN cv < 35 THEN 'moderate' WHEN cv < 50 THEN 'high' ELSE 'very high' END AS variability, abs(k) < 0.5 AND abs(q) < 0.5 AND gap < 0.1 AS normal FROM (SELECT avg(pow((x - m) / s, 3)) AS k, avg(pow((x - m) / s, 4)) - 3 AS q, 100 * max(ss) / max(m) AS cv, abs(max(m) - median(x)) / max(ss) AS gap FROM (SELECT {c} AS x, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s, stddev_samp({c}) OVER () AS ss FROM features))" for c in ("quantity", "price", "season")), "features")
def heuristic(t):
    return E.shape(t.features, ["quantity", "price", "season"]).select("column", "skew_label", "variability", "normal")


@query("h09_recommendations", """, f AS (SELECT price, price * price * price AS cube, CASE WHEN quantity > 45 THEN 1 ELSE 0 END AS rare FROM features), s AS (SELECT avg(rare) AS y, corr(price, cube) AS r FROM f)
SELECT 'imbalance' AS topic, 'rare' AS detail FROM s WHERE y < 0.3 OR y > 0.7 UNION ALL SELECT 'collinear', 'price, cube' FROM s WHERE abs(r) > 0.85
""" + "".join(f"UNION ALL SELECT 'skewed', '{c}' FROM (SELECT avg(pow((x - m) / s, 3)) AS k FROM (SELECT {c} AS x, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s FROM f)) WHERE abs(k) > 1 UNION ALL SELECT 'outliers', '{c}' FROM (SELECT avg(CASE WHEN {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) THEN 1 ELSE 0 END) AS o FROM f, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM f)) WHERE o > 0.1 " for c in ("price", "cube")), "features")
def recommendations(t):
    f = t.features.select("price", (F.col("price") * F.col("price") * F.col("price")).alias("cube"), (F.col("quantity") > 45).cast("int").alias("rare"))
    return E.recommendations(f, ["price", "cube"], "rare")


@query("e16_column_category", "SELECT 'climate' AS category, 'prec' AS name UNION ALL SELECT 'climate', 'tmax' UNION ALL SELECT 'climate', 'tmin' UNION ALL SELECT 'other', 'cell' UNION ALL SELECT 'other', 'month'")
def categories(t):
    return t.spark.createDataFrame([(X2.category(c), c) for c in t.climate.columns], "category string, name string")


@query("f12_snake_case", "SELECT 'id' AS name UNION ALL SELECT 'acq_date' UNION ALL SELECT 'bright_t31'")
def snake(t):
    return t.spark.createDataFrame([(S.snake_case(c),) for c in (" ID ", "Acq Date", "BRIGHT-T31")], "name string")


@query("f15_aspect_components", "SELECT id, round(cos(radians(latitude)), 6) AS c, round(sin(radians(latitude)), 6) AS s FROM fires", "fires")
def aspect(t):
    return rounded(t.fires.select("id", F.cos(F.radians("latitude")).alias("c"), F.sin(F.radians("latitude")).alias("s")), 6)


@query("f23_json", "SELECT id, '{\"type\":' || type || ',\"country\":\"' || country || '\"}' AS j FROM fires", "fires")
def to_json(t):
    return t.fires.select("id", F.to_json(F.struct("type", "country")).alias("j"))


@query("f24_feature_of_stem", "SELECT 'Sand' AS name, '%' AS unit UNION ALL SELECT 'Minimum temperature', 'C' UNION ALL SELECT 'Soil Depth', ''")
def stems(t):
    df = t.spark.createDataFrame([("HWSD2_SAND_D1_clipped",), ("tmin_2024-01_cleaned",), ("soil_depth",)], "s string")
    return df.select(S.feature_of(F.col("s")).alias("x")).select("x.*")


@query("m02_kmeans_sweep")
def sweep(t):
    got = M.kmeans_sweep(vectors(t), "vec_id", "v", [2, 3, 4], 3)
    rows = [(r["k"], *(float(r[c]) for c in ("davies_bouldin", "calinski_harabasz", "silhouette", "inertia")), r["k"] == got["by_silhouette"], r["k"] == got["elbow"]) for r in got["rows"]]
    return rounded(t.spark.createDataFrame(rows, "k int, davies_bouldin double, calinski_harabasz double, silhouette double, inertia double, best boolean, elbow boolean"), 6)


@query("m04_dbscan_grid")
def dbscan_grid(t):
    rows = M.dbscan_grid(vectors(t), "vec_id", "v", [0.7, 0.8], [4], "y")
    return t.spark.createDataFrame([(r["eps"], r["min_samples"], r["clusters"], float(r["noise"]), float(r["score"]), r["best"]) for r in rows], "eps double, min_samples int, clusters long, noise double, score double, best boolean")


@query("m19_prediction_sink", "SELECT id, CAST(proba >= 0.5 AS INT) AS y_pred FROM scored", "scored")
def prediction_sink(t):
    path = place(t)
    io.write_table(t.scored.select("id", (F.col("proba") >= 0.5).cast("int").alias("y_pred")), path)
    return t.spark.read.parquet(path)


@query("r09_export", "SELECT CAST(count(*) AS BIGINT) AS zones, CAST(sum(n) AS BIGINT) AS n FROM (SELECT cluster, count(*) AS n FROM scored GROUP BY cluster)", "scored")
def export(t):
    path = place(t)
    io.write_table(R.zone_profile(t.scored, "cluster", "proba", "y_true"), path, csv=True)
    return t.spark.read.parquet(path).agg(F.count("*").alias("zones"), F.sum("n").alias("n"))


@query("s02_file_name_columns", """
SELECT file_name, CASE WHEN file_name LIKE '%ALGERIA%' THEN 'Algeria' WHEN file_name LIKE '%tunis%' THEN 'Tunisia' END AS country,
  coalesce(type, CASE WHEN file_name LIKE '%type2%' THEN '2' END) AS type
FROM (SELECT concat(n_name, CASE n_nationkey % 3 WHEN 0 THEN '_tunis' WHEN 1 THEN '_type2' ELSE '' END, '.csv') AS file_name,
  CASE WHEN n_nationkey % 4 = 0 THEN '0' END AS type FROM nation)
""")
def file_names(t):
    end = F.when(F.col("n_nationkey") % 3 == 0, "_tunis").when(F.col("n_nationkey") % 3 == 1, "_type2").otherwise("")
    return io.name_columns(t.nation.select(F.concat("n_name", end, F.lit(".csv")).alias("file_name"), F.when(F.col("n_nationkey") % 4 == 0, "0").alias("type")))


@query("s04_first_existing", "SELECT CAST(count(*) AS BIGINT) AS n FROM region")
def first_existing(t):
    return t.spark.read.parquet(io.first_existing(t.spark, f"{t.dir}/absent.parquet", f"{t.dir}/region.parquet", f"{t.dir}/nation.parquet")).agg(F.count("*").alias("n"))


@query("s06_grid_columns", "SELECT lat, lon, soil_id, z FROM (SELECT c_custkey * CAST(0.5 AS DOUBLE) AS lat, c_custkey * CAST(0.25 AS DOUBLE) AS lon, c_nationkey AS soil_id, c_acctbal AS z FROM customer)")
def grid_names(t):
    return io.grid_columns(t.customer.select((F.col("c_custkey") * 0.5).alias("Y"), (F.col("c_custkey") * 0.25).alias("x"), F.col("c_nationkey").alias("SMU_code"), F.col("c_acctbal").alias("z")))


@query("s08_legend_scan", "SELECT n_nationkey AS value, n_name AS label, CAST(n_regionkey AS VARCHAR) AS code FROM nation")
def legend(t):
    path = place(t)
    t.nation.select(F.col("n_nationkey").alias("MapCode"), F.col("n_regionkey").alias("LCCCode"), F.col("n_name").alias("LCCLabel")).write.option("header", True).csv(path)
    return io.read_legend(t.spark, path)


@query("k05_grid_table", "SELECT r, c, z FROM dem", "dem")
def grid_table(t):
    path = place(t)
    io.write_table(t.dem.select("r", "c", "z"), path, "zstd")
    return t.spark.read.schema("r int, c int, z double").parquet(path)


@query("s03_fallback_chain", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation")
def fallback(t):
    return io.first_readable(t.spark, f"{t.dir}/absent.parquet", f"{t.dir}/absent.csv", f"{t.dir}/nation.parquet").agg(F.count("*").alias("n"))


@query("s05_ascii_grid_scan", "SELECT r, c, CAST(z AS DOUBLE) AS value FROM dem", "dem")
def grid_scan(t):
    # a round trip: the format is one file with a row of the grid a line, so its writer gathers it
    path, n = place(t), t.dem.agg(F.max("r")).first()[0] + 1
    cells = F.transform(F.sort_array(F.collect_list(F.struct("c", F.coalesce("z", F.lit(-1e9)).alias("z")))), lambda x: x["z"].cast("string"))
    lines = t.dem.groupBy("r").agg(F.concat_ws(" ", cells).alias("l"))
    body = lines.agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("r", "l"))), lambda x: x["l"])).alias("b"))
    head = f"ncols 40\nnrows {n}\nxllcorner -8\nyllcorner 20\ncellsize 0.5\nNODATA_value -1e9\n"
    body.select(F.concat(F.lit(head), "b").alias("value")).coalesce(1).write.option("lineSep", "\n").text(path)
    return ascii_grid.read(t.spark, f"{path}/part-*").select("r", "c", "value")


@query("s07_geojson_scan", "SELECT zone, round((x1 - x0) * (y1 - y0), 6) AS area FROM zones", "zones")
def geojson(t):
    path = place(t)
    ring = F.concat(F.lit("[["), F.concat_ws(",", F.transform("ring", lambda p: F.format_string("[%.6f,%.6f]", p["x"], p["y"]))), F.lit("]]"))
    f = zones(t).select(F.concat(F.lit('{"type":"Feature","properties":{"zone":"'), F.col("zone").cast("string"), F.lit('"},"geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}")).alias("f"))
    doc = f.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("f")), F.lit("]}")).alias("value"))  # a legend-sized layer, in one file as the format asks
    doc.coalesce(1).write.text(path)
    out = io.read_geojson(t.spark, f"{path}/part-*")
    return rounded(out.select(F.col("properties")["zone"].cast("int").alias("zone"), X.shoelace("ring").alias("area")), 6)


@query("s07_vertex_means", "SELECT zone, round((3 * x0 + 2 * x1) / 5, 6) AS x, round((3 * y0 + 2 * y1) / 5, 6) AS y FROM zones", "zones")
def vertex_means(t):
    return rounded(zones(t).select("zone", X.vertex_mean("ring").alias("p")).select("zone", "p.x", "p.y"), 6)


@query("s09_jdbc_extract", "SELECT zone, class, x0 FROM zones", "zones")
def jdbc_extract(t):
    """The database is embedded in the driver, so the driver fills and reads it; io.jdbc is for databases that executors reach."""
    url, options = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    io.write_jdbc_on_driver(t.zones.select("zone", "class", "x0"), url, "LAYERS", **options)
    return io.jdbc_on_driver(t.spark, url, "LAYERS", **options)


@query("s10_directory_walk", "SELECT CAST(2 AS BIGINT) AS files")
def walk(t):
    path = f"{shared_dir(t.spark)}/walk-{uuid.uuid4().hex}"
    for name in ("a", "b", "DATA_CLEANED"):
        t.spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{path}/{name}")
    return io.walk(t.spark, path, "*.txt").agg(F.count("*").alias("files"))


@query("s13_config", "SELECT '{\"cell\": 2.0, \"k\": 5}' AS config")
def config(t):
    return t.spark.createDataFrame([(json.dumps(io.config(None, {"cell": 2.0, "k": 5})),)], "config string")


@query("c13_cell_statistics_after_impute", "SELECT cell, round(avg(tmax), 4) AS tmax_mean, round(stddev_pop(tmax), 4) AS tmax_std FROM climate GROUP BY cell", "climate")
def cell_statistics(t):
    return rounded(L.temporal_stats(t.climate, "cell", "tmax").select("cell", "tmax_mean", "tmax_std"), 4)
