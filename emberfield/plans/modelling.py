"""Queries: features, statistical tests, models, metrics, risk reports, sinks and the stream extension."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import eda as E, features as X, ml as M, risk as R, sampling as N, tables as T
from ..session import shared_dir
from ..sources import io
from ..streaming import counts
from .registry import query, rounded

COLS = ["quantity", "price", "discount", "tax", "season"]


def one(tables, /, **values):
    return tables.spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


@query("e03_topography_features", """, s AS (SELECT sid, elevation, abs(slope) AS rug, elevation / 2 AS rel FROM stations)
SELECT sid, round(rug * rel, 6) AS terrain_complexity, round(elevation * (rug / ((SELECT max(rug) FROM s) + 1e-6)), 6) AS elevation_terrain_interaction, round(rel * rel, 6) AS relative_elevation_effect, round(1 / (1 + rug), 6) AS terrain_roughness_index FROM s""", "stations")
def topography(t):
    s = t.stations.select("sid", "elevation", F.abs("slope").alias("ruggedness"), (F.col("elevation") / 2).alias("relative_elev"))
    out = X.topography_features(s).drop("elevation", "ruggedness", "relative_elev")
    return rounded(out, 6)


@query("e04_soil_features", "SELECT soil_id, round(sand / (clay + 1e-6), 4) AS sand_clay_ratio, silt + clay AS fine_fraction, org_carbon AS organic_matter_content, round(clay * (org_carbon / ((SELECT max(org_carbon) FROM soil) + 1e-6)), 4) AS moisture_retention, abs(7 - ph_water) AS soil_acidity, cec_soil AS nutrient_richness FROM soil", "soil")
def soil_features(t):
    return rounded(X.soil_features(t.soil).select("soil_id", "sand_clay_ratio", "fine_fraction", "organic_matter_content", "moisture_retention", "soil_acidity", "nutrient_richness"), 4)


@query("e05_soil_ratios", "SELECT soil_id, 100 - coarse AS fine_fraction, round(clay / (silt + 1), 4) AS clay_to_silt_ratio, round(sand / nullif(clay + 1, 0), 4) AS sand_to_clay_ratio, round(org_carbon / 100 * bulk, 6) AS organic_bulk_density, round(bsat / (cec_soil + 1), 4) AS base_saturation_ratio, round(cec_eff / (cec_soil + 1), 4) AS cec_eff_ratio, round((total_n + org_carbon / 100) / (bulk + 1), 6) AS nutrient_index FROM soil", "soil")
def soil_ratios(t):
    upper = t.soil.select(*(F.col(c).alias(c.upper()) for c in t.soil.columns))  # names in any case
    names = ["fine_fraction", "clay_to_silt_ratio", "sand_to_clay_ratio", "organic_bulk_density", "base_saturation_ratio", "cec_eff_ratio", "nutrient_index"]
    out = X.soil_ratios(upper).select(F.col("SOIL_ID").alias("soil_id"), *names)
    return rounded(rounded(out, 6, "organic_bulk_density", "nutrient_index"), 4, "clay_to_silt_ratio", "sand_to_clay_ratio", "base_saturation_ratio", "cec_eff_ratio")


@query("e06_relative_elevation", "SELECT r, c, round(z - (SELECT median(z) FROM dem), 4) AS relative_elev, round((z - (SELECT avg(z) FROM dem)) / (SELECT stddev_pop(z) FROM dem), 5) AS elevation_z, round(radians(c), 6) AS slope_rad FROM dem", "dem")
def relative_elevation(t):
    out = X.relative_elevation(t.dem.select("r", "c", "z"), "z", "c").drop("z")
    return rounded(rounded(rounded(out, 4, "relative_elev"), 5, "elevation_z"), 6, "slope_rad")


@query("e07_one_hot", "SELECT r, c, CAST(kind = 'ECONOMY' AS INT) AS \"kind_ECONOMY\", CAST(kind = 'LARGE' AS INT) AS \"kind_LARGE\", CAST(kind = 'MEDIUM' AS INT) AS \"kind_MEDIUM\", CAST(kind = 'PROMO' AS INT) AS \"kind_PROMO\", CAST(kind = 'SMALL' AS INT) AS \"kind_SMALL\", CAST(kind = 'STANDARD' AS INT) AS \"kind_STANDARD\" FROM dem", "dem")
def one_hot(t):
    return X.one_hot(t.dem.select("r", "c", "kind"), "kind").drop("kind")


PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1:]]
CORR = "SELECT unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr({a}, {b})}}" for a, b in PAIRS) + "]) AS p FROM features"


@query("e08_correlation_matrix", f"SELECT p.a AS a, p.b AS b, round(p.r, 6) AS r FROM ({CORR})", "features")
def correlations(t):
    return rounded(X.correlations(t.features, COLS), 6)


@query("e09_correlated_drop", f"SELECT DISTINCT CASE WHEN p.a > p.b THEN p.a ELSE p.b END AS dropped FROM ({CORR}) WHERE abs(p.r) >= 0.5", "features")
def correlated_drop(t):
    return t.spark.createDataFrame([(c,) for c in X.correlated_to_drop(t.features, COLS, 0.5)], "dropped string")


@query("e10_multicollinearity_drop", f", c AS ({CORR}), y AS (SELECT unnest([" + ", ".join(f"{{'f': '{c}', 'r': abs(corr({c}, fire))}}" for c in COLS) + "]) AS y FROM features) SELECT DISTINCT CASE WHEN ya.y.r < yb.y.r THEN p.a ELSE p.b END AS dropped FROM c JOIN y ya ON ya.y.f = p.a JOIN y yb ON yb.y.f = p.b WHERE abs(p.r) > 0.5", "features")
def multicollinear(t):
    return t.spark.createDataFrame([(c,) for c in X.multicollinear_to_drop(t.features, COLS, "fire", 0.5)], "dropped string")


@query("e11_top_pairs", f"SELECT p.a AS a, p.b AS b, round(p.r, 6) AS r FROM ({CORR}) ORDER BY abs(p.r) DESC, a, b LIMIT 5", "features")
def top_pairs(t):
    return rounded(X.correlations(t.features, COLS).orderBy(F.desc(F.abs("r")), "a", "b").limit(5), 6)


@query("e12_target_correlation", "SELECT x.f AS feature, round(x.r, 6) AS r FROM (SELECT unnest([" + ", ".join(f"{{'f': '{c}', 'r': abs(corr({c}, fire))}}" for c in COLS) + "]) AS x FROM features) ORDER BY x.r DESC LIMIT 3", "features")
def target(t):
    return rounded(X.target_correlations(t.features, COLS, "fire", 3), 6)


def _f(c):
    return f"""SELECT '{c}' AS feature, round(sum(n * pow(m - g, 2)) / (count(*) - 1) / (sum(v * n) / (sum(n) - count(*))), 4) AS f FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM features GROUP BY flag), (SELECT avg({c}) AS g FROM features)"""


@query("e13_anova_f", " UNION ALL ".join(map(_f, COLS)), "features")
def anova(t):
    return rounded(X.anova_f(t.features, COLS, "flag"), 4)


@query("e13_mutual_information", """, b AS (SELECT least(floor((price - lo) / ((hi - lo) / 10)), 9) AS b, fire AS y FROM features, (SELECT min(price) AS lo, max(price) AS hi FROM features)), j AS (SELECT b, y, count(*) AS n FROM b GROUP BY ALL)
SELECT round(sum(n / t * ln(n * t / (nb * ny))), 8) AS mi FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny, CAST(sum(n) OVER () AS DOUBLE) AS t FROM j)""", "features")
def mutual(t):
    return rounded(X.mutual_information(t.features, "price", "fire"), 8)


@query("e13_composite_score", ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS v, abs(corr({c}, fire)) AS r FROM features" for c in COLS) + """), s AS (SELECT feature, ((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) + (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ())) / 2 AS c FROM v)
SELECT feature, round(c, 6) AS composite, CAST(row_number() OVER (ORDER BY c DESC, feature) AS INT) AS rank FROM s ORDER BY c DESC, feature LIMIT 3""", "features")
def composite(t):
    scores = X.variance_ranking(t.features, COLS, len(COLS)).join(X.target_correlations(t.features, COLS, "fire", len(COLS)), "feature")
    return rounded(X.composite_scores(scores, "feature", ["variance", "r"], 3), 6)


@query("e14_standard_scaling", "SELECT id, round((price - (SELECT avg(price) FROM features)) / (SELECT stddev_pop(price) FROM features), 5) AS price FROM features", "features")
def scaling(t):
    return rounded(X.zscore(t.features.select("id", "price"), ["price"]), 5)


@query("e15_variance_ranking", "SELECT x.f AS feature, round(x.v, 4) AS variance FROM (SELECT unnest([" + ", ".join(f"{{'f': '{c}', 'v': var_samp({c})}}" for c in COLS) + "]) AS x FROM features) ORDER BY x.v DESC LIMIT 3", "features")
def variance(t):
    return rounded(X.variance_ranking(t.features, COLS, 3), 4)


# statistical tests
@query("h01_shape", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(pow((x - m) / s, 3)), 4) AS skew, round(avg(pow((x - m) / s, 4)) - 3, 4) AS kurt, round(100 * max(ss) / max(m), 4) AS cv FROM (SELECT {c} AS x, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s, stddev_samp({c}) OVER () AS ss FROM features)" for c in ("price", "quantity")), "features")
def shape(t):
    return rounded(E.shape(t.features, ["price", "quantity"]).drop("skew_label", "variability", "normal"), 4)


@query("h02_point_biserial", "SELECT round(corr(price, fire), 6) AS r FROM features", "features")
def biserial(t):
    return one(t, r=round(E.point_biserial(t.features, "price", "fire")["r"], 6))


@query("h03_two_sample_t", ", g AS (SELECT fire, count(*) AS n, avg(price) AS m, var_samp(price) AS v FROM features GROUP BY fire) SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1e0 / a.n + 1e0 / b.n)), 5) AS t FROM g a, g b WHERE a.fire = 1 AND b.fire = 0", "features")
def two_sample(t):
    return one(t, t=round(E.two_sample_t(t.features, "price", "fire")["t"], 5))


@query("h04_chi_square", """, n AS (SELECT flag, status, CAST(count(*) AS DOUBLE) AS n FROM features GROUP BY ALL), e AS (SELECT a.flag, b.status, a.x * b.y / t AS e FROM (SELECT flag, sum(n) AS x FROM n GROUP BY 1) a, (SELECT status, sum(n) AS y FROM n GROUP BY 1) b, (SELECT sum(n) AS t FROM n))
SELECT round(x, 4) AS chi2, d AS dof, round(exp(-x / 2), 6) AS p FROM (SELECT sum(pow(coalesce(n, 0) - e, 2) / e) AS x, CAST((count(DISTINCT flag) - 1) * (count(DISTINCT status) - 1) AS BIGINT) AS d FROM e LEFT JOIN n USING (flag, status))""", "features")
def chi(t):
    return rounded(rounded(E.chi_square(t.features, "flag", "status"), 4, "chi2"), 6, "p")  # of 2 degrees of freedom p is exp(-chi2 / 2)


@query("h06_kde", """, s AS (SELECT count(price) AS n, stddev_samp(price) AS sd, min(price) AS lo, max(price) AS hi FROM features), b AS (SELECT least(floor((price - lo) / ((hi - lo) / 4096)), 4095) AS b, count(*) AS w FROM features, s GROUP BY 1),
x AS (SELECT lo + i * (hi - lo) / 199 AS x, lo, n, pow(n, -0.2e0) * sd AS h, (hi - lo) / 4096 AS width FROM (SELECT unnest(range(0, 200)) AS i), s)
SELECT round(x, 6) AS x, round(sum(w * exp(-pow((x - (lo + (b + 0.5e0) * width)) / h, 2) / 2)) / max(n * h * sqrt(2 * pi())), 12) AS density FROM x, b GROUP BY x""", "features")
def kde(t):
    return rounded(rounded(E.kde(t.features, "price"), 12, "density"), 6, "x")


@query("h08_linear_trend", "SELECT round(regr_slope(price, quantity), 5) AS slope, round(regr_intercept(price, quantity), 4) AS intercept, round(corr(quantity, price), 6) AS r, round(regr_r2(price, quantity), 6) AS r2 FROM features", "features")
def linear(t):
    return rounded(rounded(rounded(E.trend(t.features, "quantity", "price"), 5, "slope"), 4, "intercept"), 6, "r", "r2")


@query("h10_numeric_probe", "SELECT 'brand' AS \"column\", 0.0e0 AS share UNION ALL SELECT 'z', round(avg(CASE WHEN z IS NULL THEN 0 ELSE 1 END), 6) FROM dem", "dem")
def probe(t):
    return rounded(E.castable_share(t.dem, ["brand", "z"]), 6)


# metrics
CURVE = """, s AS (SELECT proba, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY proba),
c AS (SELECT proba, pos, n, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER () AS p, sum(n - pos) OVER () AS neg FROM s WINDOW w AS (ORDER BY proba DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query("w08_pr_roc_curve", CURVE + "SELECT proba, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c", "scored")
def curve(t):
    return M.curve(t.scored, "y_true", "proba").select("proba", "tp", "fp")


@query("m13_ranking_metrics", CURVE + "SELECT round(sum((n - pos) * (tp - pos / 2)) / max(p * neg), 8) AS roc_auc, round(sum(pos / p * tp / (tp + fp)), 8) AS average_precision FROM c", "scored")
def ranking(t):
    return rounded(M.ranking_metrics(t.scored, "y_true", "proba"), 8)


CELLS = """, c AS (SELECT fold, CAST(sum(CASE WHEN proba >= 0.5 THEN y_true ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN proba >= 0.5 THEN 1 - y_true ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN proba < 0.5 THEN y_true ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN proba < 0.5 THEN 1 - y_true ELSE 0 END) AS BIGINT) AS tn FROM scored GROUP BY fold)
"""


@query("m13_confusion_by_fold", CELLS + "SELECT fold, tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM c", "scored")
def confusion(t):
    return rounded(M.threshold_metrics(t.scored, "y_true", "proba", 0.5, ["fold"]).select("fold", "tp", "fp", "fn", "tn", "precision", "recall", "f1"), 6)


@query("m13_over_folds", CELLS + ", m AS (SELECT (tp / CAST(tp + fp AS DOUBLE) + tn / CAST(tn + fn AS DOUBLE)) / 2 AS p, (tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2 AS r, (2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) + 2 * tn / CAST(2 * tn + fp + fn AS DOUBLE)) / 2 AS f FROM c) " + " UNION ALL ".join(f"SELECT 'macro_{n}' AS metric, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std, round(stddev_samp({x}), 6) AS std_samp FROM m" for n, x in (("precision", "p"), ("recall", "r"), ("f1", "f"))), "scored")
def over_folds(t):
    predicted = t.scored.withColumn("y_pred", (F.col("proba") >= 0.5).cast("int"))
    return rounded(M.over_folds(M.macro_metrics(predicted, "y_true", "y_pred", ["fold"]), ["macro_precision", "macro_recall", "macro_f1"]), 6)


@query("m12_best_threshold", CURVE + "SELECT arg_max(proba, (v, proba)) AS threshold, round(max(v), 8) AS value FROM (SELECT proba, 2 * (tp / (tp + fp)) * (tp / p) / nullif(tp / (tp + fp) + tp / p, 0) AS v FROM c)", "scored")
def best(t):
    return rounded(M.best_threshold(t.scored, "y_true", "proba"), 8, "value")


@query("m10_stratified_folds", "SELECT fire, CAST(k AS INT) AS fold, CAST(n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT fire, count(*) AS n FROM features GROUP BY fire), (SELECT unnest(range(0, 5)) AS k)", "features")
def folds(t):
    return M.stratified_folds(t.features, "fire", "id", 5).groupBy("fire", "fold").agg(F.count("*").alias("n"))


@query("m10_spatial_folds")
def spatial_folds(t):
    return M.spatial_folds(t.stations.select("sid", "latitude", "longitude"), "sid", 5)


@query("m17_class_weights", "SELECT fire, round((SELECT count(*) FROM features) / CAST(2 * count(*) AS DOUBLE), 6) AS weight FROM features GROUP BY fire", "features")
def class_weights(t):
    return rounded(M.class_weights(t.features, "fire"), 6)


@query("m17_smote_tomek")
def smote_tomek(t):
    return M.smote_tomek(vectors(t), "vec_id", "v", "y", 1).groupBy("y").agg(F.count("*").alias("n"))


@query("m11_train_test_split", "SELECT fire, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM features GROUP BY fire", "features")
def split(t):
    return M.train_test_split(t.features, "fire", "id").groupBy("fire").agg(F.count_if("is_test").alias("n_test"))


@query("m14_cluster_agreement", """, n AS (SELECT flag AS a, status AS b, CAST(count(*) AS DOUBLE) AS n FROM features GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM n), a AS (SELECT sum(x * (x - 1) / 2) AS ai FROM (SELECT sum(n) AS x FROM n GROUP BY a)), b AS (SELECT sum(x * (x - 1) / 2) AS bj, sum(m) AS hit FROM (SELECT sum(n) AS x, max(n) AS m FROM n GROUP BY b))
SELECT round((ij - ai * bj / (t * (t - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (t * (t - 1) / 2)), 6) AS ari, round(hit / t, 6) AS purity FROM s, a, b""", "features")
def agreement(t):
    return rounded(M.agreement(t.features, "flag", "status").select("ari", "purity"), 6)


def vectors(t):
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("label") < 5, 1).otherwise(0).alias("y"))


NN = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.y AS ya, b.y AS yb, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d)
"""


@query("m05_k_distance", NN + "SELECT a AS vec_id, round(d, 6) AS d5 FROM k WHERE k = 5")
def k_distance(t):
    v = vectors(t)
    return rounded(M.block_neighbours(v, v, "vec_id", "v", 5).where("rank = 5").select("vec_id", F.col("dist").alias("d5")), 6)


@query("m07_knn_classify", NN + ", c AS (SELECT a, yb, count(*) AS n FROM k WHERE k <= 5 GROUP BY ALL) SELECT a AS vec_id, arg_max(yb, (n, -yb)) AS predicted FROM c GROUP BY a")
def knn(t):
    v = vectors(t)
    return M.knn_classify(v, v, "vec_id", "v", "y", 5)


@query("m15_tomek_links", NN + "SELECT x.a AS vec_id, x.b AS other FROM k x JOIN k z ON z.a = x.b AND z.b = x.a AND z.k = 1 WHERE x.k = 1 AND x.ya <> x.yb")
def tomek(t):
    return M.tomek_links(vectors(t), "vec_id", "v", "y")


@query("m16_edited_neighbours", NN + "SELECT a AS vec_id FROM k WHERE k <= 3 GROUP BY a HAVING avg(CASE WHEN ya = yb THEN 1 ELSE 0 END) >= 0.5")
def edited(t):
    return M.edited_neighbours(vectors(t), "vec_id", "v", "y").select("vec_id")


@query("m17_smote", "SELECT CAST(100 AS BIGINT) AS n, CAST(64 AS INT) AS width")
def smote(t):
    return M.smote(vectors(t), "vec_id", "v", "y", 1, 100).agg(F.count("*").alias("n"), F.min(F.size("v")).alias("width"))


@query("m03_dbscan", """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= 0.75),
k AS MATERIALIZED (SELECT a AS id FROM p GROUP BY a HAVING count(*) + 1 >= 5), l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN k x ON x.id = p.a JOIN k y ON y.id = p.b),
r(node, root) AS (SELECT id, id FROM k UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), c AS MATERIALIZED (SELECT node, min(root) AS cluster FROM r GROUP BY node),
n AS (SELECT p.a AS node, min(c.cluster) AS cluster FROM p JOIN c ON c.node = p.b GROUP BY p.a)
SELECT v.vec_id, CAST(coalesce(c.cluster, n.cluster, -1) AS BIGINT) AS cluster FROM v LEFT JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.node = v.vec_id""")
def dbscan(t):
    return M.dbscan(vectors(t), "vec_id", "v", 0.75, 5)


@query("m01_kmeans")
def kmeans(t):
    return M.kmeans(vectors(t), "vec_id", "v", 5, 10).select("vec_id", "cluster")


CENTERS = """WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings),
u AS MATERIALIZED (SELECT y, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v), c AS MATERIALIZED (SELECT y, list(x ORDER BY i) AS c FROM (SELECT y, i, avg(x) AS x FROM u GROUP BY y, i) GROUP BY y), g AS (SELECT list(x ORDER BY i) AS g FROM (SELECT i, avg(x) AS x FROM u GROUP BY i)),
s AS MATERIALIZED (SELECT v.y, count(*) AS n, avg(list_distance(e, c)) AS s, sum(pow(list_distance(e, c), 2)) AS w, any_value(c) AS c FROM v JOIN c USING (y) GROUP BY v.y)
"""


@query("m02_m14_cluster_quality", CENTERS + ", d AS (SELECT avg(r) AS db FROM (SELECT max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.y <> b.y GROUP BY a.y)), h AS (SELECT sum(n * pow(list_distance(c, g), 2)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))) AS ch FROM s, g) SELECT round(db, 6) AS davies_bouldin, round(ch, 6) AS calinski_harabasz FROM d, h")
def quality(t):
    return rounded(M.cluster_quality(vectors(t), "y", "v"), 6)


@query("m14_silhouette", NN + ", m AS (SELECT a, ya, avg(d) FILTER (WHERE ya = yb) AS i, avg(d) FILTER (WHERE ya <> yb) AS o FROM d GROUP BY a, ya) SELECT round(avg((o - i) / greatest(i, o)), 6) AS silhouette FROM m")
def silhouette(t):
    return rounded(M.silhouette(vectors(t), "vec_id", "v", "y"), 6)


@query("m06_clara")
def clara(t):
    return M.kmedoids(vectors(t), "vec_id", "v", 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query("m06_clarans")
def clarans(t):
    return M.clarans(vectors(t), "vec_id", "v", 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query("m06_ward")
def ward(t):
    return M.ward(vectors(t), "vec_id", "v", 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query("m08_decision_tree", "SELECT CAST(count(*) AS BIGINT) AS n, true AS better_than_majority FROM features", "features")
def tree(t):
    f = t.features
    p = f.select("fire", M.tree_column(M.grow_tree(f, COLS, "fire", 3)).alias("p"))
    return p.agg(F.count("*").alias("n"), (F.avg((F.col("p") == F.col("fire")).cast("int")) >= 1 - F.avg("fire") - 1e-9).alias("better_than_majority"))


@query("m09_random_forest")
def forest(t):
    f = t.features
    return rounded(f.select("fire", M.grow_forest(f, COLS, "fire", "id", 3, 3).alias("p")).groupBy("fire").agg(F.avg("p").alias("mean_vote")), 6)


@query("m18_logistic")
def logistic(t):
    return rounded(M.predict(M.fit_model(t.features, COLS, "fire", "logistic", maxIter=20), t.features).select("id", F.col("proba").alias("p")), 6)


@query("m18_forest_importance")
def importance(t):
    m = M.fit_model(t.features, COLS, "fire", "forest", numTrees=8, maxDepth=4, featureSubsetStrategy="all", seed=1)
    return rounded(t.spark.createDataFrame(M.importances(m, COLS), "feature string, importance double"), 4)


@query("m18_boosted_cross_validation")
def boosted(t):
    return rounded(M.cross_validate(t.features, COLS, "fire", "id", 2, "boosted", maxIter=3, maxDepth=3, seed=1), 4)


@query("n01_target_size", "SELECT 2333 AS a, 1 AS b, 500 AS c")
def target_size(t):
    return one(t, a=N.target_size(1000, 0.3), b=N.target_size(1, 0.9), c=N.target_size(1000, 0.3, 500))


# risk reports
LEVEL = "CASE WHEN proba >= 0.7 THEN 'High' WHEN proba >= 0.4 THEN 'Medium' ELSE 'Low' END"


@query("r01_risk_levels", f"SELECT {LEVEL} AS level, CAST(count(*) AS BIGINT) AS n, round(avg(proba), 6) AS mean FROM scored GROUP BY 1", "scored")
def levels(t):
    return rounded(t.scored.groupBy(R.risk_level(F.col("proba")).alias("level")).agg(F.count("*").alias("n"), F.avg("proba").alias("mean")), 6)


@query("r02_zone_profile", f"""SELECT cluster, CAST(count(*) AS BIGINT) AS n, round(avg(y_true), 6) AS actual_rate, round(avg(CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END), 6) AS predicted_rate, round(avg(proba), 6) AS mean_risk, round(stddev_samp(proba), 6) AS std_risk,
round(100 * avg(CASE WHEN {LEVEL} = 'Low' THEN 1 ELSE 0 END), 4) AS pct_low, round(100 * avg(CASE WHEN {LEVEL} = 'Medium' THEN 1 ELSE 0 END), 4) AS pct_medium, round(100 * avg(CASE WHEN {LEVEL} = 'High' THEN 1 ELSE 0 END), 4) AS pct_high, round(100.0 * count(*) / (SELECT count(*) FROM scored), 4) AS pct FROM scored GROUP BY cluster""", "scored")
def profile(t):
    return rounded(rounded(R.zone_profile(t.scored, "cluster", "proba", "y_true"), 6, "actual_rate", "predicted_rate", "mean_risk", "std_risk"), 4, "pct_low", "pct_medium", "pct_high", "pct")


@query("r03_zone_drivers", """, i AS (SELECT * FROM (VALUES ('quantity', 0.5e0), ('discount', 0.3e0), ('tax', 0.2e0)) AS i(feature, importance)), m AS (SELECT cluster, 'quantity' AS feature, avg(quantity) AS mean FROM scored WHERE proba >= 0.7 GROUP BY 1 UNION ALL SELECT cluster, 'discount', avg(discount) FROM scored WHERE proba >= 0.7 GROUP BY 1 UNION ALL SELECT cluster, 'tax', avg(tax) FROM scored WHERE proba >= 0.7 GROUP BY 1)
SELECT feature, cluster, round(mean, 5) AS mean, importance, CAST(row_number() OVER (PARTITION BY cluster ORDER BY importance DESC, feature) AS INT) AS rank FROM m JOIN i USING (feature) QUALIFY rank <= 2""", "scored")
def drivers(t):
    i = t.spark.createDataFrame([("quantity", 0.5), ("discount", 0.3), ("tax", 0.2)], "feature string, importance double")
    return rounded(R.zone_drivers(t.scored, "cluster", "proba", ["quantity", "discount", "tax"], i, 2), 5, "mean")


@query("r04_high_low_medians", " UNION ALL ".join(f"SELECT '{c}' AS feature, h AS high, l AS low, CASE WHEN h > l THEN 'higher' WHEN h < l THEN 'lower' ELSE 'same' END AS direction FROM (SELECT round(median({c}) FILTER (WHERE proba >= 0.7), 6) AS h, round(median({c}) FILTER (WHERE proba < 0.4), 6) AS l FROM scored)" for c in ("quantity", "discount")), "scored")
def medians(t):
    return rounded(R.high_low_medians(t.scored, "proba", ["quantity", "discount"]), 6)


@query("r05_band_drivers", f""", l AS (SELECT {LEVEL} AS band, 'quantity' AS feature, quantity AS v FROM scored WHERE proba < 1 UNION ALL SELECT {LEVEL}, 'tax', tax FROM scored WHERE proba < 1), a AS (SELECT 'quantity' AS feature, stddev_samp(quantity) AS a FROM scored UNION ALL SELECT 'tax', stddev_samp(tax) FROM scored)
SELECT band, feature, round(stddev_samp(v) / max(a), 6) AS score FROM l JOIN a USING (feature) GROUP BY band, feature""", "scored")
def bands(t):
    return rounded(R.band_drivers(t.scored, "proba", ["quantity", "tax"]).drop("rank"), 6)


@query("r06_management_plan", """, p AS (SELECT cluster, CAST(count(*) AS BIGINT) AS n, avg(proba) AS m FROM scored GROUP BY cluster)
SELECT cluster, n, round(m, 6) AS mean_risk, CAST(row_number() OVER (ORDER BY m DESC, cluster) AS INT) AS rank, CASE WHEN m >= 0.65 THEN 'Act' WHEN m >= 0.5 THEN 'Prevent' WHEN m >= 0.35 THEN 'Watch' ELSE 'Routine' END AS plan, round(0.8 * m, 6) AS alert FROM p""", "scored")
def plan(t):
    return rounded(R.management_plan(R.zone_profile(t.scored, "cluster", "proba", "y_true"), "cluster"), 6)


@query("r07_model_comparison", CELLS + """, m AS (SELECT fold, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM c)
SELECT 'accuracy' AS metric, arg_max(fold, (accuracy, -fold)) AS best, round(max(accuracy), 6) AS value, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM m UNION ALL SELECT 'f1', arg_max(fold, (f1, -fold)), round(max(f1), 6), round(avg(f1), 6), round(stddev_pop(f1), 6) FROM m""", "scored")
def comparison(t):
    return rounded(R.comparison(M.threshold_metrics(t.scored, "y_true", "proba", 0.5, ["fold"]), "fold", ["accuracy", "f1"]), 6)


@query("r08_summary", f""", o AS (SELECT CAST(count(*) AS DOUBLE) AS rows, avg(proba) AS mean_risk, 100 * avg(CASE WHEN {LEVEL} = 'Low' THEN 1 ELSE 0 END) AS pct_low, 100 * avg(CASE WHEN {LEVEL} = 'Medium' THEN 1 ELSE 0 END) AS pct_medium, 100 * avg(CASE WHEN {LEVEL} = 'High' THEN 1 ELSE 0 END) AS pct_high,
100.0 * count(*) FILTER (WHERE proba >= 0.5 AND y_true = 0) / count(*) FILTER (WHERE proba >= 0.5) AS pct_false_alarms FROM scored), n AS (SELECT cluster, count(*) AS n FROM scored GROUP BY cluster),
e AS (SELECT CAST(count(*) AS DOUBLE) AS zones, CAST(arg_max(cluster, (n, -cluster)) AS DOUBLE) AS largest, CAST(arg_min(cluster, (n, cluster)) AS DOUBLE) AS smallest FROM n), b AS (SELECT * FROM o, e)
SELECT metric, round(value, 6) AS value FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM b" for c in ("rows", "mean_risk", "pct_low", "pct_medium", "pct_high", "pct_false_alarms", "zones", "largest", "smallest")) + ")", "scored")
def summary(t):
    return rounded(R.summary_table(t.scored, "cluster", "proba", "y_true"), 6)


# sources and sinks, as round trips
def place(t):
    return f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"


@query("k01_parquet_csv_sink", "SELECT id, frp FROM fires", "fires")
def sink(t):
    path = place(t)
    io.write_table(t.fires.select("id", "frp"), path, "gzip", csv=True)
    return io.first_readable(t.spark, f"{path}-absent", f"{path}.csv").select(F.col("id").cast("long").alias("id"), F.col("frp").cast("double").alias("frp"))


@query("k02_partitioned_sink", "SELECT type, CAST(count(*) AS BIGINT) AS n FROM fires WHERE type = 3 GROUP BY type", "fires")
def partitioned(t):
    path = place(t)
    io.write_table(t.fires.select("id", "type"), path, by=["type"])
    return t.spark.read.parquet(path).where("type = 3").groupBy("type").agg(F.count("*").alias("n"))


@query("k03_json_summary", "SELECT CAST(count(*) AS BIGINT) AS n, round(max(frp), 4) AS top FROM fires", "fires")
def json_summary(t):
    text = io.summary_json(t.fires.agg(F.count("*").alias("n"), F.round(F.max("frp"), 4).alias("top")))
    return t.spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "n long, top double").alias("x")).select("x.*")


@query("k04_append_log", "SELECT CAST(2 AS BIGINT) AS steps")
def log(t):
    path = place(t)
    for step in ("scan", "join"):
        io.append_log(t.spark, path, step=step)
    return t.spark.read.parquet(path).agg(F.count("*").alias("steps"))


@query("k04_data_dictionary", """SELECT 'dem' AS layer, 'raster' AS type, CAST(count(*) AS STRING) || ' cells' AS notes, 'dem' AS item_id, 'raster' AS layer_type FROM dem
UNION ALL SELECT 'soil', 'table', CAST(count(*) AS STRING) || ' cells', 'soil', 'table' FROM soil""", "dem", "soil")
def dictionary(t):
    path = place(t)
    for name, kind, df in (("dem", "raster", t.dem), ("soil", "table", t.soil)):
        io.log_layer(t.spark, path, name, f"{path}/{name}", kind, notes=f"{df.count()} cells")
    item = lambda p: F.get_json_object("item", p)
    return t.spark.read.parquet(path).select("layer", "type", "notes", item("$.id").alias("item_id"), item("$.properties.layer_type").alias("layer_type"))


@query("s01_csv_scan", "SELECT country, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN id % 2 = 0 THEN 'Algeria' ELSE 'Tunisia' END AS country FROM fires) GROUP BY country", "fires")
def csv_scan(t):
    path = place(t)
    f = t.fires.select(*(F.col(c).cast("string").alias(c) if c in ("latitude", "longitude", "acq_date", "acq_time", "confidence", "frp", "daynight", "type") else F.lit("1").alias(c) for c in io.DETECTIONS.names), "id")
    for k, name in ((0, "alger"), (1, "tunis")):
        f.where(f"id % 2 = {k}").drop("id").write.option("header", True).csv(f"{path}/{name}")
    both = [io.read_detections(t.spark, f"{path}/{name}").withColumn("country", F.lit(c)) for name, c in (("alger", "Algeria"), ("tunis", "Tunisia"))]
    return T.union_all(*both).groupBy("country").agg(F.count("*").alias("n"))


@query("s12_json_reports", "SELECT 'f1' AS metric, 0.5e0 AS value UNION ALL SELECT 'f1', 0.75e0 UNION ALL SELECT 'f1', 0.9e0")
def reports(t):
    path = place(t)
    docs = ['{"aggregated": {"f1": 0.5}}', '{"metrics_per_fold": [{"f1": 0.7}, {"f1": 0.8}]}', '{"metrics": {"f1": 0.9}}']
    for k, d in enumerate(docs):
        t.spark.createDataFrame([(d,)], "value string").write.text(f"{path}/{k}")
    return rounded(io.read_reports(t.spark, f"{path}/*").select("metric", "value"), 6)


@query("x01_stream_daily_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream(t):
    path = place(t)
    q = counts.windowed_counts(counts.replay(t.spark, t.dir), "ts", "event_type", late="40 days")
    name = f"stream_{uuid.uuid4().hex[:12]}"
    q.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
