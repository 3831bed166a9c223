"""Exact values on small fixtures, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.functions import scalar as S
from emberfield.operators import clean as C, eda as E, grid as G, ml as M, sampling as N, spatial as X, tables as T
from emberfield.sources import io

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def values(spark, xs, name="x"):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], f"id long, {name} double")


def test_to_null_takes_nan_infinity_and_sentinels(spark):
    df = values(spark, [1, math.nan, math.inf, -math.inf, -9999, None])
    assert [r[0] for r in df.orderBy("id").select(S.to_null(F.col("x"), S.SENTINELS)).collect()] == [1.0, None, None, None, None, None]


@pytest.mark.parametrize(("hhmm", "want"), [("5", "00:05"), ("45", "00:45"), ("930", "09:30"), ("2359", "23:59"), ("bad", "00:00"), (None, "00:00"), ("2460", "00:00")])
def test_hhmm(spark, hhmm, want):
    df = spark.createDataFrame([("2024-05-06", hhmm)], "d string, t string").select(S.timestamp_of(F.col("d"), F.col("t")).alias("x"))
    assert df.first()["x"].strftime("%Y-%m-%d %H:%M") == f"2024-05-06 {want}"


def test_labels(spark):
    df = spark.createDataFrame([(" Yes",), ("0",), ("1.0",), ("maybe",), (None,)], "x string").select(S.label01(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == [1, 0, 1, None, None]


def test_outliers_become_the_mean_or_median_of_the_rest(spark):
    even = [21.0, 24.0, 22.5, 25.5, 27.0, 400.0, -350.0]  # fewer than ten values count as symmetric: the mean
    out, d = C.impute_smart(values(spark, even), "x")
    assert d.symmetric and sorted(r["x"] for r in out.collect()) == [21.0, 22.5, 24.0, 24.0, 24.0, 25.5, 27.0]
    skewed = [3.0, 4.0, 4.0, 5.0, 5.0, 5.0, 6.0, 6.0, 7.0, 7.0, 900.0]  # the median
    out, d = C.impute_smart(values(spark, skewed), "x")
    assert not d.symmetric and max(r["x"] for r in out.collect()) == 7.0 and sorted(r["x"] for r in out.collect())[4] == 5.0


def test_few_values_are_not_categorical(spark):
    assert not C.decide(values(spark, [1, 1, 1, 2, 2, 3, 3, 99, 1, 2, 1]), "x").categorical


def test_winsorise_guards(spark):
    same = values(spark, [5] * 12)
    assert {r["x"] for r in C.winsorise_iqr(same, ["x"]).collect()} == {5.0}
    few = values(spark, [1, 2, 3, 1000])
    assert max(r["x"] for r in C.winsorise_iqr(few, ["x"], least=5).collect()) == 1000.0


def test_all_null_column(spark):
    df = values(spark, [None] * 5)
    assert [r["x"] for r in C.fill_with(df, ["x"], "median").collect()] == [None] * 5
    assert C.decide(df, "x").fill is None


@pytest.mark.parametrize("k", [1, 3, 50])
def test_k_nearest_is_brute_force(spark, k):
    rng = np.random.default_rng(k)
    p, s = rng.uniform(0, 10, (60, 2)), np.concatenate((rng.uniform(0, 1, (30, 2)), [[9.0, 9.0]]))
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, latitude double, longitude double")
    src = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(s)], "sid long, latitude double, longitude double")
    got = {(r["id"], r["rank"]): r["sid"] for r in X.k_nearest(pts, src, "id", "sid", k).collect()}
    d = np.sqrt(((p[:, None] - s[None]) ** 2).sum(2))
    for i in range(len(p)):
        order = np.lexsort((np.arange(len(s)), d[i]))[:k]
        assert [got[i, r + 1] for r in range(min(k, len(s)))] == order.tolist()


def test_k_nearest_empty_source(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "id long, latitude double, longitude double")
    assert X.k_nearest(pts, pts.where("false").withColumnRenamed("id", "sid"), "id", "sid", 2, cell=1.0).count() == 0


def test_concave_polygon_and_hole(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]
    poly = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in ring])], "g int, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(1, 0.5, 2.0), (2, 3.0, 2.0), (3, 1.0, 0.7), (4, 5.0, 5.0)], "id int, latitude double, longitude double")
    assert sorted(r["id"] for r in X.points_in_polygons(pts, poly, "id", "g").collect()) == [1, 3]


def grid(spark, a):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)], "r int, c int, z double")


def test_focal_against_numpy(spark):
    a = np.arange(20, dtype=float).reshape(4, 5) ** 1.5
    a[1, 2] = np.nan
    got = {(r["r"], r["c"]): r for r in G.ruggedness(grid(spark, a), "z").collect()}
    for r in range(4):
        for c in range(5):
            w = a[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
            assert got[r, c]["ruggedness"] == pytest.approx(np.nanstd(w))
    filled = {(r["r"], r["c"]): r["z"] for r in G.impute_neighbours(grid(spark, a), "z").collect()}
    assert filled[1, 2] == pytest.approx(np.nanmean(a[0:3, 1:4]))


def test_gradients_are_numpys(spark):
    a = np.random.default_rng(0).normal(size=(5, 6))
    gy, gx = np.gradient(a)
    for r in G.gradients(grid(spark, a), "z").collect():
        assert (r["gx"], r["gy"]) == pytest.approx((gx[r["r"], r["c"]], gy[r["r"], r["c"]]))


def test_position_index_replicates_edges(spark):
    a = np.random.default_rng(1).normal(size=(4, 4))
    p = np.pad(a, 1, mode="edge")
    for r in G.position_index(grid(spark, a), "z", 4, 4).collect():
        assert r["tpi"] == pytest.approx(a[r["r"], r["c"]] - p[r["r"] : r["r"] + 3, r["c"] : r["c"] + 3].mean())


def test_position_index_of_wide_windows_and_far_cells(spark):
    a = np.random.default_rng(2).normal(size=(9, 8))
    a[0, 1] = np.nan
    p = np.pad(a[:5, :6], ((2, 6), (2, 4)), mode="edge")  # a raster of 5 x 6 cells
    got = G.position_index(grid(spark, a).withColumnRenamed("z", "v"), "v", 5, 6, 5).collect()
    assert len(got) == 72
    for r in got:
        want = a[r["r"], r["c"]] - np.nanmean(p[r["r"] : r["r"] + 5, r["c"] : r["c"] + 5])
        assert r["tpi"] is None if np.isnan(want) else r["tpi"] == pytest.approx(want)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    r = M.ranking_metrics(df, "y", "p").first()
    assert r["roc_auc"] == pytest.approx(0.875)
    assert r["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_dbscan_chain_border_noise(spark):
    xs = [0.0, 1.0, 2.0, 3.0, 10.0, 11.0, 12.0, 30.0]
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(xs)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in M.dbscan(df, "id", "v", 1.0, 3).collect()}
    assert len({got[i] for i in (0, 1, 2, 3)}) == 1 and len({got[i] for i in (4, 5, 6)}) == 1 and got[7] == -1 and got[0] != got[4]


def _clusters(n=300, dims=2):
    """Vectors around six centers, a tenth of them copies, one far away, and three without a place."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dims)) + rng.integers(0, 6, n)[:, None] * 20.0
    x[: n // 10] = x[0]
    x[-1] = 1e6
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    return rows, [(n, None), (n + 1, [math.nan] * dims), (n + 2, [None] * dims)]


def _distance(a, b, metric):
    d = np.abs(np.array(a) - np.array(b))
    return float(d.sum() if metric == "manhattan" else np.sqrt((d**2).sum()))


@pytest.mark.parametrize(("metric", "dims"), [("euclidean", 2), ("manhattan", 3)])
def test_nearest_vectors_are_exact_in_any_blocks(spark, metric, dims):
    rows, odd = _clusters(dims=dims)
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    ask = rows[::7] + [(900, [55.0] * dims)]
    queries = spark.createDataFrame(ask, "id long, v array<double>")
    got = M.block_neighbours(queries, df, "id", "v", 4, metric, block=24).collect()
    want = {(q, r + 1): o for q, x in ask for r, (d, o) in enumerate(sorted((round(_distance(x, y, metric), 9), o) for o, y in rows if o != q)[:4])}
    assert {(r["id"], r["rank"]): r["other"] for r in got} == want
    few = M.block_neighbours(df.where("id < 3"), df.where("id < 3"), "id", "v", 4, metric, block=1)
    assert few.groupBy("id").count().select("count").distinct().collect() == [(2,)]
    assert M.block_neighbours(df.limit(0), df.limit(0), "id", "v", 4).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_pairs_within_eps_are_exact_in_any_blocks(spark, metric):
    rows, odd = _clusters(200)
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    want = {(a, b) for a, x in rows for b, y in rows if a != b and _distance(x, y, metric) <= 0.7}
    got = [(r["id"], r["other"]) for r in M.eps_pairs(df, "id", "v", 0.7, metric, block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_far_leaves_are_not_met(spark):
    rows, _ = _clusters()
    data = M._finite(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", "o")
    place, many = M._tree(data, 24)
    placed = place(data, "o").cache()
    asked = placed.select(F.col("o").alias("q"), "x", F.lit(-1).alias("own"), F.lit(0.7).alias("reach"))
    boxes = M._boxes(placed)
    assert many and len(boxes) > 8 and M._route(asked, boxes, "euclidean").count() < 4 * len(rows)
    placed.unpersist()


def test_ward_merges_where_the_sum_of_squares_grows_least(spark):
    x = np.random.default_rng(3).normal(size=(24, 3))
    groups = [[i] for i in range(len(x))]
    inside = lambda g: float(((x[g] - x[g].mean(0)) ** 2).sum())
    while len(groups) > 5:
        _, i, j = min((inside(a + b) - inside(a) - inside(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    label = M.ward_labels(x, 5)
    assert {frozenset(np.flatnonzero(label == c).tolist()) for c in range(5)} == {frozenset(g) for g in groups}


def test_ward_and_swapped_medoids_find_clusters(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, (rng.normal(size=2) + 50 * (i % 3)).tolist()) for i in range(90)], "id long, v array<double>")
    for got in (M.ward(df, "id", "v", 3, 40), M.clarans(df, "id", "v", 3, 40)):
        rows = got.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct(F.col("id") % 3).alias("k")).collect()
        assert sorted((r["n"], r["k"]) for r in rows) == [(30, 1)] * 3
    assert [r["best"] for r in M.ward_sweep(df, "id", "v", [2, 3], 2, 40)] == [False, True]
    assert M.ward(df.limit(0), "id", "v", 3).count() == 0 and M.clarans(df.limit(0), "id", "v", 3).count() == 0


def test_grid_outliers_become_the_mean_around_them(spark):
    z = {(r, c): 10.0 + r + (c % 2) / 2 for r in range(8) for c in range(6)}
    z[2, 2], z[2, 3], z[0, 0], z[7, 5] = 900.0, 901.0, 902.0, None
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r int, c int, z double")
    out, d = C.impute_smart_grid(df, "z")
    bad = {k for k, v in z.items() if v is not None and v > 800}
    want = dict(z)
    for r, c in bad:
        around = [z[k] for k in z if max(abs(k[0] - r), abs(k[1] - c)) == 1 and k not in bad and z[k] is not None]
        want[r, c] = sum(around) / len(around)
    left = [v for v in want.values() if v is not None]
    want[7, 5] = float(np.mean(left) if d.symmetric else np.median(left))
    assert {(r["r"], r["c"]): round(r["z"], 9) for r in out.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_p_values():
    assert E.t_pvalue(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert E.chi2_pvalue(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = [r["id"] for r in T.sample_n(df.repartition(7), "id", 20).collect()]
    assert a == [r["id"] for r in T.sample_n(df.repartition(2), "id", 20).collect()]


def test_target_size():
    assert N.target_size(1000, 0.3) == 2333 and N.target_size(1, 0.99) == 1


def test_exact_percentiles(spark):
    from emberfield.operators.quantiles import exact_percentiles

    rng = np.random.default_rng(0)
    x = np.concatenate((np.full(3000, 5.0), rng.lognormal(0, 3, 6000)))
    df = spark.createDataFrame([(float(v), None) for v in x], "x double, y double")
    ps = [0, 0.01, 0.25, 0.5, 0.9, 0.999, 1]
    got = exact_percentiles(df, ["x", "y"], ps, most=50)
    assert np.allclose(got["x"], np.percentile(x, [100 * p for p in ps])) and got["y"] == [None] * len(ps)


def test_jdbc_reads_a_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/layers;create=true"
    want = [(1, "D1"), (2, "D2"), (3, None)]
    spark.createDataFrame(want, "id int, layer string").write.format("jdbc").options(url=url, dbtable="LAYERS", driver=DERBY).save()
    got = io.jdbc(spark, url, "LAYERS", driver=DERBY, partitionColumn="id", lowerBound="1", upperBound="3", numPartitions="2")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_jdbc_on_the_driver_reads_every_batch(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/layers;create=true"
    want = [(k, None if k % 3 == 0 else f"D{k}", k / 2) for k in range(25)]
    io.write_jdbc_on_driver(spark.createDataFrame(want, "id int, layer string, z double"), url, "LAYERS", 4, driver=DERBY)
    assert sorted(map(tuple, io.jdbc_on_driver(spark, url, "LAYERS", 7, driver=DERBY).collect())) == want
    assert io.jdbc_on_driver(spark, url, "(SELECT * FROM LAYERS WHERE \"id\" < 0) AS few", driver=DERBY).collect() == []


def test_grid_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, 4)], "Latitude double, X double, grid_id int, soil int")
    assert io.grid_columns(df).columns == ["lat", "lon", "grid_id", "soil_id"]
    with pytest.raises(ValueError):
        io.grid_columns(spark.createDataFrame([(1,)], "a int"))


def test_legend_of_values(spark, tmp_path):
    (tmp_path / "legend.csv").write_text("Value, Label \n1,forest\n1,forest\nbad,x\n2,\n")
    assert sorted(map(tuple, io.read_legend(spark, str(tmp_path / "legend.csv")).collect())) == [(1, "forest", None), (2, None, None)]


def places(spark, a, name="id"):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], f"{name} long, latitude double, longitude double")


def great_circle(p, s):
    (a1, o1), (a2, o2) = (np.radians(x).T for x in (p, s))
    h = np.sin((a2[None] - a1[:, None]) / 2) ** 2 + np.cos(a1)[:, None] * np.cos(a2)[None] * np.sin((o2[None] - o1[:, None]) / 2) ** 2
    return 2 * 6371 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


@pytest.mark.parametrize(("center", "km"), [((45, 10), 10), ((80, 10), 10), ((89.9, 0), 15), ((10, 180), 10), ((-88, 179), 30), ((0, 0), 4000)])
def test_within_km_is_brute_force(spark, center, km):
    rng = np.random.default_rng(int(km))
    spread = 0.4 if km < 100 else 60
    make = lambda n: np.column_stack((np.clip(center[0] + rng.uniform(-spread, spread, n), -90, 90), (center[1] + rng.uniform(-spread, spread, n) / max(0.01, math.cos(math.radians(center[0]))) + 180) % 360 - 180))
    p, s = make(60), make(80)
    got = {(r["id"], r["sid"]) for r in X.within_km(places(spark, p), places(spark, s, "sid"), "id", "sid", km, S.haversine_km).collect()}
    d = great_circle(p, s)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= km), strict=True)}
    close = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.abs(d - km) < 1e-6), strict=True)}
    assert want and got ^ want <= close


def test_k_nearest_with_far_points_and_a_dense_cell(spark):
    rng = np.random.default_rng(4)
    s = np.concatenate((rng.normal(0, 1e-4, (1500, 2)), rng.uniform(-5, 5, (40, 2)), np.zeros((30, 2))))
    p = np.concatenate((rng.uniform(-6, 6, (20, 2)), rng.normal(0, 1e-4, (20, 2)), [[85.0, 170.0], [-80.0, -179.0]]))
    got = {(r["id"], r["rank"]): r["sid"] for r in X.k_nearest(places(spark, p), places(spark, s, "sid"), "id", "sid", 3).collect()}
    d = np.sqrt(((p[:, None] - s[None]) ** 2).sum(2))
    for i in range(len(p)):
        assert [got[i, r + 1] for r in range(3)] == np.lexsort((np.arange(len(s)), d[i]))[:3].tolist()


def test_running_sums_and_ranks_in_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 7 == 0 else "a" if i % 3 else "b", int(v)) for i, v in enumerate(rng.integers(0, 50, 400))]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(5)
    want, total = {}, {}
    for i, g, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        total[g] = total.get(g, 0) + v
        want[i] = total[g]
    assert {r["id"]: r["t"] for r in T.running(df, ["g"], [F.desc("v"), F.col("id")], {"t": "v"}).collect()} == want
    p = {r["id"]: r["p"] for r in T.cdf_ranks(df, "v", [F.col("id")]).collect()}
    assert p == {i: pytest.approx((k + 0.5) / 400) for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


def test_samples_of_classes(spark):
    df = spark.createDataFrame([(i, i % 10 == 0) for i in range(1000)], "id long, y boolean").selectExpr("id", "cast(y as int) as y")
    count = lambda d: {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}
    assert count(T.stratified_sample(df, "y", "id", 100)) == {0: 90, 1: 10}
    assert count(T.undersample(df, "y", "id")) == {0: 100, 1: 100}
    assert count(M.train_test_split(df, "y", "id").where("is_test")) == {0: 180, 1: 20}
    many = M.train_test_split(df.withColumn("z", F.col("id") % 50), "z", "id")
    assert many.where("is_test").count() == 200  # too many classes: the whole table is split
    assert T.undersample(df.where("false"), "y", "id").count() == 0


def test_kmeans_is_lloyds(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.5, (30, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    start = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(3).collect()]
    c = x[start]
    for _ in range(50):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else np.zeros(2) for k in range(3)])
    assert np.allclose(M.kmeans_centers(df, "id", "v", 3, 50), c)
    assert M.inertia(df, "v", c.tolist()) == pytest.approx(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    assert M.kmeans(df.where("false"), "id", "v", 3).count() == 0 and M.kmedoids(df.where("false"), "id", "v", 3).count() == 0
    got = M.kmedoids(df, "id", "v", 3).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [30, 30, 30]
    grid = M.dbscan_grid(df.withColumn("y", F.floor(F.col("id") / 30).cast("int")), "id", "v", [0.01, 1.0], [4], "y")
    assert [r["best"] for r in grid] == [False, True] and grid[1]["score"] > 0.8


def test_smote_lies_between_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist(), int(i < 12)) for i, v in enumerate(x)], "id long, v array<double>, y int")
    out = M.smote(df, "id", "v", "y", 1, 25, k=4).collect()
    assert len(out) == 25
    for r in out:
        near = np.argsort(((x[:12] - x[r["base"]]) ** 2).sum(1), kind="stable")[1:5]
        assert r["other"] in near.tolist()
        assert np.allclose(r["v"], x[r["base"]] + r["u"] * (x[r["other"]] - x[r["base"]]))
    assert M.smote(df.where("id <> id or id > 10 and id < 13"), "id", "v", "y", 1, 5).count() == 0
    both = M.smote_tomek(df, "id", "v", "y", 1)
    assert M.tomek_links(both, "id", "v", "y").count() == 0 or both.count() < 56


def test_adjusted_mutual_information_against_all_tables(spark):
    from itertools import permutations

    a, b = [0, 0, 0, 1, 1, 2], [1, 1, 0, 0, 0, 1]

    def mi(x, y):
        n = len(x)
        return sum(c / n * math.log(n * c / (x.count(i) * y.count(j))) for i in set(x) for j in set(y) if (c := sum(p == (i, j) for p in zip(x, y, strict=True))))

    h = lambda x: mi(x, x)
    e = np.mean([mi(a, list(p)) for p in permutations(b)])
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert M.adjusted_mutual_information(df, "a", "b") == pytest.approx((mi(a, b) - e) / ((h(a) + h(b)) / 2 - e))


def test_tree_takes_the_best_first_cut(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (300, 2)).astype(float)
    y = ((x[:, 0] > 4) ^ (rng.uniform(size=300) < 0.1)).astype(int)
    df = spark.createDataFrame([(float(p), float(q), int(t)) for (p, q), t in zip(x, y, strict=True)], "a double, b double, y int")
    nodes = M.grow_tree(df, ["a", "b"], "y", depth=1, least=1)
    gini = lambda s: 2 * s.mean() * (1 - s.mean()) * len(s) if len(s) else 0.0
    best = min((gini(y[x[:, f] <= c]) + gini(y[x[:, f] > c]), f, c) for f in (0, 1) for c in range(7))
    assert (nodes[0]["feature"], nodes[0]["threshold"]) == ("ab"[best[1]], best[2])
    assert M.grow_tree(df.where("false"), ["a"], "y")[0]["value"] == 0


def test_shapiro_wilk(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # the example of the 1965 paper, W = 0.79
    assert E.royston(np.array(weights, dtype=float))[0] == pytest.approx(0.79, abs=0.005)
    rng = np.random.default_rng(0)
    flat, bell = (E.shapiro_wilk(values(spark, x), "x", "id") for x in (rng.exponential(size=300), rng.normal(size=300)))
    assert flat["p"] < 1e-6 and bell["p"] > 0.05 and bell["w"] > 0.98
    assert E.shapiro_wilk(values(spark, [3.0] * 30), "x", "id") == {"w": None, "p": None}


def test_tests_of_empty_or_one_sided_tables(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    assert E.two_sample_t(df, "x", "y") == {"t": None, "p": None} and E.point_biserial(df, "x", "y")["p"] is None
    assert E.two_sample_t(df.where("false"), "x", "y")["t"] is None
    two = spark.createDataFrame([(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)] * 7, "a int, b int")
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((8, 5.5), (2, 4.5), (3, 5.5), (7, 4.5)))
    assert E.chi_square(two, "a", "b", True).first()["chi2"] == pytest.approx(want)
    with pytest.raises(ValueError):
        N.random_in_box(spark.createDataFrame([], "id long, latitude double, longitude double"), 5, 1.0)


def test_days_without_detections_count_zero(spark, tmp_path):
    import datetime

    from emberfield.plans import catalog

    day = datetime.datetime(2024, 3, 1, 5)
    rows = [(k, day + datetime.timedelta(days=d), 1, "a", 1.0, "{}") for k, d in enumerate((0, 0, 3))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["day"].day, r["n"]) for r in catalog.queries()["a16_time_series"](spark, str(tmp_path)).collect())
    assert got == [(1, 2), (2, 0), (3, 0), (4, 1)]


def test_top_ups(spark):
    fires = places(spark, [(30.0, 5.0), (30.5, 5.5)])
    ring = [(5.0, 30.0), (5.5, 30.0), (5.5, 30.5), (5.0, 30.5), (5.0, 30.0)]
    poly = spark.createDataFrame([(1, ring), (2, [(x + 2, y) for x, y in ring])], "zone int, ring array<struct<x: double, y: double>>")
    got = N.polygons_with_interior(poly, fires, 10, 5.0, 0.1).collect()
    assert len(got) == 10 and [r["nid"] for r in got][0] == 2  # polygon 2 has no detection: its centroid, then interior points
    assert X.within_km(spark.createDataFrame(got), fires, "nid", "id", 5.0, S.haversine_km).where("km < 5").count() == 0
    few = N.even_grid(fires, 30, 1.0, refinements=1)
    assert few.count() == 30 and few.select("nid").distinct().count() == 30


def test_spread_is_the_greedy_sample_and_makes_no_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    places = [(k, float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(30, 30.8, 1500), rng.uniform(5, 5.8, 1500), strict=True))]
    places += [(1500 + k, float(a), float(o)) for k, (a, o) in enumerate(zip(rng.choice([-90, -89.7, 0, 89.8, 90], 200) * 1.0, rng.uniform(-180, 180, 200), strict=True))]
    places += [(1700 + k, 0.1 * k, float(o)) for k, o in enumerate((179.9, -179.9, 180, -180, 0))] + [(3, 60.0, 60.0), (1600, 60.1, 60.1), (3, 60.0, 60.0), (1705, None, 1.0), (1706, math.nan, 1.0)]
    df = spark.createDataFrame(places, "nid long, latitude double, longitude double")
    most, whole = [0], N.materialize

    def counted(frame, name):
        out = whole(frame, name)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(N, "materialize", counted)
    got = {r["nid"] for r in N.spread(df, 20.0, seed=7).collect()}
    by, near = {}, lambda p, q: S.EARTH_KM * 2 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2))) < 20
    for nid, a, o in places:
        by.setdefault(nid, []).extend([(a, o)] if a is not None and math.isfinite(a) else [])
    want = []
    for r in df.select("nid", F.xxhash64(F.lit(7), "nid").alias("rank")).distinct().orderBy("rank", "nid").collect():
        if not any(near(p, q) for p in by[r["nid"]] for w in want for q in by[w]):
            want.append(r["nid"])
    assert got == set(want) and {1705, 1706} <= got
    assert most[0] <= len(places)
