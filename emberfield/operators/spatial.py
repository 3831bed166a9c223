"""Joins by place: nearest and k nearest points, distance bands, raster lookup, points in polygons.

The nearest join cuts space into cells, small enough that the fullest holds few source rows. Each point looks into the
cells around its own; a k-th distance of at most one cell is final, as nothing nearer lies outside. Points that are not
settled go on with cells of twice the size, so a point costs nine cells a round however far it lies from the source; a point
outside the source's box starts with cells of about its distance to the box.
The equi-join on cells replaces a nested loop, and a source row is copied to no other cell: the points are exploded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release


def _cells(df: DataFrame, lat: str, lon: str, cell: float) -> DataFrame:
    return df.withColumn("__i", F.floor(F.col(lat) / cell)).withColumn("__j", F.floor(F.col(lon) / cell))


def _around(df: DataFrame) -> DataFrame:
    """A row for each of the nine cells around its own."""
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    out = df.withColumn("__di", F.explode(steps)).withColumn("__dj", F.explode(steps))
    return out.withColumn("__i", F.col("__i") + F.col("__di")).withColumn("__j", F.col("__j") + F.col("__dj")).drop("__di", "__dj")


def k_nearest(points: DataFrame, source: DataFrame, pid: str, sid: str, k: int = 1, cell: float | None = None, lat: str = "latitude", lon: str = "longitude", rounds: int = 80, exclude_self: bool = False) -> DataFrame:
    """(pid, sid, dist, rank): the k nearest source rows by Euclidean distance in degrees, ties to the smaller sid. Points or
    source rows without a coordinate take no part; an empty source gives no rows."""
    src = source.select(F.col(sid).alias("__sid"), F.col(lat).cast("double").alias("__a"), F.col(lon).cast("double").alias("__o")).where("__a is not null and __o is not null")
    todo = points.select(F.col(pid).alias("__pid"), F.col(lat).cast("double").alias("__pa"), F.col(lon).cast("double").alias("__po")).where("__pa is not null and __po is not null")
    box = src.agg(F.count("*").alias("n"), F.min("__a").alias("a0"), F.max("__a").alias("a1"), F.min("__o").alias("o0"), F.max("__o").alias("o1")).first()
    want = min(k, box["n"] - (1 if exclude_self else 0))
    if want < 1:
        return todo.join(src, F.lit(False)).select(F.col("__pid").alias(pid), F.col("__sid").alias(sid), F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    if cell is None:
        area = max(box["a1"] - box["a0"], 1e-6) * max(box["o1"] - box["o0"], 1e-6)
        cell, fullest = max(1e-6, (area * 2.0 * k / box["n"]) ** 0.5), None
        for _ in range(30):  # dense places decide: sparse ones take a round more
            now = _cells(src, "__a", "__o", cell).groupBy("__i", "__j").count().agg(F.max("count")).first()[0]
            if now <= max(64, 32 * k) or cell < 1e-6 or (fullest is not None and now > 0.9 * fullest):
                break
            cell, fullest = cell / 2, now
    gap = F.greatest(F.lit(box["a0"]) - F.col("__pa"), F.col("__pa") - F.lit(box["a1"]), F.lit(box["o0"]) - F.col("__po"), F.col("__po") - F.lit(box["o1"]))
    todo = todo.withColumn("__first", F.when(gap > 2 * cell, F.floor(F.log2(gap / cell)) - 1).otherwise(0).cast("int"))
    out, last, step, size = [], None, 0, cell
    for _ in range(rounds):
        size = cell * 2.0**step
        dist = F.sqrt(F.pow(F.col("__pa") - F.col("__a"), 2) + F.pow(F.col("__po") - F.col("__o"), 2))
        pairs = _around(_cells(todo.where(F.col("__first") <= step), "__pa", "__po", size)).join(_cells(src, "__a", "__o", size), ["__i", "__j"])
        if exclude_self:
            pairs = pairs.where("__pid <> __sid")
        w = Window.partitionBy("__pid").orderBy("dist", "__sid")
        near = pairs.withColumn("dist", dist).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        near = near.withColumn("__last", F.max(F.when(F.col("rank") == want, F.col("dist"))).over(Window.partitionBy("__pid")))
        out.append(materialize(near.where(F.col("__last") <= size).select("__pid", "__sid", "dist", "rank"), "near"))
        todo = materialize(todo.join(out[-1].select("__pid").distinct(), "__pid", "left_anti"), "far")
        if last is not None:
            release(last)
        last = todo
        left = todo.agg(F.min("__first")).first()[0]
        if left is None:
            break
        step = max(step + 1, left)
    else:
        raise RuntimeError("points lie too far from the source for this cell")
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.select(F.col("__pid").alias(pid), F.col("__sid").alias(sid), "dist", "rank")


def knn_aggregate(near: DataFrame, source: DataFrame, pid: str, sid: str, numeric: list[str], categorical: list[str], idw: bool = True, tag: str = "knn") -> DataFrame:
    """Per point: weighted means (weights renormalised over valid neighbours), modes (ties: nearest, then value), quality columns."""
    joined = near.join(source.select(sid, *numeric, *categorical), sid)
    w = 1 / (F.col("dist") + 1e-6) if idw else F.lit(1.0)
    aggs = [(F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in numeric]
    first = numeric[0] if numeric else None
    aggs += [F.avg("dist").alias(f"{tag}_mean_dist"), F.count("*").alias(f"{tag}_neighbors")]
    if first:
        aggs.append(F.count(first).alias(f"{tag}_valid_neighbors"))
    out = joined.groupBy(pid).agg(*aggs)
    for c in categorical:
        votes = joined.where(F.col(c).isNotNull()).groupBy(pid, c).agg(F.count("*").alias("n"), F.min("dist").alias("d"))
        top = votes.groupBy(pid).agg(F.min(F.struct((-F.col("n")).alias("n"), "d", F.col(c).alias("v"))).alias("m")).select(pid, F.col("m.v").alias(c))
        out = out.join(top, pid, "left")
    return out


def within_km(points: DataFrame, source: DataFrame, pid: str, sid: str, km: float, metric, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Pairs (pid, sid, km) at most km apart on the sphere, poles and the date line included; `metric` is a great-circle distance.

    Bands of latitude are km wide; each is cut into cells about km wide at its end nearest the pole. A point looks into three
    bands, and in each into the cells that its greatest difference of longitude there can reach, around the globe.
    """
    band = km / 111.0 * 1.01
    radians = lambda x: x * (math.pi / 180)

    def narrow(i):  # cosine of the end of band i that is nearest to a pole
        return F.greatest(F.lit(0.0), F.cos(radians(F.least(F.lit(90.0), F.greatest(F.abs(i * band), F.abs((i + 1) * band))))))

    cells = lambda i: F.greatest(F.lit(1.0), F.floor(360.0 / band * narrow(i)))
    src = source.select(F.col(sid).alias("__sid"), F.col(lat).cast("double").alias("__a"), F.col(lon).cast("double").alias("__o")).where("__a is not null and __o is not null")
    pts = points.select(F.col(pid).alias("__pid"), F.col(lat).cast("double").alias("__pa"), F.col(lon).cast("double").alias("__po")).where("__pa is not null and __po is not null")
    src = src.withColumn("__i", F.floor(F.col("__a") / band))
    src = src.withColumn("__j", F.least(F.floor(F.pmod(F.col("__o") + 180.0, F.lit(360.0)) / (360.0 / cells(F.col("__i")))), cells(F.col("__i")) - 1).cast("long"))
    pts = pts.withColumn("__i", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("__pa") / band) + d)))
    half = min(1.0, math.sin(min(math.pi / 2, km / (2 * 6371.0) * 1.001)))
    # sin(dlon / 2) is at most sin(d / 2R) over the root of the product of cosines
    ratio = half / F.sqrt(F.greatest(F.lit(1e-300), F.cos(radians(F.col("__pa"))) * narrow(F.col("__i"))))
    reach = F.when(ratio >= 1, 180.0).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio))) * 1.0001)
    n, x = cells(F.col("__i")), F.pmod(F.col("__po") + 180.0, F.lit(360.0))
    first = F.floor((x - reach) / (360.0 / n))
    pts = pts.withColumn("__first", first).withColumn("__end", F.least(F.floor((x + reach) / (360.0 / n)), first + n - 1)).withColumn("__n", n)
    pts = pts.withColumn("__j", F.explode(F.sequence(F.col("__first").cast("long"), F.col("__end").cast("long")))).withColumn("__j", F.pmod("__j", F.col("__n").cast("long")))
    d = metric(F.col("__pa"), F.col("__po"), F.col("__a"), F.col("__o"))
    return pts.join(src, ["__i", "__j"]).withColumn("km", d).where(F.col("km") <= km).select(F.col("__pid").alias(pid), F.col("__sid").alias(sid), "km")


def farther_than(points: DataFrame, source: DataFrame, pid: str, sid: str, km: float, metric) -> DataFrame:
    """Points with no source row nearer than km: a theta anti-join as an equi-join on cells."""
    return points.join(within_km(points, source, pid, sid, km, metric).where(F.col("km") < km).select(pid).distinct(), pid, "left_anti")


def exact_left_join(base: DataFrame, source: DataFrame, keys: list[str], order: list, tag: str) -> DataFrame:
    """Left join on a key, source de-duplicated (first by order); columns get a suffix; `matched` says whether a row was found."""
    w = Window.partitionBy(*keys).orderBy(*order)
    one = source.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    one = one.select(*keys, *(F.col(c).alias(f"{c}_{tag}") for c in one.columns if c not in keys), F.lit(True).alias("__hit"))
    return base.join(one, keys, "left").withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__hit")


def fill_missing_from(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only NULL cells of base are taken from other."""
    o = other.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = base.join(o, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")) if c in base.columns else F.col(f"__{c}"))
    return out.drop(*(f"__{c}" for c in columns))


def grid_index(x: Column, origin: float, step: float, size: int, nearest: bool = True) -> Column:
    """Index on a regular axis, clipped to the grid: the nearest centre, or the cell that an affine transform gives."""
    at = (x - origin) / step
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), (F.round(at) if nearest else F.floor(at)).cast("int")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, pid: str, gid: str, ring: str = "ring", lat: str = "latitude", lon: str = "longitude", cell: float = 2.0) -> DataFrame:
    """(pid, gid) of points inside polygons: bounding-box cells make candidates, an even-odd ray cast decides.

    `ring` is an array of (x, y) structs, closed. Holes are further rings in the same array of edges by even-odd rule.
    """
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    g = polygons.select(F.col(gid), F.col(ring).alias("__r"), F.array_min(xs).alias("__x0"), F.array_max(xs).alias("__x1"), F.array_min(ys).alias("__y0"), F.array_max(ys).alias("__y1"))
    g = g.withColumn("__i", F.explode(F.sequence(F.floor(F.col("__y0") / cell), F.floor(F.col("__y1") / cell))))
    g = g.withColumn("__j", F.explode(F.sequence(F.floor(F.col("__x0") / cell), F.floor(F.col("__x1") / cell))))
    p = _cells(points.select(F.col(pid), F.col(lat).alias("__lat"), F.col(lon).alias("__lon")), "__lat", "__lon", cell)
    near = p.join(g, ["__i", "__j"]).where("__lon between __x0 and __x1 and __lat between __y0 and __y1")
    crossings = F.expr("""
        aggregate(sequence(1, size(__r) - 1), 0, (n, k) -> n + if(
          (__r[k].y > __lat) <> (__r[k - 1].y > __lat)
          and __lon < (__r[k].x - __r[k - 1].x) * (__lat - __r[k - 1].y) / (__r[k].y - __r[k - 1].y) + __r[k - 1].x, 1, 0))""")
    return near.where(crossings % 2 == 1).select(pid, gid)


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def shoelace(ring: str) -> Column:
    """Area of a closed ring in squared units."""
    return F.abs(F.expr(f"aggregate(sequence(1, size({ring}) - 1), cast(0 as double), (s, k) -> s + {ring}[k - 1].x * {ring}[k].y - {ring}[k].x * {ring}[k - 1].y)")) / 2


def perimeter(ring: str) -> Column:
    return F.expr(f"aggregate(sequence(1, size({ring}) - 1), cast(0 as double), (s, k) -> s + sqrt(pow({ring}[k].x - {ring}[k - 1].x, 2) + pow({ring}[k].y - {ring}[k - 1].y, 2)))")


def vertex_mean(ring: str) -> Column:
    """Struct (x, y): the mean of a ring's points, NULL without any."""
    mean = lambda c: F.expr(f"aggregate({ring}, cast(0 as double), (s, p) -> s + p.{c}) / nullif(size({ring}), 0)")
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def valid_ring(ring: str) -> Column:
    return F.expr(f"size({ring}) >= 4 and {ring}[0].x = {ring}[size({ring}) - 1].x and {ring}[0].y = {ring}[size({ring}) - 1].y") & (shoelace(ring) > 0)


def zonal_statistics(polygons: DataFrame, by: str, ring: str = "ring") -> DataFrame:
    """(by, n, area, mean, lo, hi, std, perimeter, compactness): areas and perimeters of valid rings by class; compactness is the
    mean of 4 pi area / perimeter^2."""
    area, p = shoelace(ring), perimeter(ring)
    z = polygons.where(valid_ring(ring)).select(by, area.alias("__a"), p.alias("__p"))
    return z.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("__a").alias("area"), F.avg("__a").alias("mean"), F.min("__a").alias("lo"), F.max("__a").alias("hi"), F.stddev_samp("__a").alias("std"),
        F.sum("__p").alias("perimeter"), F.avg(4 * math.pi * F.col("__a") / (F.col("__p") * F.col("__p"))).alias("compactness"))
