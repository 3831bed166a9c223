"""Distance-constrained samples. Coordinates and order come from hashes of row numbers: the same whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_KM, coord_text, destination, haversine_km, uniform
from ..session import materialize, release
from . import layers, spatial, tables
from .quantiles import exact_percentiles


def target_size(positives: int, ratio: float, most: int | None = None) -> int:
    """Negatives for a share `ratio` of positives; at least one."""
    n = max(1, round(positives * (1 / ratio - 1)))
    return min(n, most) if most else n


def _box(fires: DataFrame) -> tuple[float, float, float, float]:
    r = fires.agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    if r[0] is None:
        raise ValueError("no positives: there is no box to sample from")
    return tuple(r)


def _inside(candidates: DataFrame, aoi: DataFrame | None) -> DataFrame:
    """The candidates inside one of the polygons (zone, ring), or all where there are none given."""
    if aoi is None:
        return candidates
    return candidates.join(spatial.points_in_polygons(candidates, aoi, "nid", "zone").select("nid").distinct(), "nid", "left_semi")


def _candidates(spark: SparkSession, box, start: int, n: int, seed: int) -> DataFrame:
    a, b, c, d = box
    i = F.col("nid")
    return spark.range(start, start + n).select(F.col("id").alias("nid")).select("nid", (a + (b - a) * uniform(seed, i, F.lit("lat"))).alias("latitude"), (c + (d - c) * uniform(seed, i, F.lit("lon"))).alias("longitude"))


def random_in_box(fires: DataFrame, n: int, min_km: float, seed: int = 0, batches: int = 6, aoi: DataFrame | None = None) -> DataFrame:
    """n points of the positives' box (inside polygons of `aoi`, if given) that no positive is nearer than min_km; batches grow
    until there are enough."""
    box, size, out = _box(fires), 4 * n, None
    for k in range(batches):
        good = materialize(spatial.farther_than(_inside(_candidates(fires.sparkSession, box, 0, size << k, seed), aoi), fires, "nid", "id", min_km, haversine_km), "candidates")
        if good.count() >= n or k == batches - 1:
            out = good.orderBy("nid").limit(n)
            break
        release(good)
    return out


def even_grid(fires: DataFrame, n: int, min_km: float, seed: int = 0, refinements: int = 8) -> DataFrame:
    """Up to n points of a regular grid over the box, row by row, far enough from positives; the grid is refined until there are
    n, and random points of the box fill what then still lacks."""
    a, b, c, d = _box(fires)
    side = max(math.sqrt((b - a) * (d - c) / n), 0.02)
    for k in range(refinements):
        h, w = int((b - a) / side) + 1, int((d - c) / side) + 1
        cells = fires.sparkSession.range(h * w).select(F.col("id").alias("nid"))
        cells = cells.select("nid", (a + F.floor(F.col("nid") / w) * side).alias("latitude"), (c + (F.col("nid") % w) * side).alias("longitude"))
        good = materialize(spatial.farther_than(cells, fires, "nid", "id", min_km, haversine_km), "grid")
        have = good.count()
        if have >= n or k == refinements - 1:
            break
        release(good)
        side /= 1.5
    if have < n:
        good = good.unionByName(random_in_box(fires, n - have, min_km, seed).withColumn("nid", F.col("nid") + (1 << 40)))
    return good.orderBy("nid").limit(n)


def from_candidates(candidates: DataFrame, fires: DataFrame, n: int | None, min_km: float, max_km: float | None = None, seed: int = 0) -> DataFrame:
    """Up to n (or all) of the candidates (nid, latitude, longitude) in hash order, inside a band of distances to positives."""
    good = spatial.farther_than(candidates, fires, "nid", "id", min_km, haversine_km)
    if max_km is not None:
        good = good.join(spatial.within_km(candidates, fires, "nid", "id", max_km, haversine_km).select("nid").distinct(), "nid", "left_semi")
    return good if n is None else good.orderBy(F.xxhash64(F.lit(seed), "nid"), "nid").limit(n)


def ring_sample(fires: DataFrame, each: int, low: float, high: float, seed: int = 0) -> DataFrame:
    """(id, k, latitude, longitude, km): `each` points around each positive, low to high km away from it."""
    i, k = F.col("id"), F.col("k")
    km = low + (high - low) * uniform(seed, i, k, F.lit("km"))
    lat, lon = destination(F.col("latitude"), F.col("longitude"), km, 2 * math.pi * uniform(seed, i, k, F.lit("angle")))
    out = fires.select("id", F.col("latitude").alias("a"), F.col("longitude").alias("o"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k"), "latitude", "longitude")
    out = out.select("id", "k", "a", "o", lat.alias("latitude"), lon.alias("longitude"))
    return out.select("id", "k", "latitude", "longitude", haversine_km(F.col("a"), F.col("o"), F.col("latitude"), F.col("longitude")).alias("km"))


def valid_ring_sample(fires: DataFrame, n: int, low: float, high: float, seed: int = 0, aoi: DataFrame | None = None, batches: int = 6) -> DataFrame:
    """(nid, latitude, longitude): up to n points `low` to `high` km around positives, inside the polygons of `aoi` if given, and no
    nearer than `low` to any positive; rings are drawn again until there are enough."""
    out, have = None, 0
    each = max(1, math.ceil(2 * n / max(1, fires.count())))
    for k in range(batches):
        ring = ring_sample(fires, each << k, low, high, seed + k).select(F.pmod(F.xxhash64("id", "k", F.lit(k)), F.lit(1 << 62)).alias("nid"), "latitude", "longitude")
        good = materialize(spatial.farther_than(_inside(ring, aoi), fires, "nid", "id", low, haversine_km), "rings")
        have += good.count()
        out = good if out is None else out.unionByName(good)
        if have >= n:
            break
    return out.orderBy("nid").limit(n)


def assemble(positives: DataFrame, negatives: DataFrame, seed: int = 0, digits: int = 5) -> tuple[DataFrame, DataFrame]:
    """The labelled table and its summary. Columns fire (1, 0), latlon_key (rounded coordinates; of rows that share one the
    positive stays, else the first by order), neutral metadata of negatives, and `position`, a shuffled order by a hash.
    Summary, one row: positives, negatives, duplicates that went, share of positives."""
    both = tables.union_all(positives.withColumn("fire", F.lit(1)), negatives.withColumn("fire", F.lit(0)))
    key = coord_text(F.col("latitude"), F.col("longitude"), digits)
    both = materialize(layers.fill_negative_metadata(both.withColumn("latlon_key", key)), "labelled")
    kept = tables.keep_first(both, ["latlon_key"], [F.desc("fire"), F.xxhash64(*both.columns)])
    out = kept.withColumn("position", F.xxhash64(F.lit(seed), "latlon_key"))
    n = both.agg(F.count("*").alias("__rows"))
    summary = out.agg(F.count_if(F.col("fire") == 1).alias("positives"), F.count_if(F.col("fire") == 0).alias("negatives")).crossJoin(F.broadcast(n))
    total = F.col("positives") + F.col("negatives")
    return out, summary.select("positives", "negatives", (F.col("__rows") - total).alias("duplicates"), (F.col("positives") / F.nullif(total, F.lit(0))).alias("share"))


def _tight_cells(df: DataFrame, km: float) -> DataFrame:
    """Adds (__i, __j), cells of the globe so small that any two places of one are less than km apart."""
    side = math.degrees(0.7 * 2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2)))
    i = F.floor(F.col("latitude") / side)
    wide = F.cos(F.radians(F.least(F.lit(90.0), F.abs(i * side), F.abs((i + 1) * side))))  # at the band's end that is nearest to the equator
    n = F.greatest(F.lit(1.0), F.ceil(360.0 / side * wide).cast("double"))
    return df.withColumn("__i", i).withColumn("__j", F.floor(F.pmod(F.col("longitude"), F.lit(360.0)) * n / 360.0))


def spread(candidates: DataFrame, min_km: float, seed: int = 0, rounds: int = 40) -> DataFrame:
    """A maximal subset whose members are min_km apart: each round keeps candidates that come first among their neighbours.

    Rows that share a cell are neighbours, so a round compares only the first of each cell with what is around it: there are as
    many of these as cells, and no table of pairs. Candidates without finite coordinates are near nothing and stay."""
    if min_km <= 0:
        return candidates
    node = F.struct(F.xxhash64(F.lit(seed), "nid").alias("rank"), "nid").alias("node")  # rows of one nid are one node
    rows = candidates.where("nid is not null").select(node, F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    placed = F.coalesce((F.abs("latitude") < float("inf")) & (F.abs("longitude") < float("inf")), F.lit(False))
    live = materialize(_tight_cells(rows.where(placed), min_km), "live")
    kept = materialize(rows.where(~placed).join(live.select("node"), "node", "left_anti").select("node"), "win")

    def near(some: DataFrame) -> DataFrame:
        return spatial.within_km(some, live.withColumnRenamed("node", "other"), "node", "other", min_km, haversine_km).where(F.col("km") < min_km)

    for _ in range(rounds):
        first = materialize(live.groupBy("__i", "__j").agg(F.min("node").alias("first")), "first")
        ranked = live.join(first, ["__i", "__j"])
        ahead = materialize(ranked.where("node = first").select("node", "latitude", "longitude"), "ahead")
        elsewhere = ranked.where("first < node").select("node").join(ahead.select("node"), "node", "left_semi")
        win = ahead.join(near(ahead).where("other < node").select("node").unionByName(elsewhere).distinct(), "node", "left_anti")
        win = materialize(win, "win")
        kept = kept.unionByName(win.select("node"))
        left = materialize(live.join(near(win).select(F.col("other").alias("node")).distinct(), "node", "left_anti"), "live")
        release(live, first, ahead)
        live = left
        if live.isEmpty():
            return candidates.join(kept.select("node.nid"), "nid", "left_semi")
    raise RuntimeError("the sample did not settle")


def polygon_centroids(polygons: DataFrame, fires: DataFrame, n: int, min_km: float, gid: str = "zone", ring: str = "ring") -> DataFrame:
    """(nid, latitude, longitude): centroids of polygons without positives, far enough from any; at most n, by id."""
    hit = spatial.points_in_polygons(fires, polygons, "id", gid, ring).select(gid).distinct()
    mean = lambda axis: F.expr(f"aggregate(slice({ring}, 1, size({ring}) - 1), cast(0 as double), (s, p) -> s + p.{axis}) / (size({ring}) - 1)")
    free = polygons.join(hit, gid, "left_anti").select(F.col(gid).cast("long").alias("nid"), mean("y").alias("latitude"), mean("x").alias("longitude"))
    return spatial.farther_than(free, fires, "nid", "id", min_km, haversine_km).orderBy("nid").limit(n)


def polygons_with_interior(polygons: DataFrame, fires: DataFrame, n: int, min_km: float, step: float = 0.05, gid: str = "zone", ring: str = "ring") -> DataFrame:
    """polygon_centroids, and where these are fewer than n, points of a grid inside the polygons, by number."""
    first = materialize(polygon_centroids(polygons, fires, n, min_km, gid, ring), "centroids")
    lack = n - first.count()
    if lack <= 0:
        return first
    more = polygon_grid(polygons, fires, min_km, step, gid, ring).orderBy("nid").limit(lack)
    return first.unionByName(more.withColumn("nid", F.col("nid") + (1 << 40)))


def polygon_grid(polygons: DataFrame, fires: DataFrame, min_km: float, step: float = 0.05, gid: str = "zone", ring: str = "ring") -> DataFrame:
    """(nid, latitude, longitude): points of a regular grid inside polygons, far enough from positives; nid names the grid point."""
    low = lambda axis: F.floor(F.array_min(F.transform(ring, lambda p: p[axis])) / step).cast("long")
    high = lambda axis: F.ceil(F.array_max(F.transform(ring, lambda p: p[axis])) / step).cast("long")
    at = polygons.select(F.explode(F.sequence(low("y"), high("y"))).alias("gy"), low("x").alias("x0"), high("x").alias("x1")).select("gy", F.explode(F.sequence("x0", "x1")).alias("gx")).distinct()
    at = at.select((F.col("gy") * 10_000_000 + F.col("gx")).alias("nid"), (F.col("gy") * step).alias("latitude"), (F.col("gx") * step).alias("longitude"))
    inside = spatial.points_in_polygons(at, polygons, "nid", gid, ring).select("nid").distinct()
    return spatial.farther_than(at.join(inside, "nid", "left_semi"), fires, "nid", "id", min_km, haversine_km)


def adaptive_band(fires: DataFrame, n: int, min_km: float, max_km: float, seed: int = 0, batch: int = 4000, batches: int = 8) -> tuple[DataFrame, float, float]:
    """Random candidates inside a band of distances; the band widens batch by batch while few are accepted (attempts, not
    the clock, decide). Returns the sample and the band that it ended with."""
    box, floor, low, high, out, have = _box(fires), 0.8 * min_km, min_km, max_km, None, 0
    for k in range(batches):
        good = materialize(from_candidates(_candidates(fires.sparkSession, box, k * batch, batch, seed), fires, None, low, high, seed), "band")
        got = good.count()
        out = good if out is None else out.unionByName(good)
        have += got
        if have >= n:
            break
        if got < 0.005 * batch and k >= batches // 4:
            low = max(floor, 0.9 * low)
        if got < 0.01 * batch and k >= batches // 3:
            high *= 1.4
    return out.orderBy("nid").limit(n), low, high


def distance_metrics(negatives: DataFrame, fires: DataFrame) -> DataFrame:
    """One row: min_km, median_km, mean_km of the distance to the nearest positive (planar degrees x 111)."""
    near = materialize(spatial.k_nearest(negatives, fires, "nid", "id", 1).select((F.col("dist") * 111).alias("km")), "distances")
    med = exact_percentiles(near, ["km"], [0.5])["km"][0]
    return near.agg(F.min("km").alias("min_km"), F.lit(med).cast("double").alias("median_km"), F.avg("km").alias("mean_km"))
