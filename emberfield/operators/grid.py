"""Focal, terrain and resampling operators on grids held as long tables (r, c, value).

A neighbourhood is an explode of each cell onto the cells that it is a neighbour of, then one partial aggregation: an
equi-shuffle on the cell, linear in the grid, without a join of the grid with itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def neighbours(grid: DataFrame, value: str, half: int = 1, center: bool = True) -> DataFrame:
    """Rows (r, c, v): v of every cell around (r, c) that is on the grid; edges are truncated."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    out = grid.select("r", "c", F.col(value).alias("v")).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    if not center:
        out = out.where("not (dr = 0 and dc = 0)")
    return out.select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "v", "dr", "dc")


def focal(grid: DataFrame, value: str, agg: Column, name: str, half: int = 1, center: bool = True, least: int = 1) -> DataFrame:
    """grid with `agg` over v of the neighbourhood, NULL below `least` values."""
    around = neighbours(grid, value, half, center).groupBy("r", "c").agg(F.when(F.count("v") >= least, agg).alias(name))
    return grid.join(around, ["r", "c"], "left")


def ruggedness(grid: DataFrame, value: str) -> DataFrame:
    return focal(grid, value, F.stddev_pop("v"), "ruggedness", least=3)


def impute_neighbours(grid: DataFrame, value: str) -> DataFrame:
    """NULL cells take the mean of their valid neighbours in the given grid (no chain of fills)."""
    out = focal(grid, value, F.avg("v"), "__m", center=False)
    return out.withColumn(value, F.coalesce(value, "__m")).drop("__m")


def median_filter(grid: DataFrame, value: str, half: int = 1) -> DataFrame:
    """Median of the window; NULL cells stay."""
    out = focal(grid, value, F.percentile("v", 0.5), "__m", half)
    return out.withColumn(value, F.when(F.col(value).isNotNull(), F.col("__m"))).drop("__m")


def position_index(grid: DataFrame, value: str, rows: int, cols: int, width: int = 3) -> DataFrame:
    """(r, c, value, tpi), a row a cell: value minus the mean of a width x width window; the edges of the raster, rows x cols cells
    from (0, 0), are replicated. Cells whose window holds no cell of the table have no row.

    A cell of the raster sends its value, with the times that it is replicated, to the windows that it lies in: no join. Cells
    farther out than the window reaches look at what the ring around the raster looks at; the ring is written, so that Spark
    joins it by its size: an estimate doesn't count what an explode makes, and would broadcast it."""
    half = width // 2
    steps = F.sequence(F.lit(-half), F.lit(half))
    times = lambda x, d, last: 1 + F.when(F.col(x) == 0, half - F.col(d)).otherwise(0) + F.when(F.col(x) == last, half + F.col(d)).otherwise(0)
    src = grid.select("r", "c", F.col(value).cast("double").alias("__v")).where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    sent = src.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).select(
        (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "__v", (times("r", "dr", rows - 1) * times("c", "dc", cols - 1)).cast("double").alias("__w"))
    # the mean is NULL where no value is valid; n is NULL where there is no cell at all
    mean, n = F.sum(F.col("__w") * F.col("__v")) / F.sum(F.when(F.col("__v").isNotNull(), F.col("__w"))), F.sum("__w")
    ring = sent.where(F.col("r").isin(-half, rows - 1 + half) | F.col("c").isin(-half, cols - 1 + half))
    ring = materialize(ring.groupBy(F.col("r").alias("er"), F.col("c").alias("ec")).agg(mean.alias("__em"), n.alias("__en")), "ring")
    own = grid.select("r", "c", F.col(value), F.lit(True).alias("__own"))
    cells = own.unionByName(sent, allowMissingColumns=True).groupBy("r", "c").agg(F.max(value).alias(value), F.max("__own").alias("__own"), mean.alias("__m"), n.alias("__n"))
    place = lambda x, last: F.greatest(F.lit(-half), F.least(F.lit(last + half), F.col(x)))
    out = cells.where("__own").withColumn("er", place("r", rows - 1)).withColumn("ec", place("c", cols - 1)).join(ring, ["er", "ec"], "left")
    return out.where("__n is not null or __en is not null").select("r", "c", value, (F.col(value) - F.coalesce("__m", "__em")).alias("tpi"))


def gradients(grid: DataFrame, value: str, step: float = 1.0) -> DataFrame:
    """gx along columns and gy along rows: central differences, one-sided at edges."""

    def along(keys: str, order: str) -> Column:
        w = Window.partitionBy(keys).orderBy(order)
        before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        first, last = F.row_number().over(w) == 1, F.lead(order).over(w).isNull()
        return F.when(first, (after - v) / step).when(last, (v - before) / step).otherwise((after - before) / (2 * step))

    return grid.withColumn("gx", along("r", "c")).withColumn("gy", along("c", "r"))


def slope_aspect(grid: DataFrame, value: str, step: float = 1.0, variant: str = "a") -> DataFrame:
    """Slope in degrees; aspect by variant a (0 to 360) or b (90 - angle, or 450 - angle)."""
    out = gradients(grid, value, step)
    slope = F.degrees(F.atan(F.sqrt(F.pow("gx", 2) + F.pow("gy", 2))))
    raw = F.degrees(F.atan2(F.col("gy"), -F.col("gx")))
    aspect = F.pmod(raw + 360, F.lit(360.0)) if variant == "a" else F.when(raw < 0, 90 - raw).otherwise(450 - raw)
    return out.withColumn("slope", slope).withColumn("aspect", aspect)


def hillshade(slope: Column, aspect: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """sin(alt) sin(slope) + cos(alt) cos(slope) cos(azimuth - aspect), clipped to [0, 1]; angles in degrees."""
    alt, az = math.radians(altitude), math.radians(azimuth)
    v = math.sin(alt) * F.sin(F.radians(slope)) + math.cos(alt) * F.cos(F.radians(slope)) * F.cos(az - F.radians(aspect))
    return F.when(v < 0, 0.0).when(v > 1, 1.0).otherwise(v)


def resample(grid: DataFrame, value: str, factor: float, rows: int, cols: int, bilinear: bool = True) -> DataFrame:
    """A grid of `factor` times as many cells an axis, by the four nearest cells or the nearest. rows and cols make the target's
    size; bilinear values go on to the last row and column of the table, which may lie beyond, and are constant from there."""
    n, m = int(rows * factor), int(cols * factor)
    spark = grid.sparkSession
    at = spark.range(n * m).select(F.floor(F.col("id") / m).cast("int").alias("tr"), (F.col("id") % m).cast("int").alias("tc"))
    y, x = (F.col("tr") + 0.5) / factor - 0.5, (F.col("tc") + 0.5) / factor - 0.5
    clamp = lambda v, last: F.greatest(F.lit(0.0), F.least(last, v))
    src = grid.select("r", "c", F.col(value).alias("v"))
    if not bilinear:
        y, x = clamp(y, F.lit(float(rows - 1))), clamp(x, F.lit(float(cols - 1)))
        near = at.withColumn("r", F.floor(y + 0.5).cast("int")).withColumn("c", F.floor(x + 0.5).cast("int"))
        return near.join(src, ["r", "c"], "left").select(F.col("tr").alias("r"), F.col("tc").alias("c"), F.col("v").alias(value))
    edge = grid.agg(F.max("r").cast("double").alias("r1"), F.max("c").cast("double").alias("c1"))
    at = at.crossJoin(F.broadcast(edge)).withColumn("y", clamp(y, F.col("r1"))).withColumn("x", clamp(x, F.col("c1")))
    at = at.withColumn("dr", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dc", F.explode(F.array(F.lit(0), F.lit(1))))
    at = at.withColumn("r", (F.floor("y") + F.col("dr")).cast("int")).withColumn("c", (F.floor("x") + F.col("dc")).cast("int"))
    w = (1 - F.abs(F.col("y") - F.col("r"))) * (1 - F.abs(F.col("x") - F.col("c")))
    joined = at.withColumn("w", w).where("w > 0").join(src, ["r", "c"])
    # at most four terms, summed by row and column: the last digit doesn't depend on the partitioning
    terms = F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("r", "c", "w", "v"))))
    total = lambda term: F.aggregate("terms", F.lit(0.0), lambda s, t: s + term(t))
    mean = total(lambda t: t["w"] * t["v"]) / F.nullif(total(lambda t: t["w"]), F.lit(0.0))
    return joined.groupBy("tr", "tc").agg(terms.alias("terms")).select(F.col("tr").alias("r"), F.col("tc").alias("c"), mean.alias(value))


def profile(grid: DataFrame, value: str, axis: str) -> DataFrame:
    """(axis, n, mean): of each row ("r") or column ("c") of the grid."""
    return grid.groupBy(axis).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def quadrants(grid: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """(quadrant, n, mean) of NW, NE, SW, SE; row 0 is the northernmost."""
    name = F.concat(F.when(F.col("r") < rows // 2, "N").otherwise("S"), F.when(F.col("c") < cols // 2, "W").otherwise("E"))
    return grid.groupBy(name.alias("quadrant")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def edge_gradients(grid: DataFrame, value: str, band: int) -> DataFrame:
    """One row: mean of the last `band` rows minus that of the first, and the same of columns; edges are those of the table."""
    edge = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    out = grid.crossJoin(F.broadcast(edge))
    mean = lambda cond: F.avg(F.when(F.expr(cond), F.col(value)))
    return out.agg((mean(f"r > r1 - {band}") - mean(f"r < r0 + {band}")).alias("rows_gradient"), (mean(f"c > c1 - {band}") - mean(f"c < c0 + {band}")).alias("cols_gradient"))
