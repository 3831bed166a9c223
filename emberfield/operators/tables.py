"""Projections, filters, de-duplication, aggregation and set operations on point tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import exact_percentiles

# Parts of column names that mark derived columns.
DERIVED_TOKENS = ("max", "min", "std", "p10", "p90", "mean", "range", "total", "index", "dist", "knn", "_r", "key", "class")


def resolve(df: DataFrame, *candidates: str) -> str | None:
    """The column that matches the first of some names, whatever the case."""
    have = {c.strip().lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def keep_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns in the keep-list, any case, in their own order, once."""
    want, seen = {c.lower() for c in keep}, set()
    return df.select(*(c for c in df.columns if c.lower() in want and not (c.lower() in seen or seen.add(c.lower()))))


def drop_by_token(df: DataFrame, protected: list[str], tokens: tuple[str, ...] = DERIVED_TOKENS) -> DataFrame:
    safe = {c.lower() for c in protected}
    return df.drop(*(c for c in df.columns if c.lower() not in safe and any(t in c.lower() for t in tokens)))


def drop_uninformative(df: DataFrame, always: list[str], constant: list[str]) -> DataFrame:
    """Drops some columns, and others that hold at most one value: one aggregation."""
    some = [c for c in constant if c in df.columns]
    if some:
        n = df.agg(*(F.count_distinct(c).alias(c) for c in some)).first()
        always = [*always, *(c for c in some if n[c] <= 1)]
    return df.drop(*always)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key, the first by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def relax_if_empty(df: DataFrame, kept: Column) -> DataFrame:
    """Rows where `kept`; if there is none, all rows, with filter_relaxed = 1."""
    part = df.where(kept)
    return df.withColumn("filter_relaxed", F.lit(1)) if part.isEmpty() else part.withColumn("filter_relaxed", F.lit(0))


def lower_whisker(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    q1, q3 = exact_percentiles(df, [column], [0.25, 0.75])[column]
    return df if q1 is None else df.where(F.col(column) >= q1 - factor * (q3 - q1))


def grid_snap(df: DataFrame, lat: str, lon: str, step: float, order: str) -> DataFrame:
    """First row of each cell of a grid."""
    out = df.withColumn("__i", F.round(F.col(lat) / step).cast("long")).withColumn("__j", F.round(F.col(lon) / step).cast("long"))
    return keep_first(out, ["__i", "__j"], [order]).drop("__i", "__j")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with sums {new column: summed column} that run over each `by` group in a total order. Rows are dealt by ranges of
    (by, order), so no group, however large, is in one task; only the ranges' sums meet in one."""
    keys = [*map(F.col, by), *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__range", F.shiftrightunsigned(F.monotonically_increasing_id(), 33).cast("int"))
    placed = materialize(placed, "ranges")
    total = placed.groupBy("__range", *by).agg(*(F.sum(x).alias(f"__sum_{c}") for c, x in sums.items()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select(F.col("__range").alias("__at"), *(F.col(b).alias(f"__by{i}") for i, b in enumerate(by)), *(F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__sum_{c}") for c in sums))
    inside = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({c: F.sum(x).over(inside) for c, x in sums.items()})
    same = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)), F.col("__range") == F.col("__at"))
    return out.join(start, same).select(*df.columns, *((F.col(c) + F.col(f"__sum_{c}")).alias(c) for c in sums))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with a row's number (from 1) in its group, by ranges like `running`."""
    return running(df.withColumn("__one", F.lit(1)), by, order, {name: "__one"}).drop("__one")


def by_hash(key: str, seed: int = 0) -> list[Column]:
    """The order of a hash of the key, and the key."""
    return [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def cdf_ranks(df: DataFrame, column: str, order: list[Column], name: str = "p") -> DataFrame:
    """Non-null rows with their place (rank - 0.5) / n among all values."""
    some = df.where(F.col(column).isNotNull())
    n = some.agg(F.count("*").alias("__n"))
    return ranked(some, [], [F.col(column), *order], "__rank").crossJoin(F.broadcast(n)).withColumn(name, (F.col("__rank") - 0.5) / F.col("__n")).drop("__rank", "__n")


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """About n rows, from each class its share, at least one. Null is a class."""
    sizes = df.groupBy(F.col(by).alias("__k")).agg(F.count("*").alias("__c"))
    total = df.agg(F.count("*").alias("__t"))
    take = sizes.crossJoin(F.broadcast(total)).select("__k", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("__c") / F.col("__t"))).alias("__take"))
    out = ranked(df, [by], by_hash(key, seed), "__rn")
    return out.join(take, F.col(by).eqNullSafe(F.col("__k"))).where("__rn <= __take").select(*df.columns)


def undersample(df: DataFrame, by: str, key: str, seed: int = 0) -> DataFrame:
    """Every class cut to the size of the smallest."""
    least = df.groupBy(by).agg(F.count("*").alias("c")).agg(F.min("c").alias("__m"))
    return ranked(df, [by], by_hash(key, seed), "__rn").crossJoin(F.broadcast(least)).where("__rn <= __m").select(*df.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_common(*frames: DataFrame) -> DataFrame:
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, (f.select(*common) for f in frames))


def fill_along(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Forward, then backward fill."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(back, ahead))


def fill_nearest(df: DataFrame, keys: list[str], order: str, column: str, limit: int) -> DataFrame:
    """Nearest value along an integer axis, at most `limit` steps off; the earlier on ties."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("p"), F.col(column).alias("v")))
    a = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumn("__a", a).withColumn("__b", b)
    da, db = F.col(order) - F.col("__a.p"), F.col("__b.p") - F.col(order)
    near = F.when((da <= limit) & (db.isNull() | (da <= db)), F.col("__a.v")).when(db <= limit, F.col("__b.v"))
    return out.withColumn(column, F.coalesce(F.col(column), near)).drop("__a", "__b")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, std (sample), min, quartiles, max."""
    q = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                      F.array(*(F.lit(v).cast("double") for v in q[c])).alias("q"), F.max(c).cast("double").alias("max")) for c in columns]
    out = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return out.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"), F.count("*").alias("rows")) for c in columns]
    out = df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return out.withColumn("pct", 100 * F.col("missing") / F.col("rows"))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum; the last is closed."""
    lim = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.least(F.floor((F.col(column) - F.col("__lo")) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(lim)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of a x b with margins: total column and 'All' row."""
    counts = df.groupBy(a).pivot(b, values).count().na.fill(0)
    cols = [str(v) for v in values]
    rows = counts.select(F.col(a).cast("string").alias(a), *(F.col(c).cast("long").alias(c) for c in cols))
    rows = rows.unionByName(rows.agg(F.lit("All").alias(a), *(F.sum(c).alias(c) for c in cols)))
    return rows.withColumn("All", reduce(lambda x, y: x + y, (F.col(c) for c in cols)))
