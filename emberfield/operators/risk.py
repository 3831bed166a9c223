"""Zone-level risk reports from scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bands
from .quantiles import exact_percentiles

# Limits of risk levels and of management classes.
RISK_CUTS, RISK_NAMES = [0.4, 0.7], ["Low", "Medium", "High"]
PLAN_CUTS, PLAN_NAMES = [0.35, 0.5, 0.65], ["Routine", "Watch", "Prevent", "Act"]


def risk_level(p: Column) -> Column:
    return bands(p, RISK_CUTS, RISK_NAMES)


def zone_profile(df: DataFrame, zone: str, proba: str, actual: str) -> DataFrame:
    level = risk_level(F.col(proba))
    share = lambda n: (100 * F.avg((level == n).cast("int"))).alias(f"pct_{n.lower()}")
    out = df.groupBy(zone).agg(
        F.count("*").alias("n"), F.avg(actual).alias("actual_rate"), F.avg((F.col(proba) >= 0.5).cast("int")).alias("predicted_rate"),
        F.avg(proba).alias("mean_risk"), F.stddev_samp(proba).alias("std_risk"), *map(share, RISK_NAMES))
    total = df.agg(F.count("*").alias("__t"))
    return out.crossJoin(F.broadcast(total)).withColumn("pct", 100 * F.col("n") / F.col("__t")).drop("__t")


def zone_drivers(df: DataFrame, zone: str, proba: str, features: list[str], importance: DataFrame, top: int = 5) -> DataFrame:
    """(zone, feature, mean, importance, rank) over rows of high risk."""
    long = df.where(F.col(proba) >= 0.7).select(zone, *features).unpivot([zone], features, "feature", "value")
    mean = long.groupBy(zone, "feature").agg(F.avg("value").alias("mean")).join(importance, "feature")
    w = Window.partitionBy(zone).orderBy(F.desc("importance"), "feature")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def high_low_medians(df: DataFrame, proba: str, features: list[str]) -> DataFrame:
    """(feature, high, low, direction): exact medians of rows of high and of low risk."""
    high = exact_percentiles(df.where(F.col(proba) >= RISK_CUTS[1]), features, [0.5])
    low = exact_percentiles(df.where(F.col(proba) < RISK_CUTS[0]), features, [0.5])
    out = df.sparkSession.createDataFrame([(c, high[c][0], low[c][0]) for c in features], "feature string, high double, low double")
    return out.withColumn("direction", F.when(F.col("high") > F.col("low"), "higher").when(F.col("high") < F.col("low"), "lower").otherwise("same"))


def band_drivers(df: DataFrame, proba: str, features: list[str], top: int = 5) -> DataFrame:
    """Features by std in the band over std of all; the high band leaves out probability 1."""
    long = df.where(F.col(proba) < 1.0).select(risk_level(F.col(proba)).alias("band"), *features).unpivot(["band"], features, "feature", "value")
    inside = long.groupBy("band", "feature").agg(F.stddev_samp("value").alias("s"))
    every = df.select(*features).unpivot([], features, "feature", "value").groupBy("feature").agg(F.stddev_samp("value").alias("a"))
    w = Window.partitionBy("band").orderBy(F.desc("score"), "feature")
    out = inside.join(F.broadcast(every), "feature").withColumn("score", F.col("s") / F.nullif(F.col("a"), F.lit(0.0)))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("band", "feature", "score", "rank")


def management_plan(profile: DataFrame, zone: str) -> DataFrame:
    """Zones ranked by mean risk (a row a zone), with a class and an alert threshold of 0.8 of the mean."""
    w = Window.orderBy(F.desc("mean_risk"), zone)
    return profile.select(zone, "n", "mean_risk").withColumn("rank", F.row_number().over(w)).withColumn("plan", bands(F.col("mean_risk"), PLAN_CUTS, PLAN_NAMES)).withColumn("alert", 0.8 * F.col("mean_risk"))


def summary_table(df: DataFrame, zone: str, proba: str, actual: str) -> DataFrame:
    """(metric, value): rows, zones, mean risk, shares of each level, false alarms (predicted, not actual) of all predicted in
    percent, and the largest and smallest zone (ties to the smaller)."""
    level, hit = risk_level(F.col(proba)), F.col(proba) >= 0.5
    share = lambda n: (100 * F.avg((level == n).cast("int"))).alias(f"pct_{n.lower()}")
    one = df.agg(
        F.count("*").cast("double").alias("rows"), F.avg(proba).alias("mean_risk"), *map(share, RISK_NAMES),
        (100 * F.count_if(hit & (F.col(actual) == 0)) / F.nullif(F.count_if(hit), F.lit(0))).alias("pct_false_alarms"))
    n = df.groupBy(zone).agg(F.count("*").alias("n"))
    ends = n.agg(F.count("*").cast("double").alias("zones"), F.max_by(zone, F.struct(F.col("n"), -F.col(zone))).cast("double").alias("largest"), F.min_by(zone, F.struct("n", zone)).cast("double").alias("smallest"))
    both = one.crossJoin(ends)
    return both.unpivot([], both.columns, "metric", "value")


def comparison(df: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """(metric, best, value, mean, std) over the rows of a table of one row a model; ties to the smaller model."""
    long = df.unpivot([model], metrics, "metric", "value")
    best = long.groupBy("metric").agg(F.max("value").alias("top"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return long.join(best, "metric").where(F.col("value") == F.col("top")).groupBy("metric").agg(F.min(model).alias("best"), F.first("value").alias("value"), F.first("mean").alias("mean"), F.first("std").alias("std"))
