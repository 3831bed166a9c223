"""Feature engineering, correlation, selection, encoding, scaling. Statistics of all columns are one aggregation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_percentiles


# Parts of column names that tell a feature's topic, in order of precedence.
TOPICS = {"climate": ("prec", "tmax", "tmin"), "topography": ("elev", "slope", "aspect", "rug", "terrain"), "soil": ("sand", "silt", "clay", "carbon", "ph_", "cec", "soil")}


def category(name: str) -> str:
    """The topic of a column by its name, else "other"."""
    return next((t for t, parts in TOPICS.items() if any(p in name.lower() for p in parts)), "other")


def _with(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds each column {name: (its inputs, SQL)} whose inputs are there, whatever their case."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({name: F.expr(sql) for name, (inputs, sql) in columns.items() if set(inputs.split()) <= have})


def climate_derived(df: DataFrame) -> DataFrame:
    """t_range, prec_mean (of the seasons, where it isn't there), prec_total (twelve means), dryness_index and dryness_season_ratio."""
    return _with(_seasonal_mean(df), {
        "t_range": ("tmax_mean tmin_mean", "tmax_mean - tmin_mean"),
        "prec_total": ("prec_mean", "12 * prec_mean"),
        "dryness_index": ("tmax_mean prec_mean", "tmax_mean / (prec_mean + 1)"),
        "dryness_season_ratio": ("tmax_jja tmax_djf prec_jja prec_djf", "(tmax_jja / (prec_jja + 1)) / (tmax_djf / (prec_djf + 1))"),
    })


def _seasonal_mean(df: DataFrame) -> DataFrame:
    """prec_mean as the mean of the seasons that are not null, where it lacks."""
    seasons = "array(prec_djf, prec_mam, prec_jja, prec_son)"
    known = f"filter({seasons}, x -> x is not null)"
    mean = f"aggregate({known}, cast(0 as double), (s, x) -> s + x) / nullif(size({known}), 0)"
    return df if "prec_mean" in df.columns else _with(df, {"prec_mean": ("prec_djf prec_mam prec_jja prec_son", mean)})


def climate_features(df: DataFrame) -> DataFrame:
    """Nine features of a cell's climate, each where its inputs are there."""
    return _with(df, {
        "annual_temp_range": ("tmax_max tmin_min", "tmax_max - tmin_min"),
        "avg_tmax": ("tmax_mean", "tmax_mean"),
        "avg_tmin": ("tmin_mean", "tmin_mean"),
        "diurnal_temp_range": ("tmax_mean tmin_mean", "tmax_mean - tmin_mean"),
        "total_annual_precip": ("prec_total", "prec_total"),
        "precip_variability": ("prec_std", "prec_std"),
        "dry_season_intensity": ("prec_p10", "prec_p10"),
        "heat_dryness_index": ("tmax_mean prec_p10 prec_total", "tmax_mean * (1 - prec_p10 / (prec_total + 1e-6))"),
        "drought_index": ("tmax_mean prec_total", "tmax_mean / (prec_total + 1e-6)"),
    })


def _with_top(df: DataFrame, column: str) -> DataFrame:
    """Adds __top, the greatest value of a column, if it is there."""
    if column not in {c.lower() for c in df.columns}:
        return df
    return df.crossJoin(F.broadcast(df.agg(F.max(column).alias("__top"))))


def topography_features(df: DataFrame) -> DataFrame:
    """Four features of terrain, each where its inputs are there."""
    complexity = ("ruggedness relative_elev", "ruggedness * relative_elev") if "relative_elev" in df.columns else ("ruggedness", "pow(ruggedness, 1.5)")
    return _with(_with_top(df, "ruggedness"), {
        "terrain_complexity": complexity,
        "elevation_terrain_interaction": ("elevation ruggedness", "elevation * (ruggedness / (__top + 1e-6))"),
        "relative_elevation_effect": ("relative_elev", "relative_elev * relative_elev"),
        "terrain_roughness_index": ("ruggedness", "1 / (1 + ruggedness)"),
    }).drop("__top")


def soil_features(df: DataFrame) -> DataFrame:
    """Six features of soil, each where its inputs are there."""
    return _with(_with_top(df, "org_carbon"), {
        "sand_clay_ratio": ("sand clay", "sand / (clay + 1e-6)"),
        "fine_fraction": ("silt clay", "silt + clay"),
        "organic_matter_content": ("org_carbon", "org_carbon"),
        "moisture_retention": ("clay org_carbon", "clay * (org_carbon / (__top + 1e-6))"),
        "soil_acidity": ("ph_water", "abs(7 - ph_water)"),
        "nutrient_richness": ("cec_soil", "cec_soil"),
    }).drop("__top")


def soil_ratios(df: DataFrame) -> DataFrame:
    """Seven ratios of a soil layer, each where its inputs are there; NULL where a divisor is 0."""
    return _with(df, {
        "fine_fraction": ("coarse", "100 - coarse"),
        "clay_to_silt_ratio": ("clay silt", "clay / nullif(silt + 1, 0)"),
        "sand_to_clay_ratio": ("sand clay", "sand / nullif(clay + 1, 0)"),
        "organic_bulk_density": ("org_carbon bulk", "org_carbon / 100 * bulk"),
        "base_saturation_ratio": ("bsat cec_soil", "bsat / nullif(cec_soil + 1, 0)"),
        "cec_eff_ratio": ("cec_eff cec_soil", "cec_eff / nullif(cec_soil + 1, 0)"),
        "nutrient_index": ("total_n org_carbon bulk", "(total_n + org_carbon / 100) / nullif(bulk + 1, 0)"),
    })


def relative_elevation(df: DataFrame, z: str, slope: str | None = None) -> DataFrame:
    """Adds relative_elev (above the median), elevation_z (population deviation; 1 where there is none) and slope_rad."""
    med = exact_percentiles(df, [z], [0.5])[z][0]
    s = df.agg(F.avg(z).alias("__m"), F.stddev_pop(z).alias("__s"))
    out = df.crossJoin(F.broadcast(s)).withColumn("relative_elev", F.col(z) - F.lit(med).cast("double"))
    out = out.withColumn("elevation_z", (F.col(z) - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))).drop("__m", "__s")
    return out.withColumn("slope_rad", F.radians(slope)) if slope else out


def composite_scores(scores: DataFrame, feature: str, methods: list[str], top: int = 20) -> DataFrame:
    """(feature, composite, rank): the mean of the methods' scores, each scaled from its least (0) to its greatest (1; all 0 where
    none is positive), for the `top` best; a row a feature. Ties: by name."""
    s = scores.agg(*(F.struct(F.min(m).alias("a"), F.max(m).alias("b")).alias(f"__{m}") for m in methods))
    out = scores.crossJoin(F.broadcast(s))
    scaled = [F.when(F.col(f"__{m}.b") > 0, F.coalesce((F.col(m) - F.col(f"__{m}.a")) / F.nullif(F.col(f"__{m}.b") - F.col(f"__{m}.a"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0) for m in methods]
    best = out.select(feature, (sum(scaled[1:], scaled[0]) / len(methods)).alias("composite")).orderBy(F.desc("composite"), feature).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), feature)))  # `top` rows


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standard scores with the population deviation; a constant column becomes x - mean."""
    s = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(s))
    for c in columns:
        sd = F.col(f"__{c}.s")
        out = out.withColumn(c, (F.col(c) - F.col(f"__{c}.m")) / F.when(sd == 0, 1.0).otherwise(sd))
    return out.drop(*(f"__{c}" for c in columns))


def one_hot(df: DataFrame, column: str, top: int | None = None, least: int = 1, drop_first: bool = False, most: int = 1000) -> DataFrame:
    """A 0/1 column for each level (the `top` most frequent with at least `least` rows). Without `top`, more than `most` levels
    are an error: so many columns are no encoding."""
    levels = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), column)
    names = [r[0] for r in levels.limit(top if top else most + 1).collect()]
    if not top and len(names) > most:
        raise ValueError(f"{column} has more than {most} levels")
    names = sorted(names)[int(drop_first):]
    return df.withColumns({f"{column}_{n}": F.coalesce((F.col(column) == n).cast("int"), F.lit(0)) for n in names})


def correlations(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """(a, b, r) of every pair, pairwise complete, in one aggregation."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= least, F.corr(a, b)).alias("r")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def correlated_to_drop(df: DataFrame, columns: list[str], limit: float = 0.95, protected: tuple[str, ...] = ()) -> list[str]:
    """Greedy: strongest pairs first, the alphabetically later of a pair goes unless protected; pairs with a dropped column are skipped."""
    rows = [(abs(r["r"]), r["a"], r["b"]) for r in correlations(df, columns).collect() if r["r"] is not None and abs(r["r"]) >= limit]
    gone: list[str] = []
    for _, a, b in sorted(rows, key=lambda x: (-round(x[0], 3), x[1], x[2])):
        if a in gone or b in gone:
            continue
        drop = max(a, b) if max(a, b) not in protected else min(a, b)
        if drop not in protected:
            gone.append(drop)
    return gone


def multicollinear_to_drop(df: DataFrame, columns: list[str], target: str, limit: float = 0.9) -> list[str]:
    """Of each pair above the limit, the one with the lower |correlation with the target|."""
    r = df.agg(*(F.abs(F.corr(c, target)).alias(c) for c in columns)).first()
    gone = {min((r[p["a"]] or 0, p["a"]), (r[p["b"]] or 0, p["b"]))[1] for p in correlations(df, columns).collect() if p["r"] is not None and abs(p["r"]) > limit}
    return sorted(gone)


def target_correlations(df: DataFrame, columns: list[str], target: str, top: int) -> DataFrame:
    out = df.agg(F.array(*(F.struct(F.lit(c).alias("feature"), F.abs(F.corr(c, target)).alias("r")) for c in columns)).alias("x"))
    return out.select(F.explode("x").alias("x")).select("x.*").orderBy(F.desc("r"), "feature").limit(top)


def anova_f(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(feature, f) of a one-way analysis of variance, from class sums."""
    per = df.groupBy(y).agg(F.count("*").alias("n"), *(F.struct(F.sum(c).alias("s"), F.sum(F.col(c) * F.col(c)).alias("q")).alias(c) for c in columns))
    total = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), *(F.struct(F.sum(F.col(f"{c}.s")).alias("s"), F.sum(F.col(f"{c}.q")).alias("q"), F.sum(F.pow(F.col(f"{c}.s"), 2) / F.col("n")).alias("b")).alias(c) for c in columns))

    def f(c: str) -> Column:
        between = F.col(f"{c}.b") - F.pow(F.col(f"{c}.s"), 2) / F.col("n")
        within = F.col(f"{c}.q") - F.col(f"{c}.b")
        return (between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k")))

    return total.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), f(c).alias("f")) for c in columns))).alias("x")).select("x.*")


def mutual_information(df: DataFrame, column: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of equal-width bins of a column with the label."""
    lim = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    at = F.least(F.floor((F.col(column) - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)), F.lit(bins - 1))
    joint = df.crossJoin(F.broadcast(lim)).groupBy(at.alias("b"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    a, b, t = joint.groupBy("b").agg(F.sum("n").alias("nb")), joint.groupBy("y").agg(F.sum("n").alias("ny")), joint.agg(F.sum("n").alias("t"))
    out = joint.join(a, "b").join(b, "y").crossJoin(F.broadcast(t))
    return out.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def variance_ranking(df: DataFrame, columns: list[str], top: int) -> DataFrame:
    out = df.agg(F.array(*(F.struct(F.lit(c).alias("feature"), F.var_samp(c).alias("variance")) for c in columns)).alias("x"))
    return out.select(F.explode("x").alias("x")).select("x.*").orderBy(F.desc("variance"), "feature").limit(top)
