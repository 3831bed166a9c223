"""Scalar column functions. Missing is NULL throughout; to_null() makes it so on read."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM = 6371.0, 111.0
# Sentinels that stand for missing data.
SENTINELS = (-9.0, -7.0, -1.0, -99.0, -999.0, -9999.0, -99999.0)
# Names of the leading digit of a land-cover code, and of detection types.
TYPE_NAMES = ("vegetation", "volcano", "static", "offshore")
# Texts that mean label 1 and label 0.
TRUE_WORDS = ("1", "true", "yes", "y", "fire", "t", "positive", "pos")
FALSE_WORDS = ("0", "false", "no", "n", "non-fire", "nofire", "f", "negative", "neg")


def to_null(x: Column, sentinels: tuple[float, ...] = ()) -> Column:
    """NaN, infinities and sentinels become NULL."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~(bad | x.isin(*sentinels) if sentinels else bad), x)


def coerce(x: Column) -> Column:
    return x.try_cast("double")


def timestamp_of(date: Column, hhmm: Column) -> Column:
    """Date and HHMM (leading zeros may lack); the date alone if the time can't be read; NULL without a date."""
    t = F.lpad(F.trim(hhmm.cast("string")), 4, "0")
    h, m = F.substring(t, 1, 2).try_cast("int"), F.substring(t, 3, 2).try_cast("int")
    good = F.coalesce(h.between(0, 23) & m.between(0, 59), F.lit(False))
    day = F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return day + F.make_dt_interval(mins=F.when(good, h * 60 + m).otherwise(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)) * DEGREE_KM


def destination(lat: Column, lon: Column, km: Column, angle: Column) -> tuple[Column, Column]:
    dlat = km * F.sin(angle) / DEGREE_KM
    return lat + dlat, lon + km * F.cos(angle) / (DEGREE_KM * F.greatest(F.lit(1e-6), F.cos(F.radians(lat))))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def coord_key(lat: Column, lon: Column, digits: int = 5) -> list[Column]:
    """Integer pair to join on."""
    return [F.round(lat * 10**digits).cast("long"), F.round(lon * 10**digits).cast("long")]


def coord_text(lat: Column, lon: Column, digits: int = 5) -> Column:
    return F.concat_ws("_", F.format_string(f"%.{digits}f", lat), F.format_string(f"%.{digits}f", lon))


def first_part(code: Column) -> Column:
    """First non-empty part of a composite code 'a // b'."""
    return F.filter(F.transform(F.split(code, r"\s*//\s*"), lambda x: F.trim(x)), lambda x: x != "")[0]


def digits_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit(""))


def class_code(grid: Column, label: Column) -> Column:
    """The grid's integer; else a stable hash of the label; else its digits."""
    return F.coalesce(grid.try_cast("int"), F.pmod(F.xxhash64(label), F.lit(100_000)).cast("int"), digits_of(label).try_cast("int"))


def label01(x: Column) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), 1).when(t.isin(*FALSE_WORDS), 0).when(t.try_cast("double") == 1, 1).when(t.try_cast("double") == 0, 0)


def clean_text(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin("none", "", "nan"), x)


def clip(x: Column, low: float | Column | None, high: float | Column | None) -> Column:
    """NULL stays NULL, unlike greatest and least."""
    out = x
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    return out if high is None else F.when(out > high, high).otherwise(out)


def log1p_nonnegative(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def bands(x: Column, cuts: list[float], names: list, right: bool = False) -> Column:
    """names[k] for the k-th interval between cuts; right: intervals closed on the right."""
    out = F.when(x.isNull(), F.lit(None))
    for c, n in zip(cuts, names, strict=False):
        out = out.when((x <= c) if right else (x < c), F.lit(n))
    return out.otherwise(F.lit(names[len(cuts)]))


def texture_class(clay: Column, sand: Column, silt: Column) -> Column:
    return (
        F.when(clay >= 40, "clay").when((sand >= 70) & (clay < 15), "sand").when((silt >= 50) & (clay < 27), "silt").when(clay >= 27, "clay loam").when(clay.isNotNull(), "loam")
    )


def normal_quantile(p: Column) -> Column:
    """sqrt(2) x (1 - x^2 / 3) at x = 2 p - 1."""
    x = 2 * p - 1
    return F.lit(math.sqrt(2)) * x * (1 - x * x / 3)


def hex_rgb(h: Column) -> Column:
    s = F.regexp_replace(h, "^#", "")
    return F.array(*(F.conv(F.substring(s, k, 2), 16, 10).cast("int") for k in (1, 3, 5)))


def snake_case(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def short_hash(x: Column, n: int = 8) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, n)


# Parts of file names, in order of precedence, with the feature and unit that they tell.
FEATURE_NAMES = (("tmin", "Minimum temperature", "C"), ("tmax", "Maximum temperature", "C"), ("prec", "Precipitation", "mm"), ("elev", "Elevation", "m"), ("clay", "Clay", "%"), ("sand", "Sand", "%"))


def feature_of(stem: Column) -> Column:
    """Struct (name, unit) of a file stem: suffixes and layer numbers go, the first known part decides, else title case."""
    clean = F.regexp_replace(F.lower(stem), r"(_clipped|_cleaned|_aligned)+$|_d[0-9]+(?=_|$)", "")
    out = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit("").alias("unit")))
    for part, name, unit in FEATURE_NAMES:
        out = out.when(clean.contains(part), F.struct(F.lit(name).alias("name"), F.lit(unit).alias("unit")))
    return out.otherwise(F.struct(F.initcap(F.regexp_replace(clean, "_", " ")).alias("name"), F.lit("").alias("unit")))
