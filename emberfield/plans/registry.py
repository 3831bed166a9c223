"""Where query modules put their queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Domain projections and stored tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in domain.PROJECTIONS:
            return domain.frame(self.spark, self.dir, name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None, *projections: str):
    """Registers f(tables) as a query; sql, with the projections that it uses, is its oracle."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = domain.with_projections(sql, *projections) if projections else sql.strip()
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounds doubles (all of them, or those named) so that results compare across engines; -0.0 becomes 0.0."""
    names = columns or [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})
