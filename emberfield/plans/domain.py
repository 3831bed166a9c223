"""The domain's tables as projections of the star schema, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source tables, SQL). A projection may use others by name.
PROJECTIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "fires": (("events",), """
SELECT event_id AS id, 20 + ((event_id * 7919) % 17000) / 1e3 AS latitude, -8 + ((event_id * 104729) % 20000) / 1e3 AS longitude,
  value AS frp, CAST(event_id % 5 AS INT) AS type, event_type, user_id, ts,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(hour(ts) * 100 + minute(ts) AS STRING) END AS acq_time,
  CAST(CAST(ts AS DATE) AS STRING) AS acq_date, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day,
  CASE event_id % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'l' ELSE 'h' END AS confidence,
  CASE WHEN event_id % 2 = 0 THEN 'D' ELSE 'N' END AS daynight,
  CASE WHEN (event_id * 104729) % 20000 < 10000 THEN 'west' ELSE 'east' END AS country FROM events"""),
    "stations": (("customer",), """
SELECT c_custkey AS sid, 20 + ((c_custkey * 6143) % 17000) / 1e3 AS latitude, -8 + ((c_custkey * 75577) % 20000) / 1e3 AS longitude,
  c_acctbal AS elevation, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 10 END AS slope, c_mktsegment AS label, CAST(c_nationkey AS INT) AS soil_id FROM customer"""),
    "dem": (("part",), """
SELECT CAST(floor(p_partkey / 40) AS INT) AS r, CAST(p_partkey % 40 AS INT) AS c,
  CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 53 = 0 THEN -9999e0 ELSE p_retailprice + p_size END AS z,
  p_brand AS brand, p_type AS kind FROM part"""),
    "climate": (("orders",), """
SELECT CAST(o_custkey % 25 AS INT) AS cell, CAST(month(o_orderdate) AS INT) AS month,
  CASE WHEN (o_custkey % 25) * 12 + month(o_orderdate) > 280 THEN NULL ELSE round(avg(o_totalprice) / 1e4, 6) END AS prec,
  round(max(o_totalprice) / 1e4, 6) AS tmax, round(min(o_totalprice) / 1e4, 6) AS tmin
FROM orders GROUP BY CAST(o_custkey % 25 AS INT), (o_custkey % 25), month(o_orderdate)"""),
    "soil": (("nation",), """
SELECT CAST(n_nationkey AS INT) AS soil_id, CAST(20 + (n_nationkey * 7) % 50 AS DOUBLE) AS sand, CAST(10 + (n_nationkey * 5) % 30 AS DOUBLE) AS silt,
  CASE WHEN n_nationkey % 6 = 5 THEN -9e0 ELSE CAST(5 + (n_nationkey * 11) % 60 AS DOUBLE) END AS clay, CAST(n_nationkey % 9 AS DOUBLE) / 2 AS org_carbon,
  CAST(4 + n_nationkey % 6 AS DOUBLE) AS ph_water, CAST(n_nationkey * 3 % 40 AS DOUBLE) AS cec_soil, CAST((n_nationkey * 13) % 130 AS DOUBLE) AS bsat,
  CAST(n_nationkey * 2 % 35 AS DOUBLE) AS coarse, 1 + (n_nationkey % 8) / 1e1 AS bulk, (n_nationkey % 5) / 1e1 AS total_n, CAST(n_nationkey * 3 % 30 AS DOUBLE) AS cec_eff,
  n_name AS texture FROM nation WHERE n_nationkey <> 11"""),
    "features": (("lineitem",), """
SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  CAST(month(l_shipdate) AS DOUBLE) AS season, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS fire, l_returnflag AS flag, l_linestatus AS status, CAST(l_suppkey % 6 AS INT) AS cluster FROM lineitem"""),
    "scored": (("lineitem",), """
SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  CAST((l_orderkey * 37 + l_linenumber * 11 + CASE WHEN l_returnflag = 'R' THEN 30 ELSE 0 END) % 101 AS DOUBLE) / 100 AS proba,
  CAST(l_suppkey % 6 AS INT) - 1 AS cluster, CAST(l_orderkey % 5 AS INT) AS fold, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem"""),
    "zones": (("nation",), """
SELECT CAST(n_nationkey AS INT) AS zone, CAST(n_regionkey AS INT) AS class, -8 + (n_nationkey % 5) * 4e0 + 0.0005e0 AS x0, 20 + floor(n_nationkey / 5) * 3.4e0 + 0.0005e0 AS y0,
  -8 + (n_nationkey % 5) * 4e0 + 3.7005e0 AS x1, 20 + floor(n_nationkey / 5) * 3.4e0 + 3.1005e0 AS y1 FROM nation"""),
    # zones, and the same once more to the east of all detections
    "areas": (("nation",), """
SELECT CAST(n_nationkey + 100 * k AS INT) AS zone, -8 + (n_nationkey % 5) * 4e0 + 20.2e0 * k + 0.0005e0 AS x0, 20 + floor(n_nationkey / 5) * 3.4e0 + 0.0005e0 AS y0,
  -8 + (n_nationkey % 5) * 4e0 + 20.2e0 * k + 3.7005e0 AS x1, 20 + floor(n_nationkey / 5) * 3.4e0 + 3.1005e0 AS y1 FROM nation CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) AS twice"""),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame; it is plain SQL, so filters and columns are pushed into the scan."""
    sources, sql = PROJECTIONS[name]
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sources}
    for t in sources:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **read)


def with_projections(sql: str, *names: str) -> str:
    """An oracle's SQL with the projections that it uses in front."""
    return "WITH " + ", ".join(f"{n} AS ({PROJECTIONS[n][1]})" for n in names) + " " + sql.strip()
