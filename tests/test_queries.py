"""Every query of the reference's own operators beside its oracle."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from emberfield.plans import catalog

SF = Path("/root/testdata/sf0.01")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(normal, r))) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    out = con.execute(sql)
    at = [[d[0] for d in out.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(normal(r[k]) for k in at)) for r in out.fetchall())


def test_ring_sample_is_of_all_fires(spark, con, tmp_path):
    con.execute(f"copy (select * from events where event_id % 20 = 7) to '{tmp_path}/events.parquet' (format parquet)")
    row = catalog.queries()["n08_ring_sample"](spark, str(tmp_path)).first()
    assert row["ring_in_band"] and row["inside_band"] and row["n"] == 300


def test_jdbc_extract_where_executors_are_other_processes(con, tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from emberfield.plans import catalog
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", sorted(map(tuple, catalog.queries()["s09_jdbc_extract"](spark, "{SF}").collect())))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert f"ROWS {sorted(con.execute(catalog.oracle_sql()['s09_jdbc_extract']).fetchall())}" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
@pytest.mark.parametrize("name", ["g03_position_index", "g08_resample_bilinear"])
def test_grids_that_are_not_50_rows(spark, name, sf):
    df, c = catalog.queries()[name](spark, str(SF.parent / sf)), duckdb.connect()
    c.execute(f"create view part as select * from '{SF.parent / sf}/part.parquet'")
    want = c.execute(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(map(normal, r))) for r in df.collect()) == sorted(repr(tuple(map(normal, r))) for r in want)


def test_position_index_broadcasts_no_table_of_windows(spark):
    sf = SF.parent / "sf0.1"
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")  # the exploded windows of 20,000 cells take more
    try:
        # collected: a count would not need the means
        assert len(catalog.queries()["g03_position_index"](spark, str(sf)).collect()) == 20_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_position_index_of_odd_tables(spark, con, tmp_path):
    # cells far out, before the raster, twice, without a key; and one whose window has no cell
    keys = "select unnest([0, 1, 39, 40, 41, 79, 1960, 1999, 1999, 5000, 5020, 5039, 5039, 900000, -1, -41, -5000, 1200, null])"
    con.execute(f"copy (select k as p_partkey, 900 + coalesce(k, 7) % 13 + row_number() over () * 0.5e0 as p_retailprice, 3::int as p_size, 'b' as p_brand, 't' as p_type from ({keys}) t(k)) to '{tmp_path}/part.parquet' (format parquet)")
    df, c = catalog.queries()["g03_position_index"](spark, str(tmp_path)), duckdb.connect()
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = c.execute(f"select r, c, tpi from ({catalog.oracle_sql()['g03_position_index']})").fetchall()
    assert sorted(repr(tuple(map(normal, r))) for r in df.select("r", "c", "tpi").collect()) == sorted(repr(tuple(map(normal, r))) for r in want)
