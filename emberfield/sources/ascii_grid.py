"""ESRI ASCII grids as a Spark data source: rows (r, c, lat, lon, value), cell centres, nodata as NULL.

Files are read by Spark itself (any store it can open); a worker only parses the text that it is handed, so a grid per file
is the unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, r int, c int, lat double, lon double, value double"


def parse(text: str) -> tuple[dict[str, float], np.ndarray]:
    """Header (lower-case names) and the values, top row first."""
    lines, head, k = text.splitlines(), {}, 0
    while k < len(lines) and lines[k][:1].isalpha():
        name, value = lines[k].split()
        head[name.lower()] = float(value)
        k += 1
    a = np.array(" ".join(lines[k:]).split(), dtype=float).reshape(int(head["nrows"]), int(head["ncols"]))
    if "nodata_value" in head:
        a[a == head["nodata_value"]] = np.nan
    return head, a


def read(spark: SparkSession, path: str, rows: int = 65_536) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                head, a = parse(raw.decode())
                n, m = a.shape
                step = head["cellsize"]
                half = 0.0 if "xllcenter" in head else step / 2
                x0, y0 = head.get("xllcenter", head.get("xllcorner")) + half, head.get("yllcenter", head.get("yllcorner")) + half
                for s in range(0, n * m, rows):
                    at = np.arange(s, min(n * m, s + rows))
                    r, c = at // m, at % m
                    v = a[r, c]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(at)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)),
                        pa.array(y0 + (n - 1 - r) * step), pa.array(x0 + c * step), pa.array(v, mask=np.isnan(v)),
                    ], names=["file", "r", "c", "lat", "lon", "value"])

    return files.mapInArrow(cells, SCHEMA)
