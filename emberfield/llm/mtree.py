"""Exact top-k search by inner product over M-trees.

An M-tree page holds entries of one routing object: objects (leaf) or child routing objects with covering radii, each
with its distance to the page's own object. Search is best first: pages wait in a heap by an upper bound of the inner
product. With d(q, c) the Euclidean distance to a routing object c of radius r, every x below has d(q, x) >= d(q, c) - r,
and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so the bound is the lesser of (|q|^2 + max|x|^2 - max(0, d - r)^2) / 2 and
q.c + |q| r. Before anything is computed for an entry e, |d(q, p) - d(e, p)| from the stored parent distance stands for
d(q, e); entries that this bound excludes cost no computation.

Across the cluster: up to `cells` pivots (a bounded sample) split the vectors into cells, cells of more than `page_rows`
rows are split further by a hash, and each part is one tree, so a tree has about `page_rows` rows however many vectors there
are. A query is searched in one tree of the cell that promises most; its k-th score then excludes whole cells by their
radii, and the trees of the rest are searched, in blocks of queries. The routing table (at most `cells` objects) is what
is broadcast.

Null vectors, and vectors with null, NaN or infinite components, take no part. Vectors of different lengths are padded
with zeros. Rows that repeat a vec_id are separate candidates, but one query per distinct vec_id (its smallest vector), and
none of the query's own rows is a candidate. Equal scores: the smaller vec_id first. An empty table: no rows. Other columns
may have any name. Scores are exact for components below 2^20 in absolute value.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What rounding may take off a bound, as a part of the squared norms that it is made of.
SLACK = 1e-9


class MTree:
    """Bulk-loaded M-tree over rows of x (float64) with their ids."""

    #: Rows of a leaf page, child pages of a page. A leaf's rows lie side by side, so a page is one product.
    LEAF, FAN = 512, 16

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norm2 = (x * x).sum(axis=1)
        #: Pages: (object vector, radius, max |x|^2, leaf?, entries, distances of entries to the object)
        self.pages: list[tuple] = []
        self.order: list[np.ndarray] = []
        self.root = self._build(np.arange(len(ids)), x.mean(axis=0)) if len(ids) else None
        if self.order:
            order = np.concatenate(self.order)
            self.ids, self.x, self.norm2 = self.ids[order], np.ascontiguousarray(self.x[order]), self.norm2[order]
            self.order = []

    def _build(self, rows: np.ndarray, center: np.ndarray) -> int:
        far = np.sqrt(((self.x[rows] - center) ** 2).sum(axis=1))
        radius, high = float(far.max()), float(self.norm2[rows].max())
        if len(rows) <= self.LEAF or radius == 0.0:
            order = np.argsort(far, kind="stable")
            start = sum(map(len, self.order))
            self.order.append(rows[order])
            self.pages.append((center, radius, high, True, (start, start + len(rows)), far[order]))
            return len(self.pages) - 1
        fan = min(self.FAN, math.ceil(len(rows) / (self.LEAF * 0.75)))
        seeds = self.x[rows[np.argsort(far, kind="stable")[np.linspace(0, len(rows) - 1, fan).astype(int)]]]
        near = (seeds * seeds).sum(axis=1)[None] - 2 * self.x[rows] @ seeds.T
        cell = near.argmin(axis=1)
        parts = [rows[cell == c] for c in range(fan)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1 or max(map(len, parts)) > 0.95 * len(rows):  # copies or a lump: halves by distance
            order = np.argsort(far, kind="stable")
            parts = np.array_split(rows[order], 4)
        children = [self._build(p, self.x[p].mean(axis=0)) for p in parts]
        to = np.array([math.dist(self.pages[c][0], center) for c in children])
        self.pages.append((center, radius, high, False, np.array(children), to))
        return len(self.pages) - 1

    def bound(self, page: int, q: np.ndarray, q2: float) -> tuple[float, float]:
        c, r, high, *_ = self.pages[page]
        d = math.sqrt(max(0.0, ((q - c) ** 2).sum()))
        return min((q2 + high - max(0.0, d - r) ** 2) / 2, float(q @ c) + math.sqrt(q2) * r), d

    def search(self, q: np.ndarray, k: int, own: int | None = None, least: float = -math.inf) -> tuple[list[tuple[int, int]], int]:
        """Up to k (score, id), best first, of score >= least; and how many distances and products it computed."""
        best: list[tuple[float, int]] = []  # heap of (score, -id)
        if self.root is None or k < 1:
            return [], 0
        q2 = float(q @ q)
        slack = SLACK * (1 + q2 + self.pages[self.root][2])
        top, d = self.bound(self.root, q, q2)
        heap, computed = [(-top, self.root, d)], 1
        while heap:
            up, page, d = heapq.heappop(heap)
            if -up + slack < least:
                break
            c, _, _, leaf, entries, to = self.pages[page]
            if leaf:
                # stored distances to the parent bound each product before it is computed
                start, end = entries
                able = (q2 + self.norm2[start:end] - (d - to) ** 2) / 2 + slack >= least
                if able.all():
                    scores, ids = self.x[start:end] @ q, self.ids[start:end]
                else:
                    rows = start + np.flatnonzero(able)
                    scores, ids = self.x[rows] @ q, self.ids[rows]
                computed += len(ids)
                if own is not None and (other := ids != own).sum() < len(ids):  # the query's own rows, any number of them
                    scores, ids = scores[other], ids[other]
                floor = least
                if len(scores) > k:
                    floor = max(floor, np.partition(scores, len(scores) - k)[len(scores) - k])
                good = scores >= floor
                for s, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    least = max(least, best[0][0])
            else:
                for child, t in zip(entries.tolist(), to.tolist(), strict=True):
                    _, r, high, *_ = self.pages[child]
                    gap = max(0.0, abs(d - t) - r)
                    if (q2 + high - gap * gap) / 2 + slack < least:
                        continue
                    u, dc = self.bound(child, q, q2)
                    computed += 1
                    if u + slack >= least:
                        heapq.heappush(heap, (-u, child, dc))
        return [(int(s), -i) for s, i in sorted(best, reverse=True)], computed


def quantize(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose components are all finite numbers."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    good = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, page_rows: int = 8192, cells: int = 2048, block: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, its k best other vectors."""
    spark = vectors.sparkSession
    base = materialize(quantize(vectors, key, vector, scale), "vectors")
    n, width = base.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    width = max(1, width or 1)
    pivots = base.orderBy(F.xxhash64("vec_id", F.lit(17)), "v").limit(min(cells, math.ceil(n / page_rows))).collect()
    pivot = np.zeros((len(pivots), width))
    for i, p in enumerate(sorted(pivots, key=lambda p: (p["vec_id"], p["v"]))):
        pivot[i, : len(p["v"])] = p["v"]

    def dense(column: pa.Array) -> np.ndarray:
        x = np.zeros((len(column), width))
        for i, v in enumerate(column.to_numpy(zero_copy_only=False)):
            x[i, : len(v)] = v
        return x

    def nearest(batches):
        for b in batches:
            x = dense(b.column("v"))
            cell = ((pivot * pivot).sum(axis=1)[None] - 2 * x @ pivot.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "cell", "x"])

    placed = materialize(base.mapInArrow(nearest, "vec_id long, cell int, x binary"), "cells")
    parts = materialize(placed.groupBy("cell").agg(F.count("*").alias("c")).select("cell", F.ceil(F.col("c") / page_rows).cast("int").alias("parts")), "parts")  # a row a cell
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    placed = placed.join(F.broadcast(parts), "cell").select("cell", part.alias("part"), "vec_id", "x")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "x"])
        t = MTree(pdf["vec_id"].to_numpy(), np.stack([np.frombuffer(b) for b in pdf["x"]]))
        c, r, high, *_ = t.pages[t.root]
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "part": [pdf["part"].iloc[0]], "center": [c.tobytes()], "radius": [r], "high": [high], "pages": [pickle.dumps(t, protocol=5)]})

    forest = materialize(placed.groupBy("cell", "part").applyInPandas(build, "cell int, part int, center binary, radius double, high double, pages binary"), "forest")
    # a cell is routed to by its first tree's object, with a radius that holds all of its trees
    reach = forest.where("part = 0").select("cell", F.col("center").alias("c0"))

    def spans(batches):
        for b in batches:
            far = [math.dist(np.frombuffer(x), np.frombuffer(y)) + r for x, y, r in zip(*(b.column(c).to_pylist() for c in ("center", "c0", "radius")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("c0"), pa.array(far, pa.float64()), b.column("high")], names=["cell", "center", "radius", "high"])

    spanned = forest.select("cell", "center", "radius", "high").join(F.broadcast(reach), "cell").mapInArrow(spans, "cell int, center binary, radius double, high double")
    routing = spanned.groupBy("cell").agg(F.min("center").alias("center"), F.max("radius").alias("radius"), F.max("high").alias("high")).orderBy("cell").collect()
    table = spark.sparkContext.broadcast((
        np.array([r["cell"] for r in routing]), np.stack([np.frombuffer(r["center"]) for r in routing]), np.array([r["radius"] for r in routing]), np.array([r["high"] for r in routing]),
    ))

    def routes(home: bool):
        """(cell, query_id, q, least): the cell of the greatest product, or all that the k-th score doesn't exclude."""

        def run(batches):
            cell, c, r, high = table.value
            c2 = (c * c).sum(axis=1)
            for b in batches:
                q = dense(b.column("v"))
                q2 = (q * q).sum(axis=1)
                ip = q @ c.T
                d = np.sqrt(np.maximum(0, q2[:, None] + c2[None] - 2 * ip))
                up = np.minimum((q2[:, None] + high[None] - np.maximum(0, d - r[None]) ** 2) / 2, ip + np.sqrt(q2)[:, None] * r[None])
                if home:
                    i, j = np.arange(len(q)), ip.argmax(axis=1)
                else:
                    least = np.nan_to_num(b.column("least").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                    slack = SLACK * (1 + q2[:, None] + high[None]) * 10
                    i, j = np.nonzero(up + slack >= least[:, None])
                cols = [pa.array(cell[j].astype(np.int32)), b.column("vec_id").take(pa.array(i)), pa.array([q[x].tobytes() for x in i], pa.binary())]
                cols.append(pa.nulls(len(i), pa.float64()) if home else b.column("least").take(pa.array(i)))
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "query_id", "q", "least"])

        return run

    def search(queries: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(tree):
            t: MTree = pickle.loads(tree["pages"].iloc[0])
            for i, q, least in zip(queries["query_id"].tolist(), queries["q"], queries["least"].astype(float).fillna(-math.inf).tolist(), strict=True):
                out += [(i, v, s) for s, v in t.search(np.frombuffer(q), k, i, least)[0]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    # the tree of its best cell that a query looks into first
    start = F.pmod(F.xxhash64("query_id", F.lit(31)), F.col("parts")).cast("int")

    def found(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "pairs")
        units = pairs.select(F.col("cell").alias("at_cell"), F.col("part").alias("at_part"), F.col("block").alias("at_block")).distinct()
        needed = units.join(forest.select(F.col("cell").alias("at_cell"), F.col("part").alias("at_part"), "pages"), ["at_cell", "at_part"])
        key = ["cell", "part", "block"]
        return pairs.groupBy(*key).cogroup(needed.groupBy(*(f"at_{c}" for c in key))).applyInPandas(search, "query_id long, vec_id long, score long")

    queries = materialize(base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, math.ceil(queries.count() / block))
    pairs_schema = "cell int, query_id long, q binary, least double"
    homes = materialize(queries.mapInArrow(routes(True), pairs_schema).join(F.broadcast(parts), "cell").withColumn("part", start).drop("parts"), "homes")
    home = materialize(found(homes), "home")
    least = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    rest = queries.join(least.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", "least").mapInArrow(routes(False), pairs_schema)
    rest = rest.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = home.unionByName(found(rest.join(homes.select("cell", "part", "query_id"), ["cell", "part", "query_id"], "left_anti")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
