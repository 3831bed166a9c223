"""Folds, metrics, resampling, clustering and classification.

Metrics are exact: ties of a score are one step of a curve. Curves are aggregated by score, then summed over ranges of scores
(`tables.running`), so neither a fold nor the whole table is ever in one task. Folds and splits rank rows the same way.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from .tables import by_hash, ranked, running


# folds
def stratified_folds(df: DataFrame, y: str, key: str, k: int, seed: int = 0) -> DataFrame:
    return ranked(df, [y], by_hash(key, seed), "fold").withColumn("fold", ((F.col("fold") - 1) % k).cast("int"))


def spatial_folds(df: DataFrame, key: str, k: int, lat: str = "latitude", lon: str = "longitude", iterations: int = 20) -> DataFrame:
    """`fold` by k-means on the coordinates: neighbours share a fold. Rows without coordinates have none."""
    at = df.withColumn("__xy", F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.array(F.col(lat).cast("double"), F.col(lon).cast("double"))))
    return at.select("*", nearest_center(F.col("__xy"), kmeans_centers(at.where("__xy is not null"), key, "__xy", k, iterations)).alias("fold")).drop("__xy")


def train_test_split(df: DataFrame, y: str, key: str, test: float = 0.2, seed: int = 0, most_classes: int = 20) -> DataFrame:
    """is_test for a share of each class; of the whole table where there are more than `most_classes`."""
    by = [y] if df.select(y).distinct().limit(most_classes + 1).count() <= most_classes else []
    n = df.groupBy(*(F.col(c).alias("__y") for c in by)).agg(F.round(F.count("*") * test).alias("__n"))
    out = ranked(df, by, by_hash(key, seed), "__rn")
    out = out.join(n, F.col(y).eqNullSafe(F.col("__y"))) if by else out.crossJoin(F.broadcast(n))
    return out.select(*df.columns, (F.col("__rn") <= F.col("__n")).alias("is_test"))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """(y, weight): n / (classes * n of the class)."""
    n = df.groupBy(y).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("t"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(total)).select(y, (F.col("t") / (F.col("k") * F.col("c"))).alias("weight"))


# binary metrics
def curve(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, tp, fp, p, n, pos, all) at each distinct score, from the highest down."""
    by = by or []
    steps = df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count("*").alias("all")).withColumn("__neg", F.col("all") - F.col("pos"))
    out = running(steps, by, [F.desc(score)], {"tp": "pos", "fp": "__neg"})
    total = df.groupBy(*(F.col(b).alias(f"__t{i}") for i, b in enumerate(by))).agg(F.sum(y).alias("p"), (F.count("*") - F.sum(y)).alias("n"))
    if by:
        same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"__t{i}")) for i, b in enumerate(by)))
        out = out.join(total, same)
    else:
        out = out.crossJoin(F.broadcast(total))
    return out.select(*by, score, "tp", "fp", "p", "n", "pos", "all")


def ranking_metrics(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, roc_auc, average_precision)."""
    by = by or []
    c = curve(df.select(*by, F.col(y).alias("__y"), F.col(score).alias("__s")), "__y", "__s", by)
    neg = F.col("all") - F.col("pos")
    auc = F.sum(neg * (F.col("tp") - F.col("pos") / 2)) / F.first(F.col("p") * F.col("n"))
    ap = F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*by).agg(auc.alias("roc_auc"), ap.alias("average_precision"))


def threshold_metrics(df: DataFrame, y: str, score: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    hit = (F.col(score) >= threshold).cast("int")
    out = df.groupBy(*(by or [])).agg(
        F.sum(hit * F.col(y)).alias("tp"), F.sum(hit * (1 - F.col(y))).alias("fp"), F.sum((1 - hit) * F.col(y)).alias("fn"), F.sum((1 - hit) * (1 - F.col(y))).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn)).withColumn("specificity", div(tn, tn + fp))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", div(2 * p * r, p + r)).withColumn("balanced_accuracy", (r + F.col("specificity")) / 2).withColumn("accuracy", (tp + tn) / (tp + fp + fn + tn))


def macro_metrics(df: DataFrame, y: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by, macro_precision, macro_recall, macro_f1): means over the two classes; 0 where a class is never predicted or absent."""
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(predicted) == b))
    out = df.groupBy(*(by or [])).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = (div(tp, tp + fp), div(tn, tn + fn)), (div(tp, tp + fn), div(tn, tn + fp))
    f = [div(2 * a * b, a + b) for a, b in zip(p, r, strict=True)]
    return out.select(*(by or []), *((sum(x[1:], x[0]) / 2).alias(f"macro_{n}") for n, x in (("precision", p), ("recall", r), ("f1", f))))


def over_folds(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std, std_samp) of a table of one row a fold; std is the population's."""
    long = folds.unpivot([], [*metrics], "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.stddev_samp("value").alias("std_samp"))


def best_threshold(df: DataFrame, y: str, score: str, optimize: str = "f1", least: float = 0.8) -> DataFrame:
    """One row (threshold, value): max F1; or max precision at recall >= least; or max recall at precision >= least; ties to the higher score."""
    c = curve(df.select(F.col(y).alias("__y"), F.col(score).alias("__s")), "__y", "__s")
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("p")
    value = {"f1": 2 * p * r / F.nullif(p + r, F.lit(0.0)), "precision": F.when(r >= least, p), "recall": F.when(p >= least, r)}[optimize]
    return c.withColumn("v", value).where("v is not null").agg(F.max(F.struct("v", "__s")).alias("m")).select(F.col("m.__s").alias("threshold"), F.col("m.v").alias("value"))


# clusterings
def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari, homogeneity, completeness, purity of clusters b against classes a."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    wa, wb, w = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy()
    # the contingency table: levels x levels, not rows
    c = n.select("n", F.sum("n").over(wa).alias("na"), F.sum("n").over(wb).alias("nb"), F.sum("n").over(w).alias("t"), F.max("n").over(wb).alias("mb"), F.row_number().over(wa.orderBy("b")).alias("ia"), F.row_number().over(wb.orderBy("a")).alias("ib"))
    two = lambda x: x * (x - 1) / 2
    s = c.agg(
        F.sum(two(F.col("n"))).alias("ij"), F.sum(F.when(F.col("ia") == 1, two(F.col("na")))).alias("ai"), F.sum(F.when(F.col("ib") == 1, two(F.col("nb")))).alias("bj"), F.first("t").alias("t"),
        F.sum(F.when(F.col("ib") == 1, F.col("mb"))).alias("hit"), F.sum(F.col("n") / F.col("t") * F.log(F.col("nb") / F.col("n"))).alias("h_ab"), F.sum(F.col("n") / F.col("t") * F.log(F.col("na") / F.col("n"))).alias("h_ba"),
        F.sum(F.when(F.col("ia") == 1, F.col("na") / F.col("t") * F.log(F.col("t") / F.col("na")))).alias("ha"), F.sum(F.when(F.col("ib") == 1, F.col("nb") / F.col("t") * F.log(F.col("t") / F.col("nb")))).alias("hb"))
    expected = F.col("ai") * F.col("bj") / two(F.col("t"))
    one = lambda x: F.coalesce(x, F.lit(1.0))
    return s.select(
        one((F.col("ij") - expected) / F.nullif((F.col("ai") + F.col("bj")) / 2 - expected, F.lit(0.0))).alias("ari"),
        one(1 - F.col("h_ab") / F.nullif(F.col("ha"), F.lit(0.0))).alias("homogeneity"), one(1 - F.col("h_ba") / F.nullif(F.col("hb"), F.lit(0.0))).alias("completeness"), (F.col("hit") / F.col("t")).alias("purity"))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, above a table."""
    x = np.asarray(x, dtype=float)
    small = np.array([math.lgamma(k + 1) for k in range(32)])
    y = np.maximum(x, 1)
    series = y * np.log(y) - y + 0.5 * np.log(2 * np.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 32, small[np.minimum(x, 31).astype(int)], series)


def adjusted_mutual_information(df: DataFrame, a: str, b: str, most: int = 100_000) -> float:
    """(MI - E[MI]) / (mean of the entropies - E[MI]), the expectation over tables of the same margins. The contingency table (levels x
    levels, at most `most` cells) goes to the driver."""
    rows = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many levels")
    n = float(sum(r["count"] for r in rows))
    na, nb = Counter(), Counter()
    for r in rows:
        na[r["a"]] += r["count"]
        nb[r["b"]] += r["count"]
    if not n or len(na) == len(nb) == 1:
        return 1.0
    mi = sum(r["count"] / n * math.log(n * r["count"] / (na[r["a"]] * nb[r["b"]])) for r in rows)
    entropy = lambda c: -sum(v / n * math.log(v / n) for v in c.values())
    expected = 0.0
    for (x, tx), (y, ty) in product(Counter(na.values()).items(), Counter(nb.values()).items()):  # equal margins count together
        mean, sd = x * y / n, math.sqrt(max(1.0, x * y / n * (1 - x / n) * (1 - y / n)))
        k = np.arange(max(1, int(x + y - n), int(mean - 15 * sd)), min(x, y, int(mean + 15 * sd) + 2) + 1, dtype=float)  # what lies outside weighs nothing
        if len(k):
            f = _log_factorial
            logp = f(x) + f(y) + f(n - x) + f(n - y) - f(n) - f(k) - f(x - k) - f(y - k) - f(n - x - y + k)
            expected += tx * ty * float((k / n * np.log(n * k / (x * y)) * np.exp(logp)).sum())
    top = (entropy(na) + entropy(nb)) / 2 - expected
    return (mi - expected) / top if abs(top) > 1e-15 else 1.0


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def _centers(df: DataFrame, label: str, v: str) -> DataFrame:
    return df.select(label, F.posexplode(v).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x")).groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))


def kmeans_centers(df: DataFrame, key: str, v: str, k: int, iterations: int = 20) -> list[list[float]]:
    """Centers by Lloyd's steps from the k rows of smallest hash; an empty cluster becomes the zero vector. k rows are the only thing
    on the driver."""
    centers = [[float(x) for x in r[0]] for r in df.orderBy(F.xxhash64(F.col(key)), key).limit(k).select(v).collect()]
    if not centers:
        return []
    for _ in range(iterations):
        got = {r["cluster"]: r["center"] for r in _centers(assign(df, v, centers), "cluster", v).collect()}
        new = [list(got.get(c, [0.0] * len(centers[0]))) for c in range(len(centers))]
        done = np.allclose(new, centers)
        centers = new
        if done:
            break
    return centers


def kmeans(df: DataFrame, key: str, v: str, k: int, iterations: int = 20) -> DataFrame:
    """df with `cluster`; an empty table stays empty."""
    return assign(df, v, kmeans_centers(df, key, v, k, iterations))


def nearest_center(v: Column, centers: list[list[float]]) -> Column:
    """The nearest center's number; ties to the smaller; NULL without a vector or centers."""
    if not centers:
        return F.lit(None).cast("int")
    d = F.array(*(F.struct(distance2(v, F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centers)))
    return F.when(v.isNotNull(), F.array_min(d)["c"])


def assign(df: DataFrame, v: str, centers: list[list[float]]) -> DataFrame:
    return df.withColumn("cluster", nearest_center(F.col(v), centers))


def inertia(df: DataFrame, v: str, centers: list[list[float]]) -> float:
    """Sum of squared distances to the nearest center."""
    d = F.array_min(F.array(*(distance2(F.col(v), F.array(*map(F.lit, c))) for c in centers)))
    return float(df.agg(F.sum(d)).first()[0] or 0.0)


def center_profile(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, feature, mean, z): each cluster's mean, and its distance from the mean of all in deviations (population)."""
    every = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns)).first()
    per = df.groupBy(label).agg(*(F.avg(c).alias(c) for c in columns)).unpivot([label], columns, "feature", "mean")
    both = df.sparkSession.createDataFrame([(c, every[c]["m"], every[c]["s"]) for c in columns], "feature string, m double, s double")
    return per.join(F.broadcast(both), "feature").select(label, "feature", "mean", ((F.col("mean") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z"))


def cluster_quality(df: DataFrame, label: str, v: str) -> DataFrame:
    """One row: davies_bouldin and calinski_harabasz from per-cluster moments."""
    c = _centers(df, label, v)
    inside = df.join(F.broadcast(c), label).withColumn("d2", distance2(F.col(v), F.col("center")))
    per = inside.groupBy(label).agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"), F.count("*").alias("n")).join(c, label)
    mean = df.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("all"))
    o = per.select(F.col(label).alias("o"), F.col("s").alias("so"), F.col("center").alias("co"))
    # clusters x clusters
    worst = per.join(F.broadcast(o), F.col(label) != F.col("o")).groupBy(label).agg(F.max((F.col("s") + F.col("so")) / F.sqrt(distance2(F.col("center"), F.col("co")))).alias("r"))
    ch = per.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("n") * distance2(F.col("center"), F.col("all"))).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return worst.agg(F.avg("r").alias("davies_bouldin")).crossJoin(ch.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz")))


# neighbours of vectors: leaves of a tree, in blocks
def _finite(df: DataFrame, key: str, v: str, name: str) -> DataFrame:
    """(name, x) of the rows with a vector; null or non-finite components have no distance to anything."""
    rows = df.select(F.col(key).cast("long").alias(name), F.col(v).cast("array<double>").alias("x"))
    return rows.where(F.coalesce(F.forall("x", lambda t: F.abs(t) < math.inf), F.lit(False)))


def _split(rows: np.ndarray, leaves: int) -> tuple[np.ndarray, ...]:
    """(dim or -1, cut, left, right) of each node of a tree of at most `leaves` leaves: halves along the widest dimension."""
    dim, cut, left, right, todo = [-1], [0.0], [0], [0], [(0, rows)]
    while todo and len(dim) < 2 * leaves - 1:
        node, part = todo.pop(0)
        wide = np.ptp(part, axis=0) if part.size else np.zeros(0)
        if not wide.any():
            continue
        dim[node] = int(np.argmax(wide))
        c = part[:, dim[node]]
        cut[node] = float(min(np.median(c), c[c < c.max()].max()))
        left[node], right[node] = len(dim), len(dim) + 1
        low = c <= cut[node]
        for half in (part[low], part[~low]):
            todo.append((len(dim), half))
            dim.append(-1)
            cut.append(0.0)
            left.append(0)
            right.append(0)
    return tuple(map(np.array, (dim, cut, left, right)))


def _tree(data: DataFrame, block: int, most: int = 512, each: int = 64):
    """place(rows, name), which adds the leaf `j` to (name, x), of a tree for data (o, x). The tree comes from at most `most` * `each`
    rows, and only steers which blocks meet: results do not depend on it."""
    leaves = min(most, math.ceil(data.count() / block))
    rows = data.orderBy(F.xxhash64("o"), "o").limit(each * leaves).select("x").collect() if leaves > 1 else []
    dim, cut, left, right = _split(np.array([r["x"] for r in rows]).reshape(len(rows), -1) if rows else np.zeros((0, 0)), max(1, leaves))

    def place(batches):
        for p in batches:
            at = np.zeros(len(p), dtype=np.int32)
            x = np.stack(p["x"]) if len(p) else None
            while (inner := dim[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(dim[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at).astype(np.int32)
            yield p.assign(j=at)

    return (lambda df, name: df.select(name, "x").mapInPandas(place, f"{name} long, x array<double>, j int")), len(dim) > 1


def _boxes(placed: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, low corner, high corner) of all rows of each leaf: as many as the tree has."""
    ends = placed.select("j", F.posexplode("x").alias("i", "t")).groupBy("j", "i").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    per = ends.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))
    return [(r["j"], np.array([e["lo"] for e in r["b"]]), np.array([e["hi"] for e in r["b"]])) for r in per.collect()]


def _route(df: DataFrame, boxes, metric: str) -> DataFrame:
    """(q, x, j) of df (q, x, own, reach): each leaf but `own` whose box is within reach."""

    def run(batches):
        import pandas as pd

        for p in batches:
            if not len(p):
                continue
            x, own, reach = np.stack(p["x"]), p["own"].to_numpy(), p["reach"].to_numpy() * (1 + 1e-9)
            for j, lo, hi in boxes:
                gap = np.maximum(np.maximum(lo - x, x - hi), 0)
                d = gap.sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))
                hit = (d <= reach) & (own != j)
                if hit.any():
                    yield pd.DataFrame({"q": p["q"][hit], "x": p["x"][hit], "j": np.full(hit.sum(), j, dtype=np.int32)})

    return df.select("q", "x", "own", "reach").mapInPandas(run, "q long, x array<double>, j int")


def _meet(left: DataFrame, right: DataFrame, block: int, fn, schema: str) -> DataFrame:
    """fn over blocks of left (q, x, j) and right (o, x, j) rows of one leaf; a leaf of many rows is cut by hashes of the keys."""
    sizes = [df.groupBy("j").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for df, n in ((left, "m"), (right, "n"))]
    cuts = F.broadcast(materialize(sizes[0].join(sizes[1], "j"), "cuts"))  # a row a leaf
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    a = left.join(cuts, "j").select("q", F.col("x").alias("x"), F.col("j").alias("j"), part("q", "m").alias("a"), F.explode(F.expr("sequence(0, n - 1)")).alias("b"))
    b = right.join(cuts, "j").select("o", "x", "j", F.explode(F.expr("sequence(0, m - 1)")).alias("a"), part("o", "n").alias("b"))
    return a.groupBy("j", "a", "b").cogroup(b.groupBy("j", "a", "b")).applyInPandas(fn, schema)


def block_neighbours(queries: DataFrame, data: DataFrame, key: str, v: str, k: int, metric: str = "euclidean", block: int = 4096, exclude_self: bool = True) -> DataFrame:
    """(key, other, dist, rank): exact k nearest of each query, ties to the smaller key; fewer if there are fewer. Data lies in the leaves
    of a tree. A query meets its own leaf first, and then the leaves whose box is no farther than its k-th distance so far."""

    def near(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "o": [], "dist": []}).astype({"q": "int64", "o": "int64", "dist": "float64"})
        y, ids, out = np.stack(right["x"]), right["o"].to_numpy(), []
        for q, row in zip(left["q"].to_numpy(), np.stack(left["x"]), strict=True):
            d = np.abs(y - row).sum(axis=1) if metric == "manhattan" else np.sqrt(((y - row) ** 2).sum(axis=1))
            if exclude_self:
                d = np.where(ids == q, np.inf, d)
            order = np.lexsort((ids, d))[:k]
            out += [(q, ids[t], d[t]) for t in order if np.isfinite(d[t])]
        return pd.DataFrame(out, columns=["q", "o", "dist"])

    def best(df):
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "o"))).where(F.col("rank") <= k)

    data = _finite(data, key, v, "o")
    place, many = _tree(data, block)
    b, a = materialize(place(data, "o"), "data"), materialize(place(_finite(queries, key, v, "q"), "q"), "queries")
    found = best(_meet(a, b, block, near, "q long, o long, dist double"))
    if many:
        own = materialize(found.select("q", "o", "dist"), "own")
        reach = own.groupBy("q").agg(F.when(F.count("*") >= k, F.max("dist")).alias("reach"))
        ask = a.join(reach, "q", "left").select("q", "x", F.col("j").alias("own"), F.coalesce("reach", F.lit(math.inf)).alias("reach"))
        far = materialize(_route(ask, _boxes(b), metric), "far")
        found = best(own.unionByName(_meet(far, b, block, near, "q long, o long, dist double")))
    return found.select(F.col("q").alias(key), F.col("o").alias("other"), "dist", "rank")


def knn_classify(test: DataFrame, train: DataFrame, key: str, v: str, y: str, k: int, metric: str = "euclidean") -> DataFrame:
    """(key, predicted): majority of the k nearest, ties to the smaller class."""
    near = block_neighbours(test, train, key, v, k, metric).join(train.select(F.col(key).alias("other"), F.col(y).alias("y")), "other")
    return near.groupBy(key, "y").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("predicted"))


def tomek_links(df: DataFrame, key: str, v: str, y: str) -> DataFrame:
    """(key, other): mutual nearest neighbours of different classes."""
    one = materialize(block_neighbours(df, df, key, v, 1), "nearest").select(key, "other")
    back = one.select(F.col(key).alias("other"), F.col("other").alias(key))
    label = df.select(F.col(key), F.col(y).alias("ya"))
    both = one.join(back, [key, "other"]).join(label, key).join(label.select(F.col(key).alias("other"), F.col("ya").alias("yb")), "other")
    return both.where("ya <> yb").select(key, "other")


def edited_neighbours(df: DataFrame, key: str, v: str, y: str, k: int = 3, rule: str = "majority") -> DataFrame:
    """df without the rows that most (or any) of their k neighbours contradict."""
    near = block_neighbours(df, df, key, v, k).join(df.select(F.col(key).alias("other"), F.col(y).alias("yo")), "other").join(df.select(key, F.col(y).alias("ys")), key)
    same = F.avg((F.col("yo") == F.col("ys")).cast("int"))
    bad = near.groupBy(key).agg(same.alias("s")).where("s < 0.5" if rule == "majority" else "s < 1").select(key)
    return df.join(bad, key, "left_anti")


def smote(df: DataFrame, key: str, v: str, y: str, minority: int, n: int, k: int = 5, seed: int = 0) -> DataFrame:
    """(s, v, y, base, other, u): n synthetic rows at base + u (other - base), between a minority row and one of its k nearest of the
    class; picks come from hashes. Fewer than two minority rows: none."""
    few = materialize(df.where(F.col(y) == minority).select(key, F.col(v).cast("array<double>").alias("x")), "minority")
    total = few.count()
    if total < 2:
        n, total = 0, 2
    near = block_neighbours(few, few, key, "x", k)
    order = ranked(few, [], by_hash(key, seed), "p").withColumn("p", F.col("p") - 1)
    pick = df.sparkSession.range(n).select(F.col("id").alias("s"), (F.col("id") % total).alias("p"), (1 + F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(min(k, total - 1)))).cast("int").alias("rank"), (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    out = pick.join(order, "p").join(near.select(key, "other", "rank"), [key, "rank"]).join(few.select(F.col(key).alias("other"), F.col("x").alias("x2")), "other")
    return out.select("s", F.expr("zip_with(x, x2, (a, b) -> a + u * (b - a))").alias(v), F.lit(minority).alias(y), F.col(key).alias("base"), "other", "u")


def smote_tomek(df: DataFrame, key: str, v: str, y: str, minority: int, k: int = 5, seed: int = 0) -> DataFrame:
    """(key, v, y): classes 0 and 1 evened out by synthetic rows (negative keys), then without both members of any Tomek link."""
    sizes = {r[y]: r["count"] for r in df.where(F.col(y).isin(0, 1)).groupBy(y).count().collect()}
    more = smote(df, key, v, y, minority, max(0, sizes.get(1 - minority, 0) - sizes.get(minority, 0)), k, seed)
    both = df.select(key, F.col(v).cast("array<double>").alias(v), y).unionByName(more.select((-F.col("s") - 1).alias(key), v, y))
    both = materialize(both, "balanced")
    links = materialize(tomek_links(both, key, v, y), "links")
    gone = links.select(key).unionByName(links.select(F.col("other").alias(key))).distinct()
    return both.join(gone, key, "left_anti")


def dbscan(df: DataFrame, key: str, v: str, eps: float, least: int, pairs: DataFrame | None = None) -> DataFrame:
    """(key, cluster): -1 noise; a border point joins the smallest cluster in reach. Clusters are named by their smallest core key."""
    near = pairs if pairs is not None else eps_pairs(df, key, v, eps)
    near = near.where(F.col("dist") <= eps).select(key, "other")
    core = materialize(near.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") + 1 >= least).select(key), "core")
    links = near.join(core, key).join(core.withColumnRenamed(key, "other"), "other")
    label = core.withColumn("cluster", F.col(key))
    for _ in range(100):
        low = links.join(label.select(F.col(key).alias("other"), "cluster"), "other").groupBy(key).agg(F.min("cluster").alias("m"))
        new = materialize(label.join(low, key, "left").select(key, F.least("cluster", F.coalesce("m", "cluster")).alias("cluster")), "label")
        # a label is itself a core point: jump to its own label
        jump = new.select(F.col(key).alias("cluster"), F.col("cluster").alias("c2"))
        new = materialize(new.join(jump, "cluster").select(key, F.col("c2").alias("cluster")), "label")
        moved = new.join(label.withColumnRenamed("cluster", "was"), key).where("was <> cluster").isEmpty()
        label = new
        if moved:
            break
    border = near.join(core, key, "left_anti").join(label.select(F.col(key).alias("other"), "cluster"), "other").groupBy(key).agg(F.min("cluster").alias("cluster"))
    found = label.unionByName(border)
    return df.select(key).join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def eps_pairs(df: DataFrame, key: str, v: str, eps: float, metric: str = "euclidean", block: int = 2048) -> DataFrame:
    """(key, other, dist) of all pairs at most eps apart, both ways. Rows lie in the leaves of a tree, and meet the leaves whose box is
    within eps; the result is as large as the pairs are many."""

    def near(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "o": [], "dist": []}).astype({"q": "int64", "o": "int64", "dist": "float64"})
        y, ids, out = np.stack(right["x"]), right["o"].to_numpy(), []
        for q, row in zip(left["q"].to_numpy(), np.stack(left["x"]), strict=True):
            d = np.abs(y - row).sum(axis=1) if metric == "manhattan" else np.sqrt(((y - row) ** 2).sum(axis=1))
            hit = np.flatnonzero((d <= eps) & (ids != q))
            out.append(pd.DataFrame({"q": q, "o": ids[hit], "dist": d[hit]}))
        return pd.concat(out)

    data = _finite(df, key, v, "o")
    place, many = _tree(data, block)
    b = materialize(place(data, "o"), "data")
    a = b.select(F.col("o").alias("q"), "x", "j")
    if many:
        a = materialize(_route(a.select("q", "x", F.lit(-1).alias("own"), F.lit(float(eps)).alias("reach")), _boxes(b), metric), "near")
    pairs = materialize(_meet(a, b, block, near, "q long, o long, dist double").select(F.col("q").alias(key), F.col("o").alias("other"), "dist"), "eps")
    release(a, b)
    return pairs


def label_sums(df: DataFrame, key: str, v: str, label: str, block: int = 2048) -> DataFrame:
    """(key, lo, s, c): the sum of each row's distances to the other rows of each label, and their number. Blocks meet blocks, and give
    one row a label: no table of pairs."""
    n = max(1, math.ceil(df.count() / block))
    base = df.select(F.col(key).alias("id"), F.col(v).cast("array<double>").alias("x"), F.col(label).cast("long").alias("l"), F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int").alias("b"))
    a = base.select("id", "x", F.col("b").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    b = base.select("id", "x", "l", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.col("b").alias("j"))

    def sums(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "lo": [], "s": [], "c": []}).astype({"id": "int64", "lo": "int64", "s": "float64", "c": "int64"})
        labels, at = np.unique(right["l"].to_numpy(), return_inverse=True)
        y, ids, out = np.stack(right["x"]), right["id"].to_numpy(), []
        for q, row in zip(left["id"].to_numpy(), np.stack(left["x"]), strict=True):
            d, other = np.sqrt(((y - row) ** 2).sum(axis=1)), ids != q
            out.append((np.full(len(labels), q), labels, np.bincount(at[other], d[other], len(labels)), np.bincount(at[other], minlength=len(labels))))
        return pd.DataFrame({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("id", "lo", "s", "c"))})

    parts = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(sums, "id long, lo long, s double, c long")
    return parts.groupBy("id", "lo").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).withColumnRenamed("id", key)


def silhouette(df: DataFrame, key: str, v: str, label: str) -> DataFrame:
    """One row: the exact mean silhouette (Euclidean); a row alone in its cluster counts 0."""
    per = label_sums(df, key, v, label).where("c > 0").join(df.select(key, F.col(label).alias("ls")), key)
    mean = F.col("s") / F.col("c")
    s = per.groupBy(key, "ls").agg(F.max(F.when(F.col("lo") == F.col("ls"), mean)).alias("a"), F.min(F.when(F.col("lo") != F.col("ls"), mean)).alias("b"))
    return s.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))


# trees, level by level
def grow_tree(df: DataFrame, columns: list[str], y: str, depth: int = 4, bins: int = 32, least: int = 10, weight: str | None = None) -> list[dict]:
    """CART on gini: each level is one aggregation of (node, feature, bin) class weights; split candidates are `bins` quantiles a feature.

    Nodes: {id, feature, threshold, left, right, value, n}. Leaves vote the majority, ties to 0.
    """
    # an empty table is a leaf of 0
    q = df.agg(*(F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(c) for c in columns)).first()
    cuts = {c: sorted(set(q[c] or [])) for c in columns}
    w = F.col(weight) if weight else F.lit(1.0)
    binned = df.select(F.col(y).cast("double").alias("y"), w.alias("w"), F.array(*(sum((F.col(c) > F.lit(x)).cast("int") for x in cuts[c]) if cuts[c] else F.lit(0) for c in columns)).alias("b")).persist()
    nodes: list[dict] = [{"id": 0, "feature": None, "threshold": None, "left": None, "right": None, "value": 0, "n": 0.0}]
    open_nodes, at = [0], F.lit(0)
    for level in range(depth + 1):
        long = binned.withColumn("node", at).where(F.col("node").isin(open_nodes)).select("node", "y", "w", F.posexplode("b").alias("f", "bin"))
        rows = long.groupBy("node", "f", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()
        hist: dict = {}
        for r in rows:
            hist.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["n"], r["p"])
        nxt = []
        for node in open_nodes:
            h = hist.get(node, {})
            if not h:
                continue
            n, p = map(sum, zip(*h[0].values(), strict=True))
            nodes[node] |= {"n": n, "value": int(p > n - p)}
            if level == depth or p in (0, n):
                continue
            best = (2 * p / n * (1 - p / n) - 1e-12, None, None)
            for f, byte in sorted(h.items()):
                ln = lp = 0.0
                for b in range(len(cuts[columns[f]])):
                    dn, dp = byte.get(b, (0, 0))
                    ln, lp = ln + dn, lp + dp
                    rn, rp = n - ln, p - lp
                    if ln < least or rn < least:
                        continue
                    g = (2 * lp * (1 - lp / ln) + 2 * rp * (1 - rp / rn)) / n
                    if g < best[0]:
                        best = (g, f, b)
            if best[1] is not None:
                left = len(nodes)
                nodes += [{"id": left + i, "feature": None, "threshold": None, "left": None, "right": None, "value": 0, "n": 0.0} for i in (0, 1)]
                nodes[node] |= {"feature": columns[best[1]], "threshold": float(cuts[columns[best[1]]][best[2]]), "left": left, "right": left + 1}
                nxt += [left, left + 1]
                at = F.when((at == node) & (F.col("b")[best[1]] <= best[2]), left).when(at == node, left + 1).otherwise(at)
        open_nodes = nxt
        if not open_nodes:
            break
    binned.unpersist()
    return nodes


def tree_column(nodes: list[dict], node: int = 0) -> Column:
    """The tree as a column expression."""
    n = nodes[node]
    if n["feature"] is None:
        return F.lit(n["value"])
    return F.when(F.col(n["feature"]) <= F.lit(n["threshold"]), tree_column(nodes, n["left"])).otherwise(tree_column(nodes, n["right"]))


def grow_forest(df: DataFrame, columns: list[str], y: str, key: str, trees: int = 5, depth: int = 4, seed: int = 0, balanced: bool = False) -> Column:
    """Mean of votes of trees on bootstrap weights (Poisson(1) by a hash of the key). balanced: each tree sees of the larger class a
    hashed share as large as the smaller class."""
    share = {0: 1.0, 1: 1.0}
    if balanced:
        sizes = {r[y]: r["count"] for r in df.where(F.col(y).isin(0, 1)).groupBy(y).count().collect()}
        share = {c: min(sizes.values()) / n for c, n in sizes.items()}
    uniform = lambda *salt: F.pmod(F.xxhash64(*map(F.lit, salt), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    out = []
    for k in range(trees):
        u, w, total = uniform(seed + k), F.lit(0.0), 0.0
        for j in range(6):
            total += math.exp(-1) / math.factorial(j)
            w = w + (u >= total).cast("double")
        if balanced:
            kept = F.when(F.col(y) == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
            w = F.when(uniform(seed + k, 1) < kept, w).otherwise(0.0)
        out.append(tree_column(grow_tree(df.withColumn("__w", w), columns, y, depth, weight="__w")))
    return sum(out[1:], out[0]) / len(out)


def kmedoids(df: DataFrame, key: str, v: str, k: int, sample: int = 500, iterations: int = 10, samples: int = 5) -> DataFrame:
    """CLARA: medoids of each of some bounded samples (by hashes); those of the least cost over all rows win, and every row goes to its
    nearest. An empty table stays empty."""
    df = df.withColumn(v, F.col(v).cast("array<double>"))
    best = None
    for s in range(samples):
        rows = df.orderBy(*by_hash(key, s)).limit(sample).select(v).collect()
        if not rows:
            return assign(df, v, [])
        x = np.array([r[v] for r in rows], dtype=float)
        d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T))
        medoids = list(range(min(k, len(x))))
        for _ in range(iterations):
            near = d[:, medoids].argmin(axis=1)
            new = [int(np.flatnonzero(near == c)[d[np.ix_(near == c, near == c)].sum(axis=1).argmin()]) if (near == c).any() else medoids[c] for c in range(len(medoids))]
            if new == medoids:
                break
            medoids = new
        centers = [x[m].tolist() for m in medoids]
        d = F.array_min(F.array(*(distance2(F.col(v), F.array(*map(F.lit, c))) for c in centers)))
        cost = df.agg(F.sum(F.sqrt(d))).first()[0]
        if best is None or cost < best[0]:
            best = cost, centers
        if len(rows) < sample:
            break
    return assign(df, v, best[1])


def clarans(df: DataFrame, key: str, v: str, k: int, sample: int = 500, local: int = 5, swaps: int = 100, seed: int = 0, metric: str = "manhattan") -> DataFrame:
    """Medoids of a bounded sample by random swaps: each of `local` starts ends when `swaps` swaps in a row don't lower the cost. Every
    row goes to its nearest medoid (Euclidean, as `assign` does). An empty table stays empty."""
    df = df.withColumn(v, F.col(v).cast("array<double>"))
    rows = df.where(F.col(v).isNotNull()).orderBy(*by_hash(key, seed)).limit(sample).select(v).collect()
    if not rows:
        return assign(df, v, [])
    x = np.array([r[v] for r in rows])
    d = np.abs(x[:, None] - x[None]).sum(2) if metric == "manhattan" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rng, k, best = np.random.default_rng(seed), min(k, len(x)), None
    for _ in range(local):
        now = rng.choice(len(x), k, replace=False)
        cost, missed = d[:, now].min(1).sum(), 0
        while missed < swaps and k < len(x):
            new = now.copy()
            new[rng.integers(k)] = rng.choice(np.setdiff1d(np.arange(len(x)), now))
            c = d[:, new].min(1).sum()
            now, cost, missed = (new, c, 0) if c < cost else (now, cost, missed + 1)
        if best is None or cost < best[0]:
            best = cost, now
    return assign(df, v, x[best[1]].tolist())


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers of rows merged pairwise, down to k clusters, where the sum of squares grows least (ties to the first rows)."""
    n, label = np.ones(len(x)), np.arange(len(x))
    d = ((x[:, None] - x[None]) ** 2).sum(2) / 2
    np.fill_diagonal(d, np.inf)
    for _ in range(len(x) - k):
        i, j = sorted(divmod(int(d.argmin()), len(x)))
        gone = np.isinf(d[i]) | np.isinf(d[j])
        new = ((n[i] + n) * np.where(gone, 0, d[i]) + (n[j] + n) * np.where(gone, 0, d[j]) - n * d[i, j]) / (n[i] + n[j] + n)
        d[i] = d[:, i] = np.where(gone, np.inf, new)
        d[j] = d[:, j] = np.inf
        n[i] += n[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def ward(df: DataFrame, key: str, v: str, k: int, sample: int = 500, seed: int = 0) -> DataFrame:
    """Ward's clusters of a bounded sample (by hashes); every row goes to the nearest of their means. An empty table stays empty."""
    df = df.withColumn(v, F.col(v).cast("array<double>"))
    x = np.array([r[v] for r in df.where(F.col(v).isNotNull()).orderBy(*by_hash(key, seed)).limit(sample).select(v).collect()])
    label = ward_labels(x, k) if len(x) else np.zeros(0, dtype=int)
    return assign(df, v, [x[label == c].mean(0).tolist() for c in np.unique(label)])


def ward_sweep(df: DataFrame, key: str, v: str, ks: list[int], runs: int = 5, sample: int = 500) -> list[dict]:
    """Mean and deviation (population) of Davies-Bouldin and Calinski-Harabasz over samples, for each k; best: the least Davies-Bouldin."""
    out = []
    for k in ks:
        got = []
        for s in range(runs):
            labelled = materialize(ward(df.select(key, v), key, v, k, sample, s), "ward")
            got.append(cluster_quality(labelled, "cluster", v).first())
            release(labelled)
        row = {"k": k}
        for c in ("davies_bouldin", "calinski_harabasz"):
            xs = [g[c] for g in got if g[c] is not None]
            row |= {c: float(np.mean(xs)) if xs else None, f"{c}_std": float(np.std(xs)) if xs else None}
        out.append(row)
    low = min((r["davies_bouldin"] for r in out if r["davies_bouldin"] is not None), default=None)
    return [{**r, "best": low is not None and r["davies_bouldin"] == low} for r in out]


def kmeans_sweep(df: DataFrame, key: str, v: str, ks: list[int], iterations: int = 10) -> dict:
    """rows (k, davies_bouldin, calinski_harabasz, silhouette, inertia), best by silhouette and by Davies-Bouldin (ties to the smaller k),
    and the elbow: the k where the inertia's fall slows most."""
    out = []
    for k in ks:
        centers = kmeans_centers(df, key, v, k, iterations)
        labelled = materialize(assign(df.select(key, v), v, centers), "labelled")
        q = cluster_quality(labelled, "cluster", v).first()
        out.append({"k": k, **q.asDict(), "silhouette": silhouette(labelled, key, v, "cluster").first()[0], "inertia": inertia(df, v, centers)})
        release(labelled)
    fall = {out[i]["k"]: out[i - 1]["inertia"] - 2 * out[i]["inertia"] + out[i + 1]["inertia"] for i in range(1, len(out) - 1)}
    return {
        "rows": out, "by_silhouette": max(out, key=lambda r: (r["silhouette"] or -1, -r["k"]))["k"], "by_davies_bouldin": min(out, key=lambda r: (math.inf if r["davies_bouldin"] is None else r["davies_bouldin"], r["k"]))["k"],
        "elbow": max(fall, key=lambda k: (fall[k], -k)) if fall else None,
    }


def dbscan_grid(df: DataFrame, key: str, v: str, eps: list[float], least: list[int], y: str | None = None) -> list[dict]:
    """Clusters, noise share and score of each setting, and which is best (ties to the first). The score is the adjusted Rand index
    against y, if given, else the silhouette (noise counts as a cluster; 0 where it isn't defined), less 0.01 for each cluster over ten and
    half of the noise share over 0.3. One table of pairs, at the greatest eps, serves all."""
    pairs = eps_pairs(df, key, v, max(eps))
    out = []
    for e in eps:
        for m in least:
            labels = materialize(dbscan(df, key, v, e, m, pairs), "labels")
            r = labels.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"), F.avg((F.col("cluster") < 0).cast("int")).alias("noise"), F.count_distinct("cluster").alias("all")).first()
            noise = r["noise"] or 0.0
            if y is not None:
                main = agreement(labels.join(df.select(key, y), key), y, "cluster").first()["ari"]
            else:
                main = silhouette(labels.join(df.select(key, v), key), key, v, "cluster").first()[0] if r["all"] > 1 else 0.0
            out.append({"eps": e, "min_samples": m, "clusters": r["k"], "noise": noise, "main": main or 0.0, "score": (main or 0.0) - max(0, r["k"] - 10) * 0.01 - max(0.0, noise - 0.3) * 0.5})
            release(labels)
    top = max((r["score"] for r in out), default=None)
    first = next((i for i, r in enumerate(out) if r["score"] == top), None)
    return [{**r, "best": i == first} for i, r in enumerate(out)]


# models of Spark's own library
def fit_model(df: DataFrame, columns: list[str], y: str, kind: str = "forest", weight: str | None = None, **kw):
    """A fitted pipeline: "forest", "boosted" or "logistic"; its transform adds probability and prediction."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    one = {"forest": RandomForestClassifier, "boosted": GBTClassifier, "logistic": LogisticRegression}[kind]
    more = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__x"), one(featuresCol="__x", labelCol=y, **more, **kw)]).fit(df)


def predict(model, df: DataFrame) -> DataFrame:
    """df with proba, the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*df.columns, vector_to_array("probability")[1].alias("proba"))


def predict_row(model, spark, row: dict) -> float:
    return predict(model, spark.createDataFrame([{k: float(x) for k, x in row.items()}])).first()["proba"]


def importances(model, columns: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, best first."""
    v = model.stages[-1].featureImportances.toArray()
    return sorted(((c, float(x)) for c, x in zip(columns, v, strict=True)), key=lambda r: (-r[1], r[0]))


def cross_validate(df: DataFrame, columns: list[str], y: str, key: str, k: int = 5, kind: str = "forest", seed: int = 0, **kw) -> DataFrame:
    """(fold, roc_auc, average_precision) of a model trained on the other folds, for each fold with both classes."""
    dealt = materialize(stratified_folds(df.select(key, y, *columns), y, key, k, seed), "folds")
    out = None
    for f in range(k):
        rest, held = dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f)
        part = predict(fit_model(rest, columns, y, kind, **kw), held).select("fold", y, "proba")
        out = part if out is None else out.unionByName(part)
    return ranking_metrics(materialize(out, "held-out"), y, "proba", ["fold"])
