"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark columns. Shallow boosted trees on them, grown in numpy over a bounded sample of labelled
rows, give paths; each path is a conjunction of thresholds, a rule. Logistic regression with a lasso penalty weighs the
rules, and those of weight zero go. The rest compile into one Spark column expression, so scoring is a projection: no
join, no shuffle, no Python.

Null text counts as empty. Labels that are null take no part; of rows that repeat a doc_id, one trains for each label it has.
Without labels of both classes the score is the share of label 1 (1 where there is none). A score of exactly 1/2 predicts 1. An
empty table: no rows. A very long text is one row of statistics, in its task. Repeated rows and null doc_ids: a score each. Other
columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> SQL over `x` (the text) and `w` (its words), in statistics that don't depend on the language
STATISTICS = {
    "chars": "cast(length(x) as double)",
    "words": "cast(size(w) as double)",
    "word_length": "length(x) / greatest(size(w), 1)",
    "upper": "regexp_count(x, '[A-Z]') / greatest(length(x), 1)",
    "digits": "regexp_count(x, '[0-9]') / greatest(length(x), 1)",
    "bang": "regexp_count(x, '!') / greatest(size(w), 1)",
    "symbols": "regexp_count(x, '[#$%&*]') / greatest(length(x), 1)",
    "pipes": "regexp_count(x, '[|]') / greatest(size(w), 1)",
    "stops": "regexp_count(x, '[.?]') / greatest(size(w), 1)",
    "commas": "regexp_count(x, ',') / greatest(size(w), 1)",
    "lines": "regexp_count(x, '\\n') / greatest(size(w), 1)",
    "herdan": "ln(size(array_distinct(w)) + 1) / ln(size(w) + 2)",
    "adjacent": "size(filter(w, (v, i) -> i > 0 and v = w[i - 1])) / greatest(size(w), 1)",
}
NAMES = tuple(STATISTICS)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row struct of all columns, stats struct of doubles); columns of any name may come in."""
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    w = F.filter(F.split(x, "[ \\t-\\r]+"), lambda v: v != "")
    out = docs.select(F.struct("*").alias("row"), x.alias("x"), w.alias("w"))
    return out.select("row", F.struct(*(F.expr(sql).cast("double").alias(n) for n, sql in STATISTICS.items())).alias("stats"))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_greater, threshold) hold; not greater means at most."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, stats: str = "stats") -> Column:
        c = F.lit(True)
        for name, greater, cut in self.terms:
            x = F.col(f"{stats}.{name}")
            c = c & ((x > F.lit(cut)) if greater else (x <= F.lit(cut)))
        return c

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, greater, cut in self.terms:
            v = x[:, NAMES.index(name)]
            out &= (v > cut) if greater else (v <= cut)
        return out


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, stats: str = "stats") -> Column:
        z = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(stats), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))


def _paths(x, y, g, h, rows, depth, cuts, terms, out, least) -> np.ndarray:
    """Grows one tree on gradients g and hessians h; adds each node's path to out; returns leaf values per row."""
    value = np.zeros(len(x))
    value[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
    if terms:
        out[Rule(tuple(sorted(terms)))] = None
    if not depth or len(rows) < 2 * least:
        return value
    best = (1e-6, None, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    base = total_g**2 / (total_h + 1)
    for j in range(x.shape[1]):
        col = x[rows, j]
        for cut in cuts[j]:
            left = col <= cut
            n = int(left.sum())
            if n < least or len(rows) - n < least:
                continue
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - base
            if gain > best[0] + 1e-12:
                best = (gain, j, cut)
    if best[1] is None:
        return value
    _, j, cut = best
    for greater in (False, True):
        part = rows[(x[rows, j] > cut) == greater]
        v = _paths(x, y, g, h, part, depth - 1, cuts, [*terms, (NAMES[j], greater, float(cut))], out, least)
        value[part] = v[part]
    return value


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 2, penalty: float = 0.002, steps: int = 800, least: int = 5) -> RuleEnsemble:
    """Paths of boosted trees, then lasso logistic weights by accelerated proximal gradient; classes weigh the same."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(20.0 if not len(y) or y[0] == 1 else -20.0)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25)))
        # between values, so that a threshold doesn't lie on one
        v = np.unique(x[:, j])
        k = np.minimum(np.searchsorted(v, q, side="right"), len(v) - 1)
        cuts.append(np.unique((v[np.maximum(k - 1, 0)] + v[k]) / 2))
    z, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        z += 0.5 * _paths(x, y, weight * (y - p), weight * p * (1 - p), np.arange(len(y)), depth, cuts, [], found, least)
    rules = list(found)
    a = np.column_stack([r.holds(x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    scale = np.maximum(a.std(axis=0), 1e-3)
    mean = a.mean(axis=0)
    b = (a - mean) / scale
    w, c = np.zeros(b.shape[1]), 0.0
    v, cv, t = w.copy(), c, 1.0
    weight = weight / weight.sum()
    rate = 1 / max(1e-9, 0.25 * (1 + (weight[:, None] * b * b).sum()))
    for _ in range(steps):
        r = weight * (1 / (1 + np.exp(-(b @ v + cv))) - y)
        w2 = v - rate * (b.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        c2 = cv - rate * r.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, cv = w2 + (t - 1) / t2 * (w2 - w), c2 + (t - 1) / t2 * (c2 - c)
        w, c, t = w2, c2, t2
    used = np.flatnonzero(np.abs(w) > 1e-9)
    return RuleEnsemble(float(c - (w / scale * mean).sum()), [rules[k] for k in used], [float(w[k] / scale[k]) for k in used])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, **kw) -> RuleEnsemble:
    """Fits on at most sample_rows labelled rows outside the held-out fold, chosen by a hash of doc_id."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 1))
    usable = usable.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("y")).distinct()
    n, place = usable.count(), F.xxhash64("label_id", F.lit(17))
    if n > sample_rows:  # of the smallest hashes, so that tasks send the driver little more than the sample
        usable = usable.where(place < int(-(2**63) + 2**64 * min(1 - 2**-20, (1.2 * sample_rows + 20) / n)))
    few = usable.orderBy(place, "y").limit(sample_rows)
    spark = docs.sparkSession
    few = spark.createDataFrame(few.collect(), "label_id long, y int")
    joined = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(few), "label_id")
    once = with_statistics(joined).groupBy("row.label_id", "row.y").agg(F.min("stats").alias("stats"))
    rows = once.select("label_id", "y", "stats.*").collect()
    rows.sort(key=lambda r: (r["label_id"], tuple(r)))
    x = np.array([[r[n] for n in NAMES] for r in rows], dtype=float).reshape(len(rows), len(NAMES))
    return fit_rules(x, np.array([r["y"] for r in rows], dtype=float), **kw)


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    scored = with_statistics(docs.select("doc_id", "text")).select("row.doc_id", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject."""
    return with_statistics(docs).where(model.column() >= 0.5).select("row.*")
