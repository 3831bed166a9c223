"""Near duplicates by bottom-k sketches from one hash function.

1. One pass hashes each document's distinct word shingles; the `k` smallest hashes are its sketch. Documents of equal
   shingle sets are one class with a number of its own, represented by the smallest doc_id.
2. Inverted lists hold retained values -> classes. A class is listed under the rarest of its first
   `index` retained values only. Sketches of linked documents share at least `floor` of those values (below), so by the
   prefix argument they meet in a list of one of the `index - floor + 1` rarest values, in the order (frequency, value),
   and values that many documents share are left out of almost every list.
   A document of up to `index` shingles retains all of them, but a larger partner only some: `least_shared` bounds what
   they share from the numbers of shingles alone.
3. A list of up to `short` classes gives its pairs; the union-sketch estimate of the Jaccard similarity filters them,
   at the binomial floor of the values compared. A longer list gives a star of edges, without a filter.
4. Connected components of these candidate edges are candidate groups: any two linked documents are in one group. Full
   shingle sets verify inside groups by exact integer counts. A group of more than `block` classes is first dealt as blocks
   that each meet the group's `pivots` classes of smallest hash: linear in the group. What is connected by then needs no
   more comparison; blocks of one such component meet only the blocks of other components and of classes that are still
   alone. So a task holds two blocks at most, and a hot group of near copies costs little more than its rows. A task returns a
   spanning forest of its links. Sets are made before they are shuffled, and only for documents that a bitmap of the
   candidates' ids lets pass.
5. Components of those links, over classes and over rows that share a doc_id, give component_id.

Chance of a miss: a linked pair shares fewer than 14 of the 32 smallest values of its union with probability below
1e-8 (binomial, 0.85; at 0.8 `floor` is 11, below 1e-8 also), and falls below the filter's floor of its 64 values with
1e-8 too. Documents of up to 32 shingles are indexed exactly, also for larger partners (where pct is above 50).

Null or empty text, or no words: n_shingles 0, linked with nothing. Null doc_id: component_id null, kept. Rows that
repeat a doc_id, with the same text or another: each is a row of the result; they are one node, which has the links of each of
its texts. Ties in similarity at pct are links. An empty table: no rows. A very long text is one set of hashes in its task.
Columns but doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IdFilter, groups, materialize, mix, ngram_hashes, release, small, smallest_reachable, texts_of, word_hashes

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of all words as one where there are fewer."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    a = word_hashes(words)
    return np.unique(ngram_hashes(a, min(n, len(a))) if len(a) >= n else mix(ngram_hashes(a, len(a)) + np.uint64(len(a))))


def _binomial_floor(k: int, p: float, chance: float = 1e-8) -> int:
    """The largest c with P(Binomial(k, p) < c) <= chance."""
    total, c = 0.0, 0
    while total + (q := math.comb(k, c) * p**c * (1 - p) ** (k - c)) <= chance:
        total += q
        c += 1
    return c


def least_shared(n: int, pct: int, index: int) -> int:
    """Retained values that a document of n <= index shingles shares at least with any linked one. A partner of m > index
    shingles retains `index` of them, of which those that are not shared may all be retained."""
    least = -(-n * pct // 100)
    for m in range(index + 1, n * 100 // pct + 1):
        both = -(-pct * (n + m) // (100 + pct))
        least = min(least, index - (m - both))
    return max(1, least)


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two hashes that name a shingle set."""
    if not len(s):
        return 0, 0
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1))).view(np.int64))


def _sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    def run(batches):
        for b in small(batches):
            sets = [shingle_set(t, shingle) for t in texts_of(b.column("text"))]
            names = [_names(s) for s in sets]
            sketch = [(s[:k] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]  # signed order is the hash's
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[j] for x in names], pa.int64()) for j in (0, 1)), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "n", "h1", "h2", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def _estimate(k: int, p: float):
    """Keeps pairs whose sketches share what a pair of similarity p does but for a chance of 1e-8; pairs come with both sketches."""
    low = [_binomial_floor(n, p) for n in range(k + 1)]

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_numpy(zero_copy_only=False), b.column("sb").to_numpy(zero_copy_only=False), strict=True):
                u = np.union1d(x, y)[: max(k, 1)]
                both = np.intersect1d(x, y, assume_unique=True)
                shared = np.searchsorted(both, u[-1], side="right")
                keep.append(shared >= low[len(u)])
            t = pa.Table.from_batches([b.select(["a", "b"])]).filter(pa.array(keep, pa.bool_()))
            yield from t.to_batches()

    return run


def _forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """(root, member) of the components of n nodes; the root is the smallest index."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(r, x) for x in range(n) if (r := root(x)) != x]


def linked(sets: list[np.ndarray], left: int, pct: int, columns: int = 8192) -> list[tuple[int, int]]:
    """Pairs of indices with 100 * intersection >= pct * union: all pairs if left is 0, else those across that index."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * c >= pct * (size[0] + size[1] - c) else []
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = times[column] > 1  # a value of one set alone is in no intersection
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cut = left or n
    count = np.zeros((cut, n - left), dtype=np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        s, e = np.searchsorted(column, [low, low + columns])
        m = np.zeros((n, columns), dtype=np.float32)
        m[row[s:e], column[s:e] - low] = 1
        count += m[:cut] @ m[left:].T
    count = count.astype(np.int64)
    hit = 100 * count >= pct * (size[:cut, None] + size[None, left:] - count)
    x, y = np.nonzero(hit)
    y = y + left
    return [(int(p), int(q)) for p, q in zip(x, y, strict=True) if p < q]


def _verify(pct: int):
    """A spanning forest of the links of each unit (g, i, j): rows (cid, side, shingles), side 0 for block i and 1 for block j."""

    def run(batches):
        out: list[tuple[int, int]] = []
        for _, t in groups(batches, ["g", "i", "j"]):
            ids, side = t["cid"].to_numpy(), t["side"].to_numpy()
            order = np.lexsort((ids, side))
            raw = t["shingles"].to_pylist()
            sets = [np.frombuffer(raw[k], dtype="<u8") for k in order]
            ids, side = ids[order], side[order]
            # nodes in ascending order, so that a root is the smallest
            rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            by_rank = np.sort(ids, kind="stable")
            left = int((side == 0).sum()) if side[-1] == 1 else 0
            if len(ids) > 1 and (not side[-1] or 0 < left):
                pairs = [(int(rank[x]), int(rank[y])) for x, y in linked(sets, left, pct)]
                out += [(int(by_rank[r]), int(by_rank[x])) for r, x in _forest(pairs, len(ids))]
            if len(out) > 8192:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema=EDGE)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema=EDGE)

    return run


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(docs: DataFrame, pct: int = 85, shingle: int = 5, k: int = 64, index: int = 32, short: int = 64, block: int = 128, pivots: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text); linked: Jaccard >= pct / 100."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    name, t = ["h1", "h2", "n"], pct / 100
    rows = materialize(_sketches(docs, shingle, k), "sketch")
    some = rows.where("n > 0 and doc_id is not null")
    classes = some.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    # the numbers are fixed by the write
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    repeated = materialize(some.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    unique = repeated.isEmpty()

    # the rarest retained values of each class
    retained = classes.select("cid", "n", F.explode(F.slice("sketch", 1, index)).alias("v"))
    often = materialize(retained.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "often")
    floor = _binomial_floor(index, t)
    whole = F.array(*(F.lit(n - least_shared(n, pct, index) + 1) for n in range(1, index + 1)))
    slots = F.when(F.col("n") <= index, F.get(whole, F.col("n").cast("int") - 1)).otherwise(F.lit(index - floor + 1)).cast("int")
    listed = (
        retained.join(often, "v").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
        # values of one class alone come first in the order and need no list
        .withColumn("slots", slots - (F.least(F.lit(index).cast("long"), F.col("n")) - F.size("vs")).cast("int")).where("slots > 0")
        .select("cid", "n", F.explode(F.expr("slice(vs, 1, slots)")).alias("x")).select("cid", "n", "x.v", "x.df")
    )
    listed = materialize(listed, "lists")

    brief = listed.where(F.col("df") <= short).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("cid", "n"))).alias("l")).where("size(l) > 1")
    pairs = (
        brief.select(F.posexplode("l").alias("p", "x"), "l")
        .select(F.col("x.cid").alias("a"), F.col("x.n").alias("na"), F.explode(F.expr("slice(l, p + 2, size(l))")).alias("y"))
        .where(f"100 * least(na, y.n) >= {pct} * greatest(na, y.n)").select("a", F.col("y.cid").alias("b")).distinct()
    )
    s = classes.select("cid", "sketch")
    pairs = pairs.join(s.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = pairs.select("a", "b", "sa", "sb").mapInArrow(_estimate(k, t), "a long, b long")
    long_lists = listed.where(F.col("df") > short)
    hub = materialize(long_lists.groupBy("v").agg(F.min("cid").alias("a")), "hubs")
    stars = long_lists.join(hub, "v").select("a", F.col("cid").alias("b")).where("a <> b")
    member = materialize(smallest_reachable(pairs.unionByName(stars), "candidates").withColumnsRenamed({"node": "cid", "root": "g"}), "members")
    release(often, listed, hub)

    # full sets of the classes in candidate groups
    names = classes.select("cid", *name, F.col("rep").alias("doc_id"))
    sizes = materialize(member.groupBy("g").agg(F.count("*").alias("c")), "sizes")
    groups_ = materialize(member.join(sizes, "g").join(names, "cid"), "groups")
    release(member)

    def with_sets(some: DataFrame) -> DataFrame:
        """(columns of some, shingles): classes with their full sets; `some` has cid, doc_id and the names of sets."""
        wanted = IdFilter(some, "doc_id")

        def sets(batches):
            for b in small(batches):
                pick = pa.array(wanted.passes(b.column("place").to_numpy()))
                found = [shingle_set(x, shingle) for x in texts_of(b.column("text").filter(pick))]
                h = [_names(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").filter(pick), *(pa.array([x[j] for x in h], pa.int64()) for j in (0, 1)), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())],
                    names=["doc_id", *name, "shingles"],
                )

        full = docs.where("doc_id is not null").select("doc_id", "text", wanted.column("doc_id").alias("place")).mapInArrow(sets, "doc_id long, h1 long, h2 long, n long, shingles binary")
        if not unique:  # equal rows: one of them has the set
            full = full.dropDuplicates(["doc_id", *name])
        return full.join(some, ["doc_id", *name]).drop("doc_id", *name)

    def verified(units: DataFrame) -> DataFrame:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        units = units.select("cid", "g", "i", "j", "side", "shingles").repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j")
        return materialize(units.mapInArrow(_verify(pct), "a long, b long"), "links")

    zero = F.lit(0)
    links = verified(with_sets(groups_.where(F.col("c") <= block)).select("*", zero.alias("i"), zero.alias("j"), zero.alias("side")))
    large = groups_.where(F.col("c") > block)
    if not large.isEmpty():
        links = links.unionByName(_large_groups(large, with_sets, verified, block, pivots, 4 * block))
    if not unique:  # rows of one doc_id are one node
        of = some.join(repeated, "doc_id").join(classes.select("cid", *name), name).select("doc_id", "cid").distinct()
        least = materialize(of.groupBy("doc_id").agg(F.min("cid").alias("a")), "least")
        links = links.unionByName(of.join(least, "doc_id").select("a", F.col("cid").alias("b")).where("a <> b"))
    roots = materialize(smallest_reachable(links, "links").withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid"), "reached")
    low = materialize(roots.groupBy("root").agg(F.min("rep").alias("component")), "low")
    roots = roots.join(low, "root").select("cid", "component")

    # every document: its class, the component of the class
    roots = materialize(classes.join(roots, "cid", "left").select(*name, F.coalesce("component", "rep").alias("root")), "roots")
    release(classes, groups_, sizes, repeated, low)
    out = rows.select("doc_id", *name).join(roots, name, "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _large_groups(large: DataFrame, with_sets, verified, block: int, pivots: int, wide: int) -> DataFrame:
    """Links (a, b) inside groups of more than `block` classes; what they connect is all that the group's links connect."""
    share = lambda seed, parts: F.pmod(F.xxhash64("cid", F.lit(seed)), parts).cast("int")
    count = F.ceil(F.col("c") / block).cast("int")
    sets = materialize(with_sets(large), "large-sets")
    # blocks of a group, each with all of its pivots; a pivot is a member of some block as well
    w = Window.partitionBy("g").orderBy(F.xxhash64("cid", F.lit(5)), "cid")
    chosen = materialize(large.select("g", "cid").withColumn("p", F.row_number().over(w)).where(F.col("p") <= pivots).select("g", "cid"), "pivots")
    blocks = materialize(large.select("g", "c").distinct().select("g", F.explode(F.sequence(F.lit(0), count - 1)).alias("i")), "blocks")
    lead = sets.join(chosen, ["g", "cid"], "left_semi").select("g", "cid", "shingles").join(blocks, "g").select("cid", "g", "i", F.lit(0).alias("side"), "shingles")
    units = lead.unionByName(sets.select("cid", "g", share(3, count).alias("i"), F.lit(1).alias("side"), "shingles"))
    links = verified(units.withColumn("j", F.lit(-1)))

    # components of a block or more are whole; the rest of a group are dealt as one part, whose number is -1
    near = materialize(large.select("g", "cid").join(smallest_reachable(links, "pivoted").withColumnRenamed("node", "cid"), "cid", "left"), "near")
    whole = materialize(near.where("root is not null").groupBy("g", "root").agg(F.count("*").alias("size")).where(F.col("size") >= block).select("g", "root", F.col("root").alias("label")), "whole")
    near = materialize(near.join(whole, ["g", "root"], "left").select("g", "cid", F.coalesce("label", F.lit(-1)).alias("label")), "labelled")
    parts = near.groupBy("g", "label").agg(F.ceil(F.count("*") / wide).cast("int").alias("parts"))
    parts = materialize(parts.select("*", F.sum("parts").over(Window.partitionBy("g").orderBy("label")).cast("int").alias("end"), F.sum("parts").over(Window.partitionBy("g")).cast("int").alias("all")), "parts")
    left = near.join(parts.where("label = -1 or `all` > parts"), ["g", "label"]).select("cid", "label", (F.col("end") - F.col("parts")).alias("start"), "end", "all", (F.col("end") - F.col("parts") + share(7, F.col("parts"))).alias("at"))
    others = F.expr("""if(label = -1, sequence(0, `all` - 1),
        concat(if(start > 0, sequence(0, start - 1), cast(array() as array<int>)), if(end < `all`, sequence(end, `all` - 1), cast(array() as array<int>))))""")
    units = sets.select("g", "cid", "shingles").join(left, "cid").withColumn("other", F.explode(others))
    more = verified(units.select("cid", "g", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") > F.col("other")).cast("int").alias("side"), "shingles"))
    release(sets, chosen, blocks, whole, near, parts)
    return links.unionByName(more)


def drop_near_duplicates(docs: DataFrame, pct: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, but those whose group has a smaller doc_id. A doc_id names one document:
    rows that share one stay or go together."""
    gone = near_duplicates(docs, pct, shingle).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
