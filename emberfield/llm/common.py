"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release, shared_dir, ship_code  # noqa: F401

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, key: str, text: str, rows: int, most_bytes: int = 16 << 20) -> list[tuple]:
    """At most `rows` pairs (key, text) of at most `most_bytes` in all (the first may exceed them), in the order of a hash of
    both: the same pairs whatever the partitioning. Equal rows count once. Rows without text are left out.

    Keys and sizes of little more than the sample reach the driver first; texts come for those that stay only.
    """
    some = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("x")).withColumn("h", F.xxhash64("k", "x", F.lit(17)))
    n = some.count()
    if n > rows:
        share = min(1 - 2**-20, (1.2 * rows + 40 + 6 * math.sqrt(rows)) / n)
        some = some.where(F.col("h") < int(-(2**63) + 2**64 * share))
    sizes = some.groupBy("h").agg(F.min(F.octet_length("x")).alias("size")).orderBy("h").limit(rows).collect()
    total, hashes = 0, []
    for r in sizes:
        total += r["size"]
        if hashes and total > most_bytes:
            break
        hashes.append((r["h"],))
    if not hashes:
        return []
    few = df.sparkSession.createDataFrame(hashes, "h long")
    got = some.join(F.broadcast(few), "h").groupBy("h").agg(F.min(F.struct("x", "k")).alias("r")).collect()
    return [(r["r"]["k"], r["r"]["x"]) for r in sorted(got, key=lambda r: r["h"])]


class WordHashes(dict):
    """bytes -> unsigned 64-bit hash. Two generations of at most LIMIT words each: a word that is used again stays."""

    LIMIT = 75_000

    def __init__(self):
        super().__init__()
        self.old: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.old = dict(self)
                self.clear()
            self[word] = h
        return h


WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries of a; empty where a is shorter."""
    m = len(a) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[j : j + m]
    return mix(h)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows, so that a worker holds few texts as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys over batches that come sorted by them; a run may span batches. Keys are not null."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t[k].to_numpy() for k in key]
        change = np.zeros(t.num_rows, dtype=bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist() + [t.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            k = tuple(c[s] for c in cols)
            if last is not None and k != last:
                yield last, pa.concat_tables(held)
                held = []
            last = k
            held.append(t.slice(s, e - s))
    if held:
        yield last, pa.concat_tables(held)


def smallest_reachable(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node reachable.

    Alternating star contraction. Each round is two partial aggregations and two joins on a node, so a hub of any
    degree is summed map-side. The sums are written before they are joined: a join right above an aggregation shares its
    exchange, and Spark can't split a hub's rows there. Nothing goes to the driver but two numbers a round.
    """
    def written(e: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()  # of the write itself, without a job of its own
        e = e.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
        return materialize(e, name), seen.get

    edges, was = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    for _ in range(rounds):
        if not was["n"]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        # every larger neighbour goes to the smallest of the neighbourhood
        large = materialize(both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), name)
        # every smaller neighbour, and the node, go to the smallest
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a")
        small = small.select(F.col("a"), F.col("m").alias("b")).unionByName(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        before = edges
        edges, now = written(small.where("a <> b"))
        release(before, near, large, low)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


class IdFilter:
    """A bitmap of hashed ids: tells for most ids that they are not among some given ones. At most 2^27 bits (16 MB)."""

    def __init__(self, ids: DataFrame, key: str, most_bits: int = 27):
        n = ids.count()
        self.bits = min(most_bits, max(15, math.ceil(math.log2(16 * max(n, 1)))))
        place = F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(29)), F.lit(1 << self.bits))
        words = ids.select(place.alias("p")).where("p > 0").groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b")).collect()
        full = np.zeros(max(1, (1 << self.bits) // 8), dtype=np.uint8)
        size = 4096  # bytes of one of Spark's bitmaps; their bucket numbers begin at 1
        for r in words:
            raw = np.frombuffer(bytes(r["b"]), dtype=np.uint8)
            at = (r["k"] - 1) * size
            full[at : at + len(raw)] |= raw[: len(full) - at]
        self.shared = ids.sparkSession.sparkContext.broadcast(full)

    def column(self, key: str):
        """Where an id's bit is; goes with `passes`."""
        return F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(29)), F.lit(1 << self.bits))

    def passes(self, place: np.ndarray) -> np.ndarray:
        # bit_position(p) is (p - 1) mod 32768 within bucket 1 + (p - 1) div 32768; place 0 has a bucket of its own
        p = place.astype(np.int64) - 1
        full = self.shared.value
        return (p < 0) | ((full[np.maximum(p, 0) >> 3] >> (np.maximum(p, 0) & 7).astype(np.uint8)) & 1).astype(bool)
