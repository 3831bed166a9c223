"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

A document and a benchmark item are candidates if they share a seed, `seed` consecutive lower-cased words. For each
candidate the longest common run of unmarked words, of at least `seed` words, is marked as a tile, again and again (ties: item
position, then document position), until none is left. The length of the longest run is found by bisection: Karp-Rabin
hashes of all unmarked windows of a length, from running sums, tell whether the two texts share one; all tiles of that length
are marked in one go. Tiles don't overlap in either text, and their order is free, so a passage cut into blocks
and dealt out in another order is caught. An item is in a document if tiles cover `coverage` of its words. An item of fewer
than `seed` words is one seed, all its words.

Benchmark items go to the tasks in blocks of at most `block_words` words. Between two blocks what is known so far is written,
and a block's broadcast is dropped, so the driver and a task hold one block whatever the size of the benchmark. Documents are not
shuffled. An item's words whose seeds stand in the document bound its coverage; items whose bound can't change the result
are not tiled.

Null or empty text matches nothing; an item without words is in no document. An item of null item_id is matched too, and its
id in the array is null. Null doc_id and repeated rows: a row each. Items that tie in coverage are all in the array, by id.
Empty tables: no rows, or nothing contaminated. Very long texts are tiled whole; only stretches around seeds are looked at.
Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, ngram_hashes, release, texts_of, word_hashes

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Text:
    """A word sequence with the running sums of its Karp-Rabin hash and the words that no tile holds yet."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words) * _powers(BASE, len(words))[:-1])))
        self.down = _powers(INVERSE, len(words))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the unmarked windows of n words."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.down[at]


def _tiles(item: np.ndarray, doc: np.ndarray, free: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles of two sequences of word hashes; words of doc that are not free belong to no tile."""
    a, b = _Text(item, np.ones(len(item), dtype=bool)), _Text(doc, free.copy())
    tiles: list[tuple[int, int, int]] = []
    high = min(len(item), len(doc))

    def shared(n: int) -> bool:
        return bool(np.isin(a.windows(n)[1], b.windows(n)[1]).any())

    while high >= seed and shared(seed):
        low = seed
        while low < high:
            mid = (low + high + 1) // 2
            if shared(mid):
                low = mid
            else:
                high = mid - 1
        (at_a, x), (at_b, y) = a.windows(low), b.windows(low)
        order = np.lexsort((at_b, y))
        at_b, y = at_b[order], y[order]
        pick = np.isin(x, y)
        for i, s, e in zip(at_a[pick].tolist(), np.searchsorted(y, x[pick]).tolist(), np.searchsorted(y, x[pick], side="right").tolist(), strict=True):
            if not a.free[i : i + low].all():
                continue
            at = at_b[s:e]
            if len(at) > 1:
                taken = np.concatenate(([0], np.cumsum(~b.free)))
                at = at[taken[at + low] == taken[at]]
            for d in at.tolist():
                if b.free[d : d + low].all() and np.array_equal(item[i : i + low], doc[d : d + low]):
                    a.free[i : i + low] = b.free[d : d + low] = False
                    tiles.append((i, d, low))
                    break
        high = low - 1
    return tiles


def greedy_tiles(item: list, doc: list, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, length), by marking longest common unmarked runs; None in doc matches nothing."""
    seed = min(seed, len(item))
    if not seed or len(doc) < seed:
        return []
    number: dict = {}
    a = np.array([number.setdefault(w, len(number)) for w in item], dtype=np.uint64)
    known = np.array([w is not None and w in number for w in doc])
    b = np.array([number[w] if k else 0 for w, k in zip(doc, known.tolist(), strict=True)], dtype=np.uint64)
    return _tiles(a, b, known, seed)


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Lists of (item_id, text) of at most block_words words in all (one item at least)."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    held, size = [], 0
    for r in rows.toLocalIterator():
        n = len(words_of(r["text"].encode()))
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield held


class Finder:
    """Benchmark items with a sorted table of their seeds, ready to be looked up in documents."""

    def __init__(self, block: list[tuple], seed: int):
        self.seed, self.ids, self.words = seed, [], []
        rows: dict[int, list] = {}
        for i, t in block:
            if w := words_of(t.encode()):
                a, n = word_hashes(w), min(seed, len(w))
                g = ngram_hashes(a, n)
                rows.setdefault(n, []).append((g, np.full(len(g), len(self.ids), np.int32), np.arange(len(g), dtype=np.int32)))
                self.ids.append(i)
                self.words.append(a)
        #: seed length -> (hashes, items, positions), sorted by hash
        self.seeds: dict[int, tuple] = {}
        for n, parts in rows.items():
            g, k, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            self.seeds[n] = g[order], k[order], p[order]

    def _candidates(self, a: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """(words that seeds cover, item, seed length, places of its seeds in the document) of every item with a seed in it."""
        out = []
        for n, (h, item, place) in self.seeds.items():
            g = ngram_hashes(a, n)
            s = np.searchsorted(h, g)
            s[s == len(h)] = 0
            hits = np.flatnonzero(h[s] == g)
            if not len(hits):
                continue
            hits = hits[np.argsort(g[hits], kind="stable")]
            found, first = np.unique(g[hits], return_index=True)
            ends = np.append(first[1:], len(hits))
            low, high = np.searchsorted(h, found), np.searchsorted(h, found, side="right")
            size = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            which = np.repeat(np.arange(len(found)), size)
            order = np.lexsort((place[rows], item[rows]))
            rows, which = rows[order], which[order]
            edge = np.flatnonzero(np.diff(item[rows])) + 1
            for at, w in zip(np.split(rows, edge), np.split(which, edge), strict=True):
                covered = int(np.minimum(np.diff(place[at]), n).sum()) + n
                places = np.concatenate([hits[first[x] : ends[x]] for x in np.unique(w).tolist()])
                out.append((covered, int(item[at[0]]), n, np.sort(places)))
        return out

    def covered(self, text: bytes | None, coverage: float, best: float = 0.0) -> tuple[float, list[tuple[int, int, int]]]:
        """The greatest share of an item that tiles cover, `best` at least; and (item_id, covered words, words) of every item that reaches the coverage."""
        doc = words_of(text)
        if not doc:
            return best, []
        a = word_hashes(doc)
        hit = []
        for most, k, n, places in sorted(self._candidates(a), key=lambda c: -c[0] / len(self.words[c[1]])):
            item = self.words[k]
            if most < coverage * len(item) and most / len(item) <= best:
                break  # the others' bounds are no greater
            near, gap = _near(a, places, n)
            got = sum(x for *_, x in _tiles(item, near, gap, n))
            best = max(best, got / len(item))
            if got >= coverage * len(item):
                hit.append((self.ids[k], got, len(item)))
        return best, sorted(hit, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))


def _near(doc: np.ndarray, hits: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that seeds at `hits` hold, with one word that is not free between such stretches: no tile lies elsewhere."""
    held = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(held, hits, 1)
    np.add.at(held, hits + seed, -1)
    inside = np.cumsum(held)[:-1] > 0
    keep = inside | np.concatenate(([False], inside[:-1]))
    return doc[keep], inside[keep]


def _each_block(docs: DataFrame, benchmark: DataFrame, block_words: int, step) -> DataFrame:
    """step(frame, broadcast block) for each block of items in turn; the frame is written between two blocks."""
    last = shared = None
    for block in item_blocks(benchmark, block_words):
        if shared is not None:
            docs, old = materialize(docs, "blocks"), last
            shared.destroy()
            if old is not None:
                release(old)
            last = docs
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = step(docs, shared)
    return docs


ITEMS = "array<struct<item_id: long, covered: int, words: int>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, max_coverage, items array of (item_id, covered, words), contaminated) for each row; items reach the coverage."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int32()), ("words", pa.int32())]))

    def step(frame: DataFrame, table) -> DataFrame:
        def run(batches):
            finder = Finder(table.value, seed)
            for b in batches:
                best, hit = b.column("max_coverage").to_pylist(), b.column("items").to_pylist()
                for r, t in enumerate(texts_of(b.column("text"))):
                    best[r], more = finder.covered(t, coverage, best[r])
                    hit[r] += [{"item_id": i, "covered": c, "words": n} for i, c, n in more]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(best, pa.float64()), pa.array([sorted(h, key=lambda x: (x["item_id"] is None, x["item_id"] or 0)) for h in hit], item_kind)], names=["doc_id", "text", "max_coverage", "items"])

        return frame.mapInArrow(run, f"doc_id {kind}, text string, max_coverage double, items {ITEMS}")

    out = docs.select("doc_id", "text", F.lit(0.0).alias("max_coverage"), F.array().cast(ITEMS).alias("items"))
    return _each_block(out, benchmark, block_words, step).drop("text").withColumn("contaminated", F.size("items") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all their columns, of which no item reaches the coverage."""

    def step(frame: DataFrame, table) -> DataFrame:
        def run(batches):
            finder = Finder(table.value, seed)
            for b in batches:
                # with `best` infinite only items whose bound reaches the coverage are tiled
                keep = [not finder.covered(t, coverage, math.inf)[1] for t in texts_of(b.column("text"))]
                yield b.filter(pa.array(keep, pa.bool_()))

        return frame.mapInArrow(run, frame.schema)

    return _each_block(docs, benchmark, block_words, step)
