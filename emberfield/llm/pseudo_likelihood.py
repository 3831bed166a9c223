"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from `side` words on both sides of it, itself masked: the sum of position-wise embeddings of the
context, tanh, then a softmax over classes of words and one over the words of the class. A document's score is the sum of
its words' conditional log-probabilities.

The vocabulary and its classes come from the counts of all words of the corpus (summed map-side); other words are dealt
to `rare` buckets by a hash. Vocabulary, classes and buckets grow with the square root of the distinct words. A rare word's
probability is its bucket's, from the network, times its share of the bucket's counts; a bucket's unseen words share one
count more. So the probabilities of all words at a place sum to 1. Shares of up to `held` of the most frequent words are
broadcast, those of others come by a join on hashes of words.

The network is trained in numpy: it starts on a bounded sample of documents (`sample_docs`, `positions`). Then come `rounds`
passes, each over the documents of one remainder of a hash, so that every document trains once: every task goes on from the
network of the round before with all documents of its part, and the tasks' changes are averaged by the places that they saw. So
training grows with the corpus, and what comes back to the driver in a round is one network, whose size is bounded by the
vocabulary (about 1 MB for 2,000 words). Scoring is one narrow map and the join of the rarest words.

Words are runs without ASCII white space, A-Z lower-cased. Null or empty text: 0 words, log-probability 0, mean null.
Null doc_id and repeated rows: a row each. An empty table: no rows. Very long texts are hashed in pieces and scored whole, about 200,000
words of a task at a time or one document. Words are known by a 64-bit hash; those that tie in frequency enter the
vocabulary by it. Other columns may have any name.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, hash_sample, materialize, mix, release, texts_of

#: Bytes that are looked at together, and the base of the words' hashes.
PIECE, BASE = 1 << 19, 0x9E3779B97F4A7C15
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
VALUE = mix(np.arange(1, 257, dtype=np.uint64))
VALUE[ord("A") : ord("Z") + 1] = VALUE[ord("a") : ord("z") + 1]
GAP = re.compile(rb"[ \t-\r]")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


UP, DOWN = _powers(BASE, PIECE), _powers(pow(BASE, -1, 1 << 64), PIECE)


def _piece_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of at most PIECE bytes: a polynomial in their bytes, whatever the case of A-Z."""
    x = np.frombuffer(raw, dtype=np.uint8)
    inside = np.concatenate(([False], ~SPACE[x], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(VALUE[x] * UP[: len(x)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * DOWN[start] + (end - start).astype(np.uint64))


def _long_hash(word: bytes) -> np.ndarray:
    """The same hash of one word of any length, a piece at a time."""
    total, shift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(word), PIECE):
        x = np.frombuffer(word[at : at + PIECE], dtype=np.uint8)
        total += shift * (VALUE[x] * UP[: len(x)]).sum(dtype=np.uint64)
        shift *= UP[len(x)]
    return mix(total + np.uint64(len(word)))


def text_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words, in their order; memory is bounded by PIECE and the result."""
    out, at, text = [], 0, text or b""
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # between two words, or after one that is longer than a piece
            gap = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if gap <= at:
                m = GAP.search(text, at + 1)
                end = m.start() if m else len(text)
                word = text[at:end].strip(b" \t\n\r\v\f")
                out.append(_long_hash(word) if word else np.empty(0, np.uint64))
                at = end
                continue
            end = gap
        out.append(_piece_hashes(text[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Held:
    """Hashes of the words of some documents, until they are looked at together. Short texts are hashed side by side."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.size = self.words = 0
        self.hashes: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, text: bytes | None) -> int:
        """Words that are held, about: texts that wait to be hashed count by their bytes."""
        text = text or b""
        if self.texts and self.size + len(text) >= PIECE:
            self._hash()
        self.texts.append(text)
        self.size += len(text) + 1
        return self.words + self.size // 6

    def _hash(self) -> None:
        if len(self.texts) == 1:
            h = text_hashes(self.texts[0])
            n = np.array([len(h)], dtype=np.int64)
        else:
            start, h = _piece_hashes(b" ".join(self.texts))
            edge = np.cumsum([0] + [len(t) + 1 for t in self.texts])
            n = np.diff(np.searchsorted(start, edge))
        self.hashes.append(h)
        self.lengths.append(n)
        self.words += len(h)
        self.texts, self.size = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the documents' lengths."""
        if self.texts:
            self._hash()
        out = np.concatenate([np.empty(0, np.uint64), *self.hashes]), np.concatenate([np.empty(0, np.int64), *self.lengths])
        self.__init__()
        return out


def word_counts(docs: DataFrame, flush: int = 1 << 18) -> DataFrame:
    """(h, n): counts of all words of all documents, by their hash; a task holds about `flush` words at once."""

    def run(batches):
        held = Held()

        def out():
            h, n = np.unique(held.take()[0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(n)], names=["h", "n"])

        for b in batches:
            for t in texts_of(b.column("text")):
                if held.add(t) >= flush:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int, counts: DataFrame | None = None) -> tuple[list, int]:
    """The `most` most frequent words (ties: smaller hash) as rows (h, n), and the count of all words. Bands of counts tell
    first how frequent a word must be, so that tasks send the driver little more than those words."""
    own = counts is None
    if own:
        counts = materialize(word_counts(docs), "word-counts")
    band = F.floor(F.log2("n") * 8)
    left, least, total = most, 0, 0
    for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("band")).collect():
        if left > 0:
            left, least = left - r["words"], r["band"]
        total += r["n"]
    top = counts.where(band >= least).orderBy(F.desc("n"), "h").limit(most).collect()
    if own:
        release(counts)
    return top, total


def _looked_up(h: np.ndarray, keys: np.ndarray, values: np.ndarray, other) -> np.ndarray:
    """values of sorted keys for each h, `other` where there is none."""
    if not len(keys):
        return np.broadcast_to(other, h.shape)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, values[at], other)


class WordIds:
    """Ids of words from their hashes: the place in the vocabulary; other words go to hashed buckets after it."""

    def __init__(self, vocabulary: np.ndarray, rare: int):
        self.n, self.rare = len(vocabulary), rare
        self.order = np.argsort(vocabulary)
        self.hashes = vocabulary[self.order]

    def of(self, h: np.ndarray) -> np.ndarray:
        return _looked_up(h, self.hashes, self.order, self.n + (h % np.uint64(self.rare)).astype(np.int64))


class WindowNetwork:
    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, rare_count: int, side: int = 2, width: int = 24, rare: int = 64, classes: int = 40, seed: int = 7):
        self.vocabulary, self.side, self.rare = vocabulary, side, rare
        size = len(vocabulary) + rare
        mass = np.concatenate((counts, np.full(rare, rare_count / rare))).astype(float) + 1
        order = np.argsort(-mass, kind="stable")
        # classes of equal square-rooted mass, from the most frequent words down
        share = np.cumsum(np.sqrt(mass[order]))
        self.cls = np.empty(size, dtype=np.int64)
        self.cls[order] = np.minimum(classes - 1, (share / share[-1] * classes).astype(int))
        used, self.cls = np.unique(self.cls, return_inverse=True)
        self.members = [np.flatnonzero(self.cls == c) for c in range(len(used))]
        self.place = np.empty(size, dtype=np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        rng = np.random.default_rng(seed)
        f = np.float32
        self.pad = size
        #: of a word, side by side, what it adds to the hidden units of each neighbour that it is an offset away from
        self.emb = rng.normal(0, 0.1, (size + 1, 2 * side * width)).astype(f)
        per_class = np.array([mass[m].sum() for m in self.members])
        # words in the order of classes, and where each class begins
        by_rank = np.concatenate(self.members)
        self.rank = np.empty(size, dtype=np.min_scalar_type(size))
        self.rank[by_rank] = np.arange(size)
        self.begin = np.cumsum([0] + [len(m) for m in self.members])
        #: weights of classes, and of words in the order of rank; the last of each row is the bias
        layer = lambda p: np.column_stack((rng.normal(0, 0.1, (len(p), width)), np.log(p))).astype(f)
        self.top = layer(per_class / per_class.sum())
        self.low = layer(mass[by_rank] / np.repeat(per_class, np.diff(self.begin)))

    def ids(self) -> WordIds:
        return WordIds(self.vocabulary, self.rare)

    def offsets(self) -> list[int]:
        return [o for o in range(-self.side, self.side + 1) if o]

    def hidden(self, padded: np.ndarray, low: int, high: int) -> np.ndarray:
        """Hidden units, and a 1 for the bias, of all places from low up to high, which have `side` entries around them."""
        side, width = self.side, self.top.shape[1] - 1
        e = self.emb.take(padded[low - side : high + side], axis=0, mode="clip")
        h = np.ones((high - low, width + 1), dtype=np.float32)
        x = e[: high - low, :width].copy()
        for k, o in enumerate(self.offsets()[1:], 1):
            x += e[side + o : side + o + high - low, k * width : (k + 1) * width]
        np.tanh(x, out=h[:, :-1])
        return h

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order of words by class and place in it, their ranks so, and (class, start, end) of each class in it."""
        rank = self.rank[y]
        order = np.argsort(rank, kind="stable")  # by radix, as ranks are small integers
        rank = rank[order].astype(np.int64)
        edge = np.searchsorted(rank, self.begin).tolist()
        return order, rank, [(k, s, e) for k, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > s]

    @staticmethod
    def _exponentials(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
        """exp of all logits, their sums by row, and what was taken off each row's logits before: nothing, unless a sum would
        leave the range of its type."""
        z = h @ w.T
        np.exp(z, out=z)
        total = z.sum(axis=1)
        if 1e-30 < total.min() and total.max() < 1e30:
            return z, total, 0.0
        z = h @ w.T
        off = z.max(axis=1)
        z -= off[:, None]
        np.exp(z, out=z)
        return z, z.sum(axis=1), off

    def log_probs(self, padded: np.ndarray, at: np.ndarray, step: int = 8192) -> np.ndarray:
        """log p(word at each place | its context); places ascend."""
        out = np.empty(len(at), dtype=np.float64)
        with np.errstate(over="ignore"):
            for low in range(0, len(at), step):
                places = at[low : low + step]
                h = self.hidden(padded, places[0], places[-1] + 1)[places - places[0]]
                order, rank, classes = self._by_class(padded[places])
                h = h[order]
                _, total, off = self._exponentials(h, self.top)
                picked = np.repeat([k for k, *_ in classes], [e - s for _, s, e in classes])
                lp = np.einsum("ij,ij->i", h, self.top[picked]) - off - np.log(total)
                for k, s, e in classes:
                    if self.begin[k + 1] - self.begin[k] > 1:
                        _, total, off = self._exponentials(h[s:e], self.low[self.begin[k] : self.begin[k + 1]])
                        lp[s:e] += np.einsum("ij,ij->i", h[s:e], self.low[rank[s:e]]) - off - np.log(total)
                out[low + order] = lp
        return out

    def train(self, padded: np.ndarray, at: np.ndarray, epochs: int = 2, batch: int = 8192, rate: float = 1.0) -> None:
        """Stochastic gradient ascent on the masked log-likelihood of ascending places, in batches of neighbouring places; without
        places the network stays as it is. A word's share of a batch bounds how far its embedding moves."""
        for epoch in range(epochs if len(at) else 0):
            with np.errstate(over="ignore"):
                for part in np.array_split(at, max(1, math.ceil(len(at) / batch))):
                    self._step(padded, part, np.float32(rate / (1 + epoch)))

    def _step(self, padded: np.ndarray, part: np.ndarray, step: np.float32) -> None:
        width, side = self.top.shape[1] - 1, self.side
        low, high = int(part[0]), int(part[-1]) + 1
        order, rank, classes = self._by_class(padded[part])
        rows = (part - low)[order]
        h = self.hidden(padded, low, high)[rows]

        def errors(x, w, scale):
            """What all words but the right one add to the gradient of the hidden units; moves w by what they add to its own."""
            z, total, _ = self._exponentials(x, w)
            share = x / total[:, None]
            g = z @ w
            g *= share[:, -1:]  # the last entry of x is 1
            w -= scale * (z.T @ share)
            return g

        # the right words and classes: rows come sorted by them
        first = np.flatnonzero(np.diff(rank, prepend=-1))
        inside = np.repeat(np.arange(len(first)), np.diff(first, append=len(rank)))
        sums = np.stack([np.bincount(inside, x) for x in h.T.copy()], axis=1).astype(np.float32)
        word, starts, names = rank[first], [s for _, s, _ in classes], [k for k, *_ in classes]
        group = np.searchsorted(first, starts)
        scale = step / np.maximum(np.diff(starts, append=len(rank)), 256).astype(np.float32)
        scale *= np.diff(self.begin)[names] > 1  # a class of one word has nothing to tell
        single = np.repeat(scale > 0, np.diff(starts, append=len(rank)))
        g = -self.low.take(rank, axis=0) * single[:, None]
        g -= np.repeat(self.top[names], np.diff(starts, append=len(rank)), axis=0)
        g += errors(h, self.top, step / np.float32(len(part)))
        for (k, s, e), by in zip(classes, scale, strict=True):
            if by > 0:
                g[s:e] += errors(h[s:e], self.low[self.begin[k] : self.begin[k + 1]], by)
        self.low[word] += sums * np.repeat(scale, np.diff(group, append=len(word)))[:, None]
        self.top[names] += np.add.reduceat(sums, group, axis=0) * (step / np.float32(len(part)))
        # embeddings: each word's share of the errors around it, summed by word
        g *= 1 - h * h
        errors_at = np.zeros((width, high - low), dtype=np.float32)
        errors_at[:, rows] = g[:, :-1].T
        seen = padded[low - side : high + side]
        times = np.bincount(seen, minlength=self.pad + 1)
        words = np.flatnonzero(times)
        number = np.zeros(self.pad + 1, dtype=np.int64)
        number[words] = np.arange(len(words))
        seen = number[seen]
        move = np.empty((len(words), self.emb.shape[1]), dtype=np.float32)
        for k, o in enumerate(self.offsets()):
            around = seen[side + o : side + o + high - low]
            for j in range(width):
                move[:, k * width + j] = np.bincount(around, errors_at[j], len(words))
        self.emb[words] -= move * (step / np.maximum(32, times[words])).astype(np.float32)[:, None]

    def weights(self) -> list[np.ndarray]:
        return [self.emb, self.top, self.low]

    def flat(self) -> np.ndarray:
        """All weights in one new array."""
        return np.concatenate([x.ravel() for x in self.weights()])

    def add(self, change: np.ndarray) -> None:
        """Adds a change, in the order of flat(), to the weights."""
        low = 0
        for x in self.weights():
            x += change[low : low + x.size].reshape(x.shape)
            low += x.size

    def padded(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents, their words' ids in a row, in one array with `side` pads around each; and the places of their words."""
        gaps = self.side * np.repeat(np.arange(1, len(lengths) + 1), lengths)
        places = np.arange(len(ids)) + gaps
        out = np.full(len(ids) + self.side * (len(lengths) + 1), self.pad, dtype=np.int64)
        out[places] = ids
        return out, places


def refine(docs: DataFrame, net: WindowNetwork, rounds: int = 4, held_words: int = 100_000, cells: int = 4096) -> WindowNetwork:
    """The network after every document trained it once, in `rounds` averaged passes over parts by a hash of id and text. A task
    holds `held_words` words and a document at once, and sends its change in pieces of `cells` weights, which are summed
    by piece in 64 bits; a sum's task holds no more than one network."""
    net = copy.deepcopy(net)
    for k in range(rounds):
        part = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(rounds)) == k
        _averaged(docs.where(F.col("text").isNotNull() & part).select("text"), net, held_words, cells)
    return net


def _averaged(some: DataFrame, net: WindowNetwork, held_words: int, cells: int) -> None:
    """Moves the network by what the tasks learn from `some`, averaged."""
    spark = some.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def learn(batches):
        net = copy.deepcopy(shared.value)
        before, ids, seen, held = net.flat(), net.ids(), 0, Held()

        def flush():
            h, lengths = held.take()
            padded, at = net.padded(ids.of(h), lengths)
            net.train(padded, at, epochs=1)
            return len(at)

        for b in batches:
            for t in texts_of(b.column("text")):
                if held.add(t) >= held_words:
                    seen += flush()
        seen += flush()
        if seen:
            change = net.flat() - before
            parts = [change[low : low + cells].tobytes() for low in range(0, len(change), cells)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["piece", "seen", "change"])

    def add(batches):
        seen: Counter = Counter()
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n, raw in zip(*(b.column(c).to_pylist() for c in ("piece", "seen", "change")), strict=True):
                x = np.frombuffer(raw, dtype=np.float32) * np.float64(n)
                total[k] = total[k] + x if k in total else x
                seen[k] += n
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([(total[k] / seen[k]).astype(np.float32).tobytes() for k in keys], pa.binary())], names=["piece", "change"])

    changes = some.mapInArrow(learn, "piece int, seen long, change binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sorted(changes.repartition(parts, "piece").mapInArrow(add, "piece int, change binary").collect())
    if rows:
        net.add(np.concatenate([np.frombuffer(bytes(r["change"]), dtype=np.float32) for r in rows]))
    shared.destroy()


def sizes(distinct: int) -> dict[str, int]:
    """Sizes of the vocabulary, the buckets and the classes for a number of distinct words."""
    vocabulary = max(2000, math.ceil(2 * math.sqrt(distinct)))
    return {"vocabulary": vocabulary, "rare": max(64, math.ceil(math.sqrt(distinct) / 16)), "classes": round(40 * math.sqrt(vocabulary / 2000))}


def fit(docs: DataFrame, vocabulary: int | None = None, sample_docs: int = 400, positions: int = 150_000, rounds: int = 4, counts: DataFrame | None = None, **kw) -> WindowNetwork:
    """A network for docs(doc_id, text); `rounds` 0 leaves out the passes over the corpus. counts: of word_counts, if at hand. A
    vocabulary that is not given has the size that `sizes` names, with its buckets and classes. The sample is cut
    after the document that reaches `positions` words."""
    counts = materialize(word_counts(docs), "word-counts") if counts is None else counts
    if vocabulary is None:
        kw = sizes(counts.count()) | kw
        vocabulary = kw.pop("vocabulary")
    top, total = frequent_words(docs, vocabulary, counts)
    n = np.array([r["n"] for r in top], dtype=float)
    net = WindowNetwork(np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64), n, int(total - n.sum()), **kw)
    held = Held()
    for _, t in hash_sample(docs, "doc_id", "text", sample_docs) if positions else ():
        if held.add(t.encode()) >= positions:
            break
    h, lengths = held.take()
    net.train(*net.padded(net.ids().of(h), lengths))
    return refine(docs, net, rounds)


class Shares:
    """log p(word | bucket) from the corpus counts: `known` (hashes, logs) for the most frequent words outside the vocabulary;
    `rest` (h, n) has the counts of all words outside the vocabulary by hash, `total` the counts of each bucket."""

    def __init__(self, counts: DataFrame, net: WindowNetwork, held: int):
        ids = net.ids()

        def run(batches):
            for b in batches:
                h, n = b.column("h").to_numpy().view(np.uint64), b.column("n").to_numpy()
                bucket = ids.of(h) - ids.n
                out = bucket >= 0
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h[out])), pa.array(bucket[out].astype(np.int32)), pa.array(n[out])], names=["h", "bucket", "n"])

        self.rest = materialize(counts.mapInArrow(run, "h long, bucket int, n long"), "rare-words")
        self.total = [0] * net.rare
        for r in self.rest.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            self.total[r["bucket"]] = r["n"]
        # whole bands of frequent words, `held` at most
        band, least = F.floor(F.log2("n") * 8), None
        for r in self.rest.groupBy(band.alias("band")).agg(F.count("*").alias("words")).orderBy(F.desc("band")).collect():
            held -= r["words"]
            if held < 0:
                break
            least = r["band"]
        keys, logs = np.empty(0, np.uint64), np.empty(0)
        if least is not None:
            t = self.rest.where(band >= least).toArrow()
            keys = t["h"].to_numpy().view(np.uint64)
            logs = np.log(t["n"].to_numpy() / (np.array(self.total)[t["bucket"].to_numpy()] + 1))
        order = np.argsort(keys)
        self.known = keys[order], logs[order]

    def log_share(self, h, n):
        """The column of log p for a hash and its count, null for an unseen word."""
        whole = F.expr("cast(18446744073709551616 as decimal(20,0))")
        bucket = F.pmod(h.cast("decimal(20,0)") + F.when(h < 0, whole).otherwise(F.lit(0).cast("decimal(20,0)")), F.lit(len(self.total)).cast("decimal(20,0)")).cast("int")
        return F.log(F.coalesce(n, F.lit(1)) / (F.get(F.array(*map(F.lit, self.total)), bucket) + 1))


def score(docs: DataFrame, net: WindowNetwork | None = None, counts: DataFrame | None = None, held: int = 500_000, **kw) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of every row of docs(doc_id, text). counts: of word_counts, for the shares of
    rare words in their buckets; with a network but no counts, a rare word's probability is its bucket's. `held`: 16 bytes each."""
    docs = docs.select("doc_id", "text")
    if net is None:
        counts = materialize(word_counts(docs), "word-counts") if counts is None else counts
        net = fit(docs, counts=counts, **kw)
    shares = None if counts is None else Shares(counts, net, held)
    shared = docs.sparkSession.sparkContext.broadcast((net, shares and shares.known))

    def run(batches):
        net, known = shared.value
        ids, waiting = net.ids(), Held()
        for b in batches:
            n, total, rest, ends = [], [], [], [np.zeros(1, np.int32)]

            def sums(x, lengths):
                edge = np.concatenate(([0], np.cumsum(lengths)))
                run = np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))
                return run[edge[1:]] - run[edge[:-1]]

            def flush():
                h, lengths = waiting.take()
                words = ids.of(h)
                padded, at = net.padded(words, lengths)
                lp = net.log_probs(padded, at)
                open_ = np.zeros(len(h), dtype=bool)
                if known is not None:
                    rare = np.flatnonzero(words >= ids.n)
                    share = _looked_up(h[rare], *known, np.nan)
                    open_[rare] = np.isnan(share)
                    lp[rare] += np.nan_to_num(share)
                n.append(lengths)
                total.append(sums(lp, lengths))
                rest.append(as_long(h[open_]))
                ends.append(ends[-1][-1] + np.cumsum(sums(open_.astype(np.int64), lengths)).astype(np.int32))

            for t in texts_of(b.column("text")):
                if waiting.add(t) > 200_000:
                    flush()
            flush()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(rest), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(total), pa.float64()), lists], names=["doc_id", "n_words", "log_prob", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, n_words long, log_prob double, rest array<long>")
    if shares is not None:
        out = materialize(out.withColumn("row", F.monotonically_increasing_id()), "scores")
        parts = out.select("row", F.explode("rest").alias("h")).join(shares.rest.select("h", "n"), "h", "left")
        more = parts.select("row", shares.log_share(F.col("h"), F.col("n")).alias("p")).groupBy("row").agg(F.sum("p").alias("more"))
        out = out.drop("rest").join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))
