"""Removal of word passages that occur more than once anywhere in the corpus.

Windows are `window` consecutive words. Each window is named by its minimizer, the smallest hash of the `gram`-word
grams in it, which depends on the window's words alone: equal windows share it. Neighbouring windows of one minimizer
form a run, which is kept as (minimizer, start, length, hash of all its windows).

1. Runs are counted by minimizer, summed map-side. A minimizer that occurs once has no window elsewhere.
2. A repeated minimizer whose runs are all equal settles them: all their windows repeat. So do runs of the other
   repeated minimizers that have an equal run.
3. Of those minimizers, runs that stand alone and one of each set of equal runs give their windows' 128-bit hashes, which
   are counted, summed map-side.
4. Windows that repeat inside one document are found in the pass itself, by sorting its hashes.

What is shuffled is one short row for about every 14 words, and the texts that hold repeats; hot minimizers and windows
meet only in partial sums and in joins whose large side can be split.

remove_references() below streams documents past suffix automata of bounded reference shards. With the corpus itself as
the reference that can't give whole results in bounded memory (the README has figures), so remove_repeats() counts.

Null or empty text: 0 words, hash of the empty string. Null and repeated doc_ids: such rows take part like any others;
rows are told apart by doc_id and a hash of the text, and rows equal in both get the same result. An empty table: no rows. A
very long text is windows of its task, and one list of its spans. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, materialize, mix, ngram_hashes, release, small, texts_of, word_hashes


class SuffixAutomaton:
    """Suffix automaton of one word sequence; separate passages with a unique mark each."""

    def __init__(self, words):
        self.next: list[dict] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def matching(self, words) -> list[int]:
        """For each word the length of the longest match that ends there."""
        out, s, n = [], 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s = self.next[s][w]
                n += 1
            out.append(n)
        return out


def window_hashes(a: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window of a: polynomials by prefix sums over powers and their inverses."""
    n = len(a)
    out = []
    for base, seed in ((0x9E3779B97F4A7C15, 0), (0xD1342543DE82EF95, 0x5851F42D4C957F2D)):
        inverse = pow(base, -1, 1 << 64)
        up = np.full(n, base, dtype=np.uint64)
        up[0] = 1
        down = np.full(n, inverse, dtype=np.uint64)
        down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(a + np.uint64(seed)) * up)))
        out.append(mix((total[window:] - total[:-window]) * down[: n - window + 1]))
    return out[0], out[1]


def _sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    n, have = len(g) - width + 1, 1
    while have * 2 <= width:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    return np.minimum(g[:n], g[width - have : width - have + n])


def runs_of(a: np.ndarray, window: int, gram: int):
    """Minimizer, start, length and content hash of each run; and the windows that repeat inside the document (mask)."""
    h1, _ = window_hashes(a, window)
    low = _sliding_min(ngram_hashes(a, gram), window - gram + 1)
    start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    length = np.diff(np.append(start, len(low)))
    content = mix(np.add.reduceat(mix(h1), start) ^ h1[start] ^ (length.astype(np.uint64) << np.uint64(40)))
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    again = np.zeros(len(h1), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return low[start], start, length, content, again


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [(int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key (d, t) that is never null."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("d"), F.xxhash64("text").alias("t"))


def _passing(docs: DataFrame, wanted: IdFilter) -> DataFrame:
    """The rows of docs, whose column t is not null, that pass a filter of t."""

    def run(batches):
        for b in batches:
            pick = wanted.passes(b.column("place").to_numpy())
            yield b.select(docs_columns).filter(pa.array(pick))

    docs_columns = docs.columns
    return docs.withColumn("place", wanted.column("t")).mapInArrow(run, docs.schema)


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """(d, t, spans array of (start, length) in windows) of _keyed(docs): every window whose words start anywhere else too."""

    def runs(batches):
        for b in small(batches):
            cols: list[list] = [[], [], [], [], [], [], []]
            for d, t, text in zip(b.column("d").to_numpy(), b.column("t").to_numpy(), texts_of(b.column("text")), strict=True):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                low, start, length, content, again = runs_of(word_hashes(words), window, gram)
                n = len(start)
                own = _spans(again)
                for c, x in zip(cols, (np.full(n, d), np.full(n, t), low.view(np.int64), start, length, content.view(np.int64), np.zeros(n, np.int8)), strict=True):
                    c.append(x)
                if own:  # windows that repeat in the document: settled here
                    s, e = np.array(own).T
                    n = len(own)
                    for c, x in zip(cols, (np.full(n, d), np.full(n, t), s, s, e, s, np.ones(n, np.int8)), strict=True):
                        c.append(x)
            if cols[0]:
                kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["d", "t", "m", "s", "n", "f", "own"])

    found = materialize(docs.select("d", "t", "text").mapInArrow(runs, "d long, t long, m long, s int, n int, f long, own byte"), "runs")
    ran = found.where("own = 0").drop("own")
    often = ran.groupBy("m").agg(F.count("*").alias("c"), F.min("f").alias("f1"), F.max("f").alias("f2")).where("c > 1").select("m", (F.col("f1") == F.col("f2")).alias("settled"))
    # sums are written before they are joined: right above an aggregation Spark can't split a hot key's rows
    often = materialize(often, "often")
    kept = materialize(ran.join(often, "m").select("d", "t", "s", "n", "m", "f", "settled"), "kept")
    mixed = kept.where("not settled")
    alike = mixed.groupBy("m", "f").agg(F.count("*").alias("c"), F.min(F.struct("d", "t", "s")).alias("one"))
    alike = materialize(alike, "alike")
    mixed = materialize(mixed.join(alike, ["m", "f"]).select("d", "t", "s", "n", (F.col("c") > 1).alias("copied"), (F.col("one") == F.struct("d", "t", "s")).alias("shown")), "mixed")
    open_runs = mixed.where("shown").groupBy("d", "t").agg(F.collect_set(F.struct("s", "n")).alias("runs"))

    def windows(batches):
        for b in small(batches):
            d, k, s, x, y = [], [], [], [], []
            for doc, t, text, got in zip(b.column("d").to_numpy(), b.column("t").to_numpy(), texts_of(b.column("text")), b.column("runs").to_pylist(), strict=True):
                h1, h2 = window_hashes(word_hashes(text.split()), window)
                at = np.concatenate([np.arange(r["s"], r["s"] + r["n"]) for r in got])
                d.append(np.full(len(at), doc))
                k.append(np.full(len(at), t))
                s.append(at)
                x.append(h1[at])
                y.append(h2[at])
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(v)) for v in (d, k)), pa.array(np.concatenate(s).astype(np.int32)), *(pa.array(np.concatenate(v).view(np.int64)) for v in (x, y))], names=["d", "t", "s", "x", "y"])

    wanted = IdFilter(open_runs, "t")
    longer = _passing(docs.select("d", "t", "text"), wanted).join(open_runs, ["d", "t"])
    w = materialize(longer.mapInArrow(windows, "d long, t long, s int, x long, y long"), "windows")
    twice = w.groupBy("x", "y").agg(F.count("*").alias("c")).where("c > 1").select("x", "y")
    twice = materialize(twice, "twice")
    again = w.join(twice, ["x", "y"], "left_semi").select("d", "t", "s", F.lit(1).alias("n"))
    spans = kept.where("settled").select("d", "t", "s", "n").unionByName(mixed.where("copied").select("d", "t", "s", "n")).unionByName(again).unionByName(found.where("own = 1").select("d", "t", "s", "n"))
    return spans.groupBy("d", "t").agg(F.collect_set(F.struct("s", "n")).alias("spans"))  # equal rows have equal spans: a set stays as small as one row's


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words joined by one space, without those that a repeated window covers."""
    docs = _keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in small(batches):
            n, gone, text = [], [], []
            for t, spans in zip(texts_of(b.column("text")), b.column("spans").to_pylist(), strict=True):
                words = (t or b"").split()
                n.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    s, e = np.array([(x["s"], x["s"] + x["n"] + window - 1) for x in spans]).T
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(n[-1] - len(words))
                text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    # only texts with spans are shuffled to meet them
    spans = materialize(repeated_spans(docs, window, gram), "spans")
    wanted = IdFilter(spans, "t")
    joined = _passing(docs, wanted).join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_text string"

    def plain(batches):  # one worker filters and cuts
        return cut(b.filter(pa.array(~wanted.passes(b.column("place").to_numpy()))) for b in batches)

    rest = docs.select("doc_id", "text", F.lit(None).cast("array<struct<s: int, n: int>>").alias("spans"), wanted.column("t").alias("place"))
    return joined.mapInArrow(cut, schema).unionByName(rest.mapInArrow(plain, schema))


def _shards(reference: DataFrame, shard_words: int, window: int):
    """Lists of words of at most shard_words words, passages apart by a mark; long passages overlap by window - 1 words."""
    held: list = []
    mark = 0
    for r in reference.select("text").where("text is not null").toLocalIterator():
        words = r["text"].encode().split()
        step = max(1, shard_words - window)
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + step + window - 1]
            if len(part) < window:
                continue
            if held and len(held) + len(part) >= shard_words:
                yield held
                held = []
            held += [*part, mark]
            mark += 1
    if held:
        yield held


def remove_references(docs: DataFrame, reference: DataFrame, window: int = 35, shard_words: int = 50_000) -> DataFrame:
    """(doc_id, n_removed, kept_text) of docs(doc_id, text), without maximal spans of at least `window` words that stand in
    reference(text) too. Shards of the reference, bounded in words, go to the tasks as suffix automata in turn, and the
    documents are streamed past each for their matching statistics."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.withColumn("spans", F.array().cast("array<struct<s: int, n: int>>"))
    last = shared = None
    for shard in _shards(reference, shard_words, window):
        if shared is not None:  # between two shards what is known so far is written, so one automaton lives at a time
            out, old = materialize(out, "shards"), last
            shared.destroy()
            if old is not None:
                release(old)
            last = out
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches, shared=shared):
            automaton = SuffixAutomaton(shared.value)
            for b in batches:
                spans = b.column("spans").to_pylist()
                for have, t in zip(spans, texts_of(b.column("text")), strict=True):
                    words = (t or b"").split()
                    if len(words) >= window:
                        long = np.array(automaton.matching(words)) >= window
                        have += [{"s": e - window + 1, "n": n} for e, n in _spans(long)]
                yield b.set_column(b.schema.get_field_index("spans"), "spans", pa.array(spans, b.column("spans").type))

        out = out.mapInArrow(run, out.schema)

    def cut(batches):
        for b in batches:
            gone, text = [], []
            for t, spans in zip(texts_of(b.column("text")), b.column("spans").to_pylist(), strict=True):
                words = (t or b"").split()
                keep = np.ones(len(words), dtype=bool)
                for x in spans:
                    keep[x["s"] : x["s"] + x["n"] + window - 1] = False
                gone.append(int((~keep).sum()))
                text.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_removed", "kept_text"])

    return out.mapInArrow(cut, f"doc_id {kind}, n_removed long, kept_text string")
