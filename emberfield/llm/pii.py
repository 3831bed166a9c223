"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns below give the base spans, leftmost and non-overlapping per kind; a match that its check rejects is dropped
and not retried. Every base span, every rejected match and every looser match is a mention, a node of the document's
field. Neighbouring mentions are joined by a chain; mentions that repeat each other or are alike (same last digits, same
local part), however far apart, are joined by skip edges. Sum-product messages run over the loopy graph with damping;
base mentions are clamped to their kind. Another mention that ends with a kind of marginal probability of at least
`sure` adds its span, unless it overlaps a span that stands.

Weights come from pseudo-likelihood over a bounded sample of documents: base mentions teach, some of them with their
checks hidden, so that the field learns to lean on context and on alike mentions. With few mentions the prior stays.

Scans are linear in the text: an address is sought around each "@", a dotted number only at the head of a digit run.
Null or empty text: no spans. Null doc_id and repeated rows: a row each. Ties (equal spans of two kinds): both stand. An
empty table: no rows, and the prior weights. A very long text is one field of all its mentions; scans, messages and the
overlap test are linear in text and mentions but for sorting. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LABEL = re.compile(r"[A-Za-z0-9-]++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BARE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
DIGITS = re.compile(r"[^0-9]+")
ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mentions(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check): all matches of the base patterns, and looser ones, which never pass."""
    out: list[tuple[str, int, int, bool]] = []
    if not ANY.search(text):
        return out
    at, free = text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        if s < at:
            if m := DOMAIN.match(text, at + 1):
                out.append(("email", s, m.end(), True))
                free = m.end()
            elif m := LABEL.match(text, at + 1):
                out.append(("email", s, m.end(), False))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        out.append(("ip", *m.span(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)))
    for m in CARD.finditer(text):
        d = DIGITS.sub("", m[0])
        if (ok := 13 <= len(d) <= 19 and luhn(d)) or len(d) >= 7:
            out.append(("card", *m.span(), ok))
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append(("phone", *m.span(), 9 <= len(DIGITS.sub("", m[0])) <= 15))
    out += [("phone", *m.span(), False) for m in BARE.finditer(text)]
    return out


def canonical(kind: str, text: str) -> str:
    """Alike mentions share this: the local part of an address, else the last seven digits."""
    return "@" + text.split("@")[0].lower() if kind == "email" else DIGITS.sub("", text)[-7:]


#: Node statistics: bias, passes, proposed kind (4), at most 8 / 9-12 / 13-19 / over 19 digits, a plus, a lead-in sign.
WIDTH = 12


def features(text: str, m: tuple[str, int, int, bool]) -> np.ndarray:
    kind, s, e, ok = m
    x = np.zeros(WIDTH)
    x[0], x[1], x[2 + KINDS.index(kind)] = 1, ok, 1
    n = sum(c.isdigit() for c in text[s : min(e, s + 64)])
    x[6 + (n > 8) + (n > 12) + (n > 19)] = 1
    x[10] = text[s] == "+"
    x[11] = text[max(0, s - 2) : s].strip()[-1:] in (":", "=", "#")
    return x


def graph(text: str, found: list[tuple[str, int, int, bool]], near: int = 200) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours at most `near` apart; skip edges from each mention to the first and the previous alike."""
    chain = [(k, k + 1) for k in range(len(found) - 1) if found[k + 1][1] - found[k][2] <= near]
    alike: dict[str, list[int]] = defaultdict(list)
    skip: list[tuple[int, int]] = []
    for k, (kind, s, e, _) in enumerate(found):
        same = alike[canonical(kind, text[s : min(e, s + 256)])]
        if same:
            skip += {(same[0], k), (same[-1], k)}
        same.append(k)
    return chain, skip


class SkipChain:
    """Weights: unary (labels x WIDTH), the same-label potential of skip edges, and of chain edges."""

    LABELS = 1 + len(KINDS)  # 0 is no entity

    def __init__(self):
        self.unary = np.zeros((self.LABELS, WIDTH))
        self.unary[0, 0] = 2.0
        for k in range(len(KINDS)):
            self.unary[k + 1, 1], self.unary[k + 1, 2 + k] = 3.0, 2.0
            self.unary[0, 1] = -3.0
        self.skip, self.chain = 4.0, 0.0

    def fit(self, texts: list[str], steps: int = 200, rate: float = 0.5, l2: float = 0.01, hide: int = 3) -> SkipChain:
        """Pseudo-likelihood: each label given the others'. Every `hide`-th passing mention hides its check."""
        xs, ys, same_skip, same_chain = [], [], [], []
        for t in texts:
            found = sorted(mentions(t), key=lambda m: (m[1], m[2], m[0]))
            label = [1 + KINDS.index(m[0]) if m[3] else 0 for m in found]
            counts = np.zeros((2, len(found), self.LABELS))
            for which, edges in enumerate(graph(t, found)):
                for a, b in edges:
                    counts[which, a, label[b]] += 1
                    counts[which, b, label[a]] += 1
            for k, m in enumerate(found):
                x = features(t, m)
                if m[3] and len(ys) % hide == 0:
                    x[1] = 0
                xs.append(x)
                ys.append(label[k])
                same_chain.append(counts[0, k])
                same_skip.append(counts[1, k])
        if len(ys) < 50:
            return self
        x, y, s, c = np.array(xs), np.array(ys), np.minimum(np.array(same_skip), 3), np.minimum(np.array(same_chain), 3)
        target = np.eye(self.LABELS)[y]
        start = self.unary.copy()
        for _ in range(steps):
            z = x @ self.unary.T + self.skip * s + self.chain * c
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = target - p
            self.unary += rate * (g.T @ x / len(y) - l2 * (self.unary - start))
            self.skip += rate * ((g * s).sum() / len(y) - l2 * (self.skip - 4.0))
            self.chain += rate * ((g * c).sum() / len(y) - l2 * self.chain)
        return self

    def marginals(self, text: str, found: list[tuple[str, int, int, bool]], rounds: int = 10, damping: float = 0.5) -> np.ndarray:
        """Label probabilities of each mention by loopy sum-product; passing mentions are clamped."""
        n = len(found)
        score = np.array([features(text, m) for m in found]).reshape(n, WIDTH) @ self.unary.T
        for k, m in enumerate(found):
            if m[3]:
                score[k] = -50.0
                score[k, 1 + KINDS.index(m[0])] = 0.0
        chain, skip = graph(text, found)
        edges = np.array(chain + skip).reshape(-1, 2).astype(int)
        if len(edges):
            weight = np.array([self.chain] * len(chain) + [self.skip] * len(skip))
            src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
            w = np.concatenate((weight, weight))[:, None]
            back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
            msg = np.zeros((len(src), self.LABELS))
            for _ in range(rounds):
                belief = score.copy()
                np.add.at(belief, dst, msg)
                out = belief[src] - msg[back]
                top = out.max(axis=1, keepdims=True)
                p = np.exp(out - top)
                new = np.log(p.sum(axis=1, keepdims=True) + (np.exp(w) - 1) * p)  # sum over labels, the same one weighs e^w
                new -= new.max(axis=1, keepdims=True)
                msg = damping * msg + (1 - damping) * new
            np.add.at(score, dst, msg)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str, sure: float = 0.9) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans, each by kind as listed, then start."""
        found = sorted(mentions(text), key=lambda m: (m[1], m[2], m[0]))
        base = [m[:3] for m in found if m[3]]
        every = list(base)
        if len(base) < len(found):
            # unions of the base spans; added ones come in the order of their starts, so the last end stands for them
            taken: list[list[int]] = []
            for _, s, e in sorted(base, key=lambda m: m[1:]):
                if taken and s < taken[-1][1]:
                    taken[-1][1] = max(taken[-1][1], e)
                else:
                    taken.append([s, e])
            p, last = self.marginals(text, found), 0
            for k, m in enumerate(found):
                label = int(p[k].argmax())
                if not m[3] and label and p[k, label] >= sure and m[1] >= last:
                    at = bisect_left(taken, m[2], key=lambda u: u[0]) - 1  # the last union that begins before the mention ends
                    if at < 0 or taken[at][1] <= m[1]:
                        every.append((KINDS[label - 1], m[1], m[2]))
                        last = m[2]
        order = lambda m: (KINDS.index(m[0]), m[1], m[2])
        return sorted(base, key=order), sorted(every, key=order)


def train(docs: DataFrame, sample_docs: int = 1500, sample_bytes: int = 16 << 20) -> SkipChain:
    few = hash_sample(docs.where(F.col("text").rlike("@|[0-9]{3}")), "doc_id", "text", sample_docs, sample_bytes)
    return SkipChain().fit([t for _, t in few])


SPANS = "array<struct<kind: string, start: long, end: long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, model: SkipChain | None = None, sure: float = 0.9) -> DataFrame:
    """docs(doc_id, text) with `base` and `spans`; both arrays of (kind, start, end) in code points, end exclusive."""
    docs = docs.select("doc_id", "text")
    model = model or train(docs)

    def run(batches):
        for b in batches:
            both = [model.spans(t, sure) if t else ([], []) for t in b.column("text").to_pylist()]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x[w]] for x in both], SPAN_TYPE) for w in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *cols], names=["doc_id", "text", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text string, base {SPANS}, spans {SPANS}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or each union of overlapping ones, replaced by [KIND] of its first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda m: (m[1], -m[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: SkipChain | None = None, sure: float = 0.9) -> DataFrame:
    """docs with text redacted and n_chars, where it is a column, counted again; other columns as they are."""
    model = model or train(docs)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [redact(t, model.spans(t, sure)[1]) if t else t for t in b.column("text").to_pylist()]
            yield b.set_column(at, "text", pa.array(texts, b.column("text").type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
