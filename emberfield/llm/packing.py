"""Hierarchical multi-length packing.

Whole windows of the longest context are cut straight off a document. What is left goes to a tier, the smallest
context size that holds it. Tiers are packed from the longest down: the longest remainder opens a window of its tier,
the gap is filled from shorter remainders, best fit first, and the last gap by a cut piece, whose rest is routed again.
Every window ends exactly full at a power of two; the tail of a partition is cut into powers of two, so no id is padding.

One narrow map: a partition packs its own documents, `pool` remainders at a time. sequence_id is the partition number
(upper bits) and a counter, so it is unique and the same again when a task is retried on the same input partition.
Step groups gather windows of one tier up to `step_tokens`, so that every group holds the same number of tokens
(but for the last of each tier and partition).

Null or empty text: the closing id alone. Null doc_id and repeated rows: packed like any row. Remainders that tie in length are
taken by their order in the partition. An empty table: no pieces. A very long text is encoded whole in its task and cut into
windows. Only doc_id and text are looked at, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encoding

TIERS = (64, 128, 256, 512, 1024)
FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())]


class Packer:
    """Packs the documents of one partition; rows: (doc_id, start, length, doc_tokens, sequence_id, offset, tier, step_group, ids)."""

    def __init__(self, part: int = 0, tiers: tuple[int, ...] = TIERS, pool: int = 2048, step_tokens: int = 8192):
        self.tiers, self.size, self.step = tiers, pool, step_tokens
        self.next = part << 36
        self.groups: dict[int, tuple[int, int]] = {}
        self.next_group = part << 36
        self.pool: list[tuple[int, int]] = []  # (length, slot), sorted
        self.slots: dict[int, tuple] = {}
        self.slot = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, n, at = self.tiers[-1], len(ids), 0
        while n - at >= top:
            self._window([(doc_id, ids, at, at + top)])
            at += top
        if at < n:
            self._route(doc_id, ids, at, n)
        if len(self.pool) >= self.size:
            self._pack(keep=self.size // 4)

    def close(self) -> None:
        self._pack(keep=0)

    def _route(self, doc_id, ids, s: int, e: int) -> None:
        self.slots[self.slot] = (doc_id, ids, s, e)
        insort(self.pool, (e - s, self.slot))
        self.slot += 1

    def _take(self, k: int) -> tuple:
        return self.slots.pop(self.pool.pop(k)[1])

    def _pack(self, keep: int) -> None:
        """Packs all but about `keep` remainders; with keep 0, all."""
        while len(self.pool) > keep:
            doc = self._take(len(self.pool) - 1)
            length = doc[3] - doc[2]
            window = next(t for t in self.tiers if t >= length)
            room, held = window - length, [doc]
            while room and self.pool:
                k = bisect_right(self.pool, (room, self.slot)) - 1
                if k < 0:  # all are longer: the shortest is cut
                    doc_id, ids, s, e = self._take(0)
                    held.append((doc_id, ids, s, s + room))
                    self._route(doc_id, ids, s + room, e)
                    room = 0
                else:
                    held.append(self._take(k))
                    room -= held[-1][3] - held[-1][2]
            if room:
                self._tail(held)
            else:
                self._window(held)

    def _tail(self, held: list[tuple]) -> None:
        """What the last window holds, cut into powers of two."""
        left = sum(e - s for *_, s, e in held)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part: list[tuple] = []
            while size:
                doc_id, ids, s, e = held.pop(0)
                k = min(size, e - s)
                part.append((doc_id, ids, s, s + k))
                if s + k < e:
                    held.insert(0, (doc_id, ids, s + k, e))
                size -= k
            self._window(part)

    def _window(self, held: list[tuple]) -> None:
        size = sum(e - s for *_, s, e in held)
        tier = next(t for t in self.tiers if t >= size)
        group, used = self.groups.get(tier, (0, self.step))
        if used + size > self.step:
            group, used = self.next_group, 0
            self.next_group += 1
        self.groups[tier] = (group, used + size)
        at = 0
        for doc_id, ids, s, e in held:
            self.rows.append((doc_id, s, e - s, len(ids), self.next, at, tier, group, ids[s:e].tobytes()))
            at += e - s
        self.next += 1


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, pool: int = 2048, step_tokens: int = 8192) -> DataFrame:
    """Pieces of every row of docs(doc_id, text): doc_id, FIELDS; ids are little-endian unsigned 32-bit."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        enc, _ = encoding(path)
        packer = Packer(TaskContext.get().partitionId(), tiers, pool, step_tokens)

        def out():
            rows, packer.rows = packer.rows, []
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, t) for c, (_, t) in zip(cols[1:], FIELDS, strict=True)]], names=["doc_id", *[n for n, _ in FIELDS]])

        kind = pa.int64()
        for b in batches:
            kind = b.column("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                packer.add(doc_id, np.append(enc.encode_to_numpy(text or "", allowed_special="all"), end_id).astype("<u4"))
                if len(packer.rows) > 4096:
                    yield from out()
        packer.close()
        if packer.rows:
            yield from out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary")
