"""Token counts by a map-side two-tier lookup.

A broadcast table holds the token lengths of frequent pieces; misses are encoded by the tokenizer and kept in a
bounded cache of the worker. No pre-token is shuffled: the count is one narrow map over the table.

The frequent table comes from a bounded sample of documents (`sample_docs`, `sample_bytes`; whole texts). It only warms the cache:
every piece that it lacks is encoded, so counts are exact whatever it holds.

Null or empty text: 0 bytes, 0 tokens. Null doc_id and repeated rows: counted like any row. An empty table: no rows. A very
long text is counted whole, in the worker's memory, piece by piece. A count equal to the limit is not over it. Only doc_id
and text are looked at, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample
from .tokens import CUT, KEEP, Lengths, batches_of

LIMIT_TOKENS = 512


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = 2000, entries: int = 65_536, sample_bytes: int = 16 << 20) -> dict[str, int]:
    """At most `entries` frequent pieces of the sample with their token counts (about 4 MB)."""
    c: Counter = Counter()
    for _, t in hash_sample(docs, "doc_id", "text", sample_docs, sample_bytes):
        c.update(CUT(t)[1:])
    best = sorted(((p, n) for p, n in c.items() if len(p) < KEEP), key=lambda x: (-x[1], x[0]))[:entries]
    names = [" " + p for p, _ in best]
    return dict(zip(names, Lengths(path).of(names), strict=True))


def count_tokens(docs: DataFrame, path: str, sample_docs: int = 2000, entries: int = 65_536, limit: int = LIMIT_TOKENS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_docs, entries))

    def count(batches):
        lengths = Lengths(path, table.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n: list[int] = []
            for s, e in batches_of(texts):
                n += lengths.of(texts[s:e])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
