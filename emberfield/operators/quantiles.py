"""Exact percentiles in bounded memory.

Spark's percentile gathers every distinct value of a column in one task. Here each wanted order statistic has a bracket of
values that is known to hold it; approximate percentiles inside the bracket narrow it, one aggregation for all columns a
round, until it holds at most `most` rows or a single value. Only those rows are gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_percentiles(df: DataFrame, columns: list[str], ps: list[float], most: int = 50_000, rounds: int = 12) -> dict[str, list[float | None]]:
    """For each column the interpolated percentiles ps over its non-null values."""
    first = df.agg(*(x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.min(c).cast("double").alias(f"a{i}"), F.max(c).cast("double").alias(f"b{i}")))).first()
    n = [first[f"n{i}"] for i in range(len(columns))]
    #: (column number, rank) -> [low, high, rows below low]
    open_ranks: dict[tuple[int, int], list] = {}
    for i in range(len(columns)):
        for p in ps if n[i] else []:
            k = p * (n[i] - 1)
            for r in {math.floor(k), math.ceil(k)}:
                open_ranks[i, r] = [first[f"a{i}"], first[f"b{i}"], 0]
    known: dict[tuple[int, int], float] = {}
    held = {key: n[key[0]] for key in open_ranks}
    for _ in range(rounds):
        for key in [k for k, (a, b, _) in open_ranks.items() if a == b]:
            known[key] = open_ranks.pop(key)[0]
        small = {tuple(v): None for k, v in open_ranks.items() if held[k] <= most}
        spans = list(dict.fromkeys((k[0], v[0], v[1], v[2]) for k, v in open_ranks.items()))
        if not spans:
            break
        x = {s: F.when(F.col(columns[s[0]]).cast("double").between(s[1], s[2]), F.col(columns[s[0]]).cast("double")) for s in spans}
        ask = []
        for j, s in enumerate(spans):
            ranks = [k[1] for k, v in open_ranks.items() if (k[0], v[0], v[1], v[2]) == s]
            size = held[next(k for k, v in open_ranks.items() if (k[0], v[0], v[1], v[2]) == s)]
            if (s[1], s[2], s[3]) in small:
                ask.append(F.sort_array(F.collect_list(x[s])).alias(f"s{j}"))
            else:
                at = sorted({min(1.0, max(0.0, (r - s[3]) / max(size - 1, 1) + d)) for r in ranks for d in (-2e-3, 2e-3)})
                ask.append(F.percentile_approx(x[s], at, 2_000).alias(f"s{j}"))
        got = df.agg(*ask).first()
        cuts: dict[int, set] = {}
        for j, s in enumerate(spans):
            if (s[1], s[2], s[3]) in small:
                for key in [k for k, v in open_ranks.items() if (k[0], v[0], v[1], v[2]) == s]:
                    known[key] = got[f"s{j}"][key[1] - s[3]]
                    del open_ranks[key]
            else:
                cuts.setdefault(s[0], set()).update(got[f"s{j}"] or [])
        if not open_ranks:
            break
        # ranks of the cut values decide each bracket
        pairs = [(i, c) for i, vs in cuts.items() for c in sorted(vs)]
        row = df.agg(*(y for j, (i, c) in enumerate(pairs) for y in (F.count_if(F.col(columns[i]) < c).alias(f"l{j}"), F.count_if(F.col(columns[i]) <= c).alias(f"e{j}")))).first()
        for key, v in open_ranks.items():
            end = v[2] + held[key]
            for j, (i, c) in enumerate(pairs):
                if i != key[0]:
                    continue
                below, upto = row[f"l{j}"], row[f"e{j}"]
                if below <= key[1] < upto:
                    v[:], end = [c, c, below], upto
                    break
                if upto <= key[1] and c >= v[0]:
                    v[0], v[2] = c, below
                elif below > key[1] and c <= v[1]:
                    v[1], end = c, upto
                    break
            held[key] = end - v[2]
    for key in [k for k, (a, b, _) in open_ranks.items() if a == b]:
        known[key] = open_ranks.pop(key)[0]
    if open_ranks:
        raise RuntimeError("percentiles did not settle")
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = []
        for p in ps:
            k = p * (n[i] - 1)
            lo, hi = (known[i, math.floor(k)], known[i, math.ceil(k)]) if n[i] else (None, None)
            out[c].append(None if lo is None else lo + (hi - lo) * (k - math.floor(k)))
    return out
