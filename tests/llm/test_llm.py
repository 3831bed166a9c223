"""Operators against brute force on fixtures with nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import copy
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberfield.llm import mtree, near_dups, packing, pii, pseudo_likelihood, quality, substrings, tiling, token_counts, warc
from emberfield.llm.common import IdFilter, smallest_reachable

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One  TWO"), (5, "x" * 30_000), (6, "same " * 300)]
    base = text(120)
    for i in range(10, 40):  # near copies: one word changed here and there
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, base) for i in range(40, 50)]
    shared = text(60)
    rows += [(i, f"{text(30)} {shared} {text(30)}") for i in range(50, 70)]
    rows += [(i, text(rng.randint(1, 200))) for i in range(70, 110)]
    rows += [(110, "tok <|endoftext|> en d  \n\n x's  're 12ab!!  　 z"), (111, text(6000)), (112, "\x1c \x85 a\x0bb\x0cc")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names the operators use inside
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], "doc_id long, text string, spans string, n long, stats int").repartition(3)


def empty(docs):
    return docs.where("false")


def test_tokens(docs, rows):
    t = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, BPE, sample_docs=20, entries=50).collect()}
    for i, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((x or "").encode()), n, n > 512), i
    assert token_counts.count_tokens(empty(docs), BPE).count() == 0


def test_tokens_of_every_kind_of_character():
    from emberfield.llm.tokens import Lengths

    t, own = Tokenizer.from_file(BPE), Lengths(BPE)
    texts = [f"a{chr(c)}a 1{chr(c)} .{chr(c)}. {chr(c)}x\n{chr(c)} {chr(c)}" for c in [*range(0x3000), *range(0x3000, 0x110000, 37)] if not 0xD800 <= c <= 0xDFFF]
    assert own.of(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, rows):
    t = Tokenizer.from_file(BPE)
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, BPE, pool=16).withColumn("crc", F.crc32("ids")).collect():
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["crc"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    groups = Counter()
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and not at & (at - 1)  # every window is full at a power of two
        groups[s[0]["step_group"]] += at
        assert len({(r["tier"], r["step_group"]) for r in s}) == 1
    assert max(groups.values()) <= 8192
    assert packing.pack(empty(docs), BPE).count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("pct", "kw"), [(85, {}), (80, {}), (85, {"short": 2, "block": 4}), (80, {"short": 2, "block": 4, "pivots": 1}), (85, {"short": 1, "block": 2, "pivots": 2})])
def test_near_duplicates(docs, rows, pct, kw):
    s = {i: shingles(t) for i, t in rows}
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= pct * len(s[a] | s[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(docs, pct, **kw).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s[i]), root(i), root(i) == i) for i in s}


def test_near_duplicates_edges(docs):
    assert near_dups.near_duplicates(empty(docs)).count() == 0
    twice = docs.where("doc_id in (40, 41)").unionByName(docs.where("doc_id = 40")).withColumn("doc_id", F.when(F.col("doc_id") == 41, None).otherwise(F.col("doc_id")))
    got = sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in near_dups.near_duplicates(twice).collect() if r["doc_id"])
    assert got == [(False, 40, True)] * 2


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share a doc_id are one node, with the links of each text."""
    rng = random.Random(8)
    text = lambda: [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60)]
    x, y, z = text(), text(), text()
    near = lambda w: " ".join(w[:-1] + ["end"])
    rows = [(3, " ".join(x)), (3, " ".join(y)), (11, near(y)), (12, near(x)), (20, " ".join(z)), (20, " ".join(z)), (21, near(z)), (30, " ".join(text())), (30, None), (None, " ".join(x))]
    for kw in ({}, {"short": 1, "block": 1, "pivots": 1}):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect())
        want = Counter()
        for i, t in rows:
            c = {3: 3, 11: 3, 12: 3, 20: 20, 21: 20}.get(i, i)
            want[i, len(shingles(t)), c, c == i] += 1
        assert got == want
    left = near_dups.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in left) == {3: 2, 20: 2, 30: 2, None: 1}


@pytest.mark.parametrize("pct", [85, 80])
def test_near_duplicates_around_the_index_size(spark, pct):
    """30 to 45 shingles: the smaller document retains all of them, the larger one only 32."""
    rows, want = [], {}
    for p in range(400):
        n, m = 28 + p % 5, 33 + p // 5 % 13
        words = [f"p{p}w{k}" for k in range(m + 4)]
        a, b = 2 * p, 2 * p + 1
        rows += [(a, " ".join(words[: n + 4])), (b, " ".join(words))]
        want[a], want[b] = a, a if 100 * n >= pct * m else b
    assert sum(want[i] != i for i in want) > 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(df, pct).collect()} == want


def test_least_shared_of_retained_values():
    for pct in (80, 85):
        for n in range(1, 33):
            some = [index - (m - c) if m > (index := 32) else c for m in range(1, 60) for c in range(1, min(n, m) + 1) if 100 * c >= pct * (n + m - c)]
            assert 0 < near_dups.least_shared(n, pct, 32) <= min(some)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in smallest_reachable(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_id_filter(spark):
    f = IdFilter(spark.range(0, 3000, 7).withColumnRenamed("id", "x"), "x")
    r = spark.range(3000).select("id", f.column("id").alias("p")).toPandas()
    assert f.passes(r["p"].to_numpy())[r["id"] % 7 == 0].all()


def removal(rows, window):
    c = Counter()
    words = [WORD.findall(t or "") for _, t in rows]
    for w in words:
        c.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if c[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_substrings(docs, rows):
    assert sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=repr) == removal(rows, 35)


def test_substrings_repeated_and_null_ids(spark, rows):
    odd = [(1, rows[60][1]), (1, rows[61][1]), (None, rows[62][1]), (None, None), (2, rows[80][1]), (2, rows[80][1])]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    assert sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=repr) == removal(odd, 35)
    assert substrings.remove_repeats(df.where("false")).count() == 0


def test_suffix_automaton_matching():
    rng = random.Random(1)
    ref, doc = [rng.choice("abc") for _ in range(80)], [rng.choice("abc") for _ in range(60)]
    inside = {tuple(ref[i:j]) for i in range(80) for j in range(i + 1, 81)}
    want = [max([n for n in range(1, k + 2) if tuple(doc[k + 1 - n : k + 1]) in inside], default=0) for k in range(60)]
    assert substrings.SuffixAutomaton(ref).matching(doc) == want


def test_spans_in_references(docs, rows, spark):
    ref = [rows[50][1], None, ""]
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substrings.remove_references(docs, spark.createDataFrame([(t,) for t in ref], "text string"), 35, shard_words=40).collect()}
    windows = {tuple(WORD.findall(ref[0])[k : k + 35]) for k in range(len(WORD.findall(ref[0])) - 34)}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if tuple(w[k : k + 35]) in windows:
                gone[k : k + 35] = [True] * 35
        assert got[i] == (sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)), i


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:180] = x[0]  # many copies
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [float("nan")] * 8), (440, [None] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    q = np.floor(64 * x.astype(float))
    want = []
    for i in range(0, 300, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:20]
        want += [(i, r + 1, int(j), int(s[j])) for r, j in enumerate(order)]
    for kw in ({}, {"page_rows": 40, "block": 4}):
        assert sorted(tuple(r) for r in mtree.top_k(df, **kw).collect()) == want
    assert mtree.top_k(df.where("false")).count() == 0
    assert mtree.top_k(df.where("vec_id < 3")).count() == 2


def test_mtree_with_many_own_rows():
    x = np.arange(1.0, 101.0)[:, None]
    ids = np.concatenate((np.arange(90), np.full(10, 500)))
    assert mtree.MTree(ids, x).search(np.array([1.0]), 5, 500)[0] == [(90 - r, 89 - r) for r in range(5)]


def test_mtree_skips_computations():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 4)) * 50
    x = np.floor(np.repeat(centers, 100, axis=0) + rng.normal(size=(4000, 4)))
    t = mtree.MTree(np.arange(4000), x)
    assert np.mean([t.search(x[i], 10, i)[1] for i in range(0, 4000, 200)]) < 2000


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p) < 4000 and int(p) <= 255 for p in m[0].split("."))]
    for kind, p, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == "phone" or pii.luhn(d)):
                out.append((kind, *m.span()))
    return out


PII = [
    "mail a.b@c.de, x@y.z.w@v.u and @@a@b-c.d+1 (555) 123-4567 é 4111 1111 1111 1111 or 4111111111111112", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4", "+1 23 +123456789 +1234567890123456 ++12 345 678 90",
    "", None, "@" * 50, "1" * 20_000, "a" * 20_000 + "@", "call +1 (521) 555-2373 or (521) 555-2373 again (521) 555-2373", "1.1.1.1.1 12@3.4", "a@b a@b.c", "9" * 5000 + ".1.1.1",
]


def test_pii(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)], "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [tuple(s) for s in r["base"]] == base_spans(r["text"] or ""), r["doc_id"]
        assert set(r["base"]) <= set(r["spans"])
    added = [tuple(s) for s in pii.find(df).where("doc_id = 8").first()["spans"]]
    assert ("phone", 5, 22) in added and len(added) == 3  # alike mentions get the label too
    assert pii.find(df.where("false")).count() == 0
    red = pii.redact_documents(df.withColumn("n_chars", F.length("text"))).where("doc_id = 10").first()
    # the first is no base span; it is alike the second, and joined to it by a skip edge
    assert red["text"] == "[EMAIL] [EMAIL]" and red["n_chars"] == len(red["text"])


def test_pii_random_texts():
    rng = random.Random(3)
    model = pii.SkipChain()
    for _ in range(3000):
        t = "".join(rng.choice("0123459. -+()@ab%") for _ in range(rng.randint(0, 60)))
        assert model.spans(t)[0] == base_spans(t), t


def test_pii_field_without_a_base_span():
    text = "write to someone@nodots now"
    model = pii.SkipChain()
    found = pii.mentions(text)
    assert len(found) == 1 and not found[0][3]
    model.unary[:] = 0.0
    model.unary[1] = 50 * pii.features(text, found[0])
    assert model.spans(text) == ([], [("email", *found[0][1:3])])


def test_warc(spark):
    big = "<p>é</p>" * 50
    pages = [(1, "u1", big), (2, "u\r\n2", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", big + "x"), (2, "again", big), (9, "crlf", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = Counter(tuple(r)[:5] for r in warc.round_trip(df).collect())
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        first = min(p for p, _, x in pages if (x or "") == (h or ""))
        again = len(b) >= 100 and i > first
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_of_a_page_id_with_other_payloads(spark):
    a, b, c = "a" * 200, "b" * 200, "c" * 200
    df = spark.createDataFrame([(1, "u", a), (2, "u", b), (3, "u", a), (3, "u", b), (3, "u", c), (3, "u", a)], "page_id long, url string, html string")
    got = Counter((r["page_id"], bytes(r["payload"] or b"").decode()[:1], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == {(1, "a", "response", None): 1, (2, "b", "response", None): 1, (3, "", "revisit", 1): 2, (3, "", "revisit", 2): 1, (3, "c", "response", None): 1}


def test_bundle_is_a_series_of_zstd_frames():
    import io

    import zstandard

    out = io.BytesIO()
    w = warc.BundleWriter(out, frame_bytes=500)
    raw = [warc.record(i, "u", f"page {i} ".encode() * i) for i in range(50)]
    where = [w.add(r) for r in raw]
    w.close()
    data = out.getvalue()
    frames = warc.seek_table(lambda at, n: data[at : at + n], len(data))
    assert len(frames) > 3
    for r, (f, o) in zip(raw, where, strict=True):
        at, n = frames[f]
        plain = zstandard.ZstdDecompressor().decompress(data[at : at + n])
        assert plain[o : o + len(r)] == r
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read().startswith(b"WARC/1.1")


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    r = quality.score(docs, model).join(labels, "doc_id").where(quality.fold_of(F.col("doc_id")) == 1).agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert r[0] > 0.97
    odd = spark.createDataFrame([(1, None, 3), (None, "", 4), (3, "x" * 50_000, 5)], "doc_id long, text string, w int")
    assert all(0 <= x["score"] <= 1 for x in quality.score(odd, model).collect())
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.score(odd, quality.train(odd, labels.where("false"))).count() == 3


def test_training_rows_are_bounded_and_repeats_count_once(spark):
    docs = spark.createDataFrame([(i, "good words, here. " * (2 + i % 5) if i % 2 else "!!! $$$ " * (2 + i % 7)) for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    model = quality.train(docs, labels, sample_rows=100)
    again = quality.train(docs.unionByName(docs), labels.unionByName(labels).repartition(5), sample_rows=100)
    assert model == again and model.rules
    assert {r["predicted"] == r["doc_id"] % 2 for r in quality.score(docs, model).collect()} == {True}


def test_statistics_against_python(spark, docs, rows):
    from math import log

    texts = [t for _, t in rows] + ["A|b?c.d!e, F9 #$%&*", "a a b\nb b\n\n", "é É ß"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in quality.with_statistics(df).select("row.i", "stats.*").collect():
        t = texts[r["i"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, c, some = max(len(w), 1), max(len(t), 1), lambda chars: sum(x in chars for x in t)  # noqa: B023, E731
        want = {
            "chars": len(t), "words": len(w), "word_length": len(t) / n, "upper": some("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, "digits": some("0123456789") / c, "bang": some("!") / n,
            "symbols": some("#$%&*") / c, "pipes": some("|") / n, "stops": some(".?") / n, "commas": some(",") / n, "lines": some("\n") / n,
            "herdan": log(len(set(w)) + 1) / log(len(w) + 2), "adjacent": sum(p == q for p, q in zip(w, w[1:], strict=False)) / n,
        }
        assert set(want) == set(quality.NAMES)
        for k, v in want.items():
            assert r[k] == pytest.approx(v, abs=1e-12), (k, t[:40])


def test_lasso_weights_are_an_optimum():
    """The conditions of a minimum of weighted logistic loss + penalty * |w| over standardised rules."""
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (300, len(quality.NAMES)))
    y = ((x[:, 1] > 0.4) & (rng.uniform(size=300) < 0.9)).astype(float)
    penalty = 0.01
    model = quality.fit_rules(x, y, penalty=penalty, steps=6000)
    a = np.column_stack([r.holds(x) for r in model.rules]).astype(float)
    scale = np.maximum(a.std(axis=0), 1e-3)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    r = weight / weight.sum() * (model.score(x) - y)
    assert abs(r.sum()) < 1e-4
    assert np.allclose(((a - a.mean(axis=0)) / scale).T @ r, -penalty * np.sign(model.weights), atol=1e-4)


def test_scores_at_the_threshold_and_of_an_empty_table(spark):
    model = quality.RuleEnsemble(0.0)  # every score is 1/2
    df = spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id long, text string")
    assert [(r["score"], r["predicted"]) for r in quality.score(df, model).collect()] == [(0.5, 1)] * 3
    assert quality.keep_good(df, model).count() == 3 and quality.score(df.where("false"), model).count() == 0


def test_nulls_and_repeated_rows(spark):
    """Each row counts on its own: token counts, pieces, scores, items."""
    t = Tokenizer.from_file(BPE)
    odd = [(None, "one two three"), (5, "x y"), (5, "x y"), (5, "other text"), (6, None), (None, None)]
    df = spark.createDataFrame([(i, x, 1, "w") for i, x in odd], "doc_id long, text string, n_tokens int, ids string")
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, BPE).collect()) == Counter((i, len(x or ""), n(x)) for i, x in odd)
    pieces = packing.pack(df, BPE).collect()
    assert sum(r["length"] for r in pieces) == sum(n(x) + 1 for _, x in odd)
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(i for i, _ in odd)
    scores = pseudo_likelihood.score(df, vocabulary=5, rounds=1).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in scores) == Counter((i, len(words_in(x))) for i, x in odd)
    assert len({round(r["log_prob"], 6) for r in scores if r["doc_id"] == 5}) == 2 and all(r["mean_log_prob"] is None for r in scores if not r["n_words"])
    bench = spark.createDataFrame([(1, "x y"), (2, "one two three")], "item_id long, text string")
    got = Counter((r["doc_id"], tuple(x["item_id"] for x in r["items"])) for r in tiling.decontaminate(df, bench).collect())
    assert got == {(None, (2,)): 1, (5, (1,)): 2, (5, ()): 1, (6, ()): 1, (None, ()): 1}


def test_pages_without_id_and_very_long(spark):
    big = "b" * 700_000
    df = spark.createDataFrame([(None, "u", big), (2, "u", big), (None, "u", big), (3, "u", big)], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == {(None, len(big), "response", None): 2, (2, len(big), "response", None): 1, (3, len(big), "revisit", 2): 1}


def test_many_equal_rows_keep_one_list_of_spans(spark):
    words = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(None, words)] * 40 + [(7, words)], "doc_id long, text string").repartition(4)
    spans = substrings.repeated_spans(substrings._keyed(df)).collect()
    assert len(spans) == 2 and all(len(r["spans"]) < 80 for r in spans)
    assert {r["n_removed"] for r in substrings.remove_repeats(df).collect()} == {80}


def test_rules_as_columns_are_the_model(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (400, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97 and len(model.rules) < 60
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.NAMES)).select(F.struct("*").alias("stats"))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.score(x))


def hash_of(w: bytes) -> int:
    return int(pseudo_likelihood.text_hashes(w)[0])


def words_in(t: str | None) -> list[bytes]:
    return [w.encode() for w in WORD.findall((t or "").translate(LOW))]


class Ids(dict):
    """word -> id of a network."""

    def __init__(self, net):
        super().__init__()
        self.ids = net.ids()
        self.n = self.ids.n

    def __missing__(self, w: bytes) -> int:
        self[w] = int(self.ids.of(pseudo_likelihood.text_hashes(w))[0])
        return self[w]


def test_hashes_of_words(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbBzZé \t\n\x0b\x0c\r\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " ", "x" * 500, " " * 300, "y" * 200 + " z"]
    whole = [pseudo_likelihood.text_hashes(t.encode()) for t in texts]
    known: dict[int, bytes] = {}
    for t, h in zip(texts, whole, strict=True):
        words = words_in(t)
        assert len(h) == len(words)
        assert all(known.setdefault(int(x), w) == w for x, w in zip(h, words, strict=True)) and len({known[int(x)] for x in h}) == len(set(words))
    held = pseudo_likelihood.Held()
    for t in texts:
        held.add(t.encode())
    h, n = held.take()
    assert np.array_equal(h, np.concatenate(whole)) and n.tolist() == [len(w) for w in whole]
    monkeypatch.setattr(pseudo_likelihood, "PIECE", 16)  # pieces end inside texts, and words are longer than pieces
    for t, h in zip(texts, whole, strict=True):
        assert np.array_equal(pseudo_likelihood.text_hashes(t.encode()), h), t


def test_pseudo_likelihood(docs, rows):
    net = pseudo_likelihood.fit(docs, vocabulary=100, sample_docs=60, positions=5000, rounds=1)
    width = net.top.shape[1] - 1
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(docs, net).collect()}
    ids = Ids(net)
    for i, t in rows:
        w = [ids[x] for x in words_in(t)]
        total = 0.0
        for k in range(len(w)):  # one word at a time, the whole distribution
            ctx = [w[k + o] if 0 <= k + o < len(w) else net.pad for o in net.offsets()]
            h = np.tanh(sum(net.emb[c, j * width : (j + 1) * width] for j, c in enumerate(ctx)))
            z = net.top[:, :-1] @ h + net.top[:, -1]
            c = net.cls[w[k]]
            u = (net.low[:, :-1] @ h + net.low[:, -1])[net.begin[c] : net.begin[c + 1]]
            total += z[c] - np.log(np.exp(z).sum()) + u[net.place[w[k]]] - np.log(np.exp(u).sum())
            if k > 300:
                break
        assert got[i]["n_words"] == len(w)
        if len(w) <= 300:
            assert got[i]["log_prob"] == pytest.approx(total, rel=1e-3, abs=1e-3)
    assert pseudo_likelihood.score(empty(docs)).count() == 0


@pytest.mark.parametrize("held", [0, 20, 10_000])
def test_rare_words_share_their_bucket(docs, rows, held):
    count = Counter(w for _, t in rows for w in words_in(t))
    net = pseudo_likelihood.fit(docs, vocabulary=100, positions=0, rounds=0)
    ids, total = Ids(net), Counter()
    for w, n in count.items():
        total[ids[w]] += n
    unseen = docs.limit(1).select(F.lit(500).cast("long").alias("doc_id"), F.lit("neverseen").alias("text"))
    both = docs.select("doc_id", "text").unionByName(unseen)
    base = {r["doc_id"]: r["log_prob"] for r in pseudo_likelihood.score(both, net).collect()}
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(both, net, counts=pseudo_likelihood.word_counts(docs), held=held).collect()}
    assert len(got) == len(rows) + 1
    for i, t in [*rows, (500, "neverseen")]:
        words = words_in(t)
        share = sum(np.log(max(1, count[w]) / (total[ids[w]] + 1)) for w in words if ids[w] >= ids.n)
        assert got[i]["log_prob"] == pytest.approx(base[i] + share, rel=1e-6, abs=1e-6)
        assert got[i]["mean_log_prob"] == (pytest.approx(got[i]["log_prob"] / len(words)) if words else None)


def test_sizes_grow_with_the_distinct_words():
    small, large = (pseudo_likelihood.sizes(n) for n in (10_000, 40_000_000))
    assert small == {"vocabulary": 2000, "rare": 64, "classes": 40} and all(large[k] > small[k] for k in small)


def test_probabilities_of_all_words_sum_to_one(docs, rows):
    """At some places: every vocabulary word, every rare word by its share, and one count more for the unseen of a bucket."""
    count = Counter(w for _, t in rows for w in words_in(t))
    net = pseudo_likelihood.fit(docs, vocabulary=60, sample_docs=30, positions=3000, rounds=0, rare=7)
    ids = Ids(net)
    shares = pseudo_likelihood.Shares(pseudo_likelihood.word_counts(docs), net, 10_000)
    keys, logs = shares.known
    for context in ([b"a", b"b", None, b"c", b"a"], [net.pad, net.pad, None, *list(count)[:2]]):
        total, bucket = 0.0, {}
        for k in range(ids.n + net.rare):
            seq = np.array([k if x is None else x if isinstance(x, int) else ids[x] for x in context])
            p = float(np.exp(net.log_probs(seq, np.array([2]))[0]))
            total += p if k < ids.n else 0.0
            bucket[k - ids.n] = p
        for w in count:
            if ids[w] >= ids.n:
                total += bucket[ids[w] - ids.n] * float(np.exp(logs[np.searchsorted(keys, np.uint64(hash_of(w)))]))
        total += sum(bucket[j] / (shares.total[j] + 1) for j in range(net.rare))
        assert total == pytest.approx(1, abs=1e-4)


def test_gibberish_of_rare_words_scores_below_common_words(spark):
    rng = random.Random(6)
    common = [f"w{k}" for k in range(50)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(80))) for i in range(60)]
    rows += [(100 + i, " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(80))) for i in range(5)]
    got = {r["doc_id"]: r["mean_log_prob"] for r in pseudo_likelihood.score(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary=60, rare=4, classes=5, rounds=1).collect()}
    assert max(v for i, v in got.items() if i >= 100) < min(v for i, v in got.items() if i < 100)


def test_samples_and_scores_do_not_depend_on_the_partitioning(spark, docs, rows):
    from emberfield.llm.common import hash_sample

    samples = {tuple(hash_sample(docs.repartition(n), "doc_id", "text", 40)) for n in (1, 7)}
    assert len(samples) == 1 and len(*samples) == 40
    (sample,) = samples
    twice = docs.unionByName(docs)
    assert len(set(hash_sample(twice, "doc_id", "text", 500))) == len(hash_sample(twice, "doc_id", "text", 500)) == len([t for _, t in rows if t is not None])
    few = hash_sample(docs, "doc_id", "text", 40, most_bytes=2000)
    assert tuple(few) == sample[: len(few)] and sum(len(t.encode()) for _, t in few) <= 2000
    assert hash_sample(empty(docs), "doc_id", "text", 5) == []
    fits = [pseudo_likelihood.fit(docs.repartition(n), vocabulary=50, sample_docs=20, rounds=0).flat() for n in (2, 5)]
    assert np.array_equal(*fits)
    found = [{r["doc_id"]: r["spans"] for r in pii.find(docs.repartition(n)).collect()} for n in (2, 5)]
    assert found[0] == found[1]


def test_training_raises_likelihood(docs):
    fresh = pseudo_likelihood.fit(docs, vocabulary=100, positions=0, rounds=0)
    trained = pseudo_likelihood.fit(docs, vocabulary=100, positions=20_000, rounds=0)
    mean = lambda n: pseudo_likelihood.score(docs, n).agg(F.sum("log_prob")).first()[0]
    assert mean(trained) > mean(fresh)


@pytest.mark.parametrize("most", [0, 1, 7, 10_000])
def test_frequent_words(docs, rows, most):
    count = Counter(w for _, t in rows for w in words_in(t))
    top, total = pseudo_likelihood.frequent_words(docs, most)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    assert [(r["h"], r["n"]) for r in top] == sorted(((signed(hash_of(w)), n) for w, n in count.items()), key=lambda x: (-x[1], x[0]))[:most]
    assert total == sum(count.values())


def test_passes_over_the_corpus_average_what_tasks_learn(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in np.cumsum(rng.integers(0, 3, 400)) % 40) for _ in range(40)] + [None, "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    start = pseudo_likelihood.fit(docs, vocabulary=30, sample_docs=5, rounds=0)
    got = pseudo_likelihood.refine(docs, start, rounds=2, held_words=1000, cells=100)
    want, trained = copy.deepcopy(start), 0
    parts = docs.where("text is not null").withColumn("r", F.expr("pmod(xxhash64(doc_id, text, 23), 2)")).rdd.glom().collect()
    for k in range(2):
        seen, total = 0, 0.0
        for part in parts:
            net, held, n, first = copy.deepcopy(want), [], 0, 0
            mine = [r for r in part if r["r"] == k]
            for j, r in enumerate(mine):
                held.append([Ids(net)[w] for w in words_in(r["text"])])
                if sum(len(x["text"].encode()) + 1 for x in mine[first : j + 1]) // 6 >= 1000 or j == len(mine) - 1:
                    padded, at = net.padded(np.array(sum(held, []), dtype=np.int64), np.array([len(d) for d in held]))
                    net.train(padded, at, epochs=1)
                    n, held, first = n + len(at), [], j + 1
            seen, total = seen + n, total + n * (net.flat() - want.flat()).astype(float)
        want.add((total / seen).astype(np.float32))
        trained += seen
    assert trained == sum(len((t or "").split()) for t in texts)  # every document, once
    assert np.allclose(got.flat(), want.flat(), atol=1e-5)
    likelihood = lambda n: pseudo_likelihood.score(docs, n).agg(F.sum("log_prob")).first()[0]
    assert likelihood(got) > likelihood(start)
    assert np.array_equal(pseudo_likelihood.refine(docs.limit(0), start).flat(), start.flat())


def test_gradients_are_those_of_the_log_likelihood():
    """One step on one batch against numeric derivatives."""
    rng = np.random.default_rng(2)
    net = pseudo_likelihood.WindowNetwork(np.arange(9, dtype=np.uint64), np.arange(9, 0, -1) * 10.0, 30, side=2, width=3, rare=2, classes=3)
    padded, at = net.padded(rng.integers(0, 11, 60), np.array([35, 0, 25]))
    after = copy.deepcopy(net)
    after.train(padded, at, epochs=1, rate=1e-3)
    sizes = [w.size for w in net.weights()]
    for k in [0, 5, 40, sizes[0] + 1, sizes[0] + 4, sizes[0] + sizes[1], sizes[0] + sizes[1] + 11]:
        up, down = copy.deepcopy(net), copy.deepcopy(net)
        step = np.zeros(sum(sizes), dtype=np.float32)
        step[k] = 1e-2
        up.add(step)
        down.add(-step)
        slope = (up.log_probs(padded, at).sum() - down.log_probs(padded, at).sum()) / 2e-2
        scale = 1e-3 / (32 if k < sizes[0] else len(at) if k < sizes[0] + sizes[1] else 256)
        assert after.flat()[k] - net.flat()[k] == pytest.approx(slope * scale, rel=0.05, abs=2e-7)


def slow_tiles(item, doc, seed):
    """Greedy string tiling straight from its definition."""
    mi, md, tiles, seed = set(), set(), [], min(seed, len(item))
    while seed:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and i + n not in mi and d + n not in md and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < seed:
            break
        tiles.append((best[1], best[2], best[0]))
        mi |= set(range(best[1], best[1] + best[0]))
        md |= set(range(best[2], best[2] + best[0]))
    return tiles


def test_tiles():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        assert tiling.greedy_tiles(item, doc, 3) == slow_tiles(item, doc, 3)


def test_long_repetitive_texts_tile_fast():
    import time

    rng = random.Random(9)
    item = ["x", *["same"] * 60, "y", *["same"] * 60, "z", *["a", "b"] * 15]
    doc = ["same"] * 12_000 + ["a", "b"] * 4000
    finder = tiling.Finder([(k, " ".join(item)) for k in range(3)], 5)
    began = time.process_time()
    tiles = tiling.greedy_tiles(item, doc, 5)
    best, hit = finder.covered(" ".join(doc).encode(), 0.8)
    assert time.process_time() - began < 3
    assert [n for *_, n in tiles] == [60, 60, 30] and best == pytest.approx(150 / 153) and len(hit) == 3
    for _ in range(60):  # the bound never hides an item
        items = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(4)]
        doc = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        f = tiling.Finder([(k, " ".join(w)) for k, w in enumerate(items)], 3)
        share = [sum(n for *_, n in slow_tiles(w, doc, 3)) / len(w) for w in items]
        best, hit = f.covered(" ".join(doc).encode(), 0.8)
        assert best == pytest.approx(max(share)) and [k for k, *_ in hit] == [k for k, x in enumerate(share) if x >= 0.8 - 1e-12]


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(6)] + [["tiny", "one"]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    noise = lambda n: [word() for _ in range(n)]
    texts = [
        noise(50) + items[0] + noise(20), noise(9) + items[1][20:] + noise(5) + items[1][:20], noise(30) + items[2][:20], noise(60), ["TINY", "One"], noise(5) + [x.upper() for x in items[3]], items[4] + items[5],
    ]
    df = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(texts)] + [(50, None, 1), (51, "", 1)], "doc_id long, text string, items int")
    for kw in ({}, {"block_words": 50}):
        got = {r["doc_id"]: ([x["item_id"] for x in r["items"]], r["contaminated"]) for r in tiling.decontaminate(df, bench, **kw).collect()}
        assert got == {0: ([0], True), 1: ([1], True), 2: ([], False), 3: ([], False), 4: ([6], True), 5: ([3], True), 6: ([4, 5], True), 50: ([], False), 51: ([], False)}
    left = tiling.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 50, 51]
    assert tiling.decontaminate(df, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_of_items_without_id(spark):
    one, other = "a b c d e f g h", "k l m n o p q r"
    bench = spark.createDataFrame([(None, one), (None, other), (3, other)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"x {one} y"), (2, f"{one} z {other}"), (3, "a k b l")], "doc_id long, text string")
    for kw in ({}, {"block_words": 8}):
        got = {r["doc_id"]: ([x["item_id"] for x in r["items"]], r["contaminated"]) for r in tiling.decontaminate(df, bench, **kw).collect()}
        assert got == {1: ([None], True), 2: ([3, None, None], True), 3: ([], False)}
    assert [r["doc_id"] for r in tiling.drop_contaminated(df, bench).collect()] == [3]
