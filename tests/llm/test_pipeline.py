import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from emberfield.llm import quality, tiling

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("x", F.lit(1)).withColumn("w", F.lit("w"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns, name
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r["doc_id"] for r in d.collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = quality.score(docs, quality.train(docs, labels)).where("predicted = 0")
    assert ids[1] == ids[0] - {r["doc_id"] for r in bad.collect()}

    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower()) for r in seen[1].collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items() if w}
    kept = set(words)
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    for i in sorted(sets):
        todo, comp = [i], {i}
        while todo:
            for o in links[todo.pop()] - comp:
                comp.add(o)
                todo.append(o)
        kept -= comp - {min(comp)}
    assert ids[2] == kept
    bench = [tiling.words_of(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in seen[2].collect() if any(sum(n for *_, n in tiling.greedy_tiles(b, tiling.words_of((r["text"] or "").encode()), 5)) >= 0.8 * len(b) for b in bench)}
    assert ids[3] == ids[2] - leaked
    assert ids[4] == ids[3]
    assert not [r for r in seen[4].collect() if "@mail" in (r["text"] or "")]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[4], SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[4]


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = out if "text" in out.columns else docs
        assert out.count() == 0


def test_stages_on_odd_rows(spark):
    """Null text, null doc_id, repeated rows, a very long text: each stage gives what its docstring says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("length(text) between 300 and 2000").orderBy("doc_id").limit(3).collect()
    long = " ".join(f"word{k} here." for k in range(30_000))
    rows = [(None, good[0]["text"]), (1, None), (2, ""), (3, good[1]["text"]), (3, good[1]["text"]), (4, good[1]["text"]), (5, long), (6, good[2]["text"] + " mail a.b@mail.example")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, odd, SF)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    once = stages["near duplicates"](spark, odd, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in once) == [0, 1, 2, 3, 3, 5, 6]
    clean = stages["benchmark decontamination"](spark, odd, SF)
    assert {1, 2, 5} <= {r["doc_id"] for r in clean.collect()}
    safe = {(r["doc_id"], r["text"]) for r in stages["personal data"](spark, odd, SF).collect()}
    assert (1, None) in safe and (2, "") in safe and not any("a.b@mail.example" in (t or "") for _, t in safe)
    pieces = stages["packing"](spark, odd, SF)
    starts = sorted((r["doc_id"] or 0) for r in pieces.where("start = 0").collect())
    assert starts == sorted((i or 0) for i, _ in rows)
