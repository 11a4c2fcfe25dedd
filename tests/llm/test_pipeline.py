"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from ductwork.llm import mixing, toxicity
from test_corpus_operators import DOCS, SPACED, brute_components, brute_decontamination, brute_targets, near_copies, plain_spans, prose


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    texts = [None, "", *(prose(i, r.randint(20, 120), 2000) for i in range(150)), *near_copies(3, 120, 12, 2), *[prose(5, 60, 2000)] * 4]
    texts += [f"{prose(700 + i, 40, 2000)} mail a{i}@b.example.com and 10.0.0.{i}" for i in range(10)]
    items = [(1, prose(900, 30, 2000)), (2, prose(901, 20, 2000))]
    texts += [f"{prose(800 + i, 30, 2000)} {items[i % 2][1]}" for i in range(6)]
    toxic = {}
    for i in range(2, 80):
        if i % 3 == 0:
            toxic[i] = 1
            texts[i] += " stupid idiot moron" * 3
        else:
            toxic[i] = 0
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t) if t is not None else None) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, v) for i, v in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, at = spark.read.parquet(f"{folder}/documents.parquet"), {i: t for i, t in enumerate(texts)}
    source = {x[0]: x[3] for x in rows}

    def step(k, docs):
        name, stage = corpus_pipeline.STAGES[k]
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert out.columns == docs.columns, name
        return out, {x.doc_id: x.text for x in out.collect()}

    scores = {x.doc_id: x.score for x in toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    docs, kept = step(0, docs)
    assert kept == {i: t for i, t in at.items() if scores[i] < 0.7}
    ids = sorted(kept)
    docs, one = step(1, docs)
    assert sorted(one) == sorted({c for _, _, c in brute_components([kept[i] for i in ids], ids)})
    ids = sorted(one)
    docs, clean = step(2, docs)
    judged = brute_decontamination([one[i] for i in ids], items)
    assert sorted(clean) == [i for i, j in zip(ids, judged) if not j[4]]
    docs, safe = step(3, docs)
    assert sorted(safe) == sorted(clean)
    for i, t in clean.items():
        assert (safe[i] == t) or not any(t[a:b] in safe[i] for _, a, b in plain_spans(t)) or not plain_spans(t)
        if plain_spans(t):
            assert safe[i] != t and not plain_spans(safe[i])
    size = {i: len(SPACED.findall(t or "")) for i, t in safe.items()}
    per = {}
    for i in safe:
        per[source[i]] = per.get(source[i], 0) + size[i]
    want = brute_targets(per)
    copies = {x.doc_id: x.copies for x in mixing.mix(docs).collect()}
    out = spark.read.parquet(f"{folder}/3") and corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert sorted((x.doc_id, x.copy) for x in out) == sorted((i, c) for i, n in copies.items() for c in range(1, n + 1))
    for s, w in want.items():
        assert abs(sum(size[x.doc_id] for x in out if x.source == s) - w) <= max(size.values())


def test_stages_on_empty_tables_and_odd_columns(spark, tmp_path):
    """Every stage takes an empty table, and nulls, repeats and columns of the caller's pass through."""
    folder = str(tmp_path)
    some = [(1, "a b c d e", "en", None, 9, "x"), (None, None, None, None, None, None), (1, "a b c d e", "en", None, 9, "x"), (3, "", "en", "s", 0, "y")]
    docs = spark.createDataFrame(some, DOCS + ", score string").withColumnRenamed("score", "copies")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        if k < 4:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() == (3 if k == 1 else 4), name
