"""The pipeline against plain versions of its stages, and the registered queries."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lorekiln.llm import quality

from .test_operators import DOCS, WORDS, brute_components, corpus, make


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    own = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]

    docs = stage("quality classifier")(spark, docs, sf).cache()
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
    own = [r for r in own if scores[r[0]] >= 0.5]
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {r[0] for r in own}

    docs = stage("exact dedup")(spark, docs, sf).cache()
    last = {}
    for i, t, s in sorted(own):
        last[t or ""] = (i, t, s)
    own = sorted(last.values())
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {r[0] for r in own}

    docs = stage("n-gram Jaccard join")(spark, docs, sf).cache()
    first = {c for _, _, c in brute_components(own, 5, 80)}
    own = [r for r in own if r[0] in first]
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {r[0] for r in own}

    docs = stage("mixing sources to target weights")(spark, docs, sf).cache()
    taken = Counter(r["doc_id"] for r in docs.collect())
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in own}
    assert docs.columns == columns and set(taken) <= set(size) and max(taken.values()) <= 3
    assert sum(size[i] * n for i, n in taken.items()) == pytest.approx(sum(size.values()), rel=0.1)

    out = stage("byte-level BPE encoding and decoding")(spark, docs, sf).collect()
    assert Counter(r["doc_id"] for r in out) == taken
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, out))


def test_pipeline_on_odd_tables(spark, sf, tmp_path):
    for n, rows in enumerate((corpus(), [])):
        make(spark, rows).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{n}")
        assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (found.count() > 0) == bool(rows)
    assert "kept boolean" in DOCS


def test_every_operator_has_a_query():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
