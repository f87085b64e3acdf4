"""The pipeline, stage by stage against brute-force versions, on documents with awkward rows."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from cases import components, contamination, documents
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    home = f"file://{tmp_path_factory.mktemp('sf')}"
    r = random.Random(1)
    rows = [(*x, None) for x in documents(seed=7, n=50)]
    junk = [(500 + i, "\n".join(" ".join(r.choice(["BUY", "NOW", "WIN"]) + "!!" for _ in range(25)) for _ in range(3)), "en", "c", 1) for i in range(30)]
    spark.createDataFrame(rows + junk, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{home}/documents.parquet")
    labels = [(i, 1, 0) for i in range(70)] + [(500 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    items = [(1, " ".join((rows[4][1] or "a b").split()[:20])), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


def key(df):
    return sorted((repr(tuple(x)) for x in df.select("doc_id", "text").collect()))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "shards":
            assert out.columns == columns
        before = [(x["doc_id"], x["text"], x["lang"], x["source"]) for x in docs.collect()]
        after = [(x["doc_id"], x["text"]) for x in out.collect()]
        if name == "quality":
            assert len([1 for i, _ in after if i is not None and i >= 500]) == 0 and len(after) >= 50
        if name == "near_duplicates":
            groups = {c for i, n, c in components(before) if n and c is not None}
            assert {i for i, t in after if i is not None and (t or "").split()} == groups
        if name == "contamination":
            bench = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert sorted(map(repr, after)) == sorted(repr(x[:2]) for x in before if not contamination([x], bench)[0][5])
        if name == "mixture":
            assert {x for x in after} <= {x[:2] for x in before} and all(after.count(x) <= 3 * [y[:2] for y in before].count(x) for x in after)
        if name == "shards":
            assert sorted(map(repr, after)) == sorted(repr(x[:2]) for x in before) and "shard" in out.columns
        kept[name] = len(after)
        path = f"{sf_dir}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert kept["near_duplicates"] < kept["quality"] and kept["contamination"] < kept["near_duplicates"]


def test_run_equals_stages(spark, sf_dir):
    a = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect()))
    assert a.where(F.col("shard").isNull()).count() == 0


def test_empty_tables(spark, tmp_path):
    home = f"file://{tmp_path}"
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{home}/{name}.parquet")
    assert corpus_pipeline.run(spark, home).count() == 0
