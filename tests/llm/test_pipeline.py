"""The pipeline's stages against the operators' own verdicts, and odd inputs."""

import collections

import compare
import pytest

import corpus_pipeline
from factloom.llm import langid, mixing, quality, queries, simhash


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [collections.Counter(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert ids[1] == collections.Counter(r.doc_id for r in langid.identify(docs).collect() if not r.rejected)
    assert ids[2] == collections.Counter(r.doc_id for r in quality.rate(frames[1]).collect() if r.kept)
    assert ids[3] == collections.Counter(r.doc_id for r in simhash.near_duplicates(frames[2]).collect() if r.doc_id == r.component_id)
    assert ids[4] == collections.Counter({r.doc_id: r.times for r in mixing.plan(frames[3]).collect() if r.times})
    assert ids[5] == ids[4]
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == collections.Counter(map(tuple, frames[-1].collect()))


def test_odd_inputs(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, 0), (1, None, None, None, None), (2, "word " * 50, "en", None, 1)], schema)
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
        df.collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    assert compare.differences(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name]) == ""
