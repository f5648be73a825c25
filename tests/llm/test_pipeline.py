"""The pipeline's stages, each on what the one before kept, and on awkward rows."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import mixing, packing, quality, similar

from . import brute


def pairs(df) -> Counter:
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_follow_one_another(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(out.columns) == set(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        results[name] = (before, docs)

    before, after = results["quality_classifier"]
    weights = quality.fit(before)
    want = quality.scored(before, weights).where("kept")
    assert pairs(after) == pairs(want) and 0 < after.count() < before.count()

    before, after = results["near_duplicates"]
    had, has = pairs(before), pairs(after)
    assert all(n == 1 for n in has.values()) and set(has) <= set(had)
    kept = {t: d for d, t in has}
    for doc_id, text in had:
        # What is gone has a kept text, or one that is gone too, as its near duplicate of smaller id.
        if (doc_id, text) not in has:
            assert kept.get(text, doc_id + 1) < doc_id or any(
                similar.similarity(text, t) >= similar.SIMILAR for d, t in had if t != text
            )
    for d, t in has:
        assert not any(d2 < d and t2 == t for d2, t2 in had)
    # No two kept texts are near duplicates: all pairs, by brute force.
    sets = [similar._shingles(t or "", similar.WORDS) for t in kept]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            least, most = sorted((len(a), len(b)))
            assert least < similar.SIMILAR * most or len(a & b) < similar.SIMILAR * len(a | b)

    before, after = results["personal_data"]
    source = {r.doc_id: r for r in before.collect()}
    for r in after.collect():
        spans = sorted((a, b, k) for k, v in brute.base_spans(source[r.doc_id].text or "").items() for a, b in v)
        changed = r.text != source[r.doc_id].text  # without a base span, by one that a context discovered
        assert r.n_chars == len(r.text) and (changed if spans else not changed or re.search("<[A-Z]+>", r.text))
        assert not any(brute.base_spans(r.text).values())

    before, after = results["source_mixing"]
    assert pairs(after) == pairs(mixing.mix(before, mixing.source_rates(before)))

    before, after = results["best_fit_packing"]
    assert after.where("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= packing.LIMIT


@pytest.mark.parametrize("rows", ["tricky", "none"])
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_on_awkward_rows(spark, sf_dir, tricky, no_documents, stage, rows):
    docs = tricky if rows == "tricky" else no_documents
    out = stage[1](spark, docs, sf_dir)
    assert out.isEmpty() == (rows == "none")


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and not out.isEmpty()
