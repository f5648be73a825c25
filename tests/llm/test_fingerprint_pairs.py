"""The pipeline's near duplicates are proposed by SimHash first, and completed by the exact search."""

import random

from quire.llm import similar, simhash


def _texts(spark):
    rng = random.Random(5)
    rows = []
    for group in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(group * 10, " ".join(words)), (group * 10 + 1, " ".join(words[:-1] + ["other"]))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_copies_are_proposed_by_their_fingerprints(spark, monkeypatch):
    """Without any candidate from shingles, texts of near fingerprints still meet and are verified."""
    docs = _texts(spark)
    whole = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert whole == [g * 10 for g in range(12)]
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    near = {g for g in range(12) if (fps[g * 10] ^ fps[g * 10 + 1]).bit_count() <= simhash.TAU}
    assert near
    shared = similar._shared_keys
    monkeypatch.setattr(similar, "_shared_keys", lambda *a: shared(*a).limit(0))
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert {g for g in range(12) if g * 10 + 1 not in kept} == near


def test_near_fingerprints_alone_join_no_texts(spark, monkeypatch):
    docs = _texts(spark)
    every = [(a.doc_id, b.doc_id) for a in docs.collect() for b in docs.collect() if a.doc_id < b.doc_id]
    pairs = spark.createDataFrame(every, "x long, y long")
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda texts: pairs)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [g * 10 for g in range(12)]
