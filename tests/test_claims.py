"""Claim operators on literal rows."""

import json
import random

from pyspark.sql import functions as F

from quire.operators import claims as C


def grouped(spark, lengths):
    """One section per artifact from block lengths."""
    rows = [
        (a, 0, 0, i, i // 8 + 1, f"p{i // 8 + 1}-b{i % 8}", "x" * n, ["[1]"] if i == 0 else [])
        for a, ns in lengths.items() for i, n in enumerate(ns)
    ]
    return spark.createDataFrame(
        rows,
        "artifact_id INT, section_ordinal INT, group_rank INT, position INT, page_no INT,"
        " external_id STRING, content STRING, markers ARRAY<STRING>",
    )


def greedy(ns, limit):
    batches, batch, size = [], 0, 0
    for n in ns:
        if size and size + n > limit:
            batch, size = batch + 1, 0
        size += n
        batches.append(batch)
    return batches


def batches_of(df):
    out = {}
    for r in df.orderBy("position").collect():
        out.setdefault(r.artifact_id, []).append(r.batch_no)
    return out


def test_batches_equal_the_loop_for_any_segment(spark):
    rng = random.Random(2)
    lengths = {a: [rng.randint(1, 30) for _ in range(rng.randint(1, 90))] for a in range(20)}
    lengths[50] = [10] * 300
    lengths[51] = [0, 0, 40, 0, 0, 1, 40, 0] * 9 + [0] * 20
    lengths[52] = [40] * 70
    expected = {a: greedy(ns, 40) for a, ns in lengths.items()}
    df = grouped(spark, lengths)
    for segment in (1, 5, 64, 1000):
        batched, none = C.batch_section_text(df, 40, segment_blocks=segment)
        assert none.isEmpty()
        assert batches_of(batched) == expected


def test_one_and_a_hundred_thousand_blocks_take_one_way(spark):
    """Packed side by side in segments, by one plan; no section is gathered."""
    import numpy as np

    n = np.random.default_rng(4).integers(1, 2000, 100_000)
    rows = spark.range(100_000).select(F.lit(1).alias("artifact_id"), F.col("id").cast("int").alias("position"),
                                       F.get(F.lit([int(x) for x in n]), F.col("id").cast("int")).cast("long").alias("n"))
    one = spark.createDataFrame([(2, 0, 30_000)], "artifact_id INT, position INT, n BIGINT")
    packed = C._packed(rows.union(one).withColumn("group_rank", F.lit(0)), 24_000, 64)
    found = packed.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("position", "batch_no"))).alias("b"))
    got = {r.artifact_id: [b.batch_no for b in r.b] for r in found.collect()}
    assert got == {1: greedy(n.tolist(), 24_000), 2: [0]}


def test_batch_boundary_and_oversized_block(spark):
    limit = C.MAX_BATCH_CHARS
    df = grouped(spark, {1: [limit - 1, 1, 1], 2: [limit], 3: [5, limit + 1], 4: [limit, limit]})
    batched, rejects = C.batch_section_text(df)
    assert batches_of(batched) == {1: [0, 0, 1], 2: [0], 4: [0, 1]}
    assert [(r.unit_id, r.offender) for r in rejects.collect()] == [("3", "p1-b1")]


def test_groups_rank_by_first_appearance(spark):
    rows = [(1, None, 1, 0), (1, 4, 1, 1), (1, 2, 1, 3), (1, 4, 2, 0), (1, 2, 9, 0), (2, 7, 1, 0)]
    df = spark.createDataFrame(
        rows, "artifact_id INT, section_ordinal INT, page_no INT, reading_order INT"
    )
    for pages in (1, 256):
        got = {(r.artifact_id, r.page_no, r.reading_order): (r.group_rank, r.position)
               for r in C.group_section_text(df, pages).collect()}
        assert got == {(1, 1, 0): (0, 0), (1, 1, 1): (1, 0), (1, 1, 3): (2, 0), (1, 2, 0): (1, 1),
                       (1, 9, 0): (2, 1), (2, 1, 0): (0, 0)}


def claim(**changes):
    base = {
        "claim_type": "factual", "text_content": "xx", "source_block_external_id": "p1-b0",
        "context_block_external_ids": ["p1-b1"], "citation_markers": ["[1]"],
        "source_span": {"start": 0, "end": 2},
    }
    return {**base, **changes}


def response(claims, finish="stop", content=None):
    content = json.dumps({"claims": claims}) if content is None else content
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content}}]})


def parsed(spark, responses):
    lengths = {a: [4, 4] for a in range(len(responses))}
    batched = grouped(spark, lengths).withColumn("batch_no", F.lit(0))
    answers = spark.createDataFrame(
        [(a, 0, 0, r) for a, r in enumerate(responses)],
        "artifact_id INT, group_rank INT, batch_no INT, response STRING",
    )
    return batched, C.parse_claim_responses(answers, batched, "m")


def test_response_faults(spark):
    cases = [
        (response([claim()]), None),
        (response([]), None),
        (response([claim()], finish="length"), "incomplete output"),
        (response([], content="not json"), "content is not JSON"),
        (response([], content='{"claims": {"a": 1}}'), "expected claims array"),
        (response([], content='{"other": []}'), "expected claims array"),
        (response([claim(source_block_external_id="p9-b9")]),
         "claim references text outside its input"),
        (response([claim(context_block_external_ids=["p9-b9"])]),
         "claim references text outside its input"),
        ("{}", "incomplete output"),
    ]
    _, (claims, rejects) = parsed(spark, [c for c, _ in cases])
    got = {int(r.unit_id): r.message for r in rejects.collect()}
    assert got == {i: m for i, (_, m) in enumerate(cases) if m}
    one = claims.filter("artifact_id = 0").first()
    assert one.extractor_version == "m:claims-1" and len(one.external_id) == 64


def test_a_batch_without_an_answer_voids_its_unit(spark):
    batched = grouped(spark, {0: [4, 4], 1: [4, 4]}).withColumn("batch_no", F.lit(0))
    answers = spark.createDataFrame(
        [(0, 0, 0, response([claim()]))],
        "artifact_id INT, group_rank INT, batch_no INT, response STRING",
    )
    claims, rejects = C.parse_claim_responses(answers, batched, "m")
    assert [(r.unit_id, r.message, r.offender) for r in rejects.collect()] == [
        ("1", "no response", "0/0")
    ]
    assert claims.count() == 1


def test_claim_faults(spark):
    cases = [
        ([claim()], None),
        ([claim(claim_type="evaluative")], "claim type"),
        ([claim(confidence=1.5)], "confidence range"),
        ([claim(text_content=None)], "missing field"),
        ([claim(), claim()], "duplicate claim"),
        ([claim(source_span={"start": 0, "end": 5})], "invalid source span"),
        ([claim(source_span={"start": 2, "end": 2})], "invalid source span"),
        ([claim(source_span={"start": -1, "end": 2})], "invalid source span"),
        ([claim(source_span={"start": 0})], "invalid source span"),
        ([claim(source_span={"start": 0, "end": 2, "page": 1})], "invalid source span"),
        ([claim(text_content="  \n")], "invalid source span"),
        ([claim(citation_markers=["[1]", "[2]"])], "invented citation markers"),
        ([claim(source_block_external_id="p1-b1", context_block_external_ids=["p1-b0"])], None),
        ([claim(source_block_external_id="p1-b1", context_block_external_ids=[])],
         "invented citation markers"),
        # a schema fault later in the section comes before an earlier claim's own fault
        ([claim(citation_markers=["[9]"]), claim(claim_type="no")], "claim type"),
    ]
    batched, (claims, _) = parsed(spark, [response(c) for c, _ in cases])
    valid, rejects = C.validate_claims(claims, batched)
    got = {int(r.unit_id): r.message for r in rejects.collect()}
    assert got == {i: m for i, (_, m) in enumerate(cases) if m}
    assert all(r.code == "parser_error" for r in rejects.collect())
    kept = {r.artifact_id for r in valid.select("artifact_id").collect()}
    assert kept == {i for i, (_, m) in enumerate(cases) if not m}
    assert valid.first().is_atomic is False


def test_context_order_is_kept(spark):
    batched, (claims, _) = parsed(
        spark, [response([claim(context_block_external_ids=["p1-b1", "p1-b0", "p1-b1"])])]
    )
    resolved, rejects = C.resolve_claim_references(claims, batched)
    row = resolved.first()
    assert rejects.isEmpty()
    a, b, c = row.context_block_ids
    assert a == c and b == row.source_block_id and a != b
