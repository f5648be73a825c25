"""Layout operators on literal rows."""

import json
import random
import re

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import captions, hierarchy
from quire.operators import layout as L
from quire.plans.report import audited_report_tables, build_report_tables
from quire.sources.layout import blocks_of, pages_of, read_layout_pages

BLOCK = (
    "artifact_id INT, page_no INT, ordinal INT, label STRING, content STRING,"
    " x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
)


def blocks(spark, rows):
    """Rows ``(artifact, page, ordinal, label, content[, box])``."""
    full = [(*r[:5], *(float(v) for v in (r[5] if len(r) > 5 else (0, 0, 10, 10)))) for r in rows]
    return spark.createDataFrame(full, BLOCK)


CITATION = re.compile(
    r"\[\d+(?:\s*[,;–-]\s*\d+)*\]|\([A-ZÀ-Ỹ][^()\n]{0,100},\s*\d{4}[a-z]?\)"
)


def test_citation_spans_slice_back_to_the_marker(spark):
    texts = [
        "😀 [1] then [2, 3] and [4–6]😀[7]",
        "(Nguyen, 2020) starts; ends (Émile & al., 1999b)",
        "[1][1][2]",
        "(lower, 2020) [x] [1;2] [١, 2]",
        "no citation 𝒳 here",
        "a [1, 2] (A" + "x" * 100 + ", 2020) (B" + "x" * 101 + ", 2020)",
    ]
    rows = [(1, 1, i, "text", t) for i, t in enumerate(texts)]
    parsed = L.order_and_assign(L.extract_citations(L.block_external_ids(blocks(spark, rows))))
    found = L.citation_positions(parsed).collect()
    actual = sorted((r.parent_external_id, r.span_start, r.span_end, r.content) for r in found)
    expected = sorted(
        (f"p1-b{i}", m.start(), m.end(), m[0])
        for i, t in enumerate(texts)
        for m in CITATION.finditer(t)
    )
    assert actual == expected
    markers = {r.ordinal: r.markers for r in parsed.collect()}
    assert markers[2] == ["[1]", "[2]"]


def test_reading_order_is_dense_on_each_page(spark):
    rng = random.Random(5)
    rows = [
        (a, p, o, "text", " ".join(["[1]"] * rng.randint(0, 3)))
        for a in range(3) for p in range(1, 4) for o in range(rng.randint(1, 9))
    ]
    counted = L.extract_citations(L.block_external_ids(blocks(spark, rows)))
    both = L.order_and_assign(counted)
    everything = L.union_blocks(both, L.citation_positions(both))
    slots = {}
    for r in everything.collect():
        slots.setdefault((r.artifact_id, r.page_no), []).append(r.reading_order)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    alone = {(r.artifact_id, r.page_no, r.ordinal): r.reading_order
             for r in L.reading_order(counted).collect()}
    assert alone == {(r.artifact_id, r.page_no, r.ordinal): r.reading_order
                     for r in both.collect()}


def test_heading_levels(spark):
    cases = {
        "1 Intro": 1, "1.2 A": 2, "1.2.3) B": 3, "2. C": 1, "1.2": 1, "1.2x D": 1, "": 1,
        "Intro": 1, "١.٢ E": 2, "1.2. F": 2, "3.4.5.6.7 G": 5, " 1.2 H": 1,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t STRING, want INT")
    for r in df.withColumn("got", text.heading_level(F.col("t"))).collect():
        assert r.got == r.want, r.t


# One page each: (label, box) in order, and the links "target <- caption" that are expected.
CAPTION_PAGES = {
    "the nearer of two targets": (
        [("image", (0, 0, 50, 10)), ("image", (0, 60, 50, 70)), ("figure_title", (0, 72, 50, 80))],
        {1: 2},
    ),
    "equally near: the first target": (
        [("image", (0, 0, 50, 10)), ("figure_title", (0, 20, 50, 30)), ("image", (0, 40, 50, 50))],
        {0: 1},
    ),
    "a taken target leaves the next one": (
        [
            ("image", (0, 0, 50, 10)), ("figure_title", (0, 12, 50, 20)),
            ("figure_caption", (0, 22, 50, 30)), ("image", (0, 90, 50, 99)),
        ],
        {0: 1, 3: 2},
    ),
    "an early caption takes what suits a later one better": (
        [("figure_title", (0, 0, 90, 10)), ("image", (0, 50, 90, 60)), ("figure_title", (0, 61, 90, 70))],
        {1: 0},
    ),
    "beside, with touching edges, is no overlap": (
        [("image", (0, 0, 50, 10)), ("figure_title", (50, 12, 90, 20))],
        {},
    ),
    "tables and figures do not mix": (
        [
            ("table", (0, 0, 50, 10)), ("figure_title", (0, 12, 50, 20)),
            ("table_title", (0, 90, 50, 99)), ("chart", (0, 100, 50, 110)),
        ],
        {0: 2, 3: 1},
    ),
    "a heading parts the page": (
        [
            ("image", (0, 0, 50, 10)), ("paragraph_title", (0, 12, 50, 20)),
            ("figure_title", (0, 22, 50, 30)), ("image", (0, 90, 50, 99)),
        ],
        {3: 2},
    ),
    "a caption without any target": ([("table_caption", (0, 0, 50, 10)), ("text", (0, 12, 50, 20))], {}),
}


def _linked(spark, rows):
    typed = L.assign_sections(L.map_block_type(L.block_external_ids(blocks(spark, rows))))
    return captions.link_captions(typed).collect()


def test_captions_of_literal_pages(spark):
    rows, expected = [], {}
    for a, (page, links) in enumerate(CAPTION_PAGES.values()):
        rows += [(a, 1, o, label, "x", box) for o, (label, box) in enumerate(page)]
        expected.update({(a, target): f"p1-b{caption}" for target, caption in links.items()})
    linked = {
        (r.artifact_id, r.ordinal): r.caption_external_id
        for r in _linked(spark, rows) if r.caption_external_id
    }
    assert linked == expected


def test_caption_links_are_fair(spark):
    """No caption and no target twice; a target left free suits no caption better than its own."""
    rng = random.Random(11)
    labels = ["figure_title", "figure_caption", "table_title", "table_caption", "image", "chart", "table"]
    rows = []
    for a in range(40):
        for o in range(14):
            x, y = rng.choice([0, 50, 100]), rng.choice([0, 10, 20, 30])
            rows.append((a, 1, o, rng.choice(labels), "x", (x, y, x + 50, y + 10)))
    linked = _linked(spark, rows)
    box = {(r.artifact_id, r.external_id): (r.x0, r.y0, r.x1, r.y1) for r in linked}
    kind = {(r.artifact_id, r.external_id): captions.CAPTION_KIND.get(r.label, r.block_type) for r in linked}
    pairs = [(r.artifact_id, r.external_id, r.caption_external_id) for r in linked if r.caption_external_id]
    assert pairs and len({(a, c) for a, _, c in pairs}) == len(pairs)

    def suits(a, target, caption):
        t, c = box[a, target], box[a, caption]
        if kind[a, target] != kind[a, caption] or t[0] >= c[2] or c[0] >= t[2]:
            return None
        return min(abs(t[3] - c[1]), abs(c[3] - t[1]))

    free = [
        (r.artifact_id, r.external_id) for r in linked
        if r.caption_external_id is None and r.label not in captions.CAPTION_KIND
    ]
    for a, target, caption in pairs:
        own = suits(a, target, caption)
        assert own is not None
        for b, other in free:
            if a == b and suits(a, other, caption) is not None:
                assert suits(a, other, caption) >= own


def test_bad_boxes(spark):
    good = (0.0, 0.0, 5.0, 5.0)
    bad = [
        (5.0, 0.0, 4.0, 5.0), (-1.0, 0.0, 4.0, 5.0), (0.0, 6.0, 4.0, 5.0),
        (float("nan"), 0.0, 1.0, 1.0), (0.0, 0.0, float("inf"), 1.0), (None, 0.0, 1.0, 1.0),
    ]
    rows = [(0, 1, 0, "text", "", *good)]
    rows += [(i + 1, 1, 0, "text", "", *b) for i, b in enumerate(bad)]
    accepted, rejects = L.validate_bbox(spark.createDataFrame(rows, BLOCK))
    assert [r.artifact_id for r in accepted.collect()] == [0]
    assert sorted(r.unit_id for r in rejects.collect()) == ["1", "2", "3", "4", "5", "6"]


def test_paths_cycles_and_unknown_parents(spark):
    rows = [
        (1, "a", None, 0, "A"), (1, "b", "a", 1, ""), (1, "c", "b", 2, "C"), (1, "d", None, 3, None),
        (2, "a", "b", 0, "A"), (2, "b", "a", 1, "B"), (2, "c", None, 2, "C"),
        (3, "a", "zz", 0, "A"),
        (4, "a", "b", 0, "A"), (4, "b", None, 1, "B"), (4, "s", "a", 2, "S"),
        (5, "x", "x", 0, "X"),
    ]
    sections = spark.createDataFrame(
        rows,
        "artifact_id INT, external_id STRING, parent_external_id STRING, ordinal INT, title STRING",
    )
    accepted, rejects = hierarchy.section_paths(sections)
    paths = {(r.artifact_id, r.external_id): r.section_path for r in accepted.collect()}
    assert paths == {
        (1, "a"): ["A"], (1, "b"): ["A"], (1, "c"): ["A", "C"], (1, "d"): [],
        (4, "a"): ["B", "A"], (4, "b"): ["B"], (4, "s"): ["B", "A", "S"],
    }
    assert sorted((r.unit_id, r.message) for r in rejects.collect()) == [
        ("2", "section parent cycle"), ("3", "unknown parent section"),
        ("5", "section parent cycle"),
    ]


def test_deep_chain_path(spark):
    rows = [(1, f"s{i}", f"s{i - 1}" if i else None, i, str(i)) for i in range(70)]
    sections = spark.createDataFrame(
        rows,
        "artifact_id INT, external_id STRING, parent_external_id STRING, ordinal INT, title STRING",
    )
    accepted, _ = hierarchy.section_paths(sections)
    last = accepted.filter("ordinal = 69").first()
    assert last.section_path == [str(i) for i in range(70)]


def test_unknown_references_void_the_artifact(spark):
    rows = [
        (1, "p1-b0", None, None, None), (1, "p1-b1", "section-0", "p1-b0", None),
        (2, "p1-b0", "section-7", None, None), (3, "p1-b0", None, "p9-b9", None),
        (4, "p1-b0", None, None, "p9-b9"),
    ]
    named = spark.createDataFrame(
        rows,
        "artifact_id INT, external_id STRING, section_external_id STRING,"
        " parent_external_id STRING, caption_external_id STRING",
    )
    sections = spark.createDataFrame([(1, "section-0")], "artifact_id INT, external_id STRING")
    resolved, rejects = L.resolve_block_references(named, sections)
    assert sorted((r.unit_id, r.message) for r in rejects.collect()) == [
        ("2", "unknown section"), ("3", "unknown parent block"), ("4", "unknown caption block")
    ]
    got = {r.external_id: r for r in resolved.collect()}
    assert got["p1-b1"].parent_block_id == got["p1-b0"].id
    assert got["p1-b0"].section_id is None


def test_ocr_text_to_blocks(spark):
    line = (
        '{"result":{"layoutParsingResults":[{"prunedResult":{"parsing_res_list":'
        '[{"block_label":"text","block_content":null,"block_bbox":[0,1,2,3],"block_id":7}]}},'
        '{"prunedResult":{"parsing_res_list":[]}}]}}'
    )
    broken = '{"result":{"layoutParsingResults":[{"prunedResult":{"parsing_res_list":{"a":1}}}]}}'
    texts = spark.createDataFrame(
        [("a", f"{line}\n\n  \r\n{line}"), ("b", broken), ("c", "  ")],
        "artifact_id STRING, value STRING",
    )
    pages = pages_of(texts)
    assert pages.filter("artifact_id = 'a'").count() == 4
    ok, rejects = L.audit_layout_output(pages)
    assert sorted((r.unit_id, r.message) for r in rejects.collect()) == [
        ("b", "invalid page blocks"), ("c", "no pages")
    ]
    got = blocks_of(ok).orderBy("page_no").collect()
    assert [(r.page_no, r.ordinal, r.content, r.block_id, r.y1) for r in got] == [
        (1, 0, "", "7", 3.0), (3, 0, "", "7", 3.0)
    ]
    _, quota = L.audit_layout_output(pages.filter("artifact_id = 'a'"), max_bytes=10)
    assert quota.first().message == "output exceeds quota"


def test_faulty_layout_files_are_refused(spark):
    def line(*pages):
        return json.dumps(
            {"result": {"layoutParsingResults": [{"prunedResult": {"parsing_res_list": p}} for p in pages]}}
        )

    block = {"block_label": "text", "block_content": "x", "block_bbox": [0, 0, 1, 1]}
    files = {
        "good": (line([block], [block]) + "\n" + line([block]), None),
        "no blocks": (line([]), None),
        "broken line": (line([block]) + "\n{oops\n" + line([block]), "invalid page blocks"),
        "other line": (line([block]) + '\n{"a": 1}', "invalid page blocks"),
        "empty": ("", "no pages"),
        "blank": (" \n \n", "no pages"),
        "no object": (line([7, "x"]), "invalid page blocks"),
        "no list": (line({"a": 1}), "invalid page blocks"),
        "no label": (line([{**block, "block_label": None}]), "block without label"),
        "bad box": (line([{**block, "block_bbox": [0, 0, 1]}]), "invalid bounding box"),
    }
    texts = spark.createDataFrame([(k, v[0]) for k, v in files.items()], "artifact_id STRING, value STRING")
    built = audited_report_tables(pages_of(texts))
    got = {r.unit_id: r.message for r in built.rejects.collect()}
    assert got == {k: v[1] for k, v in files.items() if v[1]}
    pages = sorted((r.artifact_id, r.page_no) for r in built.blocks.collect())
    assert pages == [("good", 1), ("good", 2), ("good", 3)]
    small = L.audit_layout_output(pages_of(texts.filter("artifact_id = 'good'")), max_bytes=50)[1]
    assert [(r.message, int(r.offender)) for r in small.collect()] == [
        ("output exceeds quota", len(files["good"][0]))
    ]


def test_layout_files_on_disk(spark, tmp_path):
    text = '{"result": {"layoutParsingResults": [{"prunedResult": {"parsing_res_list": [{"block_label": "text"}]}}]}}\n'
    (tmp_path / "a1.jsonl").write_text(text * 2)
    (tmp_path / "b2.jsonl").write_text("{")
    pages = read_layout_pages(spark, str(tmp_path))
    assert {(r.artifact_id, r.page_no, r.n_bytes) for r in pages.collect()} == {
        ("a1", 1, 2 * len(text)), ("a1", 2, 2 * len(text)), ("b2", 1, 1)
    }


def test_report_reruns_are_equal(spark, sf_dir):
    from checks import inputs

    def run():
        built = build_report_tables(inputs.layout_blocks(spark, sf_dir))
        return sorted(r.id for r in built.blocks.select("id").collect())

    assert run() == run()


def test_large_files_are_read_by_splits_and_oversized_ones_not_at_all(spark, tmp_path):
    def line(*blocks):
        pages = [{"prunedResult": {"parsing_res_list": b}} for b in blocks]
        return json.dumps({"result": {"layoutParsingResults": pages}})

    def block(text):
        return [{"block_label": "text", "block_content": text, "block_bbox": [0, 0, 1, 1]}]

    rng, want = random.Random(7), {}
    for name in ("a", "b", "c d+e%"):
        lines, pages = [], []
        for i in range(300):
            texts = [f"{name} {i} {k} " + "x" * rng.randint(0, 300) for k in range(rng.randint(0, 3))]
            lines.append(line(*map(block, texts)) if texts else rng.choice(["", "   ", "\t"]))
            pages += texts
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
        want[name] = pages
    (tmp_path / "empty.jsonl").write_text("\n \n")
    (tmp_path / "huge.jsonl").write_text(line(block("y" * 400_000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "8192")
        pages = read_layout_pages(spark, str(tmp_path), max_bytes=300_000).cache()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = pages.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted((r for r in rows if r.page_no), key=lambda r: (r.artifact_id, r.page_no)):
        got.setdefault(r.artifact_id, []).append((r.page_no, json.loads(r.page_json)["parsing_res_list"][0]["block_content"]))
    assert got == {k: list(enumerate(v, 1)) for k, v in want.items()}
    assert {(r.artifact_id, r.page_json) for r in rows if not r.page_no} == {("empty", None), ("huge", None)}
    _, rejects = L.audit_layout_output(pages, 300_000)
    assert {(r.unit_id, r.message) for r in rejects.collect()} == {("huge", "output exceeds quota"), ("empty", "no pages")}
