"""Fill-in-the-middle, toxicity and vector codes."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import codes, infill, toxicity

# --- fill in the middle -------------------------------------------------------------------------


def plain_infill(doc_id: int | None, text: str | None, unit: str = "token", rate: int = 90) -> tuple:
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "token" else list(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


AWKWARD = ["a<P>b", "<S>", "x<M", "<<<>>>", "P>S>M><", "ééé", "😀" * 9, "a😀b é\x00\n", "<P", "ſK"]


@pytest.mark.parametrize("unit", ["token", "char"])
@pytest.mark.parametrize("table", ["table", "tricky", "made"])
def test_infill_equals_plain(spark, documents, tricky, table, unit):
    rng = random.Random(4)
    made = AWKWARD + ["".join(rng.choices("ab<PSM>é😀 \n", k=rng.randint(0, 12))) for _ in range(800)]
    made = spark.createDataFrame(list(enumerate(made, -5)), "doc_id int, text string")
    docs = {"table": documents, "tricky": tricky, "made": made}[table]
    got = infill.infilled(docs, unit)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_infill(d, t, unit) for d, t in rows)
    back = got.select("doc_id", infill.restored(F.col("output"), F.col("form")))
    assert Counter(tuple(r) for r in back.collect()) == Counter((d, t or "") for d, t in rows)


def test_index_converts_both_ways():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices("ab é😀中\n", k=rng.randint(0, 20)))
        index = infill.MultibyteIndex.of(np.frombuffer(text.encode(), np.uint8))
        for k in range(len(text) + 1):
            at = len(text[:k].encode())
            assert (index.to_bytes(k), index.to_chars(at)) == (at, k)
    assert len(infill.MultibyteIndex.of(np.frombuffer(b"plain" * 99, np.uint8)).start) == 0


def test_infill_of_nothing(no_documents, documents):
    assert infill.infilled(no_documents).isEmpty()
    assert infill.infilled(documents, rate=0).where("form <> 'plain'").isEmpty()
    with pytest.raises(ValueError):
        infill.infilled(documents, unit="line")


# --- toxicity -----------------------------------------------------------------------------------


def sentences(n: int, seed: int) -> list[tuple[int, str, int]]:
    """An insult, or a group's mention, is harmless alone; both together are toxic."""
    rng, filler = random.Random(seed), [f"wort{chr(97 + i)}{chr(97 + j)}" for i, j in product(range(12), range(12))]
    rows = []
    for i in range(n):
        words = rng.sample(filler, 12)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["rotters"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_tell_what_no_word_tells_alone():
    """Exclusive or: every word is as frequent in both classes, so that additive weights see nothing."""
    rng = random.Random(2)
    places = [(a, b, 2 + rng.randrange(6)) for _ in range(400) for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))]
    rows = [np.array([i for i, on in enumerate((a, b)) if on] + [k]) for a, b, k in places]
    target = np.array([a ^ b for a, b, _ in places], np.float32)
    bias, weight, vector = toxicity.train(rows, target, 8)
    machine = toxicity.Machine(np.arange(8), bias, weight, vector)
    got = np.array([machine.score(r) for r in rows])
    assert ((got >= 0.5) == target).all()


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS)))
    for n in (0, 1, 2, 17):
        terms = rng.choice(30, n, replace=False)
        pairs = sum(machine.vector[a] @ machine.vector[b] for a, b in combinations(terms, 2))
        assert machine.margin(terms) == pytest.approx(0.3 + machine.weight[terms].sum() + pairs)


def test_insult_with_group_mention(spark):
    rows = sentences(1200, 5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, toxic) for i, _, toxic in rows], "doc_id bigint, toxic int")
    scored = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 150 and sum(r.predicted == r.toxic for r in scored) >= 0.97 * len(scored)


def test_terms_equal_plain():
    text = "Idiots, IDIOT! été x9y ab naïve"
    words = {"idiots", "idiot", "été", "x", "y", "ab", "naïve"}
    plain = {b for w in words for b in toxicity.terms_of(w)}
    assert set(toxicity.Terms().of(text).tolist()) == plain
    known = np.sort([*toxicity.terms_of("idiot"), 5])
    assert known[toxicity.Terms(known).of(text)].tolist() == sorted(toxicity.terms_of("idiot"))
    assert toxicity.Terms().of("").tolist() == []


def test_labels_of_held_out_rows_change_nothing(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.scored(documents, toxicity.fit(documents, x)) for x in (labels, turned))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    known = a.join(labels, "doc_id").where("not held_out")
    assert known.where("predicted = toxic").count() >= 0.9 * known.count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in a.collect())


def test_toxicity_on_awkward_rows(spark, tricky, no_documents):
    labels = [(i, i % 2, "x") for i in range(12)] + [(3, 0, "x"), (3, None, "x"), (None, 1, "x"), (999, 1, "x")]
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int, score string")
    out = toxicity.scored(tricky, toxicity.fit(tricky, labels), keep=("source",))
    assert out.count() == tricky.count() and out.where("score is null or score < 0 or score > 1").isEmpty()
    none = toxicity.scored(tricky, toxicity.fit(tricky, labels.limit(0)))
    assert none.where("predicted = 1").isEmpty()
    assert toxicity.scored(no_documents, toxicity.fit(no_documents, labels)).isEmpty()


# --- vector codes -------------------------------------------------------------------------------


def plain_codes(vectors: list[tuple], rounds: int, entries: int) -> tuple[list, list]:
    """``(vec_id, label, entries, error)`` of each row and the codebooks, in Python integers."""
    longest = max((len(v) for *_, v in vectors), default=0)
    width = -(-longest // 4)
    rows = [[(list(v) + [0] * (4 * width - len(v)))[p * width : (p + 1) * width] for p in range(4)] for *_, v in vectors]
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, vectors[i][2]))
    books = [[rows[i][p] for i in order[:entries]] for p in range(4)]

    def assign() -> list[list[tuple[int, int]]]:
        return [
            [min((sum((x - y) ** 2 for x, y in zip(r[p], e)), k) for k, e in enumerate(books[p])) for p in range(4)]
            for r in rows
        ]

    for _ in range(rounds):
        found = assign()
        for p in range(4):
            for k in range(len(books[p])):
                mine = [r[p] for r, f in zip(rows, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    done = [
        (i, label, tuple(k for _, k in f), min(sum(d for d, _ in f), 2**63 - 1)) for (i, label, _), f in zip(vectors, found)
    ]
    return done, books


def made_vectors(kind: str) -> list[tuple]:
    rng = random.Random(11)
    if kind == "random":
        return [(i, i % 3 or None, [rng.randint(-600, 600) for _ in range(16)]) for i in range(300)]
    if kind == "hot":  # two thirds equal, repeated rows and ids, null ids
        rows = [(i, 0, [5, -5] * 4) for i in range(200)] + [(i, 1, [rng.randint(-3, 3) for _ in range(8)]) for i in range(100)]
        return rows + rows[:20] + [(None, None, [9] * 8)] * 3
    if kind == "huge":  # beyond doubles, then beyond 64-bit squares
        return [(i, i % 2, [rng.randint(-(2**e), 2**e) for _ in range(6)]) for i, e in enumerate([20, 29, 34, 62] * 12)]
    if kind == "ragged":
        return [(i, None, [rng.randint(-9, 9) for _ in range(i % 7)]) for i in range(60)]
    return [(7, 1, [1, 2, 3, 4])]


@pytest.mark.parametrize("block", [3, 64])
@pytest.mark.parametrize("kind", ["random", "hot", "huge", "ragged", "one"])
def test_codes_equal_plain(spark, kind, block):
    vectors = made_vectors(kind)
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id bigint, label int, code array<bigint>, row string")
    done = codes.compressed(df, rounds=3, entries=20, block=block)
    rows, books = plain_codes(vectors, 3, 20)
    assert Counter((r.vec_id, r.label, tuple(r.entries), r.error) for r in done.codes.collect()) == Counter(rows)
    assert done.codebooks.tolist() == books
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    assert done.digest() == hashlib.sha256(flat.encode()).hexdigest()
    sums = Counter()
    for _, label, _, error in rows:
        sums[label] += error
    assert all(r.label_error == min(sums[r.label], 2**63 - 1) for r in codes.with_label_error(done.codes).collect())


def test_codes_of_nothing(spark):
    schema = "vec_id bigint, label int, code array<bigint>"
    for rows in ([], [(1, 1, None), (2, 1, [1, None])]):
        done = codes.compressed(spark.createDataFrame(rows, schema))
        assert codes.with_label_error(done.codes).isEmpty() and done.codebooks.size == 0
    done = codes.compressed(spark.createDataFrame([(1, 1, []), (2, None, [])], schema))
    assert [tuple(r.entries) for r in done.codes.collect()] == [(0, 0, 0, 0)] * 2


@pytest.mark.parametrize("dimensions, bits", [(1, 4), (2, 3), (3, 2), (5, 1)])
def test_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dimensions)))
    position = codes.hilbert_positions(cells, bits)
    assert sorted(position) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(position)], axis=0)).sum(axis=1) == 1).all()


def test_short_list_holds_every_nearest_entry():
    rng = np.random.default_rng(6)
    for _ in range(200):
        centre = rng.integers(-50, 50, 3)
        rows, entries = centre + rng.integers(-4, 5, (9, 3)), rng.integers(-60, 60, (30, 3))
        listed = codes.short_list(rows.min(axis=0), rows.max(axis=0), entries)
        far = codes.distances(rows, entries)
        ties = np.nonzero(far == far.min(axis=1)[:, None])[1]
        assert set(ties) <= set(listed) and len(listed) <= len(entries)
