"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their beginnings, hashed. The score adds a weight for each term and, for
each pair of terms, the product of their short vectors, so that two terms may say together what neither
says alone. Only terms whose frequencies differ between toxic and other texts of the training
sample have parameters; the rest, and so most words of most texts, are not looked at again.

The sample is bounded and documented (``TRAIN_ROWS``); its terms are counted and screened by Spark, and the
driver sees screened terms only. Every document is then scored in place, whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_rows, prepare
from quire.session import materialize

#: Labelled documents of each class that train the model, drawn by a hash of the id (on average no more).
TRAIN_ROWS = 8_000
#: Hashed terms there can be, and how many of them, those that tell most, have parameters.
BUCKETS, KNOWN = 1 << 22, 4_096
#: Log-likelihood ratio that a term needs for parameters: chance alone reaches it once in ten thousand terms.
LEAST = 7.5
#: Length of a term's vector.
FACTORS = 8
STEPS, LOT, SPEED = 2_000, 256, 0.05
WEIGHT_DECAY, FACTOR_DECAY = 3e-5, 1e-3
#: Beginnings of words that are terms of their own, so that inflected forms share one.
BEGINNINGS = (4, 5, 6)
FOLDS = 5
#: Words a Python worker remembers the terms of; they hold no more than speed.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def terms_of(word: str) -> tuple[int, ...]:
    """Buckets of a lower-case word and of its beginnings."""
    return (_bucket(word), *(_bucket(f"{word[:n]}-") for n in BEGINNINGS if len(word) >= n))


class Terms:
    """The distinct buckets of a text, among those of ``known`` where it is given, as places in it."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.places = None if known is None else {int(b): i for i, b in enumerate(known)}
        self.words: dict[str, tuple[int, ...]] = {}

    def _terms(self, word: str) -> tuple[int, ...]:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        found = terms_of(word)
        if self.places is not None:
            found = tuple(self.places[b] for b in found if b in self.places)
        self.words[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        found: set[int] = set()
        known = self.words
        for word in set(_WORD.findall(text.lower())):
            terms = known.get(word)
            found.update(self._terms(word) if terms is None else terms)
        return np.array(sorted(found), np.int64)


@dataclass(frozen=True)
class Machine:
    """``bias + sum of weights + sum over pairs of the products of their vectors``."""

    known: np.ndarray
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def margin(self, terms: np.ndarray) -> float:
        v = self.vector[terms]
        together = v.sum(axis=0)
        return float(self.bias + self.weight[terms].sum() + 0.5 * (together @ together - (v * v).sum()))

    def score(self, terms: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(terms), -40, 40))))


def train(rows: list[np.ndarray], target: np.ndarray, size: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by adaptive gradient steps on the logistic loss, in a fixed order of lots.

    ``rows`` holds the places of each document's terms. Gradients of the pair part follow from the sum of
    vectors, so a step's cost grows with the terms, not with their pairs.
    """
    random = np.random.default_rng(seed)
    bias, weight = 0.0, np.zeros(size, np.float32)
    vector = random.normal(0, 0.01, (size, FACTORS)).astype(np.float32)
    seen = [np.float32(1e-6), np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32)]
    sizes = np.array([len(r) for r in rows], np.int64)
    lots = max(1, -(-len(rows) // LOT))
    for _ in range(-(-STEPS // lots)):
        for lot in np.array_split(random.permutation(len(rows)), lots):
            x = np.zeros((len(lot), size), np.float32)
            if sizes[lot].sum():
                x[np.repeat(np.arange(len(lot)), sizes[lot]), np.concatenate([rows[i] for i in lot])] = 1
            together = x @ vector
            pairs = 0.5 * ((together * together).sum(axis=1) - x @ (vector * vector).sum(axis=1))
            margin = np.clip(bias + x @ weight + pairs, -40, 40)
            error = ((1 / (1 + np.exp(-margin)) - target[lot]) / len(lot)).astype(np.float32)
            each = x.T @ error
            slopes = (
                error.sum(),
                each + WEIGHT_DECAY * weight,
                x.T @ (error[:, None] * together) - each[:, None] * vector + FACTOR_DECAY * vector,
            )
            for total, slope in zip(range(3), slopes):
                seen[total] = seen[total] + slope * slope
            bias -= float(SPEED * slopes[0] / np.sqrt(seen[0]))
            weight -= SPEED * slopes[1] / np.sqrt(seen[1])
            vector -= SPEED * slopes[2] / np.sqrt(seen[2])
    return bias, weight, vector


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are never learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[DataFrame, dict[bool, float]]:
    """``doc_id, toxic, terms`` of the drawn documents, and the share drawn of each class.

    A document that any label calls toxic is toxic; null labels say nothing. Of rows that share an id
    one text is taken. The ids drawn are few, whatever the tables hold, and meet the documents in place.
    """
    id_ = F.col("doc_id").cast("bigint").alias("doc_id")
    told = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    told = told.select(id_, "toxic").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    share = {kind: min(1.0, train_rows / max(counts.get(kind, 0), 1)) for kind in (True, False)}
    limit = F.when(F.col("toxic"), int(share[True] * 2**40)).otherwise(int(share[False] * 2**40))
    drawn = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) < limit)
    met = docs.select(id_, "text").join(F.broadcast(drawn), "doc_id")
    one = met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        terms = Terms()
        for batch in batches:
            yield {**{c: batch[c] for c in ("doc_id", "toxic")}, "terms": [terms.of(t or "") for t in batch["text"]]}

    return materialize(map_rows(one, rows, "doc_id bigint, toxic boolean, terms array<int>")), share


def _screened(sample: DataFrame, n: dict[bool, int], known: int) -> np.ndarray:
    """Buckets that tell the classes apart most, by the likelihood ratio of their document frequencies."""
    counts = sample.select("toxic", F.explode("terms").alias("bucket")).groupBy("bucket").agg(
        F.count(F.when(F.col("toxic"), 1)).alias("yes"), F.count(F.when(~F.col("toxic"), 1)).alias("no")
    )
    a, b = F.col("yes"), F.col("no")
    c, d = n[True] - a, n[False] - b

    def part(x: Column, row: Column, column: Column) -> Column:
        return F.when(x > 0, x * F.log(x * float(n[True] + n[False]) / (row * column))).otherwise(0.0)

    ratio = part(a, a + b, F.lit(n[True])) + part(b, a + b, F.lit(n[False]))
    ratio = ratio + part(c, c + d, F.lit(n[True])) + part(d, c + d, F.lit(n[False]))
    best = counts.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST).orderBy(F.desc("ratio"), "bucket").limit(known)
    return np.sort(best.select("bucket").toArrow().column(0).to_numpy())


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, known: int = KNOWN) -> Machine:
    """The machine, from ``labels(doc_id, toxic)`` of documents that are not held out.

    Without a training document the bias alone is left, and it is low: everything scores near 0.
    """
    prepare(docs.sparkSession)
    sample, share = _sample(docs, labels, train_rows)
    n = {kind: 0 for kind in (True, False)} | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    buckets = _screened(sample, n, known) if all(n.values()) else np.zeros(0, np.int64)
    if not len(buckets):
        odds = (n[True] + 0.5) / share[True] / ((n[False] + 0.5) / share[False])
        bias = float(np.log(odds)) if any(n.values()) else -40.0
        return Machine(buckets, bias, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [np.intersect1d(t, buckets, assume_unique=True) for t in batch["terms"]]
            yield {**{c: batch[c] for c in ("doc_id", "toxic")}, "place": [np.searchsorted(buckets, f) for f in found]}

    seen = map_rows(sample, rows, "doc_id bigint, toxic boolean, place array<int>").toArrow().sort_by("doc_id")
    places = seen.column("place").combine_chunks()
    each = np.split(places.flatten().to_numpy(), places.offsets.to_numpy()[1:-1])
    target = seen.column("toxic").to_numpy(zero_copy_only=False).astype(np.float32)
    bias, weight, vector = train(each, target, len(buckets))
    # The classes are drawn at rates of their own; the odds go back to those of all labelled documents.
    return Machine(buckets, bias + float(np.log(share[False] / share[True])), weight, vector)


def scored(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the columns ``keep``: one row for each row of ``docs``, in place.

    The score comes from the text alone; a null or empty text, and one without a known term, gets the
    bias. Repeated rows score alike. Columns other than doc_id, text and ``keep`` play no part.
    """
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.known)
        for batch in batches:
            scores = [machine.score(terms.of(t or "")) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(scores, pa.float64())],
                names=["doc_id", *keep, "score"],
            )

    used = docs.select(F.col("doc_id").cast("bigint"), *keep, F.col("text").alias("_text"))
    schema = used.drop("_text").withColumn("score", F.lit(0.0)).schema
    found = used.mapInArrow(rows, schema)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *keep,
    )
