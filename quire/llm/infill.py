"""Fill-in-the-middle transformation over a sparse index of multibyte characters.

A text is handled as its UTF-8 bytes. Only the characters of more than one byte are recorded: where
they stand and how many bytes they have in excess of one. A cut is converted between code points and
bytes by one binary search among them; between two such characters, and in ASCII text everywhere,
the conversion is an addition. Texts are cut as bytes and never decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
#: Of a hundred texts so many are transformed, and of a hundred transformed so many suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"

SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class MultibyteIndex:
    """Where the characters of more than one byte start, in bytes, and the excess bytes up to each end."""

    start: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> MultibyteIndex:
        start = np.flatnonzero(data >= 0xC0)
        lead = data[start]
        return cls(start, np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64))

    def _before(self, count: int) -> int:
        return int(self.excess[count - 1]) if count else 0

    def to_chars(self, at: int) -> int:
        """Code points before the byte offset ``at``, which is a character's first byte or the end."""
        return at - self._before(int(np.searchsorted(self.start, at)))

    def to_bytes(self, at: int) -> int:
        """Byte offset at which the code point number ``at`` starts."""
        chars = self.start - np.concatenate([[0], self.excess[:-1]])[: len(self.start)]
        return at + self._before(int(np.searchsorted(chars, at)))


def _token_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets of the tokens ``[A-Za-z]+|[^A-Za-z]``: all characters but letters after a letter."""
    folded = data | 0x20
    letter = (folded >= 0x61) & (folded <= 0x7A)
    inside = (data & 0xC0) == 0x80
    inside[1:] |= letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def draw(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on the id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int(x) for x in np.frombuffer(digest[:16], ">u4"))


@dataclass(frozen=True)
class Infill:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transform(text: bytes, doc_id: int | None, unit: str = "token", rate: int = RATE) -> Infill:
    """One text, cut between tokens or, with ``unit="char"``, between any two code points."""
    data = np.frombuffer(text, np.uint8)
    index = MultibyteIndex.of(data)
    starts = _token_starts(data) if unit == "token" else None
    n = len(starts) if unit == "token" else index.to_chars(len(data))
    h1, h2, h3, h4 = draw(doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS):
        return Infill(n, "plain", None, None, text)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    if unit == "token":  # the cut is known in bytes
        a, b = (int(starts[k]) if k < n else len(data) for k in (first, last))
        first, last = index.to_chars(a), index.to_chars(b)
    else:  # the cut is known in code points
        a, b = index.to_bytes(first), index.to_bytes(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < SUFFIX_FIRST:
        form, output = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, output = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return Infill(n, form, first, last - first, output)


def infilled(docs: DataFrame, unit: str = "token", rate: int = RATE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row for each row of ``docs``, in place.

    n counts the units of the whole text. ``rate`` of a hundred texts become prefix, suffix and middle
    (psm) or suffix, prefix and middle (spm), each after its mark; the others, empty texts and texts
    that hold a mark stay plain, with null lengths. A null text is empty. Cuts and form depend on the
    id and n alone, so repeated rows give repeated rows and rows of null id draw alike. Columns
    other than doc_id and text play no part. No rows give no rows. Nothing is shuffled.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unit must be token or char, not {unit!r}")
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            made = [transform(text.as_py() or b"", doc_id, unit, rate) for text, doc_id in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([x.n for x in made], pa.int64()),
                    pa.array([x.form for x in made], pa.string()),
                    pa.array([x.prefix_chars for x in made], pa.int64()),
                    pa.array([x.middle_chars for x in made], pa.int64()),
                    pa.array([x.output for x in made], pa.binary()).cast(pa.string()),
                ],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The source text, from output and form alone: a marked text holds each mark once, its own."""

    def between(opening: str, closing: str) -> Column:
        return F.substring_index(F.substring_index(output, opening, -1), closing, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = rf"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
        sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), drawn AS (
    SELECT *, len(tokens) AS n,
        ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS y,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                OR ('0x' || h[17:24])::BIGINT % 100 >= {RATE} THEN 'plain'
            WHEN ('0x' || h[25:32])::BIGINT % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT doc_id, text, n, form,
        array_to_string(tokens[1:least(x, y)], '') AS prefix,
        array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS middle,
        array_to_string(tokens[greatest(x, y) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
        ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
