"""Best-fit packing of tokenised documents into sequences, planned on the length histogram.

The plan never sees a document: best-fit decreasing runs over *counts* of pieces by length, at most
one count for every length up to the limit. Its result is a short list of runs ("pieces of length L
with rank a to b take these slots"), and each piece finds its slot by its rank within its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import MEMORIES, map_rows, prepare
from quire.session import materialize

#: Tokens of a sequence, and the id that ends a document.
LIMIT = 4096
END_ID = 1
#: Entries after which a Python worker starts to remember anew; they hold no more than speed.
REMEMBERED = 500_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, digest bigint, ids binary"

#: Characters whose case, class and normal form are the same in every Unicode version.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ]*")
#: The tokenizer's own split of such characters once they are lower case and white space is gone.
_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "|[a-zªµºß-öø-ÿĀ-ſ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿĀ-ſ0-9²³¹¼½¾]+"
)


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and works word by word, so the ids of what stands between white
    space are computed once and remembered. Texts with characters outside ``_PLAIN`` go through the
    tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For single words, already in lower case: the same model without the steps that split texts.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [text.lower().split() if _PLAIN.fullmatch(text) else None for text in texts]
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
            self.words.clear()
        self._learn(set().union(*filter(None, plain)).difference(self.chunks))
        return [
            _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            if chunks is None
            else b"".join(map(self.chunks.__getitem__, chunks))
            for text, chunks in zip(texts, plain)
        ]

    def _learn(self, chunks: set[str]) -> None:
        split = [(chunk, _WORDS.findall(chunk)) for chunk in chunks]
        unknown = list({w for _, words in split for w in words}.difference(self.words))
        if unknown:
            encoded = self.model.encode(" ".join(unknown), add_special_tokens=False)
            ids, of = _packed(encoded.ids), np.array(encoded.word_ids)
            cuts = [0, *(4 * (np.flatnonzero(np.diff(of)) + 1)).tolist(), len(ids)]
            self.words.update(zip(unknown, map(ids.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        for chunk, words in split:
            self.chunks[chunk] = b"".join(map(self.words.__getitem__, words))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each Python worker
    return Encoder(path)


MEMORIES[__name__] = encoder.cache_clear


def tokenized_pieces(
    docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, digest (64 bits of a hash), ids (bytes).

    A document's ids are its text's ids and ``end_id``; documents longer than ``limit`` are cut into
    pieces of ``limit``, the last one shorter. A null or empty text is ``end_id`` alone. Repeated
    rows and null ids are kept as they are; columns other than doc_id and text play no part.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        encode = encoder(path)
        end, width = end_id.to_bytes(4, "little"), 4 * limit
        for batch in batches:
            out: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
            for doc_id, ids in zip(batch["doc_id"], encode([text or "" for text in batch["text"]])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    digest = xxhash.xxh64_intdigest(part) - (1 << 63)
                    values = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), digest, part)
                    for column, value in zip(out.values(), values):
                        column.append(value)
            yield out

    prepare(docs.sparkSession)
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, PIECES)


def best_fit_plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, ...]]:
    """Best-fit decreasing over counts by length.

    Runs ``(length, first_rank, last_rank, first_sequence, in_each, offset)``: the piece of that
    length with rank ``r`` goes to sequence ``first_sequence + (r - first_rank) // in_each`` at
    ``offset + (r - first_rank) % in_each * length``. A length splits at most two groups of equally
    full sequences, so the number of runs has a bound that depends on ``limit`` alone.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, sequences)
    rooms: list[int] = []  # rooms that have groups, ascending
    sequences, runs = 0, []

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = limit, sequences
                n = -(-left // (limit // length))
                sequences += n
            in_each = room // length
            full = min(n, left // in_each)
            partial = left % in_each if full < n and left < n * in_each else 0
            taken = full * in_each + partial
            used = full + (partial > 0)
            runs.append((length, rank, rank + taken - 1, first, in_each, limit - room))
            keep(room - in_each * length, first, full)
            if partial:
                keep(room - partial * length, first + full, 1)
            keep(room, first + used, n - used)
            left, rank = left - taken, rank + taken
    return runs


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to pieces with doc_id, piece and length (1 to ``limit``).

    Ranks within a length are taken in salted groups, so a length that a third of all pieces have is
    spread over all tasks: rank in the group plus the counts of the groups before it. Groups are dealt
    by all columns but ``ids``: with a row number among them, equal pieces are spread too, and without one
    they take each other's slots. No pieces give no rows. ``pieces`` is read twice (histogram,
    placement): pass a written table.
    """
    spark = pieces.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in pieces.columns if c not in ("length", "ids")]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit_plan(histogram, limit),
        "_length bigint, _first bigint, _last bigint, _sequence bigint, _each bigint, _at bigint",
    )
    before = counts.select(
        "length",
        "_salt",
        (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"),
    )
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    nth = F.col("_rank") - F.col("_first")
    # The plan's size is bounded by the limit, not by the data.
    return ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")),
    ).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_at") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def packed_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Placement of every piece, without its ids: PIECES' other columns, sequence_id, offset."""
    pieces = tokenized_pieces(docs, path, limit).drop("ids")
    numbered = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    return pack(numbered, limit).drop("_row")


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (array), n_pieces. Every placed piece comes once.

    ``pieces`` are those of the packed documents, with ids. Repeated rows, and copies that share an id,
    have pieces of the same digest: these stand for one another, and any of them gives the ids of all. A
    sequence gathers at most ``limit`` ids.
    """
    key = ["doc_id", "piece", "length", "digest"]
    ids = pieces.select(*key, "ids").dropDuplicates(key).withColumnRenamed("doc_id", "_doc")
    places = placed.select(*key, "sequence_id", "offset")
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    for c in key[1:]:
        same = same & (places[c] == ids[c])
    parts = places.join(ids, same).select("sequence_id", "offset", "ids")
    rows = parts.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    return map_rows(
        rows.select("sequence_id", F.col("parts.ids").alias("parts")),
        _joined,
        "sequence_id bigint, ids array<bigint>, n_pieces bigint",
    )


def _joined(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        whole = [b"".join(parts) for parts in batch["parts"]]
        yield {
            "sequence_id": batch["sequence_id"],
            "ids": [np.frombuffer(x, "<u4").astype("int64") for x in whole],
            "n_pieces": [len(parts) for parts in batch["parts"]],
        }
