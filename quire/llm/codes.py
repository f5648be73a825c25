"""Product codes of integer vectors: exact k-means rounds over Hilbert-sorted flat blocks.

A vector is cut into equal consecutive parts, and each part gets the number of the nearest entry of its
position's codebook. Parts are sorted once along a Hilbert curve and cut into flat blocks that
keep the smallest and largest value of each component (a box) and the sums of their rows. In every round the
distances of all entries to a block's box leave a short list of entries that can be nearest to any
row inside. One entry left takes the whole block by its sums; else a small kernel compares rows with the
short list alone, in integers or in doubles that cannot round.

Codebooks are of fixed size and travel with the tasks; a round sends back one sum for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prepare
from quire.session import materialize

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows of a block: fewer make smaller boxes and shorter lists, more make fewer calls.
BLOCK = 64
#: Bits of a position on the curve, a component's share of them at most, and components that count.
CURVE, FINEST = 62, 8
LARGEST = 2**63 - 1

BLOCKS = (
    "part int, row array<bigint>, vec_id array<bigint>, value binary, low binary, high binary, total binary, n bigint"
)


# --- the curve ----------------------------------------------------------------------------------


def hilbert_positions(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` (integers below 2 ** bits) along the Hilbert curve."""
    x = cells.T.astype(np.int64)
    if not len(x):
        return np.zeros(cells.shape[0], np.int64)
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:  # undo the turns of ever smaller cubes
        low = bit - 1
        for axis in x:
            turned = (axis & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
        bit >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    position = np.zeros(cells.shape[0], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            position = (position << 1) | ((axis >> level) & 1)
    return position


def _cells(values: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    share = (values - low.astype(float)) / np.maximum(high.astype(float) - low, 1)
    return np.clip((share * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)


# --- kernels ------------------------------------------------------------------------------------


def _exactly(bound: int) -> type:
    """A number type in which no result up to ``bound`` is rounded or wraps around."""
    return float if bound < 2**53 else np.int64 if bound < 2**63 else object


def _largest(*arrays: np.ndarray) -> int:
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, rows by entries."""
    kind = _exactly(4 * max(rows.shape[1], 1) * _largest(rows, entries) ** 2)
    a, b = rows.astype(kind), entries.astype(kind)
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    return squares - 2 * (a @ b.T)


def short_list(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to a row within the box, ascending: no farther from it than the entry
    whose farthest corner is nearest."""
    kind = _exactly(4 * max(len(low), 1) * _largest(low, high, entries) ** 2)
    a, b, e = low.astype(kind), high.astype(kind), entries.astype(kind)
    outside = np.maximum(np.maximum(a - e, e - b), 0)
    corner = np.maximum(e - a, b - e)
    return np.flatnonzero((outside * outside).sum(axis=1) <= (corner * corner).sum(axis=1).min())


def nearest(value: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row of a block, the lower of equal ones, and its distance."""
    listed = short_list(low, high, entries)
    found = distances(value, entries[listed])
    best = np.argmin(found, axis=1) if len(value) else np.zeros(0, np.int64)
    return listed[best], found[np.arange(len(value)), best]


class _Sums:
    """Rows and component sums of each entry, in 64 bits for as long as no sum can leave them."""

    def __init__(self, entries: int, width: int) -> None:
        self.n = np.zeros(entries, np.int64)
        self.fast = np.zeros((entries, width), np.int64)
        self.whole: np.ndarray | None = None
        self.bound = 0

    def add(self, entry: np.ndarray | int, rows: np.ndarray, n: int | np.ndarray, largest: int) -> None:
        if self.bound + largest >= 2**62:
            self._flush()
        if largest >= 2**62:
            self._flush()
            np.add.at(self.whole, entry, rows.astype(object))
        else:
            self.bound += largest
            np.add.at(self.fast, entry, rows)
        np.add.at(self.n, entry, n)

    def _flush(self) -> None:
        before = 0 if self.whole is None else self.whole
        self.whole, self.bound = before + self.fast.astype(object), 0
        self.fast[:] = 0

    def result(self) -> np.ndarray:
        self._flush()
        return self.whole


# --- blocks -------------------------------------------------------------------------------------


def _padded(batch: pa.RecordBatch, width: int) -> np.ndarray:
    code = batch.column("code")
    sizes = np.diff(code.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = code.flatten().to_numpy(zero_copy_only=False)
    return out


def sorted_blocks(kept: DataFrame, width: int, first: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``BLOCKS`` of the parts of ``kept(row, vec_id, code)``, each block of one part position.

    The range of the ``first`` codebooks scales the curve: it decides how tight boxes are, nothing
    else. Equal parts are dealt by their row number, so however many there are they fill many blocks.
    """
    bits = max(1, min(FINEST, CURVE // max(width, 1)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _padded(batch, width * PARTS)
            for part in range(PARTS):
                value = np.ascontiguousarray(whole[:, part * width : (part + 1) * width], "<i8")
                shown = slice(0, CURVE)
                cells = _cells(value[:, shown], first[part].min(axis=0)[shown], first[part].max(axis=0)[shown], bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(value), part, np.int32)),
                        pa.array(hilbert_positions(cells, bits)),
                        batch.column("row"),
                        batch.column("vec_id"),
                        pa.array([v.tobytes() for v in value], pa.binary()),
                    ],
                    names=["part", "position", "row", "vec_id", "value"],
                )

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(rows: pa.Table, whole_only: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            part = rows.column("part").to_numpy()
            made, at = [], 0
            while at < len(part):
                to = min(at + block, int(np.searchsorted(part, part[at], "right")))
                if whole_only and to == len(part):
                    break
                value = np.frombuffer(b"".join(rows.column("value").slice(at, to - at).to_pylist()), "<i8")
                value = value.reshape(to - at, width)
                kind = _exactly(max(_largest(value), 1) * (to - at) * 2**10)
                total = value.astype(object if kind is object else np.int64).sum(axis=0)
                fits = kind is not object
                made.append(
                    {
                        "part": int(part[at]),
                        "row": rows.column("row").slice(at, to - at).to_pylist(),
                        "vec_id": rows.column("vec_id").slice(at, to - at).to_pylist(),
                        "value": value.tobytes(),
                        "low": value.min(axis=0).astype("<i8").tobytes(),
                        "high": value.max(axis=0).astype("<i8").tobytes(),
                        "total": total.astype("<i8").tobytes() if fits else None,
                        "n": to - at,
                    }
                )
                at = to
            return (pa.RecordBatch.from_pylist(made, types) if made else None), rows.slice(at)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 64 * block:
                continue
            made, rest = blocks(pa.Table.from_batches(held), True)
            held = rest.to_batches()
            if made is not None:
                yield made
        if held:
            made, _ = blocks(pa.Table.from_batches(held), False)
            if made is not None:
                yield made

    types = _types(kept, BLOCKS)
    rows = kept.mapInArrow(parts, "part int, position bigint, row bigint, vec_id bigint, value binary")
    along = ("part", "position", "row")
    return rows.repartitionByRange(*along).sortWithinPartitions(*along).mapInArrow(flat, BLOCKS)


def _types(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _each_block(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Part position, rows, low, high and sums (null where 64 bits do not hold them)."""
    columns = (batch.column(c).to_pylist() for c in ("part", "value", "low", "high", "total", "n"))
    for part, value, low, high, total, n in zip(*columns):
        value = np.frombuffer(value, "<i8").reshape(n, width)
        yield part, value, np.frombuffer(low, "<i8"), np.frombuffer(high, "<i8"), total


# --- rounds -------------------------------------------------------------------------------------


def refined(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the componentwise floor of the mean of its parts; unused ones stay."""
    entries, width = codebooks.shape[1:]
    sums = ", ".join(f"s{i} decimal(38,0)" for i in range(width))
    schema = "part int, entry int, n bigint" + (f", {sums}" if width else "")
    types = _types(blocks, schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [_Sums(entries, width) for _ in range(PARTS)]
        for batch in batches:
            for part, value, low, high, total in _each_block(batch, width):
                listed = short_list(low, high, codebooks[part])
                largest = _largest(low, high) * len(value)
                if len(listed) == 1 and total is not None:
                    totals[part].add(int(listed[0]), np.frombuffer(total, "<i8"), len(value), largest)
                else:
                    entry = listed[np.argmin(distances(value, codebooks[part][listed]), axis=1)]
                    totals[part].add(entry, value, 1, largest)
        for part, found in enumerate(totals):
            used = np.flatnonzero(found.n)
            summed = found.result()[used]
            columns = [np.full(len(used), part, np.int32), used.astype(np.int32), found.n[used]]
            columns += [pa.array(list(map(Decimal, map(int, c))), pa.decimal128(38, 0)) for c in summed.T]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=types)

    needed = blocks.select("part", "value", "low", "high", "total", "n")
    each = needed.mapInArrow(rows, schema).groupBy("part", "entry")
    after = codebooks.copy()
    for r in each.agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect():
        after[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return after


def assigned(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``row, part, vec_id, entry, distance`` of every part; distances above a long's range are its largest."""
    width = codebooks.shape[2]
    schema = "row bigint, part int, vec_id bigint, entry int, distance bigint"
    types = _types(blocks, schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(v, lo, hi, codebooks[part]) for part, v, lo, hi, _ in _each_block(batch, width)]
            sizes = batch.column("n").to_numpy()
            distance = np.concatenate([(np.minimum(d, LARGEST) if d.dtype == object else d).astype(np.int64) for _, d in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").flatten(),
                    pa.array(np.repeat(batch.column("part").to_numpy(), sizes)),
                    batch.column("vec_id").flatten(),
                    pa.array(np.concatenate([e for e, _ in found]).astype(np.int32)),
                    pa.array(distance),
                ],
                schema=types,
            )

    return blocks.select("part", "row", "vec_id", "value", "low", "high", "total", "n").mapInArrow(rows, schema)


@dataclass
class Compressed:
    """``codes(vec_id, label, entries, error)`` and the codebooks, part by entry by component."""

    codes: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """Hash of all components in order, as decimal numbers between commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, block: int = BLOCK) -> Compressed:
    """Codes of ``vectors(vec_id, label, code)``, ``code`` an array of integers; one row for each of its rows.

    Codebooks start as the parts of the ``entries`` smallest vec_ids (fewer rows: fewer entries; equal ids
    by their code, null ids last). Rows of null code, or with a null in it, take no part; null ids and labels do. Vectors of
    different length are compared as if filled up with zeros to a common multiple of ``PARTS``. Repeated
    rows get equal codes. Other columns play no part. No rows give no rows and empty codebooks.
    ``entries`` holds PARTS numbers; error is the sum of their squared distances, at most a long's largest.
    """
    prepare(vectors.sparkSession)
    label = "label" if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    used = vectors.where("code is not null and forall(code, x -> x is not null)").select(F.col("vec_id").cast("bigint"), label, "code")
    kept = materialize(used.withColumn("row", F.monotonically_increasing_id()))
    longest = kept.agg(F.max(F.size("code"))).first()[0] or 0
    width = -(-longest // PARTS)
    start = kept.select("vec_id", "code").orderBy(F.col("vec_id").asc_nulls_last(), "code").limit(entries).collect()
    filled = [[*r["code"], *[0] * (width * PARTS - len(r["code"]))] for r in start]
    first = np.array(filled, np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2)
    codebooks = first.copy()
    if not start:
        codes = kept.select("vec_id", "label", F.array(*[F.lit(0)] * PARTS).alias("entries"), F.lit(0).cast("bigint").alias("error"))
        return Compressed(codes, codebooks)
    blocks = materialize(sorted_blocks(kept.select("row", "vec_id", "code"), width, first, block))
    for _ in range(rounds):
        codebooks = refined(blocks, codebooks)
    found = assigned(blocks, codebooks)
    whole = found.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"),
        F.array(*(F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(PARTS))).alias("entries"),
        F.least(F.sum(F.col("distance").cast("decimal(20,0)")), F.lit(LARGEST)).cast("bigint").alias("error"),
    )
    return Compressed(whole.join(kept.select("row", "label"), "row").drop("row"), codebooks)


def hexadecimal(entries: Column) -> Column:
    return F.lower(F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), 2, "0")), ""))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the sum of ``error`` over rows of the same label, null labels together.

    One sum for each label meets the rows; a hot label's rows are never gathered.
    """
    codes = materialize(codes)
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LARGEST)).cast("bigint")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def _rounds_sql() -> str:
    """Codebooks c0 to c4 as lists by part and entry, and the assignments between them."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
    SELECT p.row, p.part, p.value, min_by(c.entry, (d, c.entry)) AS entry, min(d) AS distance
    FROM p JOIN (SELECT * FROM c{k}) c USING (part),
        LATERAL (SELECT list_sum(list_transform(range(1, len(c.value) + 1),
            lambda i: (p.value[i] - c.value[i]) * (p.value[i] - c.value[i])))::BIGINT AS d)
    GROUP BY p.row, p.part, p.value
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""m{k} AS (
    SELECT part, entry, list(mean ORDER BY i) AS value FROM (
        SELECT part, entry, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS mean
        FROM (SELECT part, entry, unnest(value) AS v, unnest(range(len(value))) AS i FROM a{k})
        GROUP BY part, entry, i)
    GROUP BY part, entry
), c{k + 1} AS MATERIALIZED (
    SELECT c{k}.part, c{k}.entry, coalesce(m{k}.value, c{k}.value) AS value
    FROM c{k} LEFT JOIN m{k} USING (part, entry)
)"""
            )
    return ",\n".join(steps)


SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS code
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT row, part, code[part * len(code) // {PARTS} + 1:(part + 1) * len(code) // {PARTS}] AS value
    FROM kept, range({PARTS}) parts(part)
), c0 AS MATERIALIZED (
    SELECT p.part, entry, p.value
    FROM p JOIN (
        SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, code) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}
    ) USING (row)
),
{_rounds_sql()},
whole AS (
    SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
    FROM a{ROUNDS} GROUP BY row
), book AS (
    SELECT sha256(string_agg(array_to_string(value, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM (SELECT row, vec_id, label FROM kept) JOIN whole USING (row), book
"""
