"""All pairs of texts whose word shingles have a Jaccard similarity of a threshold or more, as components.

Candidates come from prefixes: in one order of all shingles, similar sets share one among the first fifth
of each. Every set also leaves a parity sketch: bit b tells whether an odd number of its shingles falls
on b. Two sketches differ in no more bits than the sets differ in shingles, so a pair whose sketches differ
in more than similar sets can is out for certain; few others are left, and those are verified on whole
texts. Sketches, a few bits a shingle, travel to where candidates meet; texts travel only to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, map_rows
from quire.llm.components import connected_components
from quire.session import materialize

#: Words of a shingle and Jaccard similarity from which texts are near duplicates.
WORDS, SIMILAR = 5, 0.8
#: Texts whose shingles are counted to learn the common ones, how many of them make a shingle common, and
#: how many common ones are remembered. They set an order of shingles, so the cost, never the result.
SAMPLED, COMMON, REMEMBERED = 10_000, 4, 50_000
#: Parts that the rows of a common shingle are dealt to.
SALTS = 64
#: Rows of a block; larger cells are compared block by block.
BLOCK = 1024
#: Candidates a text proposes in the first round; times ``MORE`` with every round.
FIRST, MORE = 1, 4
#: Rows of ids (32 bytes each) up to which they are broadcast to the texts; above, both are shuffled.
BROADCAST_PAIRS = 500_000
#: Bytes of sketches that are compared at a time, and texts verified beside one copy of their first.
HELD, BESIDE = 1 << 23, 64

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


# --- sets ---------------------------------------------------------------------------------------


def _shingles(text: str, words: int) -> set[bytes]:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similarity(a: str, b: str, words: int = WORDS) -> float:
    """Jaccard similarity of the sets of word shingles; two texts without a word are alike."""
    x, y = _shingles(a, words), _shingles(b, words)
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (fewer words: one shingle of all).

    Words are hashed once each; a shingle's hash mixes those of its words in order.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    mixed = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = (mixed ^ each[i : len(w) - n + 1 + i]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    for factor, shift in zip(_MIX[1:], (31, 27)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= factor
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes over a power of two of bits, at least twice as many as hashes."""
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the same sets; ``sketch`` has a power of two times as many columns."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The first hashes of a set in one order of all: common ones (sorted; by ``rank``) after the others.

    Sets of similarity ``similar`` share that part of the larger one at least, so if a set leaves out
    fewer than this many of its last hashes, two such sets meet in what they have left.
    """
    n = len(hashes)
    k = n - ceil(similar * n - 1e-9) + 1
    known = _among(hashes, common)
    rare = hashes[~known][:k]
    if len(rare) == k:
        return rare
    at = np.searchsorted(common, hashes[known])
    return np.r_[rare, hashes[known][np.argsort(rank[at], kind="stable")][: k - len(rare)]]


def _among(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(hashes), bool)
    return common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes


def common_shingles(texts: DataFrame, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles most frequent in a sample of the texts, and the rank of each, rare first."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"h": np.concatenate([shingle_hashes(t or "", words) for t in batch["text"]]).view(np.int64)}

    sample = texts.where(F.pmod(F.xxhash64("digest"), F.lit(max(1, n // SAMPLED))) == 0).select("text")
    counted = map_rows(sample, rows, "h bigint").groupBy("h").count().where(F.col("count") >= COMMON)
    top = counted.orderBy(F.desc("count"), "h").limit(REMEMBERED).select("h").toArrow()
    hashes = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - 1 - np.arange(len(hashes)))[order]


# --- candidates ---------------------------------------------------------------------------------


def _sketched(texts: DataFrame, words: int) -> DataFrame:
    """``node, size, sketch`` of each text."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_hashes(t or "", words) for t in batch["text"]]
            yield {"node": batch["id"], "size": list(map(len, sets)), "sketch": [parity_sketch(s).tobytes() for s in sets]}

    return map_rows(texts.select("id", "text"), rows, "node bigint, size int, sketch binary")


def _shared_keys(texts: DataFrame, words: int, similar: float, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """``key, node, size``: prefix shingles that more than one text has, or that are common ones.

    Keys meet in one sort. A row goes on if its neighbour has its key, so no bucket is gathered; rows of
    common keys are known to go on and are dealt to many tasks.
    """

    def emitted(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_hashes(t or "", words) for t in batch["text"]]
            keys = [prefix(s, common, rank, similar) if len(s) else s for s in sets]
            n = list(map(len, keys))
            key = np.concatenate(keys)
            node = np.repeat(np.array(batch["id"], np.int64), n)
            salt = np.where(_among(key, common), 1 + node % SALTS, 0).astype(np.int8)
            size = np.repeat(np.array(list(map(len, sets)), np.int32), n)
            yield {"key": key.view(np.int64), "salt": salt, "node": node, "size": size}

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, until it is known whether the next one has its key
        went_on = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            same = key[1:] == key[:-1]
            goes = np.r_[same, False] | np.r_[went_on, same] | (salt > 0)
            went_on = bool(len(same) and same[-1])
            held = batch.slice(len(key) - 1)
            yield batch.slice(0, len(key) - 1).filter(pa.array(goes[:-1])).select(["key", "node", "size"])
        if held is not None and (went_on or held.column("salt")[0].as_py() > 0):
            yield held.select(["key", "node", "size"])

    rows = map_rows(texts.select("id", "text"), emitted, "key bigint, salt tinyint, node bigint, size int")
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
    return map_batches(dealt, shared, "key bigint, node bigint, size int")


def _one_of_equal_buckets(shared: DataFrame) -> DataFrame:
    """``shared`` without buckets that hold the very texts of another one, as near copies do by the hundred."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    contents = shared.groupBy("key").agg(F.count("*").alias("n"), *marks).where("n > 1")
    kept = contents.groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    return shared.join(kept, "key", "left_semi")


def _cells(shared: DataFrame, similar: float) -> DataFrame:
    """``key, band, low, high, side, guest, node``: rows that are compared with one another.

    Bands are as wide as similar sets may differ in size, so a set meets those of its own band and, as a guest,
    those of the band below. A cell of over ``BLOCK`` rows becomes pairs of blocks (``side`` tells the two apart).
    """
    width = -log(similar) + 1e-9 if similar < 1 else 1e-9
    band = F.floor(F.log(F.col("size").cast("double")) / width).cast("int")
    rows = shared.select("key", "node", band.alias("_band")).select(
        "key", "node", F.explode(F.array(F.struct(F.col("_band").alias("band"), F.lit(0).alias("guest")),
                                         F.struct((F.col("_band") - 1).alias("band"), F.lit(1).alias("guest")))).alias("c")
    ).select("key", "node", "c.band", "c.guest")
    sizes = rows.groupBy("key", "band").agg(F.count("*").alias("count"), F.min("guest").alias("own"))
    sizes = sizes.where("count > 1 and own = 0").select("key", "band", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    met = rows.join(sizes, ["key", "band"])
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int")
    dealt = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return dealt.select(
        "key",
        "band",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        side.cast("int").alias("side"),
        "guest",
        "node",
    )


CELL = ["key", "band", "low", "high"]


def _candidates(cell: dict[str, np.ndarray], sketches: list[bytes], lo: int, hi: int, similar: float):
    """Pairs of places in a cell: for each row its ``lo``-th to ``hi``-th candidate of another root, and if
    there are more. The order is fixed, those surely similar first and then by node, so rounds never repeat."""
    side, guest, size, node, root = (cell[c] for c in ("side", "guest", "size", "node", "root"))
    if root.min() == root.max() or (len(size) == 2 and size.min() < similar * size.max() - 1e-9):
        return [], False
    width = min(map(len, sketches))
    bits = np.stack([folded(np.frombuffer(s, np.uint8), width) for s in sketches]).view(np.uint64)
    order = np.argsort(node, kind="stable")
    side, guest, size, node, root, bits = (x[order] for x in (side, guest, size, node, root, bits))
    pairs, more, step = [], False, max(1, HELD // bits.nbytes)
    for at in range(0, len(node), step):
        i = slice(at, at + step)
        smaller, larger = np.minimum(size[i, None], size), np.maximum(size[i, None], size)
        fits = (smaller >= similar * larger - 1e-9) & (node[i, None] != node) & ((guest[i, None] & guest) == 0)
        fits &= (side[i, None] == 0) | (side[i, None] != side)
        if not (fits & (root[i, None] != root)).any():
            continue
        limit = np.floor((size[i, None] + size) * ((1 - similar) / (1 + similar)) + 1e-9)
        far = np.bitwise_count(bits[i, None, :] ^ bits).sum(axis=2, dtype=np.int64)
        fits &= far <= limit
        ranked = np.argsort(np.where(fits, far > 0.9 * limit, 2), axis=1, kind="stable")
        open_ = np.take_along_axis(fits & (root[i, None] != root), ranked, axis=1)
        more |= bool(open_[:, hi:].any())
        a, k = np.nonzero(open_[:, lo:hi])
        pairs.append(np.stack([node[a + at], node[ranked[a, k + lo]]], axis=1))
    return pairs, more


def _proposed(cells: DataFrame, sketches: DataFrame, roots: DataFrame, lo: int, hi: int, similar: float) -> DataFrame:
    """``x, y``, pairs to verify, and rows of null x that name cells with candidates left."""
    named = cells.join(sketches, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    columns = (*CELL, "side", "guest", "size", "node", "root")
    dealt = named.select(*columns, "sketch").repartition(*CELL).sortWithinPartitions(*CELL)
    schema = "x bigint, y bigint, key bigint, band int, low int, high int"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solved(table: pa.Table) -> pa.RecordBatch:
            data = {c: table.column(c).to_numpy() for c in columns}
            sketch = table.column("sketch").to_pylist()
            keys = np.stack([data[c].astype(np.int64) for c in CELL], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist() + [len(keys)]
            found, left = [], []
            for s, e in zip(cuts, cuts[1:]):
                pairs, more = _candidates({c: v[s:e] for c, v in data.items()}, sketch[s:e], lo, hi, similar)
                found += pairs
                if more:
                    left.append(keys[s])
            xy = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
            rest = np.array(left, np.int64).reshape(-1, 4)
            none, empty = [None] * len(rest), [None] * len(xy)
            return pa.RecordBatch.from_pydict(
                {
                    "x": xy[:, 0].tolist() + none,
                    "y": xy[:, 1].tolist() + none,
                    **{c: empty + rest[:, i].tolist() for i, c in enumerate(CELL)},
                },
                types,
            )

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            keys = [held.column(c).to_numpy() for c in CELL]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            whole = int(np.argmax(last))  # where the last, perhaps unfinished cell starts
            if whole >= 1 << 12:
                yield solved(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield solved(held)

    types = _types(cells, schema)
    return map_batches(dealt, rows, schema)


def _types(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# --- verification -------------------------------------------------------------------------------


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """``a, b``: the pairs whose whole texts are similar.

    Pairs are grouped by their first text, ``BESIDE`` or so to a group: its text comes once to a group, those of
    the others once to a pair, and one set is held at a time.
    """
    many = pairs.groupBy("x").count().select("x", F.ceil(F.col("count") / BESIDE).alias("groups"))
    grouped = materialize(pairs.join(many, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("groups")).alias("g")))
    none = F.lit(None).cast("bigint").alias("y")
    wanted = grouped.select(F.col("x").alias("id"), "x", "g", none).distinct()
    wanted = materialize(wanted.union(grouped.select(F.col("y").alias("id"), "x", "g", "y")))
    small = wanted.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    met = texts.select("id", "text").join(F.broadcast(wanted) if small else wanted, "id")
    dealt = met.repartition("x", "g").sortWithinPartitions("x", "g", F.col("y").asc_nulls_first()).drop("id", "g")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for x, y, text in zip(batch["x"], batch["y"], batch["text"]):
                hashes = shingle_hashes(text or "", words)
                if y is None:
                    mine = hashes
                    continue
                both = len(np.intersect1d(mine, hashes, assume_unique=True))
                if both >= similar * (len(mine) + len(hashes) - both) - 1e-9:
                    found.append((x, y))
            yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return map_rows(dealt, rows, "a bigint, b bigint")


def similar_roots(
    texts: DataFrame, words: int = WORDS, similar: float = SIMILAR, proposed: DataFrame | None = None
) -> DataFrame:
    """``node, root`` of the components of all pairs of ``texts(id, digest, text)`` that are ``similar``.

    Ids are unique. Pairs ``proposed(x, y)``, x < y, by another method are verified first. Then, in rounds, every text proposes ever more of its candidates in other components, until
    no cell has a pair left that is not tried or joined already.
    """
    common, rank = common_shingles(texts, texts.count(), words)
    shared = materialize(_shared_keys(texts, words, similar, common, rank))
    cells = materialize(_cells(_one_of_equal_buckets(shared), similar))
    sketches = materialize(_sketched(texts, words))
    spark = texts.sparkSession
    roots = spark.createDataFrame([], "node bigint, root bigint")
    links = tried = None
    if proposed is not None and not proposed.isEmpty():
        links = materialize(_verified(proposed, texts, words, similar).distinct())
        tried, roots = proposed, materialize(connected_components(links))
    lo, hi = 0, FIRST
    while True:
        found = materialize(_proposed(cells, sketches, roots, lo, hi, similar))
        fresh = found.where("x is not null").select("x", "y").distinct()
        if tried is not None:
            fresh = fresh.join(tried, ["x", "y"], "left_anti")
        fresh = materialize(fresh)
        if not fresh.isEmpty():
            sure = materialize(_verified(fresh, texts, words, similar).distinct())
            links = sure if links is None else links.union(sure)
            tried = fresh if tried is None else tried.union(fresh)
            roots = materialize(connected_components(links))
        left = found.where("x is null").select(*CELL).distinct()
        if left.isEmpty():
            return roots
        cells = materialize(cells.join(left, CELL, "left_semi"))
        lo, hi = hi, hi * MORE + 1
