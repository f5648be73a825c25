"""SimHash near duplicates by a generalised pigeonhole search in Hamming space.

Fingerprints that differ in at most ``tau`` bits are linked. Bits are grouped into partitions, each
with a threshold of its own; if the thresholds plus one sum to ``tau`` + 1, every linked pair is
within the threshold of at least one partition. How many partitions, and which thresholds, is chosen
by dynamic programming on the candidate counts that the bits' own statistics predict. The choice
changes only the cost: probing and verification find every link whatever it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lookup_join, map_rows, prepare
from quire.llm.components import connected_components
from quire.llm.similar import SIMILAR, WORDS, similar_roots
from quire.session import materialize, materialize_alone

BITS = 64
#: Differing bits up to which fingerprints are linked.
TAU = 3
#: Words of a shingle for the fingerprint query.
SHINGLE = 3
SEED = 42
#: Bits whose joint distribution is counted exactly; partitions are made of such atoms.
ATOM = 8
#: Cost of writing, moving and sorting one probe key, in candidate comparisons.
PROBE_COST = 40.0
#: Rows of several buckets that are compared in one go.
GATHERED = 1 << 15
#: Rows of a block; fingerprints of a larger bucket are compared block by block.
BLOCK = 1024


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed) of every row; a null text counts as empty, whose fingerprint is 0."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = np.array([fingerprint(t or "", shingle) for t in batch["text"]], np.uint64)
            yield {"doc_id": batch["doc_id"], "fp": found.view(np.int64)}

    prepare(docs.sparkSession)
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, fp bigint")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- statistics and plan ------------------------------------------------------------------------


def _unpacked(fps: list[int] | np.ndarray) -> np.ndarray:
    return np.unpackbits(np.array(fps, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(values: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all fingerprints of a vector of ``size`` counts; each task sends one vector."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += of(_unpacked(batch["fp"]).astype(np.int64))
        at = np.flatnonzero(total)
        yield {"at": at, "n": total[at]}

    parts = map_rows(values, rows, "at bigint, n bigint")
    out = np.zeros(size, np.int64)
    for row in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        out[row["at"]] = row["n"]
    return out


def correlated_atoms(together: np.ndarray, n: int) -> list[list[int]]:
    """Group bits into atoms of ``ATOM``, each bit with those it is most correlated to."""
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, atoms = set(range(BITS)), []
    while free:
        left = sorted(free)
        seed = max(left, key=lambda b: (tie[b, left].max(), -b))
        atom = [seed]
        while len(atom) < ATOM:
            rest = [b for b in left if b not in atom]
            atom.append(max(rest, key=lambda b: (tie[b, atom].sum(), -b)))
        atoms.append(sorted(atom))
        free -= set(atom)
    return atoms


def distance_shares(counts: np.ndarray) -> np.ndarray:
    """Share of pairs at each distance 0..ATOM within one atom, from its histogram."""
    values = np.arange(1 << ATOM)
    distance = np.array([bin(int(x)).count("1") for x in values])[values[:, None] ^ values[None, :]]
    share = counts / max(counts.sum(), 1)
    return np.bincount(distance.ravel(), weights=np.outer(share, share).ravel(), minlength=ATOM + 1)


def allocate(shares: list[np.ndarray], n: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) for partitions with these distance shares: least estimated cost.

    A partition with threshold e writes a key for every way to clear up to e of its set bits, about
    half its bits, and meets the pairs within e. The thresholds plus one sum to ``tau`` + 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for share in shares:
        width, reached = len(share) - 1, {}
        for used, (cost, chosen) in best.items():
            for e in range(-1, tau - used + 1):
                keys = sum(comb(width // 2, k) for k in range(e + 1))
                met = share[: e + 1].sum() * n * n / 2
                total = cost + PROBE_COST * n * keys + met
                if used + e + 1 not in reached or total < reached[used + e + 1][0]:
                    reached[used + e + 1] = (total, [*chosen, e])
        best = reached
    return best[tau + 1]


def search_plan(values: DataFrame, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to probe, from statistics of all distinct fingerprints."""
    together = _summed(values, lambda bits: (bits.T @ bits).ravel(), BITS * BITS).reshape(BITS, BITS)
    n = values.count()
    atoms = correlated_atoms(together, n)
    weights = 1 << np.arange(ATOM)

    def histograms(bits: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(bits[:, a] @ weights, minlength=1 << ATOM) for a in atoms])

    shares = [distance_shares(h) for h in np.split(_summed(values, histograms, len(atoms) << ATOM), len(atoms))]
    plans = []
    for parts in (2, 3, 4):
        cuts = np.array_split(np.arange(len(atoms)), parts)
        joined = []
        for cut in cuts:
            whole = np.ones(1)
            for a in cut:
                whole = np.convolve(whole, shares[a])
            joined.append(whole)
        cost, thresholds = allocate(joined, n, tau)
        plans.append((cost, [([b for a in cut for b in atoms[a]], e) for cut, e in zip(cuts, thresholds) if e >= 0]))
    return min(plans, key=lambda plan: plan[0])[1]


# --- probing and verification -------------------------------------------------------------------


def probe_keys(values: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """``part, key, fp``: the partition's bits, with up to its threshold of them cleared.

    Two values that differ in d bits of a partition meet where each has cleared the bits only it has.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            fps = np.array(batch["fp"], np.int64).view(np.uint64)
            out: list[tuple[np.ndarray, ...]] = []
            for part, (bits, e) in enumerate(plan):
                single = [np.uint64(1 << b) for b in bits]
                base = fps & np.bitwise_or.reduce(np.array(single))
                for k in range(e + 1):
                    for chosen in combinations(single, k):
                        mask = np.bitwise_or.reduce(np.array([np.uint64(0), *chosen], np.uint64))
                        has = np.flatnonzero((base & mask) == mask)
                        out.append((np.full(len(has), part), base[has] & ~mask, fps[has]))
            part, key, fp = (np.concatenate(column) for column in zip(*out))
            yield {"part": part, "key": key.view(np.int64), "fp": fp.view(np.int64)}

    return map_rows(values, rows, "part int, key bigint, fp bigint")


def _hooked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable position of each of ``n`` positions under links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _links(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within each run of equal ``bucket``; rows are sorted by bucket, fp.

    ``side`` is 0, or tells the two blocks of a pair of blocks apart (1, 2): only links across count.
    """
    n, found = len(fp), []
    at, step = np.arange(n), 1
    while len(at):
        at = at[at + step < n]
        at = at[bucket[at] == bucket[at + step]]
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= tau
        near &= (side[at] == 0) | (side[at] != side[at + step])
        found.append((at[near], at[near] + step))
        step += 1
    if not found:
        return fp[:0], fp[:0]
    a, b = (np.concatenate(x) for x in zip(*found))
    root = _hooked(a, b, n)
    hung = np.flatnonzero(root != np.arange(n))
    return fp[hung], fp[root[hung]]


def _cells(keyed: DataFrame, by: str) -> DataFrame:
    """``keyed`` with ``low, high, side``: buckets of over ``BLOCK`` rows (``count``) as pairs of blocks."""
    blocks = keyed.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(by), F.col("blocks"))).otherwise(0).cast("int")
    dealt = blocks.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return dealt.select(
        *keyed.columns,
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        side.alias("side"),
    )


def _whole_cells(batches: Iterator[dict], names: tuple[str, ...], key: int) -> Iterator[list[tuple]]:
    """Rows of several whole cells at a time; the first ``key`` columns tell cells apart."""
    kept: list[tuple] = []  # rows of the last, perhaps unfinished cell
    for batch in batches:
        kept += zip(*(batch[c] for c in names))
        if len(kept) < GATHERED:
            continue
        last = kept[-1][:key]
        cut = len(kept)
        while cut and kept[cut - 1][:key] == last:
            cut -= 1
        if cut:
            yield kept[:cut]
            kept = kept[cut:]
    if kept:
        yield kept


def near_links(values: DataFrame, plan: list[tuple[list[int], int]], tau: int = TAU) -> DataFrame:
    """``a, b``: links whose components are those of all pairs within ``tau``.

    A bucket (equal partition and key) of more than ``BLOCK`` rows is dealt into blocks, and each
    pair of blocks is compared on its own. Each run of a bucket or pair emits at most one link a
    fingerprint, however many pairs are near.
    """
    keys = materialize(probe_keys(values, plan))
    sizes = keys.groupBy("part", "key").count().where("count > 1")
    cell = ["part", "key", "low", "high"]
    dealt = _cells(keys.join(sizes, ["part", "key"]), "fp").select(*cell, "side", "fp")
    dealt = dealt.repartition(*cell).sortWithinPartitions(*cell, "fp")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        def solved(part: list[tuple]) -> dict:
            key = np.array([x[:4] for x in part], np.int64).reshape(-1, 4)
            new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)] if len(part) else np.zeros(0, bool)
            fp = np.array([x[5] for x in part], np.int64).view(np.uint64)
            a, b = _links(np.cumsum(new), np.array([x[4] for x in part], np.int64), fp, tau)
            return {"a": a.view(np.int64), "b": b.view(np.int64)}

        yield from map(solved, _whole_cells(batches, ("part", "key", "low", "high", "side", "fp"), 4))

    return map_rows(dealt, rows, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """``doc_id, fp, component_id``, one row for each row of ``docs``.

    component_id is the smallest doc_id that is reachable over links, its own included; null ids
    come last, so a component of null ids alone has a null component_id. Texts without a word (null,
    empty, blank) share fingerprint 0 and link like any other. Equal texts meet in one fingerprint,
    however many there are; columns other than doc_id and text play no part. No rows give no rows.
    """
    found = materialize(fingerprints(docs, shingle))
    values = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    only = values.select("fp")
    roots = materialize(connected_components(near_links(only, search_plan(only, tau), tau)))
    rooted = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.join(firsts, "root").select("fp", "component_id"))
    return found.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# --- whole documents ----------------------------------------------------------------------------


def fingerprint_pairs(texts: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """``x, y`` (x < y): ids of ``texts(id, text)`` that span the components of linked fingerprints."""
    found = materialize(fingerprints(texts.select(F.col("id").alias("doc_id"), "text"), shingle))
    values = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    only = values.select("fp")
    links = near_links(only, search_plan(only, tau), tau)
    a, b = (values.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_id")) for c in "ab")
    across = links.join(a, "a").join(b, "b").select("a_id", "b_id")
    within = found.join(values, "fp").where("doc_id <> first").select(F.col("first"), "doc_id")
    pairs = across.union(within).toDF("a", "b")
    return materialize(pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())


def deduplicated(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document, that of smallest id, of each group of near duplicates.

    Equal texts are one node. Texts whose SimHash fingerprints are linked are proposed and held against each other
    first; what bits cannot tell, all other pairs whose shingles are ``similar``, is searched after them among
    texts not joined yet. Each component of links keeps one document. Every link is verified on whole texts, so chance never joins
    two documents. A text without a word equals any other without one. Of rows that share the kept
    id and text one stays; null ids come last. All columns of ``docs`` pass through. No rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    blank = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))) == 0
    digest = F.md5(F.when(blank, F.lit("")).otherwise(F.col("text"))).alias("_digest")
    # Null ids get a number of their own for each text, above all others.
    number = F.coalesce(
        F.col("doc_id").cast("bigint"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(digest), 2)
    ).alias("_id")
    keyed = docs.select("*", digest).select("*", number)
    key = ["_id", "_digest"]
    rows_of = materialize(keyed.groupBy(*key).count())
    nodes = materialize(rows_of.groupBy("_digest").agg(F.min("_id").alias("_id"), F.count("*").alias("ids")))
    copies = rows_of.join(nodes.where("ids > 1").select(*key), key, "left_anti").join(
        nodes.where("ids > 1").select("_digest"), "_digest", "left_semi"
    )
    copies = materialize(copies.select(*key))
    repeated = materialize(rows_of.where("count > 1").select(*key))

    def one_row_each(rows: DataFrame) -> DataFrame:
        once = lookup_join(rows, repeated, key, "left_anti")
        return once.union(lookup_join(rows, repeated, key, "left_semi").dropDuplicates(key))

    def lost() -> DataFrame:
        texts = one_row_each(lookup_join(keyed, copies, key, "left_anti"))
        texts = texts.select(F.col("_id").alias("id"), F.col("_digest").alias("digest"), "text")
        return similar_roots(texts, words, similar, fingerprint_pairs(texts)).where("node <> root").select(F.col("node").alias("_id"))

    kept = nodes.join(materialize_alone(spark, lost), "_id", "left_anti").select(*key)
    gone = materialize(rows_of.join(kept, key, "left_anti").select(*key))
    return one_row_each(lookup_join(keyed, gone, key, "left_anti")).select(*docs.columns)
