"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores over ``SLICES`` slices of the dimensions. Phase 1 gathers each
block's highest partial scores per slice; the k-th best whole score among those vectors is a safe
cutoff: the true k-th score is no lower. Phase 2 hands the cutoff to every block, which collects each
vector with a partial score of at least cutoff / SLICES in some slice; a vector with none sums to less
than the cutoff. Phase 3 resolves the whole scores of what was collected, exactly.

Queries and candidates meet in blocks of bounded size, and equal vectors are one vector with a list of
its first ids, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_rows
from quire.session import materialize

K = 20
SCALE = 64
SLICES = 4
#: Distinct vectors of a block of candidates; queries pass by in Arrow batches.
BLOCK = 4096
#: Largest sum that double arithmetic adds without rounding.
EXACT = 2**53


def quantized(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(embedding: Column) -> Column:
    """Neither null nor holding a null, infinite or undefined component."""
    finite = F.forall(
        embedding,
        lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)),
    )
    return F.coalesce(embedding.isNotNull() & finite, F.lit(False))


def distinct_vectors(vectors: DataFrame, k: int = K) -> DataFrame:
    """``code, ids``: equal codes once, with their k + 1 smallest ids.

    The rank limit is applied by every task before rows are shuffled, so a code that a third of all
    rows share sends a few rows from each task.
    """
    rank = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    first = vectors.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    return first.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(codes: list, width: int) -> np.ndarray:
    out = np.zeros((len(codes), width), np.int64)
    for row, code in zip(out, codes):
        row[: len(code)] = code
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer product: in doubles where no sum can round, else in 64-bit integers."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if largest < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _slices(width: int) -> list[slice]:
    cuts = np.linspace(0, width, min(SLICES, max(width, 1)) + 1).astype(int)
    return [slice(x, y) for x, y in zip(cuts, cuts[1:])]


def _passes(rows: DataFrame, answer, schema: str) -> DataFrame:
    """Run ``answer(candidates, ids, query codes, cutoffs)`` for each block and each batch of queries.

    Rows come as ``block, query, code, ids, cutoff``; in a block, candidates (query null) first. A task
    holds one block of candidates and one batch of queries at a time.
    """
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("query").asc_nulls_first())

    def stream(batches: Iterator[dict]) -> Iterator[dict]:
        block, codes, ids, matrix = None, [], [], None
        for batch in batches:
            at = 0
            while at < len(batch["block"]):
                to = at
                kind = (batch["block"][at], batch["query"][at] is None)
                while to < len(batch["block"]) and (batch["block"][to], batch["query"][to] is None) == kind:
                    to += 1
                if kind[0] != block:
                    block, codes, ids, matrix = kind[0], [], [], None
                if kind[1]:
                    codes += batch["code"][at:to]
                    ids += batch["ids"][at:to]
                elif codes:
                    asked = batch["code"][at:to]
                    width = max(map(len, [*codes, *asked]), default=0)
                    if matrix is None or matrix.shape[1] != width:
                        matrix = _matrix(codes, width)
                    out = answer(matrix, ids, _matrix(asked, width), batch["cutoff"][at:to])
                    rows_ = [(q, *row) for q, found in zip(batch["query"][at:to], out) for row in found]
                    if rows_:
                        yield dict(zip(names, zip(*rows_)))
                at = to

    names = [part.split()[0] for part in schema.split(", ")]
    return map_rows(dealt, stream, schema)


def _local_lists(k: int):
    """Phase 1: whole scores of the vectors that lead some slice, the k + 1 best, copies counted."""

    def answer(matrix: np.ndarray, ids: list, queries: np.ndarray, _) -> Iterator[list]:
        parts = [_product(queries[:, s], matrix[:, s]) for s in _slices(matrix.shape[1])]
        whole = sum(parts)
        many = np.array([len(i) for i in ids])
        for row in range(len(queries)):
            leaders = np.unique(np.concatenate([_leading(p[row], k + 1) for p in parts]))
            scores = np.repeat(whole[row, leaders], many[leaders])
            yield [(int(x),) for x in np.sort(scores)[::-1][: k + 1]]

    return answer


def _leading(scores: np.ndarray, n: int) -> np.ndarray:
    return np.argpartition(-scores, n - 1)[:n] if len(scores) > n else np.arange(len(scores))


def _resolved(k: int):
    """Phases 2 and 3: collect by the cutoff, then the exact scores that reach it."""

    def answer(matrix: np.ndarray, ids: list, queries: np.ndarray, cutoffs: list) -> Iterator[list]:
        slices = _slices(matrix.shape[1])
        parts = [_product(queries[:, s], matrix[:, s]) for s in slices]
        for row, cutoff in enumerate(cutoffs):
            if cutoff is None:
                collected = np.arange(len(ids))
            else:
                share = -(-cutoff // len(slices))  # some slice of a vector that reaches the cutoff is no less
                collected = np.flatnonzero(np.logical_or.reduce([p[row] >= share for p in parts]))
            scores = sum(p[row, collected] for p in parts)
            enough = slice(None) if cutoff is None else scores >= cutoff
            found = sorted((-int(x), i) for x, c in zip(scores[enough], collected[enough]) for i in ids[c])
            yield [(i, -x) for x, i in found[: k + 1]]

    return answer


def top_products(
    vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    ``vectors`` has vec_id and an integer array ``code``. Candidates are all rows but the query's own;
    equal scores go to the smaller vec_id; fewer candidates give fewer rows. Rows with a null id or
    code take no part, rows equal in id and code count once, and an id with two codes is two rows.
    Codes of different length are compared as if filled up with zeros. No rows give no rows.
    """
    kept = materialize(
        vectors.where("vec_id is not null and code is not null").select(F.col("vec_id").cast("bigint"), "code").distinct()
    )
    asked = kept.where(is_query)
    first = materialize(distinct_vectors(kept, k))
    blocks = max(1, -(-first.count() // block))
    candidates = first.select(
        F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(None).cast("bigint").alias("query"),
        "code",
        "ids",
        F.lit(None).cast("bigint").alias("cutoff"),
    )
    # A code is named by its smallest id and, should that id have two codes, by the code's hash.
    named = first.join(asked.select("code").distinct(), "code", "left_semi").select(
        F.xxhash64(F.get("ids", F.lit(0)), "code").alias("query"), "code"
    )
    queries = materialize(named)

    def passing(table: DataFrame) -> DataFrame:
        each = table.select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
            "query",
            "code",
            F.lit(None).cast("array<bigint>").alias("ids"),
            "cutoff",
        )
        return candidates.union(each)

    lists = _passes(
        passing(queries.withColumn("cutoff", F.lit(None).cast("bigint"))), _local_lists(k), "query bigint, score bigint"
    )
    order = Window.partitionBy("query").orderBy(F.col("score").desc())
    best = lists.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    cutoffs = best.groupBy("query").agg(
        F.when(F.count("*") == k + 1, F.min("score")).alias("cutoff")
    )
    found = _passes(
        passing(queries.join(cutoffs, "query", "left")), _resolved(k), "query bigint, vec_id bigint, score bigint"
    )
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    top = materialize(found.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= k + 1).drop("_rank"))
    lead = asked.join(queries, "code").select(F.col("vec_id").alias("query_id"), "query", "code")
    others = lead.join(top, "query").where("query_id <> vec_id")
    within = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return (
        others.withColumn("rank", F.row_number().over(within))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = f"""
WITH kept AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS code
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id,
        list_sum(list_transform(range(1, len(q.code) + 1), lambda i: q.code[i] * v.code[i]))::BIGINT AS score
    FROM kept q JOIN kept v ON q.vec_id <> v.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY rank <= {K}
"""
