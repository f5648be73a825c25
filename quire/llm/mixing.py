"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson-distributed number of times whose mean is its source's rate:
the target share of the mixture over the source's share of the corpus. The Poisson distribution is
inverted at a number hashed from the document's id, so a rerun, on any cluster, draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lookup_join

#: Target weight of a source: its size to this power, scaled to sum to one.
TEMPERATURE = 0.7
#: Size of the mixture in sizes of the corpus.
EPOCHS = 1.0
SEED = "mix-1"
#: A larger mean is the sum of equal smaller ones, so that the distribution function stays exact.
LARGEST_MEAN = 8.0
#: Counts of the inverted distribution; a mean of 8 exceeds 48 with a chance below 1e-20.
COUNTS = 48


def _size(text: Column) -> Column:
    """Characters and one separator, so that no source has size zero."""
    return F.length(F.coalesce(text, F.lit(""))) + F.lit(1)


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = EPOCHS,
) -> DataFrame:
    """``source, rate``: mean repetitions that bring each source to its target weight.

    ``weights`` names sources and their relative weights, others get none; without it the weight is
    size ** ``temperature``. Sizes are characters of all documents. A null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.sum(_size(F.col("text"))).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(temperature))
    else:
        given = [(F.col("source") == F.lit(name), F.lit(float(w))) for name, w in weights.items()]
        weight = F.lit(0.0)
        for is_source, w in given:
            weight = F.when(is_source, w).otherwise(weight)
    weighted = sizes.withColumn("weight", weight)
    totals = weighted.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))
    # One row of totals beside one row for each source.
    return weighted.join(F.broadcast(totals)).select(
        "source", (F.lit(epochs) * F.col("weight") / F.col("weights") * F.col("sizes") / F.col("size")).alias("rate")
    )


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. COUNTS of a Poisson variable."""
    empty = F.struct(F.lit(0.0).alias("sum"), F.exp(-mean).alias("term"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(COUNTS + 1)),
        empty,
        lambda s, k: F.struct(
            (s["sum"] + s["term"]).alias("sum"),
            (s["term"] * mean / k).alias("term"),
            F.concat(s["all"], F.array(s["sum"] + s["term"])).alias("all"),
        ),
        lambda s: s["all"],
    )


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of ``parts``."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` replicated and globally shuffled, with ``copy`` (from 1) and ``mix_key`` added.

    The global order is by partition, then mix_key (a hash of document and copy): rows are dealt to
    all tasks by it, so neither a hot source nor a document of very many copies stays in one task.
    Rows without a rate are left out; equal ids are drawn alike, so repeated rows repeat alike;
    a null id is drawn like an empty one. Columns of ``docs`` named copy or mix_key give way.
    """
    table = rates.select(
        F.col("source").alias("_source"),
        F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int").alias("_draws"),
        "rate",
    ).select("_source", "_draws", _distribution(F.col("rate") / F.col("_draws")).alias("_upto"))
    kept = [c for c in docs.columns if c not in ("copy", "mix_key", "_source", "_draws", "_upto", "_key")]
    keyed = docs.select(*kept, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"))
    named = table.select(
        F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")).alias("_key"), "_draws", "_upto"
    )
    drawn = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.col("_draws")),
            lambda i: F.size(
                F.filter(F.col("_upto"), lambda c: c <= uniform(F.lit(seed), F.col("doc_id"), i))
            ),
        ),
        F.lit(0),
        lambda total, n: total + n,
    )
    counted = lookup_join(keyed, named, ["_key"], "inner").withColumn("_n", drawn).where("_n > 0")
    copies = counted.select(*kept, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy")).withColumn(
        "mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy"))
    )
    return copies.repartition("mix_key").sortWithinPartitions("mix_key")


SQL = f"""
WITH sizes AS (
    SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
    SELECT source, {EPOCHS} * pow(size, {TEMPERATURE}) / sum(pow(size, {TEMPERATURE})) OVER ()
        * sum(size) OVER () / size AS rate
    FROM sizes
), means AS (
    SELECT source, greatest(ceil(rate / {LARGEST_MEAN}), 1)::BIGINT AS draws,
        rate / greatest(ceil(rate / {LARGEST_MEAN}), 1) AS mean
    FROM rates
), upto AS (
    SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
    FROM means, range({COUNTS + 1}) AS r(k)
), draws AS (
    SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text,
        ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || i), 1, 13))::BIGINT
            / {float(1 << 52)} AS u, i
    FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, range(1, m.draws + 1) AS r(i)
), counts AS (
    SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text,
        sum((SELECT count(*) FROM upto c WHERE c.source IS NOT DISTINCT FROM d.source AND c.p <= d.u)) AS n
    FROM draws d GROUP BY ALL
)
SELECT doc_id, source, lang, n_chars, text, copy::BIGINT AS copy,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS mix_key
FROM counts, range(1, n::BIGINT + 1) AS r(copy)
"""
