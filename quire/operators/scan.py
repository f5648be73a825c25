"""Running totals inside a unit without ever holding one unit in one task.

A plain ``Window.partitionBy(unit)`` sends all rows of a unit to one task, so a document, graph
or archive holding a large share of the table would run on a single core. Here a unit is cut
into *segments* that follow its order: rows are scanned per (unit, segment), one total per
segment is formed with a map-side combine, and the totals of the earlier segments are added to
the rows of the later ones. Only later segments of split units have such a total, so for
ordinary data that join side is all but empty and is broadcast by the adaptive planner.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

SEGMENT = "_segment"


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``how`` is sum, max or min; exclusive ones leave out the row itself."""

    name: str
    value: Column
    how: str = "sum"
    inclusive: bool = True


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(how: str, local: Column, earlier: Column) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(earlier, F.lit(0))
    return (F.greatest if how == "max" else F.least)(local, earlier)


def segmented_scan(
    df: DataFrame,
    unit: Sequence[str],
    order: Sequence[Column | str],
    running: Sequence[Running],
    segment: str = SEGMENT,
    reverse: bool = False,
) -> DataFrame:
    """Add the running aggregates over each unit, in ``order``.

    Unit columns hold no nulls: the join of the carried totals is on plain equality, so it
    reuses the partitioning of the scan and the rows are shuffled once. ``segment`` names a
    column that never decreases along ``order``. With ``reverse`` the
    caller passes a descending ``order`` and the segments are taken from last to first.
    """
    keys = [*unit, segment]
    before, current = Window.unboundedPreceding, Window.currentRow
    within = Window.partitionBy(*keys).orderBy(*order)
    local = df.select(
        "*",
        *(
            _AGGREGATES[r.how](r.value)
            .over(within.rowsBetween(before, current if r.inclusive else -1))
            .alias(f"_local_{r.name}")
            for r in running
        ),
    )
    totals = df.groupBy(*keys).agg(
        *(_AGGREGATES[r.how](r.value).alias(f"_total_{r.name}") for r in running)
    )
    along = F.col(segment).desc() if reverse else F.col(segment).asc()
    across = Window.partitionBy(*unit).orderBy(along)
    carried = (
        totals.select(
            *keys,
            F.row_number().over(across).alias("_rank"),
            *(
                _AGGREGATES[r.how](f"_total_{r.name}")
                .over(across.rowsBetween(before, -1))
                .alias(f"_carry_{r.name}")
                for r in running
            ),
        )
        .filter("_rank > 1")
        .drop("_rank")
    )
    return local.join(carried, keys, "left").select(
        *df.columns,
        *(
            _combine(r.how, F.col(f"_local_{r.name}"), F.col(f"_carry_{r.name}")).alias(r.name)
            for r in running
        ),
    )


def range_segments(
    df: DataFrame, unit: Sequence[str], order: Sequence[Column | str], segments: int | None = None
) -> DataFrame:
    """Cut units into segments where no column gives natural ones.

    Rows are range-partitioned on (unit, order), which spreads a hot unit over many partitions,
    and the partition number becomes the segment. The result is materialised so that every
    later branch sees the same boundaries. Pass slim rows (keys, flags and lengths) of a
    written table: finding the boundaries reads the rows once more.
    """
    count = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *unit, *order)
    return materialize(ranged.withColumn(SEGMENT, F.spark_partition_id()))


#: A unit is dealt by ranges if it holds more than this part of a range, by a sketch of so many units a range.
PART_OF_RANGE, TRACKED = 4, 64


def _crowded(df: DataFrame, unit: Sequence[str], count: int) -> Column | None:
    """True for rows of units too large to be dealt whole to ``count`` tasks; None where there is no such unit.

    Sizes come from one bounded sketch, so only that is moved. They are near, and only decide how rows are dealt.
    """
    hashed = F.xxhash64(*unit)
    most = min(TRACKED * count, 1_000_000)
    listed = min(2 * PART_OF_RANGE * count, most)
    found = (
        df.dropna(subset=list(unit))
        .select(hashed.alias("u"))
        .agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(u, {listed}, {most})").alias("top"))
        .first()
    )
    large = [t["item"] for t in found["top"] or [] if t["count"] * PART_OF_RANGE * count > found["rows"]]
    return hashed.isin(large) if large else None


def position_in_unit(
    df: DataFrame,
    unit: Sequence[str],
    order: Sequence[Column | str],
    name: str = "position",
    segments: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """1-based position of every row in its unit (a distributed ``row_number``).

    Rows move once. Small units are dealt whole, sorted and numbered where they lie; larger ones are dealt by ranges
    of their order (see ``_by_ranges``). ``df`` is read once more to find those, so pass a written table or a cheap
    one. ``keep`` names the columns that come back; without it all do.
    """
    count = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = _crowded(df, unit, count)
    if crowded is None:
        return _whole(df, unit, order, name, segments, keep)
    rest = df.filter(~crowded)
    if rest.isEmpty():
        return _by_ranges(df, unit, order, name, count, keep)
    return _whole(rest, unit, order, name, segments, keep).unionByName(
        _by_ranges(df.filter(crowded), unit, order, name, count, keep)
    )


def _whole(
    df: DataFrame,
    unit: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    segments: int | None,
    keep: Sequence[str] | None,
) -> DataFrame:
    """Positions in units that one task can sort. What ``order`` computes is computed after the move."""
    dealt = df.repartition(segments, *unit) if segments else df.repartition(*unit)
    within = Window.partitionBy(*unit).orderBy(*order)
    return dealt.select(*(keep or df.columns), F.row_number().over(within).cast("long").alias(name))


def _by_ranges(
    df: DataFrame,
    unit: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    count: int,
    keep: Sequence[str] | None,
) -> DataFrame:
    """Positions in units of any size.

    Rows are dealt by ranges of (unit, order), sorted and numbered where they lie, and written with their numbers.
    What is taken off to let each unit start at 1 is a number per unit and range: few, as units are large.
    """
    dealt = df.repartitionByRange(count, *unit, *order).sortWithinPartitions(*unit, *order)
    numbered = dealt.withColumn("_at", F.monotonically_increasing_id())  # range << 33 | row of the range
    placed = materialize(numbered.select(*(keep or df.columns), "_at"))
    segment = F.shiftright("_at", 33).alias(SEGMENT)
    runs = placed.groupBy(*unit, segment).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*unit).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    starts = materialize(runs.select(*unit, SEGMENT, (F.col("_first") - before - 1).alias("_off")))
    met = placed.withColumn(SEGMENT, F.shiftright("_at", 33)).join(starts, [*unit, SEGMENT])
    return met.select(*(keep or df.columns), (F.col("_at") - F.col("_off")).alias(name))
