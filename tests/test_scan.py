"""Segmented scans against plain windows, with hot units and tiny segments."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators.scan import SEGMENT, Running, position_in_unit, segmented_scan


def hot_rows(spark, n=900):
    """A third of the rows in one unit, the rest spread."""
    rng = random.Random(7)
    rows = [(0 if i % 3 == 0 else i % 40 + 1, i, rng.randint(0, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "unit INT, at INT, v INT")


def test_scan_equals_window(spark):
    rows = hot_rows(spark)
    specs = [
        Running("total", F.col("v")),
        Running("before", F.col("v"), inclusive=False),
        Running("top", F.when(F.col("v") > 4, F.col("at")), "max", inclusive=False),
        Running("low", F.col("v"), "min"),
    ]
    cut = rows.withColumn(SEGMENT, (F.col("at") / 10).cast("int"))
    actual = segmented_scan(cut, ["unit"], ["at"], specs).drop(SEGMENT)
    w = Window.partitionBy("unit").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    expected = rows.select(
        "*",
        F.sum("v").over(upto).alias("total"),
        F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("before"),
        F.max(F.when(F.col("v") > 4, F.col("at"))).over(earlier).alias("top"),
        F.min("v").over(upto).alias("low"),
    )
    assert sorted(actual.collect()) == sorted(expected.collect())


def test_reverse_scan_equals_window(spark):
    rows = hot_rows(spark)
    cut = rows.withColumn(SEGMENT, (F.col("at") / 10).cast("int"))
    spec = [Running("next", F.when(F.col("v") < 3, F.col("at")), "min", inclusive=False)]
    actual = segmented_scan(cut, ["unit"], [F.col("at").desc()], spec, reverse=True).drop(SEGMENT)
    after = Window.partitionBy("unit").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    expected = rows.withColumn("next", F.min(F.when(F.col("v") < 3, F.col("at"))).over(after))
    key = lambda r: (r.unit, r.at)
    assert sorted(actual.collect(), key=key) == sorted(expected.collect(), key=key)


def test_position_of_hot_unit(spark):
    rows = hot_rows(spark)
    for order in (["v", "at"], [F.col("v").desc(), F.col("at").desc()]):
        actual = position_in_unit(rows, ["unit"], order, segments=16)
        w = Window.partitionBy("unit").orderBy(*order)
        expected = rows.withColumn("position", F.row_number().over(w).cast("bigint"))
        assert sorted(actual.collect()) == sorted(expected.collect())


def test_position_spreads_a_hot_unit(spark):
    from quire.operators.scan import range_segments

    cut = range_segments(hot_rows(spark), ["unit"], ["at"], segments=12)
    hot = cut.filter("unit = 0").groupBy(SEGMENT).count().collect()
    assert len(hot) >= 3
    assert max(r["count"] for r in hot) < 150


def stack_outline(levels):
    """Parent and closing section by the textbook stack."""
    parents, closing, stack = [], [None] * len(levels), []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            closing[stack.pop()] = i
        parents.append(stack[-1] if stack else None)
        stack.append(i)
    return parents, closing


def test_outline_equals_stack(spark):
    rng = random.Random(3)
    documents = {d: [rng.randint(1, 5) for _ in range(rng.randint(1, 60))] for d in range(30)}
    documents[99] = [rng.randint(1, 40) for _ in range(400)]
    documents[100] = [1, 3, 2, 3, 1, 1]
    rows = [(d, i, level) for d, ls in documents.items() for i, level in enumerate(ls)]
    sections = spark.createDataFrame(rows, "artifact_id INT, ordinal INT, level INT")
    both = L.section_successors(L.section_parents(sections, per_segment=8), per_segment=8)
    actual = {(r.artifact_id, r.ordinal): (r.parent_ordinal, r.next_ordinal)
              for r in both.collect()}
    for d, levels in documents.items():
        parents, closing = stack_outline(levels)
        for i in range(len(levels)):
            assert actual[d, i] == (parents[i], closing[i])


def test_outline_plan_is_the_same_for_any_depth(spark):
    """Three levels or a hundred and twenty: as many exchanges, and no job before the result is asked for."""
    counts = []
    for depth in (3, 120):
        rows = [(1, i, 1 + i % depth) for i in range(3 * depth)]
        sections = spark.createDataFrame(rows, "artifact_id INT, ordinal INT, level INT")
        spark.sparkContext.setJobGroup(f"outline-{depth}", "plan only")
        both = L.section_successors(L.section_parents(sections))
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"outline-{depth}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counts.append(plan.count("Exchange"))
        parents, closing = stack_outline([level for _, _, level in rows])
        got = {r.ordinal: (r.parent_ordinal, r.next_ordinal) for r in both.collect()}
        assert got == {i: (parents[i], closing[i]) for i in range(len(rows))}
    assert counts[0] == counts[1]


def test_sections_do_not_depend_on_segment_size(spark, sf_dir):
    from checks import inputs

    blocks = inputs.layout_blocks(spark, sf_dir)
    key = ["artifact_id", "ordinal", "level", "page_start"]
    one = L.detect_sections(blocks, pages=1).select(*key).collect()
    many = L.detect_sections(blocks).select(*key).collect()
    assert sorted(one) == sorted(many)
