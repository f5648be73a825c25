"""Data-quality audits from declared constraints, and upserts that keep time stamps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schemas


class Declared(NamedTuple):
    """Row checks by table and name, unique keys by table, and the foreign keys of a table."""

    checks: Mapping[str, Mapping[str, str]] = schemas.ROW_CHECKS
    unique: Mapping[str, Sequence[str]] = schemas.UNIQUE_KEYS
    foreign: Callable[[str], list[tuple[str, dict[str, str]]]] = schemas.foreign_keys


def audit_checks(df: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """``(key, rule)`` of every broken row check, all rules in one pass.

    Rules are SQL conditions; as in SQL, a condition that is null passes.
    """
    broken = F.array_compact(
        F.array(*(F.when(~F.expr(condition), name) for name, condition in rules.items()))
    )
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def audit_unique(df: DataFrame, keys: Sequence[str], where: str | None = None) -> DataFrame:
    """Key values that occur more than once, with their count.

    A key with a null part never clashes; ``where`` makes a partial key.
    """
    rows = df.filter(where) if where else df
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def audit_foreign_keys(
    child: DataFrame, parent: DataFrame, keys: Mapping[str, str]
) -> DataFrame:
    """Child key values without a parent, with the number of rows; a null part passes.

    Rows are counted per key value before the join, so a value used by a large share of the
    table is one row when it meets the parent.
    """
    rows = child
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    used = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(*(F.col(p).alias(c) for c, p in keys.items()))
    return used.join(known, list(keys), "left_anti")


def audit_append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the older snapshot that are missing or changed in the newer one."""
    return old.exceptAll(new)


def touch_updated_at(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], now: Column
) -> DataFrame:
    """Upsert: matched rows take the update, keep ``created_at`` and get ``updated_at = now``.

    ``updates`` has the target's columns other than the two stamps; new rows get both.
    """
    stamps = ("created_at", "updated_at")
    values = [c for c in target.columns if c not in (*keys, *stamps)]
    new = updates.select(
        *keys, *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_touched")
    )
    joined = target.withColumn("_held", F.lit(True)).join(new, list(keys), "full_outer")
    touched = F.col("_touched").isNotNull()
    return joined.select(
        *keys,
        *(F.when(touched, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values),
        F.when(F.col("_held").isNull(), now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*target.columns)


def audit_tables(tables: Mapping[str, DataFrame], declared: Declared = Declared()) -> DataFrame:
    """``table, kind, rule, value, n``: all broken checks, repeated keys and values without a parent, at once.

    Every table is read once. A row states what it breaks, the key values it holds and those it refers to;
    statements on one value are counted in one grouping, in which keys meet references. A statement is two numbers
    and the value, and what is counted are numbers, so the grouping is by hash.
    ``kind`` is check (rows that break it), unique (rows that share a value) or foreign (rows that refer to a
    value no parent has). Keys with a null part, and foreign keys into tables that are not given, say nothing.
    """
    said = {name: _statements(name, tables, declared) for name in tables}
    targets: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for statements in said.values():
        for s in statements:
            says = targets.setdefault((s.kind, s.target), [])
            if s.says and s.says not in says:
                says.append(s.says)
    number = {target: i for i, target in enumerate(targets)}
    slots = max((len(says) for says in targets.values()), default=0)

    def stated(name: str, df: DataFrame) -> DataFrame:
        """``target``, its number; ``slot``, who says it, -1 for the one that holds the value; ``value``."""
        rows = [
            F.when(s.holds, F.struct(
                F.lit(number[s.kind, s.target]).alias("target"),
                F.lit(targets[s.kind, s.target].index(s.says) if s.says else -1).alias("slot"),
                s.value.alias("value"),
            ))
            for s in said[name]
        ]
        return df.select(F.explode(F.array_compact(F.array(*rows))).alias("s")).select("s.*")

    met = reduce(DataFrame.unionByName, (stated(name, df) for name, df in tables.items() if said[name])).groupBy(
        "target", "value"
    ).agg(
        F.max(F.col("slot") == -1).alias("held"), *(F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(slots))
    )
    names = F.create_map(*(
        x for (kind, target), says in targets.items() for i, (table, rule) in enumerate(says)
        for x in (F.lit(number[kind, target] * slots + i),
                  F.struct(F.lit(table).alias("table"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule")))
    ))
    counts = F.array(*(F.struct(F.lit(i).alias("slot"), F.col(f"n{i}").alias("n")) for i in range(slots)))
    kinds = {k: [number[t] for t in targets if t[0] == k] for k in ("unique", "foreign")}
    least = F.when(F.col("target").isin(*kinds["unique"]), 2).otherwise(1)
    broken = F.filter(counts, lambda c: c["n"] >= least)
    lost = ~F.col("target").isin(*kinds["foreign"]) | ~F.col("held")
    return (
        met.where(lost)
        .select("value", "target", F.explode(broken).alias("c"))
        .select("value", names[F.col("target") * slots + F.col("c.slot")].alias("s"), "c.n")
        .select("s.table", "s.kind", "s.rule", "value", "n")
    )


class _Statement(NamedTuple):
    """What rows say of a value, where ``holds``: ``says`` is the table and rule, None if it holds the value."""

    kind: str
    target: str
    says: tuple[str, str] | None
    value: Column
    holds: Column


def _statements(name: str, tables: Mapping[str, DataFrame], declared: Declared) -> list[_Statement]:
    def key(columns: Sequence[str]) -> tuple[Column, Column]:
        whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        return F.to_json(F.array(*(F.col(c).cast("string") for c in columns))), whole

    out = []
    for rule, condition in declared.checks.get(name, {}).items():
        out.append(_Statement("check", f"{name} {rule}", (name, rule), F.lit(None).cast("string"), ~F.expr(condition)))
    for rule in declared.unique.get(name, []):
        out.append(_Statement("unique", f"{name} {rule}", (name, rule), *key(rule.split())))
    for parent, columns in declared.foreign(name):
        if parent in tables:
            target = f"{parent} {' '.join(columns.values())}"
            out.append(_Statement("foreign", target, (name, " ".join(columns)), *key(list(columns))))
    referred = {tuple(cs.values()) for child in tables for parent, cs in declared.foreign(child) if parent == name}
    for columns in sorted(referred):
        out.append(_Statement("foreign", f"{name} {' '.join(columns)}", None, *key(columns)))
    return out
