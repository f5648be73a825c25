"""Deterministic ids and fingerprints: hashes of compact JSON, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(*columns: Column) -> Column:
    """Compact UTF-8 JSON of the columns in the order given, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def digest(*columns: Column) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def packed(identifier: Column) -> Column:
    """Any text id as bytes that ``unpacked`` turns back; a digest takes 33 instead of 64."""
    is_digest = identifier.rlike(r"\A[0-9a-f]{64}\z")
    return F.when(is_digest, F.concat(F.lit(b"\1"), F.unhex(identifier))).otherwise(
        F.concat(F.lit(b"\0"), F.encode(identifier, "UTF-8"))
    )


def unpacked(held: Column) -> Column:
    rest = F.substring(held, 2, 2**31 - 1)
    return F.when(F.substring(held, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def table_id(unit: Column, external_id: Column) -> Column:
    """Table id of a unit's element; null for a null reference."""
    hashed = F.sha2(F.concat_ws("|", unit.cast("string"), external_id), 256)
    return F.when(external_id.isNotNull(), hashed)


def node_id(raw_id: Column, file: Column, location: Column) -> Column:
    return digest(raw_id.alias("id"), file.alias("file"), location.alias("location"))


def edge_id(
    source: Column, target: Column, relation: Column, location: Column, file: Column
) -> Column:
    return digest(
        source.alias("source"),
        target.alias("target"),
        relation.alias("relation"),
        location.alias("location"),
        file.alias("file"),
    )


def claim_id(source: Column, start: Column, end: Column, text: Column, kind: Column) -> Column:
    return digest(
        source.alias("source"),
        F.struct(end.alias("end"), start.alias("start")).alias("span"),
        text.alias("text"),
        kind.alias("type"),
    )


def input_fingerprint(report_sha: Column, source_sha: Column, schema_version: str) -> Column:
    return digest(
        report_sha.alias("report"),
        F.lit(schema_version).alias("schema_version"),
        source_sha.alias("source"),
    )


def output_fingerprint(claims_sha: Column, graph_sha: Column, report_sha: Column) -> Column:
    return digest(
        claims_sha.alias("claims"), graph_sha.alias("graph_sha256"), report_sha.alias("report")
    )
