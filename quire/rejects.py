"""Rejected rows as a table: every validator returns what it kept and why it refused the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECT_COLUMNS = ("unit_id", "code", "message", "offender")


class Code:
    """Reject codes. Fixed values."""

    BAD_REQUEST = "bad_request"
    FORBIDDEN = "forbidden"
    SUBMISSION_NOT_FOUND = "submission_not_found"
    ARTIFACT_NOT_FOUND = "artifact_not_found"
    CONFLICT = "conflict"
    DUPLICATE_RESOURCE = "duplicate_resource"
    INVALID_STATE_TRANSITION = "invalid_state_transition"
    PAYLOAD_TOO_LARGE = "payload_too_large"
    UNSUPPORTED_MEDIA_TYPE = "unsupported_media_type"
    INTERNAL_ERROR = "internal_error"
    STORAGE_ERROR = "storage_error"
    PARSER_ERROR = "parser_error"


def reject_rows(
    df: DataFrame, unit: Column | str, code: Column | str, message: Column | str, offender: Column
) -> DataFrame:
    """Shape failing rows as ``(unit_id, code, message, offender)``, all text.

    ``code`` and ``message`` are literal text when given as ``str``; ``unit`` is a column name.
    """
    unit = F.col(unit) if isinstance(unit, str) else unit
    code = F.lit(code) if isinstance(code, str) else code
    message = F.lit(message) if isinstance(message, str) else message
    return df.select(
        unit.cast("string").alias("unit_id"),
        code.alias("code"),
        message.alias("message"),
        offender.cast("string").alias("offender"),
    )


def union_rejects(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def drop_units(df: DataFrame, rejects: DataFrame, unit: str) -> DataFrame:
    """Void every unit that has at least one rejected row."""
    bad = rejects.select(F.col("unit_id").alias("_bad_unit")).distinct()
    return df.join(bad, df[unit].cast("string") == bad["_bad_unit"], "left_anti")


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that fails, in the order given; null when none does."""
    chain = None
    for failed, name in rules:
        chain = F.when(failed, name) if chain is None else chain.when(failed, name)
    return chain
