"""Shared column expressions (all JVM built-ins, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """``CASE WHEN cond THEN 1 ELSE 0 END`` as int."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_when(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as bigint (0 for no rows matching)."""
    return F.sum(flag(cond)).cast("bigint")


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """``ROUND(100 * num / NULLIF(den, 0), digits)`` in double arithmetic."""
    return F.round(F.lit(100.0) * num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), digits)


def ratio(num: Column, den: Column, digits: int | None = None) -> Column:
    r = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return F.round(r, digits) if digits is not None else r


def severity_counts(sev: str = "collision_severity", names=("fatal_count", "serious_count", "slight_count")):
    s = F.col(sev)
    return [count_when(s == F.lit(k)).alias(n) for k, n in zip((1, 2, 3), names)]


def numeric_fields(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def select_available(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep the requested columns that exist (schema-driven, no data access)."""
    present = set(df.columns)
    return df.select(*[c for c in cols if c in present])


TIME_OF_DAY = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"


def tod_minutes(t: Column | str) -> Column:
    """Whole minutes since midnight of an 'HH:mm' or 'HH:mm:ss' string; NULL when
    it is not a valid time of day (checked by pattern, then two substring casts)."""
    c = col(t)
    return F.when(c.rlike(TIME_OF_DAY), F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int"))


def start_of(unit: str, ts: Column | str) -> Column:
    """The start of the hour or day of a timestamp, without a time zone.

    ``date_trunc`` goes through the session's zone, where local hours can be
    missing or occur twice; the fields of a zone-free timestamp do not.
    """
    c = col(ts).cast("timestamp_ntz")
    if unit == "day":
        return c.cast("date").cast("timestamp_ntz")
    if unit == "hour":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))
    raise ValueError(f"unknown unit: {unit}")


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a single-row aggregate to every row.

    The right side is an aggregate without grouping keys, so it has exactly one
    row by construction; it is broadcast and the join is a per-row append
    (replaces ``agg(...) OVER ()`` without moving all rows into one partition).
    """
    return df.crossJoin(F.broadcast(one_row))
