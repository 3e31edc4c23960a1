"""Constraints that act on a write (S2): not-null, references and unique keys.

A database refuses a row that breaks a constraint.  Here the rows of a whole table are
judged in one job: rows that keep every constraint go to the table, the others to a
quarantine table with the list of their reasons, and no row is lost.

Not-null and references are judged first; a key is judged among the rows that passed
them.  Of rows with equal keys the earliest ``created_at`` stays (ties: smallest hash
of the row); a key with a NULL repeats nothing.  A reference must name an accepted row
of the parent, so children of quarantined parents are quarantined too.

Every key is reduced to one row map-side before the shuffle and joined back, so a key
with a large share of the rows is one row per partition in the aggregate, and its
join side can be split by AQE.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.session import stored
from crashlens.sources import schemas

REASONS = "_reasons"


@dataclass(frozen=True)
class Constraints:
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    #: column -> parent table, whose column has the same name
    references: Mapping[str, str] = field(default_factory=dict)


def declared(table: str) -> Constraints:
    """The constraints of one of the three domain tables."""
    schema = {"collision": schemas.COLLISION, "vehicle": schemas.VEHICLE, "casualty": schemas.CASUALTY}[table]
    not_null = tuple(f.name for f in schema if not f.nullable)
    return Constraints(not_null, (schemas.KEYS[table],), {} if table == "collision" else {"collision_index": "collision"})


def judged(df: DataFrame, rules: Constraints, parents: Mapping[str, DataFrame] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows with ``_reasons``, an array of ``not_null:column``, ``references:table`` and
    ``unique:columns`` (empty: the row is accepted).  Declared columns that ``df`` lacks
    count as NULL.  ``parents`` holds the accepted rows of the tables referred to.
    ``columns``: those of ``df`` that the judged rows keep (default: all); the others are read, not moved."""
    made = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp")
    columns = df.columns if columns is None else [c for c in df.columns if c in columns]
    judging = {*rules.not_null, *rules.references, *(c for key in rules.unique for c in key), *columns}
    rows = df.select(*[c for c in df.columns if c in judging], made.alias("__made"), F.xxhash64(*df.columns).alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    rows = stored(rows, "constraints")  # row numbers fixed by the write
    # NULLs are judged before any join, so only the columns that go on are moved
    missing = [F.when(F.col(c).isNull() if c in df.columns else F.lit(True), F.lit(f"not_null:{c}")) for c in rules.not_null]
    keys = {*rules.references, *(c for key in rules.unique for c in key), *columns}
    working = [*[c for c in rows.columns if c in keys], "__made", "__hash", "__row"]
    rows = rows.select(*working, (F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")).alias(REASONS))
    for i, (column, parent) in enumerate(rules.references.items()):
        if column not in df.columns:
            continue
        known = parents[parent].select(F.col(column).alias(f"__p{i}")).where(f"__p{i} IS NOT NULL").distinct()
        rows = rows.join(known, rows[column] == known[f"__p{i}"], "left")
        # a NULL refers to nothing
        unknown = F.col(column).isNotNull() & F.col(f"__p{i}").isNull()
        rows = rows.withColumn(REASONS, F.when(unknown, F.concat(REASONS, F.array(F.lit(f"references:{parent}")))).otherwise(F.col(REASONS)))
    rows = rows.select(*working, REASONS)
    order = F.struct(F.col("__made").isNull().alias("late"), F.col("__made").alias("made"), F.col("__hash").alias("hash"), F.col("__row").alias("row"))
    for key in rules.unique:
        if not set(key) <= set(df.columns):
            continue
        whole = F.size(REASONS) == 0
        for c in key:
            whole = whole & F.col(c).isNotNull()
        names = [F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]
        first = rows.where(whole).groupBy(*names).agg(F.min(order).alias("__first")).select(*[f"__k{i}" for i in range(len(key))], F.col("__first.row").alias("__stays"))
        met = whole
        for i, c in enumerate(key):
            met = met & (rows[c] == first[f"__k{i}"])
        repeated = F.col("__stays") != F.col("__row")  # NULL for a row that was not judged
        rows = rows.join(first, met, "left").withColumn(REASONS, F.when(repeated, F.array(F.lit(f"unique:{','.join(key)}"))).otherwise(F.col(REASONS)))
        rows = rows.select(*working, REASONS)
    return rows.select(*columns, REASONS)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size(REASONS) == 0).drop(REASONS)


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(F.size(REASONS) > 0)


def judged_tables(tables: Mapping[str, DataFrame], whole: bool = True) -> dict[str, DataFrame]:
    """The named domain tables judged, parents before children; not ``whole``: every row, with the
    columns alone that a later table refers to and its reasons."""
    out: dict[str, DataFrame] = {}
    names = [n for n in ("collision", "vehicle", "casualty") if n in tables]
    for name in names:
        parents = {p: accepted(out[p]) for p in declared(name).references.values()}
        columns = None if whole else [c for n in names for c, p in declared(n).references.items() if p == name]
        out[name] = stored(judged(tables[name], declared(name), parents, columns), f"judged-{name}")
    return out


def violation_counts(judged_rows: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, reason, n."""
    parts = [rows.select(F.lit(name).alias("table_name"), F.explode(REASONS).alias("reason")) for name, rows in judged_rows.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def write_enforced(tables: Mapping[str, DataFrame], folder: str, partition_by: Sequence[str] = ()) -> None:
    """Accepted rows to ``folder/name``, the others to ``folder/name_quarantine``."""
    for name, rows in judged_tables(tables).items():
        for part, path in ((accepted(rows), name), (quarantined(rows), f"{name}_quarantine")):
            writer = part.write.mode("overwrite")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder.rstrip('/')}/{path}")
