"""Cleaning operators.

All are single projections/filters except the dedup (one aggregation keyed
on the table key, with map-side partial aggregation so a hot key collapses
before the shuffle) and the median imputation (one global aggregate joined
back as a one-row broadcast).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.functions.expr import attach_one_row, numeric_fields, tod_minutes

# Per-column missing-value codes of the cleaning script.
COLLISION_SENTINELS = {
    "longitude": (-1,), "latitude": (-1,),
    "weather_conditions": (-1, 99), "light_conditions": (-1, 99), "road_surface_conditions": (-1, 99),
    "junction_detail": (99,), "junction_control": (9,), "road_type": (9,), "speed_limit": (-1,),
}
VEHICLE_SENTINELS = {
    "vehicle_type": (99,), "vehicle_manoeuvre": (99,), "age_of_driver": (-1,),
    "sex_of_driver": (-1,), "driver_imd_decile": (-1,),
}
CASUALTY_SENTINELS = {
    "age_of_casualty": (-1,), "sex_of_casualty": (-1,), "casualty_imd_decile": (-1,),
    "pedestrian_location": (-1,),
}
# Notebook post-merge missing markers (numbers and strings).
GLOBAL_SENTINEL_NUMBERS = (-1, 99)
GLOBAL_SENTINEL_STRINGS = ("Unknown", "unknown", "Not known", "Unknown (self reported only)")
ID_FIELDS = ("collision_index", "collision_reference", "vehicle_reference", "casualty_reference")

VEHICLE_KEY = ("collision_index", "vehicle_reference")
CASUALTY_KEY = ("collision_index", "vehicle_reference", "casualty_reference")
COLLISION_KEY = ("collision_index",)
#: Column of rows dealt by accident (:func:`by_accident`): the accident's key, '' for NULL.
ACCIDENT = "__accident"


def sentinels_to_null(df: DataFrame, rules: dict[str, Sequence]) -> DataFrame:
    """Per-column coded missing values -> NULL, in one projection."""
    out = []
    for c in df.columns:
        codes = rules.get(c)
        if codes:
            out.append(F.when(F.col(c).isin(*codes), F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def clean_collision(df: DataFrame) -> DataFrame:
    return sentinels_to_null(df, COLLISION_SENTINELS)


def clean_vehicle(df: DataFrame) -> DataFrame:
    return sentinels_to_null(df, VEHICLE_SENTINELS)


def clean_casualty(df: DataFrame) -> DataFrame:
    return sentinels_to_null(df, CASUALTY_SENTINELS)


def numeric_sentinel_to_null(df: DataFrame, value=-1) -> DataFrame:
    """C4: ``value`` -> NULL in every numeric column."""
    nums = set(numeric_fields(df))
    return df.select(*[
        (F.when(F.col(c) == F.lit(value), F.lit(None)).otherwise(F.col(c)).alias(c) if c in nums else F.col(c))
        for c in df.columns
    ])


def global_sentinels_to_null(df: DataFrame, numbers=GLOBAL_SENTINEL_NUMBERS,
                             strings=GLOBAL_SENTINEL_STRINGS) -> DataFrame:
    """The notebook's table-wide replace, per type family."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.BooleanType):
            out.append(F.when(c.isin(*numbers), F.lit(None)).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.when(c.isin(*strings), F.lit(None)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def strip_column_names(df: DataFrame) -> DataFrame:
    """C6."""
    return df.toDF(*[c.strip() for c in df.columns])


def ids_to_trimmed_string(df: DataFrame, ids: Iterable[str] = ID_FIELDS) -> DataFrame:
    """Id columns (if present) as trimmed strings; NULL stays NULL."""
    ids = set(ids)
    return df.select(*[F.trim(F.col(c).cast("string")).alias(c) if c in ids else F.col(c) for c in df.columns])


def add_source_tag(df: DataFrame, name: str) -> DataFrame:
    """C10."""
    return df.withColumn("source_table", F.lit(name))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates (hash aggregate with map-side combine)."""
    return df.dropDuplicates()


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """One aggregate pass decides which columns hold no value at all."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in counts.items() if n == 0])


def drop_unique_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose distinct count equals the row count.

    One pass of HyperLogLog shortlists candidates; the exact distinct count is
    only computed for the shortlist (both are aggregates, nothing collected).
    """
    cols = df.columns
    approx = df.agg(F.count(F.lit(1)).alias("__n"),
                    *[F.approx_count_distinct(F.col(c), 0.02).alias(c) for c in cols]).first().asDict()
    n = approx.pop("__n")
    short = [c for c, v in approx.items() if v >= 0.9 * n]
    if not short:
        return df
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in short]).first().asDict()
    # pandas nunique ignores NaN: a column with any NULL cannot be unique per row
    return df.drop(*[c for c, v in exact.items() if v == n])


def by_accident(df: DataFrame) -> DataFrame:
    """The rows of an accident in one partition, with the key they are dealt by.

    Whatever groups or joins by accident after that (dedup by a key of the accident, removal
    of equal rows, the merges) needs no further exchange and no sort before this one."""
    return df.withColumn(ACCIDENT, F.coalesce(F.col("collision_index"), F.lit(""))).repartition(ACCIDENT)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("created_at",)) -> DataFrame:
    """One row per key, the earliest by ``order`` then every other column.

    Expressed as ``min(struct(order..., rest...))`` per key: the aggregate is
    computed partially on the map side, so a key holding a third of all rows
    is reduced to one row per input partition before the shuffle.  Struct
    ordering compares field by field with NULL lowest, a total order.  Rows that are
    dealt by accident are aggregated where they are.
    """
    keys = [*keys, ACCIDENT] if ACCIDENT in df.columns else keys
    rest = [c for c in df.columns if c not in keys and c not in order]
    fields = list(order) + rest
    best = F.min(F.struct(*[F.col(c) for c in fields])).alias("__best")
    agg = df.groupBy(*keys).agg(best)
    return agg.select(*[F.col(k) for k in keys], *[F.col("__best")[c].alias(c) for c in fields]).select(*df.columns)


def dedup_vehicles(df: DataFrame) -> DataFrame:
    return dedup_keep_first(df, VEHICLE_KEY)


def dedup_casualties(df: DataFrame) -> DataFrame:
    return dedup_keep_first(df, CASUALTY_KEY)


def dedup_collisions(df: DataFrame) -> DataFrame:
    """Keeps the earliest copy (the SQL comment's intent)."""
    return dedup_keep_first(df, COLLISION_KEY)


def median_impute(df: DataFrame, cols: Sequence[str], sentinel=-1) -> DataFrame:
    """C14: ``sentinel`` -> NULL -> exact column median.

    The medians are one row (exact, from counted values) appended to every row by a
    one-row broadcast.
    """
    cleaned = df.select(*[
        (F.when(F.col(c) == F.lit(sentinel), F.lit(None)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c))
        for c in df.columns
    ])
    from crashlens.operators.quantiles import quantile_columns
    meds = quantile_columns(cleaned, cols, [0.5]).select(
        *[F.col(f"q{i}")[0].alias(f"__med_{c}") for i, c in enumerate(cols)])
    joined = attach_one_row(cleaned, meds)
    return joined.select(*[
        (F.coalesce(F.col(c).cast("double"), F.col(f"__med_{c}")).alias(c) if c in cols else F.col(c))
        for c in df.columns
    ])


def parse_datetime(df: DataFrame, date_col: str = "raw_date", time_col: str = "raw_time",
                   date_format: str = "dd/MM/yyyy", out: str = "datetime") -> DataFrame:
    """Date + time strings -> timestamp without zone; unparseable rows are
    dropped.  Dates and minutes are parsed apart, so no session zone shifts them."""
    day = F.try_to_date(F.col(date_col), date_format).cast("timestamp_ntz")
    ts = day + F.make_dt_interval(F.lit(0), F.lit(0), tod_minutes(time_col))
    return df.withColumn(out, ts).filter(F.col(out).isNotNull())


def encode_target(df: DataFrame, target: str = "casualty_severity", out: str = "label") -> DataFrame:
    """Keep severities 1..3 and encode them 0..2."""
    return df.filter(F.col(target).isin(1, 2, 3)).withColumn(out, (F.col(target) - 1).cast("int"))
