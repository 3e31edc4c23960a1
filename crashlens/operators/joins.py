"""Joins (J1-J5, C11).

All joins are equi-joins on ``collision_index`` (plus ``vehicle_reference``):
Catalyst picks broadcast when a side is small and a sort-merge join otherwise;
left joins are written so that AQE can split skewed keys of either side.  Child tables are deduplicated on their keys
before joining, so the result grows with the inputs, not with duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.functions import codes
from crashlens.operators.cleaning import ACCIDENT

VEHICLE_COLS = ("vehicle_id", "vehicle_reference", "vehicle_type", "vehicle_manoeuvre", "sex_of_driver",
                "age_of_driver", "age_band_of_driver", "driver_imd_decile")
CASUALTY_COLS = ("casualty_id", "casualty_reference", "casualty_severity", "age_of_casualty", "sex_of_casualty")


def _equal(left: DataFrame, right: DataFrame, keys: Sequence[str], renamed: dict[str, str], null_safe: bool) -> Column:
    cond = F.lit(True)
    for k in keys:
        a, b = left[k], right[renamed[k]]
        cond = cond & (a.eqNullSafe(b) if null_safe else a == b)
    return cond


def split_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """``left`` ⟕ ``right`` for any key distribution: the inner join, plus the
    ``left`` rows without a partner padded with NULLs.

    AQE cannot split a skewed right side of a left outer join, but it splits
    both sides of an inner join, so a key with a third of the ``right`` rows is
    spread over many tasks.  The partnerless rows come from an anti-join
    against the distinct keys (reduced map-side).  Both parts read the same
    shuffle of ``left``.  No key is looked up in advance and nothing depends on
    a size.  Column names other than ``keys`` must differ.
    """
    keys = list(keys)
    renamed = {k: f"__right_{k}" for k in keys}
    others = [c for c in right.columns if c not in keys]
    r = right.withColumnsRenamed(renamed)
    matched = left.join(r, _equal(left, r, keys, renamed, null_safe), "inner").select(*left.columns, *others)
    present = r.select(*renamed.values()).distinct()
    alone = left.join(present, _equal(left, present, keys, renamed, null_safe), "left_anti")
    pad = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in others]
    return matched.unionByName(alone.select(*left.columns, *pad))


def dealt_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` ⟕ ``right`` on ``keys`` (``collision_index`` among them), null-safely, both dealt by
    accident (``cleaning.by_accident``): every accident is joined where its rows are, without
    an exchange, and ``left`` is read once.  Column names other than ``keys`` must differ."""
    keys = list(keys)
    renamed = {k: f"__right_{k}" for k in [ACCIDENT, *keys]}
    others = [c for c in right.columns if c not in renamed]
    r = right.withColumnsRenamed(renamed)
    # equal accidents differ at most in NULL against ''
    cond = (left[ACCIDENT] == r[renamed[ACCIDENT]]) & (left["collision_index"].isNull() == r[renamed["collision_index"]].isNull())
    cond = cond & _equal(left, r, [k for k in keys if k != "collision_index"], renamed, True)
    return left.join(r, cond, "left").select(*left.columns, *others)


def full_accident_data(features: DataFrame, vehicle: DataFrame, casualty: DataFrame) -> DataFrame:
    """Collision ⟕ vehicle ⟕ casualty (casualties are reached through
    their vehicle, as in the view) with vehicle and casualty labels."""
    v = vehicle.select("collision_index", *VEHICLE_COLS)
    cas = casualty.select("collision_index", "vehicle_reference", *CASUALTY_COLS)
    j = split_left_join(split_left_join(features, v, ["collision_index"]), cas, ["collision_index", "vehicle_reference"])
    return j.select(*features.columns, *VEHICLE_COLS,
                    codes.decode_domain(F.col("vehicle_type"), "vehicle_type").alias("vehicle_type_label"),
                    *CASUALTY_COLS,
                    codes.decode_domain(F.col("casualty_severity"), "severity").alias("casualty_severity_label"))


def merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
          indicator: str | None = None, suffixes=("_x", "_y")) -> DataFrame:
    """pandas-style ``merge`` (left or inner): shared non-key columns get
    suffixes, keys are matched null-safely (pandas matches missing keys),
    optional indicator column 'both' / 'left_only'.  Sides that are dealt by accident are
    joined where they are, and so is the result."""
    if how not in ("left", "inner"):
        raise ValueError(f"unknown merge: {how}")
    on = list(on)
    dealt = "collision_index" in on and ACCIDENT in left.columns and ACCIDENT in right.columns
    overlap = (set(left.columns) & set(right.columns)) - set(on) - ({ACCIDENT} if dealt else set())
    marker = "__right_present"
    lt = left.withColumnsRenamed({c: c + suffixes[0] for c in overlap})
    rt = right.withColumnsRenamed({c: c + suffixes[1] for c in overlap}).withColumn(marker, F.lit(True))
    j = dealt_left_join(lt, rt, on) if dealt else split_left_join(lt, rt, on, null_safe=True)
    if how == "inner":
        j = j.filter(F.col(marker))
    if indicator:
        j = j.withColumn(indicator, F.when(F.col(marker), "both").otherwise("left_only"))
    return j.drop(marker)


def resolve_merge_columns(df: DataFrame) -> DataFrame:
    """C11: drop ``*_y`` when ``*_x`` exists; keep the first of duplicate names."""
    names = df.columns
    xs = {c[:-2] for c in names if c.endswith("_x")}
    keep, seen = [], set()
    for i, c in enumerate(names):
        if c.endswith("_y") and c[:-2] in xs:
            continue
        if c in seen:
            continue
        seen.add(c)
        keep.append(F.col(f"`{c}`") if names.count(c) == 1 else df[i])
    return df.select(*keep)


def merge_with_indicator(collision: DataFrame, vehicle: DataFrame, casualty: DataFrame) -> DataFrame:
    """The notebook's two left merges with provenance indicators."""
    m = merge(collision, vehicle, ["collision_index"], "left", "merge_vehicle")
    return merge(m, casualty, ["collision_index", "vehicle_reference"], "left", "merge_casualty")


def casualty_training_rows(casualty: DataFrame, collision: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Casualty grain: casualty ⟕ collision ⟕ vehicle (the loader's merge)."""
    m = merge(casualty, collision, ["collision_index"], "left")
    return merge(m, vehicle, ["collision_index", "vehicle_reference"], "left")


def semi(child: DataFrame, parent: DataFrame, keys: Sequence[str] = ("collision_index",)) -> DataFrame:
    """Rows of ``child`` whose key exists in ``parent`` (J5 keep side)."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_semi")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str] = ("collision_index",)) -> DataFrame:
    """Rows of ``child`` without a parent (J5 delete side / FK check)."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")
