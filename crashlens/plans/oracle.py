"""Oracle SQL (DuckDB) for the registered queries.

Written from the reference's SQL scripts and notebook steps, not from the
DataFrame code.  Each statement is ``WITH <prelude> <query>``; the prelude
maps the driver tables to the domain tables (same text as the Spark side)
and builds the cleaned tables and views the queries read.
"""

from __future__ import annotations

from crashlens.plans import oracle_labels
from crashlens.sources import fixtures


def _case(col: str, mapping: dict, else_label: str | None) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    tail = f" ELSE '{else_label}'" if else_label is not None else ""
    return f"CASE {col} {whens}{tail} END"


VEHICLE_ORDER = ("created_at", "vehicle_id", "vehicle_type", "vehicle_manoeuvre", "vehicle_location",
                 "sex_of_driver", "age_of_driver", "age_band_of_driver", "driver_imd_decile",
                 "driver_home_area_type")
CASUALTY_ORDER = ("created_at", "casualty_id", "casualty_class", "casualty_severity", "sex_of_casualty",
                  "age_of_casualty", "age_band_of_casualty", "casualty_type", "pedestrian_location",
                  "pedestrian_movement", "casualty_imd_decile")
COLLISION_ORDER = ("created_at", "collision_reference", "date_of_accident", "time_of_accident", "raw_date",
                   "raw_time", "longitude", "latitude", "local_authority_district", "first_road_class",
                   "first_road_number", "road_type", "weather_conditions", "light_conditions",
                   "road_surface_conditions", "urban_or_rural_area", "junction_detail", "junction_control",
                   "collision_severity", "number_of_vehicles", "number_of_casualties", "speed_limit",
                   "police_force", "did_police_officer_attend", "updated_at")


def _dedup(src: str, keys: str, order) -> str:
    ob = ", ".join(f"{c} ASC NULLS FIRST" for c in order)
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {ob}) AS rn "
            f"FROM {src}) t WHERE rn = 1")


def _features(period_night: str) -> str:
    hour = "CAST(EXTRACT(HOUR FROM CAST(time_of_accident AS TIME)) AS INTEGER)"
    minute = "EXTRACT(MINUTE FROM CAST(time_of_accident AS TIME))"
    dow = "CAST(EXTRACT(DOW FROM date_of_accident) AS INTEGER)"
    return f"""SELECT c.*,
      {hour} AS hour_of_day,
      {dow} AS day_of_week,
      CAST(EXTRACT(MONTH FROM date_of_accident) AS INTEGER) AS month,
      CAST(EXTRACT(YEAR FROM date_of_accident) AS INTEGER) AS year,
      dayname(date_of_accident) AS day_name,
      monthname(date_of_accident) AS month_name,
      CAST({hour} * 4 + FLOOR({minute} / 15) AS INTEGER) AS time_slot_15min,
      CASE WHEN {hour} BETWEEN 7 AND 9 THEN 'Morning Rush'
           WHEN {hour} BETWEEN 15 AND 18 THEN 'Evening Rush'
           WHEN {period_night.format(h=hour)} THEN 'Night'
           ELSE 'Off-Peak' END AS time_period,
      CASE WHEN {dow} IN (0, 6) THEN TRUE ELSE FALSE END AS is_weekend,
      {_case('collision_severity', oracle_labels.DOMAINS["severity"], None)} AS severity_label,
      {_case('weather_conditions', oracle_labels.DOMAINS["weather"], 'Unknown')} AS weather_label,
      {_case('light_conditions', oracle_labels.DOMAINS["light"], 'Unknown')} AS light_label,
      {_case('road_surface_conditions', oracle_labels.DOMAINS["surface"], 'Unknown')} AS road_surface_label,
      {_case('road_type', oracle_labels.DOMAINS["road_type"], 'Unknown')} AS road_type_label,
      {_case('urban_or_rural_area', oracle_labels.DOMAINS["area"], 'Unknown')} AS area_type_label
    FROM collision c"""


def _nb_table(src: str, strings, numerics, name: str) -> str:
    cols = [f"trim(CAST({c} AS VARCHAR)) AS {c}" if c in ("collision_index", "vehicle_reference",
                                                          "casualty_reference") else c for c in strings]
    cols += [f"CASE WHEN {c} = -1 THEN NULL ELSE {c} END AS {c}" for c in numerics]
    cols.append("created_at")
    return f"SELECT *, '{name}' AS source_table FROM (SELECT DISTINCT {', '.join(cols)} FROM {src}) d"


NB_COL_STR = ("collision_index", "raw_date", "raw_time")
NB_COL_NUM = ("weather_conditions", "light_conditions", "road_surface_conditions", "road_type",
              "urban_or_rural_area", "junction_detail", "junction_control", "speed_limit", "collision_severity",
              "number_of_vehicles", "number_of_casualties", "police_force")
NB_VEH_STR = ("collision_index", "vehicle_reference")
NB_VEH_NUM = ("vehicle_type", "vehicle_manoeuvre", "sex_of_driver", "age_of_driver", "driver_imd_decile")
NB_CAS_STR = ("collision_index", "vehicle_reference", "casualty_reference")
NB_CAS_NUM = ("casualty_class", "casualty_severity", "sex_of_casualty", "age_of_casualty", "casualty_type",
              "pedestrian_location")

NB_MERGED_NUM = NB_COL_NUM + NB_VEH_NUM + NB_CAS_NUM
NB_MERGED_STR = ("collision_index", "raw_date", "raw_time", "source_table_x", "vehicle_reference",
                 "source_table_y", "merge_vehicle", "casualty_reference", "source_table", "merge_casualty")


def _nb_merged() -> str:
    ccols = ", ".join(f"c.{x}" for x in NB_COL_STR[1:] + NB_COL_NUM)
    vcols = ", ".join(f"v.{x}" for x in NB_VEH_NUM)
    kcols = ", ".join(f"k.{x}" for x in NB_CAS_NUM)
    return f"""
    nb_merged1 AS (
      SELECT c.collision_index, {ccols}, c.created_at AS created_at_x, c.source_table AS source_table_x,
             v.vehicle_reference, {vcols}, v.created_at AS created_at_y, v.source_table AS source_table_y,
             CASE WHEN v.__p THEN 'both' ELSE 'left_only' END AS merge_vehicle
      FROM nb_collision c
      LEFT JOIN (SELECT *, TRUE AS __p FROM nb_vehicle) v ON c.collision_index IS NOT DISTINCT FROM v.collision_index),
    nb_merged AS (
      SELECT m.*, k.casualty_reference, {kcols}, k.created_at, k.source_table,
             CASE WHEN k.__p THEN 'both' ELSE 'left_only' END AS merge_casualty
      FROM nb_merged1 m
      LEFT JOIN (SELECT *, TRUE AS __p FROM nb_casualty) k
        ON m.collision_index IS NOT DISTINCT FROM k.collision_index
       AND m.vehicle_reference IS NOT DISTINCT FROM k.vehicle_reference)"""


def _nb_global() -> str:
    nums = ", ".join(f"CASE WHEN {c} IN (-1, 99) THEN NULL ELSE {c} END AS {c}" for c in NB_MERGED_NUM)
    strs = ", ".join(f"CASE WHEN {c} IN ('Unknown', 'unknown', 'Not known', 'Unknown (self reported only)') "
                     f"THEN NULL ELSE {c} END AS {c}" for c in NB_MERGED_STR)
    return f"SELECT * REPLACE ({nums}, {strs}) FROM nb_merged"


def _nb_full() -> str:
    labels = ", ".join(f"{_case(f'CAST({c} AS DOUBLE)', m, None)} AS {c}_label"
                       for c, m in oracle_labels.NOTEBOOK.items())
    return f"""
    nb_clean AS ({_nb_global()}),
    nb_dt AS (
      SELECT * EXCLUDE (created_at_y, source_table_y),
             try_strptime(raw_date || ' ' || raw_time, '%d/%m/%Y %H:%M') AS datetime
      FROM nb_clean),
    nb_full AS (
      SELECT *, CAST(EXTRACT(HOUR FROM datetime) AS INTEGER) AS hour, dayname(datetime) AS day,
             CAST(EXTRACT(MONTH FROM datetime) AS INTEGER) AS month,
             CAST(EXTRACT(HOUR FROM datetime) * 4 + FLOOR(EXTRACT(MINUTE FROM datetime) / 15) AS INTEGER)
               AS time_slot_15min,
             {labels}
      FROM nb_dt WHERE datetime IS NOT NULL)"""


def _prelude() -> str:
    vc = ", ".join(f"CASE WHEN {c} IN ({', '.join(map(str, v))}) THEN NULL ELSE {c} END AS {c}"
                   for c, v in {"vehicle_type": (99,), "vehicle_manoeuvre": (99,), "age_of_driver": (-1,),
                                "sex_of_driver": (-1,), "driver_imd_decile": (-1,)}.items())
    cc = ", ".join(f"CASE WHEN {c} = -1 THEN NULL ELSE {c} END AS {c}"
                   for c in ("age_of_casualty", "sex_of_casualty", "casualty_imd_decile", "pedestrian_location"))
    veh_label = _case("v.vehicle_type", oracle_labels.DOMAINS["vehicle_type"], "Other")
    cas_label = _case("cas.casualty_severity", oracle_labels.DOMAINS["severity"], None)
    return f"""WITH {fixtures.oracle_ctes()},
    collision AS (
      SELECT * REPLACE (
        CASE WHEN longitude = -1 THEN NULL ELSE longitude END AS longitude,
        CASE WHEN latitude = -1 THEN NULL ELSE latitude END AS latitude,
        CASE WHEN weather_conditions IN (-1, 99) THEN NULL ELSE weather_conditions END AS weather_conditions,
        CASE WHEN light_conditions IN (-1, 99) THEN NULL ELSE light_conditions END AS light_conditions,
        CASE WHEN road_surface_conditions IN (-1, 99) THEN NULL ELSE road_surface_conditions END
          AS road_surface_conditions,
        CASE WHEN junction_detail = 99 THEN NULL ELSE junction_detail END AS junction_detail,
        CASE WHEN junction_control = 9 THEN NULL ELSE junction_control END AS junction_control,
        CASE WHEN road_type = 9 THEN NULL ELSE road_type END AS road_type,
        CASE WHEN speed_limit = -1 THEN NULL ELSE speed_limit END AS speed_limit)
      FROM raw_collision),
    vehicle_clean AS (SELECT * REPLACE ({vc}) FROM raw_vehicle),
    vehicle AS ({_dedup('vehicle_clean', 'collision_index, vehicle_reference', VEHICLE_ORDER)}),
    casualty_clean AS (SELECT * REPLACE ({cc}) FROM raw_casualty),
    casualty AS ({_dedup('casualty_clean', 'collision_index, vehicle_reference, casualty_reference',
                         CASUALTY_ORDER)}),
    collision_with_features AS ({_features('{h} BETWEEN 22 AND 6')}),
    collision_with_features_wrap AS ({_features('({h} >= 22 OR {h} <= 6)')}),
    full_accident_data AS (
      SELECT c.*, v.vehicle_id, v.vehicle_reference, v.vehicle_type, v.vehicle_manoeuvre, v.sex_of_driver,
             v.age_of_driver, v.age_band_of_driver, v.driver_imd_decile, {veh_label} AS vehicle_type_label,
             cas.casualty_id, cas.casualty_reference, cas.casualty_severity, cas.age_of_casualty,
             cas.sex_of_casualty, {cas_label} AS casualty_severity_label
      FROM collision_with_features c
      LEFT JOIN vehicle v ON c.collision_index = v.collision_index
      LEFT JOIN casualty cas ON c.collision_index = cas.collision_index
        AND v.vehicle_reference = cas.vehicle_reference),
    nb_collision AS ({_nb_table('raw_collision', NB_COL_STR, NB_COL_NUM, 'collision')}),
    nb_vehicle AS ({_nb_table('raw_vehicle', NB_VEH_STR, NB_VEH_NUM, 'vehicle')}),
    nb_casualty AS ({_nb_table('raw_casualty', NB_CAS_STR, NB_CAS_NUM, 'casualty')}),
    {_nb_merged()},
    {_nb_full()},
    loader_collision AS (SELECT *, CAST(EXTRACT(DOW FROM date_of_accident) AS INTEGER) AS day_of_week
                         FROM raw_collision),
    loader_vehicle AS ({_dedup('raw_vehicle', 'collision_index, vehicle_reference', VEHICLE_ORDER)}),
    loader_casualty AS ({_dedup('raw_casualty', 'collision_index, vehicle_reference, casualty_reference',
                                CASUALTY_ORDER)}),
    training_rows AS (
      SELECT k.*, c.number_of_vehicles, c.number_of_casualties, c.day_of_week, c.road_type, c.speed_limit,
             c.light_conditions, c.weather_conditions, c.road_surface_conditions,
             v.vehicle_type, v.vehicle_manoeuvre, v.sex_of_driver, v.age_of_driver
      FROM loader_casualty k
      LEFT JOIN loader_collision c ON k.collision_index = c.collision_index
      LEFT JOIN loader_vehicle v ON k.collision_index = v.collision_index
        AND k.vehicle_reference = v.vehicle_reference)
    """


PRELUDE = _prelude()
