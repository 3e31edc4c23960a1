"""Declared schemas of the three domain tables (S2) with column comments.

CSV input is read with these schemas (no inference pass over the data).
"""

from __future__ import annotations

from pyspark.sql import types as T


def _f(name, dtype, nullable=True, comment=None):
    md = {"comment": comment} if comment else {}
    return T.StructField(name, dtype, nullable, md)


S, I, L, D, TS, B, DBL = (T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampNTZType(),
                          T.BooleanType(), T.DoubleType())

COLLISION = T.StructType([
    _f("collision_index", S, False, "primary key"), _f("collision_reference", S),
    _f("date_of_accident", D, False), _f("time_of_accident", S, False, "HH:mm"),
    _f("raw_date", S, comment="dd/MM/yyyy as in the source CSV"), _f("raw_time", S, comment="HH:mm as in the CSV"),
    _f("longitude", DBL, comment="-1 = missing"), _f("latitude", DBL, comment="-1 = missing"),
    _f("local_authority_district", S), _f("first_road_class", I), _f("first_road_number", I),
    _f("road_type", I, comment="9 = missing"), _f("weather_conditions", I, comment="-1/99 = missing"),
    _f("light_conditions", I, comment="-1/99 = missing"), _f("road_surface_conditions", I, comment="-1/99 = missing"),
    _f("urban_or_rural_area", I), _f("junction_detail", I, comment="99 = missing"),
    _f("junction_control", I, comment="9 = missing"), _f("collision_severity", I, comment="1 fatal, 2 serious, 3 slight"),
    _f("number_of_vehicles", I), _f("number_of_casualties", I), _f("speed_limit", I, comment="-1 = missing"),
    _f("police_force", I), _f("did_police_officer_attend", B), _f("created_at", TS), _f("updated_at", TS),
])

VEHICLE = T.StructType([
    _f("vehicle_id", L, False), _f("collision_index", S, False, "references collision"),
    _f("vehicle_reference", S, False), _f("vehicle_type", I, comment="99 = missing"),
    _f("vehicle_manoeuvre", I, comment="99 = missing"), _f("vehicle_location", I),
    _f("sex_of_driver", I, comment="-1 = missing"), _f("age_of_driver", I, comment="-1 = missing"),
    _f("age_band_of_driver", S), _f("driver_imd_decile", I, comment="-1 = missing"), _f("driver_home_area_type", I),
    _f("created_at", TS),
])

CASUALTY = T.StructType([
    _f("casualty_id", L, False), _f("collision_index", S, False, "references collision"),
    _f("vehicle_reference", S, False), _f("casualty_reference", S, False), _f("casualty_class", I),
    _f("casualty_severity", I), _f("sex_of_casualty", I, comment="-1 = missing"),
    _f("age_of_casualty", I, comment="-1 = missing"), _f("age_band_of_casualty", S), _f("casualty_type", I),
    _f("pedestrian_location", I, comment="-1 = missing"), _f("pedestrian_movement", I),
    _f("casualty_imd_decile", I, comment="-1 = missing"), _f("created_at", TS),
])

EVENTS = T.StructType([
    _f("event_id", L), _f("ts", TS), _f("user_id", L), _f("event_type", S), _f("value", DBL), _f("props", S),
])

KEYS = {"collision": ("collision_index",), "vehicle": ("collision_index", "vehicle_reference"),
        "casualty": ("collision_index", "vehicle_reference", "casualty_reference")}
