"""Code -> label domains.

Decoding is a ``CASE`` built from a small literal dict (a handful of codes
per domain), so it stays inside whole-stage codegen; no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Labels of the DfT code domains as used by the SQL views
# (unmapped codes fall to the per-domain ELSE label; None means NULL).
# ---------------------------------------------------------------------------
SEVERITY = {1: "Fatal", 2: "Serious", 3: "Slight"}
WEATHER = {1: "Fine (no wind)", 2: "Rain (no wind)", 3: "Snow (no wind)", 4: "Fine (wind)",
           5: "Rain (wind)", 6: "Snow (wind)", 7: "Fog/mist", 8: "Other"}
LIGHT = {1: "Daylight", 4: "Dark-lit", 5: "Dark-unlit", 6: "Dark-no lighting", 7: "Lighting unknown"}
SURFACE = {1: "Dry", 2: "Wet/Damp", 3: "Snow", 4: "Frost/Ice", 5: "Flood", 6: "Oil", 7: "Mud"}
ROAD_TYPE = {1: "Roundabout", 2: "One-way", 3: "Dual carriageway", 6: "Single carriageway", 7: "Slip Road"}
AREA = {1: "Urban", 2: "Rural"}
VEHICLE_TYPE = {1: "Motorcycle <=50cc", 2: "Motorcycle <=125cc", 3: "Motorcycle <=500cc",
                4: "Motorcycle >500cc", 5: "Taxi", 8: "Minibus", 9: "Bus/Coach", 19: "Pedal cycle"}

# (domain, mapping, else label) of the SQL views.
SQL_DOMAINS = {
    "severity": (SEVERITY, None),
    "weather": (WEATHER, "Unknown"),
    "light": (LIGHT, "Unknown"),
    "surface": (SURFACE, "Unknown"),
    "road_type": (ROAD_TYPE, "Unknown"),
    "area": (AREA, "Unknown"),
    "vehicle_type": (VEHICLE_TYPE, "Other"),
}

# ---------------------------------------------------------------------------
# Notebook label maps (no ELSE: unmapped codes give NULL).
# ---------------------------------------------------------------------------
NOTEBOOK_LABELS = {
    "casualty_severity": {1: "Fatal", 2: "Serious", 3: "Slight"},
    "urban_or_rural_area": {1: "Urban", 2: "Rural"},
    "road_surface_conditions": {1: "Dry", 2: "Wet/Damp", 3: "Snow", 4: "Frost/Ice", 5: "Flood", 6: "Oil",
                                7: "Mud", 9: "Unknown"},
    "light_conditions": {1: "Daylight", 4: "Dark-lit", 5: "Dark-unlit", 6: "Dark-no lighting",
                         7: "Lighting unknown"},
    "weather_conditions": {1: "Fine (no wind)", 2: "Rain (no wind)", 3: "Snow (no wind)", 4: "Fine (wind)",
                           5: "Rain (wind)", 6: "Snow (wind)", 7: "Fog/mist", 8: "Other", 9: "Unknown"},
    "junction_detail": {0: "Not at or within 20m", 13: "T or staggered", 16: "Crossroads", 17: ">4 arms",
                        18: "Private entrance", 19: "Other junction", 99: "Unknown"},
    "junction_control": {1: "Authorised person", 2: "Auto signal", 3: "Stop sign", 4: "Give way/uncontrolled",
                         9: "Unknown"},
    "road_type": {1: "Roundabout", 2: "One-way", 3: "Dual carriageway", 6: "Single carriageway",
                  7: "Slip Road", 9: "Unknown"},
    "vehicle_type": {1: "Motorcycle <=50cc", 2: "Motorcycle <=125cc", 3: "Motorcycle <=500cc",
                     4: "Motorcycle >500cc", 5: "Taxi", 8: "Minibus", 9: "Bus/Coach", 10: "Tram",
                     11: "Van <=3.5t", 14: "Goods 3.5-7.5t", 16: "Goods >7.5t", 17: "Mobility scooter",
                     18: "Electric motorcycle", 19: "Pedal cycle", 20: "Other", 21: "Ridden horse",
                     97: "MC unknown cc", 98: "Goods unknown weight", 99: "Unknown"},
    "vehicle_manoeuvre": {1: "Reversing", 2: "Parked", 3: "Held up", 4: "Slowing/stopping", 5: "Moving off",
                          6: "U-turn", 7: "Turning left", 8: "Waiting to turn left", 9: "Turning right",
                          10: "Waiting to turn right", 11: "Changing lane left", 12: "Changing lane right",
                          13: "Overtaking nearside", 14: "Overtaking offside", 15: "Ahead left bend",
                          16: "Ahead right bend", 17: "Going ahead other", 99: "Unknown"},
}

# Condition groups used by risk flags.
DARK_LIGHT = (4, 5, 6)
ADVERSE_WEATHER = (2, 3, 5, 6, 7)
POOR_SURFACE = (2, 3, 4)
HIGH_SPEED = 60


def decode(col: Column | str, mapping: dict, else_label: str | None = None) -> Column:
    """``CASE col WHEN code THEN label ... ELSE else_label END`` as a lookup in a
    literal map: NULL or unmapped codes give ``else_label``.  The map is a
    constant, so each decode compiles to one small lookup instead of a branch
    per code (keeps wide projections' generated methods small enough to JIT)."""
    c = F.col(col) if isinstance(col, str) else col
    if all(isinstance(k, (int, float)) for k in mapping):
        # numeric codes compare as double on both sides (exact for integer codes;
        # a non-integer value matches no code, as with ``=``)
        c, keys = c.cast("double"), [F.lit(float(k)) for k in mapping]
    else:
        keys = [F.lit(k) for k in mapping]
    m = F.create_map(*[x for k, v in zip(keys, mapping.values()) for x in (k, F.lit(v))])
    hit = m[c]
    return hit if else_label is None else F.coalesce(hit, F.lit(else_label))


def decode_domain(col: Column | str, domain: str) -> Column:
    mapping, else_label = SQL_DOMAINS[domain]
    return decode(col, mapping, else_label)
