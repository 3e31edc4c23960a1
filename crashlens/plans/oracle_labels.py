"""Label domains of the oracle, stated apart from the engine's own maps, so that a
wrong label on either side shows as a difference."""

# Code and label, one per line, of the published label lists.
_LABELS = """
severity
1 Fatal
2 Serious
3 Slight

area
1 Urban
2 Rural

weather
1 Fine (no wind)
2 Rain (no wind)
3 Snow (no wind)
4 Fine (wind)
5 Rain (wind)
6 Snow (wind)
7 Fog/mist
8 Other

light
1 Daylight
4 Dark-lit
5 Dark-unlit
6 Dark-no lighting
7 Lighting unknown

surface
1 Dry
2 Wet/Damp
3 Snow
4 Frost/Ice
5 Flood
6 Oil
7 Mud

road_type
1 Roundabout
2 One-way
3 Dual carriageway
6 Single carriageway
7 Slip Road

vehicle_type
1 Motorcycle <=50cc
2 Motorcycle <=125cc
3 Motorcycle <=500cc
4 Motorcycle >500cc
5 Taxi
8 Minibus
9 Bus/Coach
19 Pedal cycle

vehicle_type_more
10 Tram
11 Van <=3.5t
14 Goods 3.5-7.5t
16 Goods >7.5t
17 Mobility scooter
18 Electric motorcycle
20 Other
21 Ridden horse
97 MC unknown cc
98 Goods unknown weight
99 Unknown

junction_detail
0 Not at or within 20m
13 T or staggered
16 Crossroads
17 >4 arms
18 Private entrance
19 Other junction
99 Unknown

junction_control
1 Authorised person
2 Auto signal
3 Stop sign
4 Give way/uncontrolled
9 Unknown

vehicle_manoeuvre
1 Reversing
2 Parked
3 Held up
4 Slowing/stopping
5 Moving off
6 U-turn
7 Turning left
8 Waiting to turn left
9 Turning right
10 Waiting to turn right
11 Changing lane left
12 Changing lane right
13 Overtaking nearside
14 Overtaking offside
15 Ahead left bend
16 Ahead right bend
17 Going ahead other
99 Unknown
"""


def _domains(text: str) -> dict[str, dict[int, str]]:
    out: dict[str, dict[int, str]] = {}
    for block in text.strip().split("\n\n"):
        name, *rows = block.split("\n")
        out[name] = {int(code): label for code, label in (r.split(" ", 1) for r in rows)}
    return out


DOMAINS = _domains(_LABELS)
_UNKNOWN = {9: "Unknown"}

# column of the notebook -> its labels (codes without a label give NULL)
NOTEBOOK = {
    "casualty_severity": DOMAINS["severity"],
    "urban_or_rural_area": DOMAINS["area"],
    "road_surface_conditions": DOMAINS["surface"] | _UNKNOWN,
    "light_conditions": DOMAINS["light"],
    "weather_conditions": DOMAINS["weather"] | _UNKNOWN,
    "junction_detail": DOMAINS["junction_detail"],
    "junction_control": DOMAINS["junction_control"],
    "road_type": DOMAINS["road_type"] | _UNKNOWN,
    "vehicle_type": DOMAINS["vehicle_type"] | DOMAINS["vehicle_type_more"],
    "vehicle_manoeuvre": DOMAINS["vehicle_manoeuvre"],
}
