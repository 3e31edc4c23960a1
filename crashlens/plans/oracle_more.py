"""Oracle SQL bodies for profiling, EDA tables and series keys (DuckDB)."""

from __future__ import annotations

from crashlens.plans.oracle_queries import BODIES, rnd

# Column lists of the profiled relations (as produced by the pipelines).
COLLISION_COLS = ("collision_index", "collision_reference", "date_of_accident", "time_of_accident", "raw_date",
                  "raw_time", "longitude", "latitude", "local_authority_district", "first_road_class",
                  "first_road_number", "road_type", "weather_conditions", "light_conditions",
                  "road_surface_conditions", "urban_or_rural_area", "junction_detail", "junction_control",
                  "collision_severity", "number_of_vehicles", "number_of_casualties", "speed_limit", "police_force",
                  "did_police_officer_attend", "created_at", "updated_at")
RAW_COLLISION_NUMERIC = ("longitude", "latitude", "first_road_class", "first_road_number", "road_type",
                         "weather_conditions", "light_conditions", "road_surface_conditions", "urban_or_rural_area",
                         "junction_detail", "junction_control", "collision_severity", "number_of_vehicles",
                         "number_of_casualties", "speed_limit", "police_force")
NB_FULL_TYPES = {
    "collision_index": "object", "raw_date": "object", "raw_time": "object", "weather_conditions": "int",
    "light_conditions": "int", "road_surface_conditions": "int", "road_type": "int", "urban_or_rural_area": "int",
    "junction_detail": "int", "junction_control": "int", "speed_limit": "int", "collision_severity": "int",
    "number_of_vehicles": "int", "number_of_casualties": "int", "police_force": "int", "created_at_x": "datetime",
    "source_table_x": "object", "vehicle_reference": "object", "vehicle_type": "int", "vehicle_manoeuvre": "int",
    "sex_of_driver": "int", "age_of_driver": "int", "driver_imd_decile": "int", "merge_vehicle": "object",
    "casualty_reference": "object", "casualty_class": "int", "casualty_severity": "int", "sex_of_casualty": "int",
    "age_of_casualty": "int", "casualty_type": "int", "pedestrian_location": "int", "created_at": "datetime",
    "source_table": "object", "merge_casualty": "object", "datetime": "datetime", "hour": "int", "day": "object",
    "month": "int", "time_slot_15min": "int", "casualty_severity_label": "object",
    "urban_or_rural_area_label": "object", "road_surface_conditions_label": "object",
    "light_conditions_label": "object", "weather_conditions_label": "object", "junction_detail_label": "object",
    "junction_control_label": "object", "road_type_label": "object", "vehicle_type_label": "object",
    "vehicle_manoeuvre_label": "object"}
NB_NUMERIC_PROFILE = ("number_of_vehicles", "number_of_casualties", "speed_limit", "age_of_driver",
                      "age_of_casualty", "hour", "time_slot_15min")
CORR_COLS = ("hour_of_day", "day_of_week", "month", "time_slot_15min", "weather_conditions", "light_conditions",
             "road_surface_conditions", "speed_limit", "number_of_vehicles", "number_of_casualties")
CATEGORICAL = ("weather_conditions_label", "light_conditions_label", "road_surface_conditions_label",
               "road_type_label", "vehicle_type_label")


def union(parts):
    return "\nUNION ALL\n".join(parts)


# ---- profiling -----------------------------------------------------------------
BODIES["profile_missing_pct"] = union(
    f"SELECT '{c}' AS column_name, {rnd(f'CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100', 6)} AS missing_pct "
    f"FROM collision" for c in COLLISION_COLS)
BODIES["profile_minus1"] = union(
    f"SELECT '{c}' AS column_name, CAST(COALESCE(SUM(CASE WHEN {c} = -1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS minus1_count FROM raw_collision"
    for c in RAW_COLLISION_NUMERIC)
BODIES["profile_describe"] = union(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS count, {rnd(f'AVG(CAST({c} AS DOUBLE))', 6)} AS mean, "
    f"{rnd(f'STDDEV_SAMP(CAST({c} AS DOUBLE))', 6)} AS std, CAST(MIN({c}) AS DOUBLE) AS min, "
    f"{rnd(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25)', 6)} AS q25, "
    f"{rnd(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5)', 6)} AS q50, "
    f"{rnd(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75)', 6)} AS q75, CAST(MAX({c}) AS DOUBLE) AS max "
    f"FROM raw_collision" for c in RAW_COLLISION_NUMERIC)
RAW_COLLISION_TEXT = tuple(c for c in COLLISION_COLS if c not in RAW_COLLISION_NUMERIC)
_MEASURES = ("mean", "std", "min", "q25", "q50", "q75", "max")
BODIES["profile_describe_all"] = f""",
numbers AS ({BODIES["profile_describe"]})
SELECT column_name, count, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, {', '.join(_MEASURES)} FROM numbers
UNION ALL
""" + union(
    f"SELECT '{c}', COUNT({c}), COUNT(DISTINCT {c}), "
    f"(SELECT CAST({c} AS VARCHAR) FROM raw_collision WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) LIMIT 1), "
    f"(SELECT COUNT(*) FROM raw_collision WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC LIMIT 1), "
    f"{', '.join('CAST(NULL AS DOUBLE)' for _ in _MEASURES)} FROM raw_collision" for c in RAW_COLLISION_TEXT)
BODIES["constraint_violations"] = """,
whole_collision AS (SELECT * FROM raw_collision_dup WHERE collision_index IS NOT NULL AND date_of_accident IS NOT NULL AND time_of_accident IS NOT NULL),
parents AS (SELECT DISTINCT collision_index FROM whole_collision),
whole_vehicle AS (SELECT * FROM raw_vehicle WHERE vehicle_id IS NOT NULL AND collision_index IS NOT NULL AND vehicle_reference IS NOT NULL),
whole_casualty AS (SELECT * FROM raw_casualty WHERE casualty_id IS NOT NULL AND collision_index IS NOT NULL AND vehicle_reference IS NOT NULL
                   AND casualty_reference IS NOT NULL),
found AS (
""" + union(
    [f"SELECT '{t}' AS table_name, 'not_null:{c}' AS reason, COUNT(*) AS n FROM {src} WHERE {c} IS NULL"
     for t, src, cols in (("collision", "raw_collision_dup", ("collision_index", "date_of_accident", "time_of_accident")),
                          ("vehicle", "raw_vehicle", ("vehicle_id", "collision_index", "vehicle_reference")),
                          ("casualty", "raw_casualty", ("casualty_id", "collision_index", "vehicle_reference", "casualty_reference")))
     for c in cols]
    + [f"SELECT '{t}', 'references:collision', COUNT(*) FROM raw_{t} WHERE collision_index IS NOT NULL "
       f"AND collision_index NOT IN (SELECT collision_index FROM parents)" for t in ("vehicle", "casualty")]
    + ["SELECT 'collision', 'unique:collision_index', COUNT(*) - COUNT(DISTINCT collision_index) FROM whole_collision"]
    + [f"SELECT '{t}', 'unique:{','.join(keys)}', CAST(COALESCE(SUM(k - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS k FROM whole_{t} "
       f"WHERE collision_index IN (SELECT collision_index FROM parents) GROUP BY {', '.join(keys)})"
       for t, keys in (("vehicle", ("collision_index", "vehicle_reference")),
                       ("casualty", ("collision_index", "vehicle_reference", "casualty_reference")))]) + """)
SELECT * FROM found WHERE n > 0"""
BODIES["risk_score_incremental"] = BODIES["risk_score_batch"]
BODIES["feature_overview"] = union(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, COUNT(DISTINCT {c}) AS n_unique, "
    f"COUNT(*) - COUNT({c}) AS n_missing, {rnd(f'CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*)', 6)} AS missing_rate, "
    f"(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) < 0.2 AND COUNT(DISTINCT {c}) < 20) AS keep FROM nb_full"
    for c, t in NB_FULL_TYPES.items())
BODIES["duplicate_row_count"] = """
SELECT CAST((SELECT COUNT(*) FROM nb_full) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM nb_full) d) AS BIGINT)
  AS duplicate_rows"""
BODIES["iqr_outliers"] = union(
    f"SELECT '{c}' AS column_name, {rnd('q1', 6)} AS q1, {rnd('q3', 6)} AS q3, "
    f"CAST(COUNT_IF(CAST({c} AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR CAST({c} AS DOUBLE) > q3 + 1.5 * (q3 - q1)) AS BIGINT)"
    f" AS outlier_count FROM nb_full, (SELECT QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS q1, "
    f"QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS q3 FROM nb_full) q GROUP BY q1, q3" for c in NB_NUMERIC_PROFILE)
BODIES["merge_entity_counts"] = f"""
SELECT unique_accidents, vehicle_records, casualty_records,
       {rnd('CAST(vehicle_records AS DOUBLE) / unique_accidents', 6)} AS vehicles_per_accident,
       {rnd('CAST(casualty_records AS DOUBLE) / unique_accidents', 6)} AS casualties_per_accident
FROM (SELECT COUNT(DISTINCT collision_index) AS unique_accidents, COUNT(vehicle_reference) AS vehicle_records,
             COUNT(casualty_reference) AS casualty_records FROM nb_merged) t"""
_pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
BODIES["correlation_pairs"] = f""",
ml AS ({BODIES['ml_training_dataset']})
""" + union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {rnd(f'CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 6)}"
            f" AS corr FROM ml" for a, b in _pairs)

# ---- notebook EDA tables --------------------------------------------------------
BODIES["categorical_frequencies"] = union(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM nb_full WHERE {c} IS NOT NULL "
    f"GROUP BY 2" for c in CATEGORICAL + ("casualty_severity_label", "time_slot_15min", "hour"))
BODIES["severity_by_hour"] = """
SELECT hour, CAST(COUNT_IF(casualty_severity_label = 'Fatal') AS BIGINT) AS Fatal,
       CAST(COUNT_IF(casualty_severity_label = 'Serious') AS BIGINT) AS Serious,
       CAST(COUNT_IF(casualty_severity_label = 'Slight') AS BIGINT) AS Slight
FROM nb_full WHERE casualty_severity_label IS NOT NULL AND hour IS NOT NULL GROUP BY hour"""
BODIES["weekday_counts"] = """
SELECT c.weekday, c.position, n.n
FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'),
             (6, 'Sunday')) c(position, weekday)
LEFT JOIN (SELECT day AS weekday, COUNT(*) AS n FROM nb_full GROUP BY day) n ON c.weekday = n.weekday"""
BODIES["month_counts"] = """
SELECT c.month_name, c.position, n.n
FROM (VALUES (0, 'Jan'), (1, 'Feb'), (2, 'Mar'), (3, 'Apr'), (4, 'May'), (5, 'Jun')) c(position, month_name)
LEFT JOIN (SELECT CASE month WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr'
                             WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' END AS month_name, COUNT(*) AS n
           FROM nb_full WHERE month BETWEEN 1 AND 6 GROUP BY 1) n ON c.month_name = n.month_name"""
BODIES["severity_by_category"] = union(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, casualty_severity_label AS severity, COUNT(*) AS n "
    f"FROM nb_full WHERE {c} IS NOT NULL AND casualty_severity_label IS NOT NULL GROUP BY 2, 3" for c in CATEGORICAL)
BODIES["histogram_casualties"] = f""",
hv AS (SELECT CAST(number_of_casualties AS DOUBLE) AS x FROM nb_full WHERE number_of_casualties IS NOT NULL),
hb AS (SELECT x, lo, hi, CAST(CASE WHEN (hi - lo) / 30 = 0 THEN 0 ELSE LEAST(FLOOR((x - lo) / ((hi - lo) / 30)), 29) END
                              AS INTEGER) AS bin
       FROM hv, (SELECT MIN(x) AS lo, MAX(x) AS hi FROM hv) m)
SELECT bin, {rnd('MIN(lo) + bin * (MIN(hi) - MIN(lo)) / 30', 6)} AS bin_start, COUNT(*) AS n FROM hb GROUP BY bin"""


def _box(c: str, grouped: bool) -> str:
    g = "casualty_severity_label" if grouped else "'ALL'"
    cond = "AND casualty_severity_label IS NOT NULL" if grouped else ""
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT s.grp AS group_value, '{c}' AS feature, {rnd('MIN(q1)', 6)} AS q1, {rnd('MIN(q2)', 6)} AS median,
       {rnd('MIN(q3)', 6)} AS q3,
       MIN(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_low,
       MAX(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
       CAST(COUNT_IF(NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outliers
FROM (SELECT {g} AS grp, {x} AS x FROM nb_full WHERE {c} IS NOT NULL {cond}) s
JOIN (SELECT {g} AS grp, QUANTILE_CONT({x}, 0.25) AS q1, QUANTILE_CONT({x}, 0.5) AS q2,
             QUANTILE_CONT({x}, 0.75) AS q3 FROM nb_full WHERE {c} IS NOT NULL {cond} GROUP BY 1) q
  ON s.grp = q.grp
GROUP BY s.grp"""


BODIES["boxplot_by_severity"] = union(_box(c, g) for g in (True, False)
                                      for c in ("number_of_vehicles", "number_of_casualties"))

# ---- series ---------------------------------------------------------------------
SERIES = """,
ev AS (SELECT event_type AS series_key, date_trunc('hour', ts) AS ts FROM events
       UNION ALL SELECT 'ALL', date_trunc('hour', ts) FROM events),
hc AS (SELECT series_key, ts, COUNT(*) AS y FROM ev WHERE ts IS NOT NULL GROUP BY 1, 2),
hb AS (SELECT series_key, MIN(ts) AS lo, MAX(ts) AS hi FROM hc GROUP BY 1),
hourly AS (SELECT g.series_key, g.ts, CAST(COALESCE(c.y, 0) AS BIGINT) AS y
           FROM (SELECT series_key, UNNEST(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM hb) g
           LEFT JOIN hc c ON g.series_key = c.series_key AND g.ts = c.ts),
dd AS (SELECT 'ALL' AS series_key, CAST(CAST(try_strptime(raw_date, '%d/%m/%Y') AS DATE) AS TIMESTAMP) AS ts
       FROM collision),
dc AS (SELECT series_key, ts, COUNT(*) AS y FROM dd WHERE ts IS NOT NULL GROUP BY 1, 2),
db AS (SELECT series_key, MIN(ts) AS lo, MAX(ts) AS hi FROM dc GROUP BY 1),
daily AS (SELECT g.series_key, g.ts, CAST(COALESCE(c.y, 0) AS BIGINT) AS y
          FROM (SELECT series_key, UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM db) g
          LEFT JOIN dc c ON g.series_key = c.series_key AND g.ts = c.ts)
"""


def _metrics(src: str) -> str:
    e = "(CAST(y AS DOUBLE) - yhat)"
    return (f"SELECT series_key, model, COUNT(*) AS n, {rnd(f'AVG(ABS({e}))', 6)} AS mae, "
            f"{rnd(f'SQRT(AVG({e} * {e}))', 6)} AS rmse, "
            f"{rnd(f'AVG(ABS({e} / (CAST(y AS DOUBLE) + 1))) * 100', 6)} AS mape "
            f"FROM {src} WHERE yhat IS NOT NULL AND y IS NOT NULL GROUP BY series_key, model")


BODIES["hourly_series"] = SERIES + "SELECT * FROM hourly"
BODIES["daily_series"] = SERIES + "SELECT * FROM daily"
BODIES["hourly_profile"] = SERIES + """
SELECT series_key, CAST(EXTRACT(HOUR FROM ts) AS INTEGER) AS hour, AVG(y) AS avg_value FROM hourly GROUP BY 1, 2"""
BODIES["peak_hours_top3"] = SERIES + """
SELECT series_key, CAST(EXTRACT(HOUR FROM ts) AS INTEGER) AS hour, AVG(y) AS avg_value FROM hourly
WHERE series_key = 'ALL' GROUP BY 1, 2 ORDER BY avg_value DESC, hour LIMIT 3"""
_summary = """SELECT series_key, '{f}' AS frequency, COUNT(*) AS length, MIN(ts) AS start_ts, MAX(ts) AS end_ts,
       arg_min(y, ts) AS first_value, arg_max(y, ts) AS last_value, AVG(y) AS mean_value, MAX(y) AS max_value,
       MIN(y) AS min_value FROM {t} GROUP BY series_key"""
BODIES["series_summary"] = SERIES + _summary.format(f="hourly", t="hourly") + "\nUNION ALL\n" + _summary.format(
    f="daily", t="daily")
BODIES["daily_trend_rolling"] = """
SELECT date_of_accident, daily_accidents, avg_daily_casualties,
       AVG(daily_accidents) OVER (ORDER BY date_of_accident ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
         AS rolling_7day_avg,
       MAX(daily_accidents) OVER (ORDER BY date_of_accident ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
         AS rolling_7day_max,
       LAG(daily_accidents, 30) OVER (ORDER BY date_of_accident) AS accidents_30days_ago,
       daily_accidents - LAG(daily_accidents, 30) OVER (ORDER BY date_of_accident) AS month_change
FROM (SELECT date_of_accident, COUNT(*) AS daily_accidents, AVG(number_of_casualties) AS avg_daily_casualties
      FROM collision GROUP BY date_of_accident) d"""
BODIES["daily_trend_calendar"] = """
SELECT d.date_of_accident, d.daily_accidents, d.avg_daily_casualties,
       AVG(d.daily_accidents) OVER w AS rolling_7day_avg, MAX(d.daily_accidents) OVER w AS rolling_7day_max,
       b.daily_accidents AS accidents_30days_ago, d.daily_accidents - b.daily_accidents AS month_change
FROM (SELECT date_of_accident, COUNT(*) AS daily_accidents, AVG(number_of_casualties) AS avg_daily_casualties
      FROM collision GROUP BY date_of_accident) d
LEFT JOIN (SELECT date_of_accident, COUNT(*) AS daily_accidents FROM collision GROUP BY date_of_accident) b
  ON b.date_of_accident = d.date_of_accident - INTERVAL 30 DAY
WINDOW w AS (ORDER BY d.date_of_accident RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"""
BODIES["forecast_features"] = f"""
SELECT date_of_accident, accidents AS target,
       LAG(accidents, 1) OVER (ORDER BY date_of_accident) AS lag_1day,
       LAG(accidents, 7) OVER (ORDER BY date_of_accident) AS lag_7days,
       LAG(accidents, 30) OVER (ORDER BY date_of_accident) AS lag_30days,
       AVG(accidents) OVER (ORDER BY date_of_accident ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7day_mean,
       {rnd('STDDEV(accidents) OVER (ORDER BY date_of_accident ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)', 6)}
         AS rolling_7day_stddev,
       dow, month, CASE WHEN dow IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
FROM (SELECT date_of_accident, COUNT(*) AS accidents, CAST(EXTRACT(DOW FROM date_of_accident) AS INTEGER) AS dow,
             CAST(EXTRACT(MONTH FROM date_of_accident) AS INTEGER) AS month
      FROM collision GROUP BY date_of_accident) d"""
BODIES["rolling_mean_full"] = SERIES + """
SELECT series_key, ts, y, CASE WHEN COUNT(*) OVER w = 7 THEN AVG(y) OVER w END AS rolling_mean FROM daily
WINDOW w AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
BODIES["supervised_sequences"] = SERIES + """
SELECT series_key, ts, array_to_string(x, ',') AS x_values, y FROM (
  SELECT series_key, ts, y, LIST(y) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)
    AS x FROM hourly) t
WHERE len(x) = 24"""
BODIES["minmax_scaled"] = SERIES + f"""
SELECT h.series_key, h.ts, h.y, {rnd('CAST(h.y - b.lo AS DOUBLE) / NULLIF(CAST(b.hi - b.lo AS DOUBLE), 0)', 6)}
  AS y_scaled
FROM hourly h JOIN (SELECT series_key, MIN(y) AS lo, MAX(y) AS hi FROM hourly GROUP BY 1) b
  ON h.series_key = b.series_key"""
BODIES["forecast_metrics"] = SERIES + """,
np AS (SELECT series_key, ts, y, 'naive' AS model,
              CAST(LAG(y, 1) OVER (PARTITION BY series_key ORDER BY ts) AS DOUBLE) AS yhat FROM hourly
       UNION ALL
       SELECT series_key, ts, y, 'seasonal_naive',
              CAST(LAG(y, 24) OVER (PARTITION BY series_key ORDER BY ts) AS DOUBLE) FROM hourly)
""" + _metrics("np")
BODIES["ma_baseline_metrics"] = SERIES + """,
mp AS (SELECT series_key, ts, y, 'moving_average' AS model,
              CASE WHEN COUNT(*) OVER w = 168 THEN AVG(y) OVER w END AS yhat,
              ROW_NUMBER() OVER (PARTITION BY series_key ORDER BY ts DESC) AS rn
       FROM hourly WINDOW w AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)),
mt AS (SELECT * FROM mp WHERE rn <= 720)
""" + _metrics("mt")

# ---- ML preparation -------------------------------------------------------------
TM_FEATURES = ("number_of_vehicles", "number_of_casualties", "day_of_week", "road_type", "speed_limit",
               "light_conditions", "weather_conditions", "road_surface_conditions", "vehicle_type",
               "vehicle_manoeuvre", "sex_of_driver", "age_of_driver", "age_of_casualty", "sex_of_casualty",
               "casualty_class", "casualty_type")
TM = ",\ntm_base AS (SELECT collision_index, vehicle_reference, casualty_reference, {}, casualty_severity "\
     "FROM training_rows),\ntm_med AS (SELECT {} FROM tm_base),\ntm AS (SELECT collision_index, vehicle_reference, "\
     "casualty_reference, {}, CAST(casualty_severity - 1 AS INTEGER) AS label FROM tm_base, tm_med "\
     "WHERE casualty_severity IN (1, 2, 3))\n".format(
         ", ".join(f"NULLIF({c}, -1) AS {c}" for c in TM_FEATURES),
         ", ".join(f"MEDIAN({c}) AS m_{c}" for c in TM_FEATURES),
         ", ".join(f"COALESCE(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in TM_FEATURES))
BODIES["training_matrix"] = TM + "SELECT * FROM tm"
BODIES["class_distribution"] = TM + f"""
SELECT label, n, {rnd('CAST(n AS DOUBLE) / SUM(n) OVER ()', 6)} AS share
FROM (SELECT label, COUNT(*) AS n FROM tm GROUP BY label) t"""
BODIES["stratified_folds"] = TM + """
SELECT label, CAST(fold AS INTEGER) AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n
FROM (SELECT label, COUNT(*) AS n FROM tm GROUP BY label) t, range(5) f(fold)
WHERE n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END > 0"""
BODIES["smote_balanced"] = TM + """
SELECT label, MAX(COUNT(*)) OVER () AS n FROM tm GROUP BY label"""
BODIES["class_weights"] = TM + f"""
SELECT label, n, {rnd('CAST(SUM(n) OVER () AS DOUBLE) / (COUNT(*) OVER () * n)', 6)} AS weight
FROM (SELECT label, COUNT(*) AS n FROM tm GROUP BY label) t"""
BODIES["scaled_features"] = TM + "SELECT collision_index, vehicle_reference, casualty_reference, {}, label FROM tm".format(
    ", ".join(rnd(f"({c} - AVG({c}) OVER ()) / NULLIF(STDDEV_POP({c}) OVER (), 0)", 4) + f" AS {c}"
              for c in TM_FEATURES))
BODIES["macro_metrics"] = TM + f""",
pr AS (SELECT label AS y, CASE WHEN speed_limit >= 60 THEN 1 WHEN number_of_casualties >= 3 THEN 0 ELSE 2 END AS p
       FROM tm),
conf AS (SELECT y, p, COUNT(*) AS n FROM pr GROUP BY y, p),
cls AS (SELECT c, COALESCE(sup, 0) AS support, COALESCE(tp, 0) AS tp, COALESCE(pred, 0) AS predicted
        FROM (SELECT y AS c, SUM(n) AS sup, SUM(CASE WHEN y = p THEN n END) AS tp FROM conf GROUP BY y) a
        FULL JOIN (SELECT p AS c, SUM(n) AS pred FROM conf GROUP BY p) b USING (c))
SELECT {rnd('AVG(COALESCE(2.0 * tp / NULLIF(support + predicted, 0), 0))', 6)} AS f1_macro,
       {rnd('AVG(COALESCE(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0))', 6)} AS recall_macro,
       {rnd('AVG(COALESCE(CAST(tp AS DOUBLE) / NULLIF(predicted, 0), 0))', 6)} AS precision_macro
FROM cls"""

_ml = BODIES["ml_training_dataset"]
BODIES["target_encoding"] = f""",
te_base AS (SELECT *, CASE WHEN target IN (1, 2) THEN 1 ELSE 0 END AS is_severe FROM ({_ml}) m),
te_prior AS (SELECT AVG(CAST(is_severe AS DOUBLE)) AS prior FROM te_base),
te_w AS (SELECT weather_conditions, COUNT(*) AS n, SUM(CAST(is_severe AS DOUBLE)) AS s FROM te_base GROUP BY 1),
te_l AS (SELECT light_conditions, COUNT(*) AS n, SUM(CAST(is_severe AS DOUBLE)) AS s FROM te_base GROUP BY 1)
SELECT b.collision_index,
       {rnd('(w.s + 10.0 * p.prior) / (w.n + 10.0)', 6)} AS weather_conditions_te,
       {rnd('(l.s + 10.0 * p.prior) / (l.n + 10.0)', 6)} AS light_conditions_te
FROM te_base b CROSS JOIN te_prior p
LEFT JOIN te_w w ON b.weather_conditions = w.weather_conditions
LEFT JOIN te_l l ON b.light_conditions = l.light_conditions"""
