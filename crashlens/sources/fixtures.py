"""Domain tables derived from the driver's TPC-H-like tables.

The mapping is one SQL text per table, written only with operators that
Spark SQL and DuckDB evaluate alike, so the Spark jobs and the SQL oracle
start from identical collision / vehicle / casualty rows.  ``{orders}`` and
``{lineitem}`` are placeholders: on Spark they are bound to DataFrames
(``spark.sql(text, orders=df)``), for the oracle they are view names.

Every column is a per-row expression of its source row: the mapping is a
narrow projection that scales with the input and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the mapping (code assignment rules for synthetic inputs).
COLLISION_SQL = """
SELECT
  CAST(k AS STRING) AS collision_index,
  CAST(k AS STRING) AS collision_reference,
  d AS date_of_accident,
  hhmm AS time_of_accident,
  CASE WHEN k % 301 = 0 THEN concat('31/02/', CAST(year(d) AS STRING))
       ELSE concat(lpad(CAST(day(d) AS STRING), 2, '0'), '/',
                   lpad(CAST(month(d) AS STRING), 2, '0'), '/', CAST(year(d) AS STRING))
  END AS raw_date,
  CASE WHEN k % 307 = 0 THEN '25:00' ELSE hhmm END AS raw_time,
  CASE WHEN k % 50 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(c % 1000 AS DOUBLE) / 100 - 8 END AS longitude,
  CASE WHEN k % 50 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(c % 1000 AS DOUBLE) / 100 + 50 END AS latitude,
  CAST(NULL AS STRING) AS local_authority_district,
  CAST(NULL AS INT) AS first_road_class,
  CAST(NULL AS INT) AS first_road_number,
  CAST(CASE c % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 4 THEN 7 ELSE 9 END AS INT) AS road_type,
  CAST(w AS INT) AS weather_conditions,
  CAST(CASE WHEN h BETWEEN 6 AND 18 THEN 1
            ELSE CASE c % 5 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 6 ELSE -1 END
       END AS INT) AS light_conditions,
  CAST(CASE WHEN k % 89 = 0 THEN -1 WHEN w IN (2, 5) THEN 2 WHEN k % 53 = 0 THEN 4 ELSE 1 END AS INT)
    AS road_surface_conditions,
  CAST(CASE WHEN c % 3 = 0 THEN 2 ELSE 1 END AS INT) AS urban_or_rural_area,
  CAST(CASE k % 7 WHEN 0 THEN 0 WHEN 1 THEN 13 WHEN 2 THEN 16 WHEN 3 THEN 17 WHEN 4 THEN 18 WHEN 5 THEN 19
       ELSE 99 END AS INT) AS junction_detail,
  CAST(CASE c % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 9 END AS INT) AS junction_control,
  CAST(CASE WHEN k % 499 = 0 THEN 9 WHEN k % 100 < 2 THEN 1 WHEN k % 100 < 25 THEN 2 ELSE 3 END AS INT)
    AS collision_severity,
  CAST(1 + c % 3 AS INT) AS number_of_vehicles,
  CAST(CASE WHEN k % 200 = 0 THEN 12 ELSE 1 + k % 3 END AS INT) AS number_of_casualties,
  CAST(CASE k % 7 WHEN 0 THEN -1 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 30 WHEN 4 THEN 40 WHEN 5 THEN 60
       ELSE 70 END AS INT) AS speed_limit,
  CAST(c % 25 AS INT) AS police_force,
  CAST(NULL AS BOOLEAN) AS did_police_officer_attend,
  created_at,
  CAST(NULL AS TIMESTAMP) AS updated_at
FROM (
  SELECT k, c, d, m, h, created_at, w,
         concat(lpad(CAST(h AS STRING), 2, '0'), ':', lpad(CAST(m % 60 AS STRING), 2, '0')) AS hhmm
  FROM (
    SELECT k, c, d, m, created_at,
           CAST(floor(m / 60) AS INT) AS h,
           CASE WHEN k % 97 = 0 THEN 99 WHEN k % 10 < 7 THEN 1 WHEN k % 10 = 7 THEN 2 ELSE (k % 11) - 1 END AS w
    FROM (
      SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderdate AS created_at,
             CASE WHEN o_orderpriority = '1-URGENT' THEN 900 + (o_orderkey * 37) % 240
                  ELSE (o_orderkey * 37 + o_custkey * 11) % 1440 END AS m
      FROM {orders}
    ) s0
  ) s1
) s2
"""

VEHICLE_SQL = """
SELECT
  (CASE WHEN l_partkey % 19 = 0 THEN l_orderkey + 100000000 ELSE l_orderkey END) * 10 + l_linenumber AS vehicle_id,
  CAST(CASE WHEN l_partkey % 19 = 0 THEN l_orderkey + 100000000 ELSE l_orderkey END AS STRING) AS collision_index,
  CAST(l_linenumber AS STRING) AS vehicle_reference,
  CAST(CASE l_partkey % 12 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 8
       WHEN 6 THEN 9 WHEN 7 THEN 19 WHEN 8 THEN 11 WHEN 9 THEN 10 WHEN 10 THEN 20 ELSE 99 END AS INT) AS vehicle_type,
  CAST(CASE WHEN l_partkey % 41 = 0 THEN 99 ELSE 1 + l_suppkey % 17 END AS INT) AS vehicle_manoeuvre,
  CAST(NULL AS INT) AS vehicle_location,
  CAST(CASE WHEN l_partkey % 29 = 0 THEN -1 ELSE 1 + l_suppkey % 2 END AS INT) AS sex_of_driver,
  CAST(CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE 16 + l_quantity END AS INT) AS age_of_driver,
  CAST(NULL AS STRING) AS age_band_of_driver,
  CAST(CASE WHEN l_suppkey % 9 = 0 THEN -1 ELSE 1 + l_partkey % 10 END AS INT) AS driver_imd_decile,
  CAST(NULL AS INT) AS driver_home_area_type,
  l_shipdate AS created_at
FROM {lineitem}
"""

CASUALTY_SQL = """
SELECT
  l_orderkey * 100 + l_linenumber * 10 + 1 + l_suppkey % 2 AS casualty_id,
  CAST(l_orderkey AS STRING) AS collision_index,
  CAST(CASE WHEN l_returnflag = 'N' THEN 1 ELSE l_linenumber END AS STRING) AS vehicle_reference,
  CAST(CASE WHEN l_returnflag = 'N' THEN 10 * l_linenumber ELSE 0 END + 1 + l_suppkey % 2 AS STRING) AS casualty_reference,
  CAST(1 + l_partkey % 3 AS INT) AS casualty_class,
  CAST(CASE WHEN l_partkey % 101 = 0 THEN -1
            ELSE CASE WHEN l_suppkey % 20 = 0 THEN 1 WHEN l_suppkey % 20 < 5 THEN 2 ELSE 3 END
       END AS INT) AS casualty_severity,
  CAST(1 + l_partkey % 2 AS INT) AS sex_of_casualty,
  CAST(CASE WHEN l_partkey % 17 = 0 THEN -1 ELSE l_partkey % 95 END AS INT) AS age_of_casualty,
  CAST(NULL AS STRING) AS age_band_of_casualty,
  CAST(l_partkey % 12 AS INT) AS casualty_type,
  CAST(CASE WHEN l_suppkey % 3 = 0 THEN -1 ELSE 0 END AS INT) AS pedestrian_location,
  CAST(NULL AS INT) AS pedestrian_movement,
  CAST(NULL AS INT) AS casualty_imd_decile,
  l_shipdate AS created_at
FROM {lineitem}
"""

# Collision input for the dedup job: every row plus a later copy of the
# rows with k % 113 = 0 (duplicated primary keys).
COLLISION_DUP_SQL = """
SELECT * FROM ({collision}) a
UNION ALL
SELECT collision_index, collision_reference, date_of_accident, time_of_accident, raw_date, raw_time,
       longitude, latitude, local_authority_district, first_road_class, first_road_number, road_type,
       weather_conditions, light_conditions, road_surface_conditions, urban_or_rural_area, junction_detail,
       junction_control, collision_severity, number_of_vehicles, number_of_casualties, speed_limit,
       police_force, did_police_officer_attend, created_at + INTERVAL 1 DAY AS created_at, updated_at
FROM ({collision}) b
WHERE CAST(collision_index AS BIGINT) % 113 = 0
"""

DRIVER_TABLES = ("orders", "lineitem", "events")


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def collision_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COLLISION_SQL, orders=read_driver(spark, sf_dir, "orders"))


def vehicle_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VEHICLE_SQL, lineitem=read_driver(spark, sf_dir, "lineitem"))


def casualty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CASUALTY_SQL, lineitem=read_driver(spark, sf_dir, "lineitem"))


def collision_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = collision_raw(spark, sf_dir)
    return spark.sql(COLLISION_DUP_SQL.replace("({collision})", "{collision}"), collision=base)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_driver(spark, sf_dir, "events")


def oracle_ctes() -> str:
    """The same mapping as DuckDB CTEs over the pre-registered driver views."""
    col = COLLISION_SQL.format(orders="orders")
    return (
        f"raw_collision AS ({col}),\n"
        f"raw_vehicle AS ({VEHICLE_SQL.format(lineitem='lineitem')}),\n"
        f"raw_casualty AS ({CASUALTY_SQL.format(lineitem='lineitem')}),\n"
        f"raw_collision_dup AS ({COLLISION_DUP_SQL.format(collision='SELECT * FROM raw_collision')})"
    )
