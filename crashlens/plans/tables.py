"""Named relations of the two reference pipelines, built lazily per session.

* SQL-script pipeline: fixture -> per-column sentinel cleaning -> key dedup ->
  ``collision_with_features`` -> ``full_accident_data``.
* Notebook pipeline: fixture -> per-table cleaning (-1 -> NULL, exact
  duplicates, source tag) -> merges with indicators -> global sentinels ->
  datetime parsing -> time features -> labels.

The reference cleans its tables in place before anything reads them.  So the cleaned,
deduplicated tables are written once per session and folder, when a query first asks for
them (:func:`kept`), bucketed and sorted by ``collision_index``, so their joins need no
exchange.  The other methods return plans: the notebook's table and the loader's rows are
made by each query that reads them, with the columns it needs, so what a query costs does
not hang on the queries before it.  A query that reads them twice stores its columns first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.operators import cleaning, features, joins
from crashlens.session import configure, stored, stored_by_key
from crashlens.sources import fixtures

NB_COLLISION_COLS = ("collision_index", "raw_date", "raw_time", "weather_conditions", "light_conditions",
                     "road_surface_conditions", "road_type", "urban_or_rural_area", "junction_detail",
                     "junction_control", "speed_limit", "collision_severity", "number_of_vehicles",
                     "number_of_casualties", "police_force", "created_at")
NB_VEHICLE_COLS = ("collision_index", "vehicle_reference", "vehicle_type", "vehicle_manoeuvre", "sex_of_driver",
                   "age_of_driver", "driver_imd_decile", "created_at")
NB_CASUALTY_COLS = ("collision_index", "vehicle_reference", "casualty_reference", "casualty_class",
                    "casualty_severity", "sex_of_casualty", "age_of_casualty", "casualty_type",
                    "pedestrian_location", "created_at")
# loader features (the 17 names; those absent from the tables are skipped)
TRAINING_FEATURES = ("number_of_vehicles", "number_of_casualties", "day_of_week", "road_type", "speed_limit",
                     "light_conditions", "weather_conditions", "road_surface_conditions",
                     "special_conditions_at_site", "vehicle_type", "vehicle_manoeuvre", "sex_of_driver",
                     "age_of_driver", "age_of_casualty", "sex_of_casualty", "casualty_class", "casualty_type")


#: Tables written by a session: (application, folder, table).
KEPT: dict[tuple[str, str, str], DataFrame] = {}


def forget(sf_dir: str) -> None:
    """Have the tables of a folder written anew when next asked for (its files have changed)."""
    for key in [k for k in KEPT if k[1] == sf_dir]:
        del KEPT[key]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def kept(self, name: str, plan: Callable[[], DataFrame], key: str | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The table that ``plan`` tells, from where this session wrote it (bucketed by ``key``, its
        rows finished inside the buckets)."""
        at = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if at not in KEPT:
            KEPT[at] = stored_by_key(plan(), name, key, finish) if key else stored(plan(), name)
        return KEPT[at]

    # -- fixtures -----------------------------------------------------------
    @cached_property
    def raw_collision(self) -> DataFrame:
        return fixtures.collision_raw(self.spark, self.sf_dir)

    @cached_property
    def raw_vehicle(self) -> DataFrame:
        return fixtures.vehicle_raw(self.spark, self.sf_dir)

    @cached_property
    def raw_casualty(self) -> DataFrame:
        return fixtures.casualty_raw(self.spark, self.sf_dir)

    @cached_property
    def raw_collision_dup(self) -> DataFrame:
        return fixtures.collision_with_duplicates(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return fixtures.events(self.spark, self.sf_dir)

    # -- SQL-script pipeline -------------------------------------------------
    @cached_property
    def collision(self) -> DataFrame:
        # the script removes repeated keys before the views read the table
        return self.kept("collision", lambda: cleaning.clean_collision(self.raw_collision), "collision_index", cleaning.dedup_collisions)

    @cached_property
    def vehicle(self) -> DataFrame:
        return self.kept("vehicle", lambda: cleaning.clean_vehicle(self.raw_vehicle), "collision_index", cleaning.dedup_vehicles)

    @cached_property
    def casualty(self) -> DataFrame:
        return self.kept("casualty", lambda: cleaning.clean_casualty(self.raw_casualty), "collision_index", cleaning.dedup_casualties)

    def keys(self, table: str) -> DataFrame:
        """The key of every row of a cleaned table (cleaning leaves the keys as they are, and a dedup
        leaves one row of each)."""
        raw, key = {"collision": (self.raw_collision, cleaning.COLLISION_KEY), "vehicle": (self.raw_vehicle, cleaning.VEHICLE_KEY),
                    "casualty": (self.raw_casualty, cleaning.CASUALTY_KEY)}[table]
        return raw.select(*key).repartition("collision_index").distinct()

    @cached_property
    def vehicle_rows(self) -> DataFrame:
        """The rows of :attr:`vehicle` as a plan, for a query that needs no other cleaned table; they are
        dealt by accident once, before dedup and any join by accident."""
        return cleaning.dedup_vehicles(cleaning.clean_vehicle(self.raw_vehicle).repartition("collision_index"))

    def features(self, night: str = "literal") -> DataFrame:
        return features.with_features(self.collision, night)

    @cached_property
    def full(self) -> DataFrame:
        return joins.full_accident_data(self.features(), self.vehicle, self.casualty)

    # -- notebook pipeline ---------------------------------------------------
    def _nb_table(self, df: DataFrame, cols, name: str) -> DataFrame:
        t = cleaning.strip_column_names(df.select(*cols))
        t = cleaning.ids_to_trimmed_string(t)
        t = cleaning.numeric_sentinel_to_null(t, -1)
        t = cleaning.drop_exact_duplicates(cleaning.by_accident(t))
        return cleaning.add_source_tag(t, name)

    @cached_property
    def nb_collision(self) -> DataFrame:
        return self._nb_table(self.raw_collision, NB_COLLISION_COLS, "collision").drop(cleaning.ACCIDENT)

    @cached_property
    def nb_vehicle(self) -> DataFrame:
        return self._nb_table(self.raw_vehicle, NB_VEHICLE_COLS, "vehicle").drop(cleaning.ACCIDENT)

    @cached_property
    def nb_casualty(self) -> DataFrame:
        return self._nb_table(self.raw_casualty, NB_CASUALTY_COLS, "casualty").drop(cleaning.ACCIDENT)

    @cached_property
    def nb_merged(self) -> DataFrame:
        dealt = (self._nb_table(self.raw_collision, NB_COLLISION_COLS, "collision"), self._nb_table(self.raw_vehicle, NB_VEHICLE_COLS, "vehicle"),
                 self._nb_table(self.raw_casualty, NB_CASUALTY_COLS, "casualty"))
        return joins.merge_with_indicator(*dealt).drop(cleaning.ACCIDENT)

    @cached_property
    def nb_full(self) -> DataFrame:
        return self._nb_full()

    def _nb_full(self) -> DataFrame:
        t = cleaning.global_sentinels_to_null(self.nb_merged)
        t = joins.resolve_merge_columns(t)
        t = cleaning.parse_datetime(t, "raw_date", "raw_time")
        t = features.notebook_time_features(t, "datetime")
        return features.label_notebook(t)

    # -- loader (ML) pipeline ------------------------------------------------
    @cached_property
    def training_rows(self) -> DataFrame:
        """J3 on deduplicated (not sentinel-cleaned) tables; the loader handles -1."""
        return self._training_rows()

    def _training_rows(self) -> DataFrame:
        col, veh, cas = (cleaning.by_accident(t) for t in (self.raw_collision, self.raw_vehicle, self.raw_casualty))
        col = cleaning.dedup_collisions(col).withColumn("day_of_week", (F.dayofweek("date_of_accident") - 1))
        return joins.casualty_training_rows(cleaning.dedup_casualties(cas), col, cleaning.dedup_vehicles(veh)).drop(cleaning.ACCIDENT)
