"""What a query costs does not hang on the queries before it, and no table is dealt twice."""

import numpy as np
from pyspark.sql import functions as F

from crashlens.operators import forest, profiling
from crashlens.plans import tables
from crashlens.plans.queries import QUERIES
from crashlens.sources import constraints


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_notebook_and_training_rows_are_made_by_the_query_that_reads_them(spark, sf):
    """Each reads the driver's tables, not a table that an earlier query wrote."""
    for name in ("weekday_counts", "severity_by_hour", "categorical_frequencies", "encode_target", "casualty_training_rows"):
        for _ in range(2):
            files = {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in QUERIES[name](spark, sf).inputFiles()}
            assert files and all(f.startswith(("sf0.001/orders", "sf0.001/lineitem")) for f in files)
    assert not [k for k in tables.KEPT if k[2] in ("notebook", "training")]


def test_partitions_follow_the_rows(spark):
    """An exchange by accident makes more partitions for more rows, also where the session names few."""
    from crashlens.operators import cleaning
    from crashlens.session import configure

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], "2")
        spark.conf.set(names[1], "1m")
        configure(spark)
        assert spark.conf.get(names[1]) == "1m"  # the session's own size stays
        for rows, least, most in ((200_000, 3, 200), (100, 1, 1)):
            df = spark.range(rows).select((F.col("id") / 2).cast("long").cast("string").alias("collision_index"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
            dealt = cleaning.by_accident(df)
            assert least <= dealt.rdd.getNumPartitions() <= most
            at = dealt.withColumn("p", F.spark_partition_id()).groupBy("collision_index").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("x").alias("n"))
            assert at.where("a = b AND n = 2").count() == rows // 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_orphan_queries_deal_each_table_once(spark, sf):
    """keys alone for the parents, one exchange of rows for each use."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = len(tables.KEPT)
        plan = plan_of(QUERIES["drop_orphans"](spark, sf + "/"))  # a folder that no table was kept for
        assert len(tables.KEPT) == before and plan.count("Exchange") == 2
        plan = plan_of(QUERIES["dq_orphans"](spark, sf + "/"))
        assert len(tables.KEPT) == before and "l_shipdate" not in plan and "l_quantity" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_and_rows_equal_the_kept_tables(spark, sf):
    """Also with repeated and NULL keys."""
    t = tables.Tables(spark, sf)
    raw = t.raw_vehicle
    odd = raw.limit(40)
    raw = raw.unionByName(odd).unionByName(odd.withColumn("collision_index", F.lit(None).cast("string"))).unionByName(
        odd.withColumn("vehicle_reference", F.lit(None).cast("string")))
    t.__dict__["raw_vehicle"] = raw.withColumn("created_at", F.when(F.col("vehicle_reference") == "1", F.col("created_at")))
    from crashlens.operators import cleaning
    want = cleaning.dedup_vehicles(cleaning.clean_vehicle(t.raw_vehicle))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(t.vehicle_rows) == rows(want) and rows(t.keys("vehicle")) == rows(want.select(*cleaning.VEHICLE_KEY))


def test_histogram_of_counted_values(spark):
    """its input runs once; NULLs are in no bin."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (11.0,)], "x double").withColumn("x", noted.asNondeterministic()("x"))
    got = sorted(map(tuple, profiling.histogram(df, "x", 5).collect()))
    assert got == [(0, 1.0, 3), (4, 9.0, 1)] and seen.value == 5
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [tuple(r) for r in profiling.histogram(one, "x").collect()] == [(0, 3.0, 2)]


def test_violations_are_counted_without_moving_whole_rows(spark, sf):
    """the same reasons of every row; the judged rows keep the column that others refer to."""
    t = tables.Tables(spark, sf)
    odd = t.raw_vehicle.limit(30)
    vehicle = t.raw_vehicle.unionByName(odd).unionByName(odd.withColumn("collision_index", F.lit(None).cast("string")))
    given = {"collision": t.raw_collision_dup, "vehicle": vehicle, "casualty": t.raw_casualty}
    whole, narrow = constraints.judged_tables(given), constraints.judged_tables(given, whole=False)
    assert [narrow[n].columns for n in ("collision", "vehicle", "casualty")] == [["collision_index", "_reasons"], ["_reasons"], ["_reasons"]]
    assert all(whole[n].columns == [*given[n].columns, "_reasons"] and whole[n].count() == narrow[n].count() == given[n].count() for n in given)
    counts = [sorted(map(tuple, constraints.violation_counts(j).collect())) for j in (whole, narrow)]
    assert counts[0] == counts[1] and len(counts[0]) > 3


def test_bootstrap_rows_travel_as_numbers_of_their_values():
    """values come back bit by bit, in fewer bytes where they repeat."""
    rng = np.random.default_rng(1)
    few, many = rng.integers(0, 60, 5000).astype(np.float32), rng.random(5000).astype(np.float32)
    odd = np.array([0.0, -0.0, np.nan, np.inf, 1.5] * 1000, np.float32)
    y, w = rng.integers(0, 3, 5000).astype(np.int32), rng.choice([0.4, 1.7, 9.3], 5000)
    kinds = [np.float32] * 3 + [np.int32, np.float64]
    columns = [few, many, odd, y, w]
    for at in (np.arange(5000), np.arange(0, 5000, 7), np.array([3]), np.array([4, 4, 2])):
        data = b"".join(forest.told(levels, codes[at]) for levels, codes in map(forest.coded, columns))
        back = forest.heard(data, len(at), kinds)
        assert all(c[at].tobytes() == b.tobytes() and b.dtype == c.dtype for c, b in zip(columns, back))
    assert len(forest.told(*forest.coded(few))) < 5000 * 1.1 and len(forest.told(*forest.coded(many))) <= 5000 * 4 + 4


def test_rows_ask_few_blocks_for_neighbours(spark):
    """A row is sent to the blocks that can hold a nearer row, not to most blocks of its class."""
    import os

    from crashlens.operators import neighbours
    from crashlens.session import checkpoint_dir

    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(0, [2, 3, 7, 12, 60], (3000, 5)), r.normal(0, 20, (1000, 5))])
    rows = spark.createDataFrame([(f"{i:04}", 1, *map(float, v)) for i, v in enumerate(x)], "id string, label int, a double, b double, c double, d double, e double")
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    near = {v["id"]: [(n["d"], n["id"]) for n in v["near"]] for v in neighbours.nearest(rows, list("abcde"), "id", 5, 42, "label", 100).collect()}
    bounds = [n for n in set(os.listdir(folder)) - before if n.startswith("neighbour-bounds")]
    blocks = spark.read.parquet(f"{folder}/{bounds[0]}").select(F.avg(F.size("asks"))).first()[0]
    assert blocks < 8  # of about 40
    for i in range(0, 4000, 97):
        d = sum((x[:, f] - x[i, f]) ** 2 for f in range(5))
        d[i] = np.inf
        assert near[f"{i:04}"] == [(d[j], f"{j:04}") for j in np.lexsort((np.arange(4000), d))[:5]]


def test_rows_without_a_finite_place_have_no_neighbours(spark):
    from crashlens.operators import neighbours

    odd = [None, float("nan"), float("inf"), -float("inf")]
    rows = spark.createDataFrame([(f"{i:02}", 0, odd[i] if i < 4 else float(i), 1.0) for i in range(24)], "id string, label int, a double, b double")
    near = {v["id"]: [n["id"] for n in v["near"]] for v in neighbours.nearest(rows, ["a", "b"], "id", 3, 42, "label", 5).collect()}
    assert sorted(near) == [f"{i:02}" for i in range(4, 24)] and near["04"] == ["05", "06", "07"] and near["10"] == ["09", "11", "08"]


def test_bootstrap_rows_travel_without_their_numbers(spark):
    """blocks of ranges of row numbers tell their order, so a tree is the same however rows were dealt."""
    from crashlens.operators.blocks import blocks

    r = np.random.default_rng(3)
    rows = [(0, int(n), int(v[0] > 1) + int(v[1] > 3), 1.0 + i % 2, *map(float, v)) for i, (n, v) in enumerate(zip(r.integers(-2**63, 2**63 - 1, 900), r.integers(0, 6, (900, 3))))]
    df = spark.createDataFrame(rows, "model int, row long, label int, weight double, a double, b double, c double")
    found = []
    for parts in (1, 7):
        data = blocks(forest.in_ranges(df.repartition(parts), "row"), ["a", "b", "c"])
        ends = sorted((int(b.row[0]), int(b.row[-1])) for b in data.collect())
        assert sum(len(b.row) for b in data.collect()) == 900 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
        made = forest.fit(data, None, 1, 3, 3, spark, 4)
        assert "row" not in made.subtrees.columns
        found.append(sorted((r["tree"], bytes(r["feature"]), bytes(r["threshold"]), bytes(r["share"])) for r in made.subtrees.collect()))
    assert found[0] == found[1] and len(found[0]) == 4
    # the same trees as from all rows in the order of their numbers
    rows.sort(key=lambda v: v[1])
    x, y, w, n = (np.array([v[4:] for v in rows], np.float32), np.array([v[2] for v in rows]), np.array([v[3] for v in rows]), np.array([v[1] for v in rows]))
    for t, feature, threshold, _ in found[0]:
        count = forest.times(n, t, 42)
        at = count > 0
        tree = forest.grow(x[at], y[at], w[at] * count[at], 3, 1, np.random.default_rng([42, 0, t, 1]))
        assert tree["feature"].tobytes() == feature and tree["threshold"].tobytes() == threshold
        assert (forest.children(tree["feature"]) == tree["child"]).all()


def test_values_are_counted_once_for_all_folds(spark):
    """a row is counted in its fold, not once for each of the models that see it; the same medians and scales."""
    from crashlens.operators import ml

    r = np.random.default_rng(12)
    rows = [(int(i % 5), float(round(v, 1)) if i % 7 else None, float(i % 4)) for i, v in enumerate(r.normal(size=203))]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "fold int, a double, b double")
    each = df.select("*", F.explode(ml.of_others(F.col("fold"), 5)).alias("model"))
    want = ml.prepare(each, ["a", "b"], 5)
    got = ml.prepare(df.withColumn("a", noted.asNondeterministic()("a")), ["a", "b"], 5, folds=True)
    assert seen.value == 203
    assert all(np.allclose(getattr(got, n), getattr(want, n), rtol=1e-12) for n in ("medians", "means", "scales"))
    for m in range(5):
        x = np.array([np.nan if v is None else v for f, v, _ in rows if f != m])
        filled = np.where(np.isnan(x), np.nanmedian(x), x)
        assert np.allclose([got.medians[m, 0], got.means[m, 0], got.scales[m, 0]], [np.nanmedian(x), filled.mean(), filled.std()])


def test_gradient_models_keep_rows_once_in_few_bytes(spark):
    """one copy of the rows is kept, columns of few values as their numbers, and read back bit by bit."""
    import pickle

    from crashlens.operators import network
    from crashlens.operators.blocks import Block, Column

    r = np.random.default_rng(13)
    few, many = r.integers(0, 40, 5000).astype(np.float32), r.random(5000).astype(np.float32)
    odd = np.array([0.0, -0.0, np.nan, np.inf, 1.5] * 1000, np.float32)
    for c in (few, many, odd, few[:1], few[:0]):
        assert Column(c).read().tobytes() == c.tobytes() and Column(c).read().dtype == c.dtype
    assert len(pickle.dumps(Column(few))) < 6000
    x, y = np.stack([few, many], 1), (few > 20).astype(np.int32)
    rows = spark.sparkContext.parallelize([Block(0, x, y, np.ones(5000), np.arange(5000))], 1).persist()
    kept = lambda: set(spark.sparkContext._jsc.sc().getPersistentRDDs().keySet().mkString(",").split(","))
    before, most = kept(), []
    summed = network.summed
    try:
        network.summed = lambda *a: (most.append(len(kept() - before)), summed(*a))[1]
        net = network.fit(rows, 1, 2, 0, 2, 1.0, 50)
    finally:
        network.summed = summed
    assert max(most) <= 1 and not rows.is_cached
    assert (network.probabilities(x, 0, net).argmax(1) == y).mean() > 0.95
