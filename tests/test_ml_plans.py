"""ML helpers, plan shape and streaming checks."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashlens.operators import ml, neighbours
from crashlens.plans import queries_ml
from crashlens.plans.queries import QUERIES


def test_folds_are_stratified(spark, sf):
    m = queries_ml.with_row_id(queries_ml.matrix(spark, sf))
    folds = ml.stratified_folds(m, "row_id", 5)
    per = folds.groupBy("label", "fold").count().collect()
    by_label = {}
    for r in per:
        by_label.setdefault(r.label, []).append(r["count"])
    for counts in by_label.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert folds.count() == m.count()


def test_smote_balances_classes(spark, sf):
    rows = QUERIES["smote_balanced"](spark, sf).collect()
    assert len({r.n for r in rows}) == 1


def test_macro_metrics_by_hand(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    r = ml.macro_metrics(p).collect()[0]
    # class 0: p=1, r=.5, f1=2/3; class 1: p=1/3, r=1, f1=.5; class 2: 0
    assert abs(r.f1_macro - (2 / 3 + 0.5) / 3) < 1e-6
    assert abs(r.recall_macro - 0.5) < 1e-6


def test_cross_validation_covers_all_folds(spark, sf):
    rows = queries_ml.labelled(spark, sf)
    r = ml.cross_validate(rows, "lr", queries_ml.feature_names(rows), "row_id", 3).first()
    assert r.folds == 3 and 0.0 <= r.f1_cv_mean <= 1.0 and r.f1_cv_std >= 0.0


def test_network_pipeline_runs_with_resampling(spark, sf):
    rows = queries_ml.labelled(spark, sf)
    m = ml.fit(rows, "mlp", queries_ml.feature_names(rows), "row_id", mlp_iter=5)
    assert ml.predict(m, rows).filter(F.col("prediction").isNull()).count() == 0


def test_smote_does_not_depend_on_blocks(spark):
    rows = spark.createDataFrame([(str(i), int(i % 10 == 0), float(i % 37), float((i * 7) % 11)) for i in range(600)], "id string, label int, a double, b double")
    one = ml.smote(rows, ["a", "b"], "id")
    many = ml.smote(rows, ["a", "b"], "id", block=10)
    same = ml.smote(rows, ["a", "b"], "id", block=37, most=2)
    assert one.groupBy("label").count().collect()[0]["count"] == 540 and one.count() == 1080
    assert many.exceptAll(same).count() == 0 and one.exceptAll(same).count() == 0 and many.count() == 1080


@pytest.mark.parametrize("block, most", [(4096, 256), (16, 256), (16, 3)])
def test_nearest_is_exact(spark, block, most):
    """Also with ties, repeated rows, a class below k rows and cells above a block."""
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(120, 3)), r.integers(0, 3, (80, 3)), np.tile([[1.0, 1.0, 1.0]], (40, 1))])
    label = np.where(np.arange(240) < 3, 2, np.arange(240) % 2)
    rows = spark.createDataFrame([(f"{i:03}", int(label[i]), *map(float, v)) for i, v in enumerate(x)], "id string, label int, a double, b double, c double")
    found = neighbours.nearest(rows, ["a", "b", "c"], "id", 5, 42, "label", block, most)
    got = {v["id"]: [n["id"] for n in v["near"]] for v in found.collect()}
    for i in range(240):
        others = [j for j in range(240) if j != i and label[j] == label[i]]
        d = {j: sum((x[i, f] - x[j, f]) ** 2 for f in range(3)) for j in others}
        assert got[f"{i:03}"] == [f"{j:03}" for j in sorted(others, key=lambda j: (d[j], j))[:5]]


def test_no_cartesian_product_on_big_inputs(spark, sf):
    for key in ("full_accident_data", "risk_score_batch", "vehicle_type_profile", "peak_hours_top5"):
        plan = QUERIES[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, key


def test_scan_prunes_columns(spark, sf):
    plan = QUERIES["hourly_accident_stats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan  # unused driver columns are not read


def test_streaming_hourly_matches_batch(spark, sf):
    from crashlens.operators import series
    from crashlens.streaming import jobs

    out = tempfile.mkdtemp(prefix="crashlens-stream-")
    src = os.path.join(out, "src")
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(src)
    q = jobs.hourly_counts_stream(jobs.events_stream(spark, src))
    jobs.run_available_now(q, os.path.join(out, "sink"), os.path.join(out, "ckpt"))
    streamed = spark.read.parquet(os.path.join(out, "sink"))
    batch = series.counts_per_period(spark.read.parquet(src), "ts", "hour", "event_type", also_all=True)
    # the watermark holds back the last open window of each key
    assert 0 < streamed.count() <= batch.count()
    assert streamed.join(batch, ["series_key", "ts"]).filter(streamed.y != batch.y).count() == 0


def test_ranks_do_not_depend_on_buckets(spark, sf):
    m = queries_ml.labelled(spark, sf).select("row_id", "label")
    few, many = ml.class_rank(m, "row_id", bits=2), ml.class_rank(m, "row_id", bits=16)
    assert few.exceptAll(many).count() == 0
    for r in many.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class_rank").alias("d"), F.max("class_rank").alias("hi")).collect():
        assert r.d == r.n and r.hi == r.n - 1


def _plan_nodes_ok(node, key):
    """Walk a physical plan: no CartesianProduct; a window without partition
    keys (one task) must sit above an aggregate on every path to a scan."""
    name = node.nodeName()
    assert name != "CartesianProduct", key
    kids = [node.children().apply(i) for i in range(node.children().size())]
    if name == "Window" and node.partitionSpec().isEmpty():
        def aggregated(n):
            if "Aggregate" in n.nodeName():
                return True
            ch = [n.children().apply(i) for i in range(n.children().size())]
            if not ch:   # reached a leaf (scan / local rows) without an aggregate in between
                return n.nodeName() in ("LocalTableScan", "Scan ExistingRDD", "Scan RDD", "ExistingRDD")
            return all(aggregated(c) for c in ch)
        assert aggregated(node), f"{key}: single-partition window over raw rows"
    for k in kids:
        _plan_nodes_ok(k, key)


def test_single_partition_windows_only_after_aggregation(spark, sf):
    from crashlens.plans import registry
    keys = sorted(registry.oracle_sql())
    for key in keys:
        plan = QUERIES[key](spark, sf)._jdf.queryExecution().executedPlan()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.inputPlan()
        _plan_nodes_ok(plan, key)


def test_plan_walk_rejects_raw_single_partition_window(spark):
    import pytest
    from pyspark.sql.window import Window

    raw = spark.range(100).withColumn("r", F.row_number().over(Window.orderBy("id")))
    plan = raw._jdf.queryExecution().executedPlan()
    plan = plan.inputPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    with pytest.raises(AssertionError):
        _plan_nodes_ok(plan, "raw")
    ok = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count() \
        .withColumn("r", F.row_number().over(Window.orderBy("k")))
    plan = ok._jdf.queryExecution().executedPlan()
    _plan_nodes_ok(plan.inputPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan, "agg")


def test_registered_model_sizes_are_the_reference_ones(spark, sf, monkeypatch):
    from crashlens.plans import queries_ml, registry

    calls = {}

    def compared(rows, features, id_col, k, params, models):
        calls[name] = (k, params, set(models))
        return spark.range(0).select(F.col("id").cast("string").alias("model"))

    monkeypatch.setattr(queries_ml.ml, "compare_models", compared)
    monkeypatch.setattr(queries_ml, "rounded", lambda df: df)
    monkeypatch.setattr(queries_ml.ml, "best_model", lambda df: df)
    for name in ("clf_gbt", "clf_mlp", "model_comparison", "best_model"):
        monkeypatch.setattr(queries_ml, "METRICS", {})
        registry.queries()[name](spark, sf)
        k, params, _ = calls[name]
        assert k == 5 and params["gbt"] == {"gbt_iter": 100} and params["mlp"] == {"mlp_iter": 500}


def test_cv_metrics_covers_every_model(spark, sf, monkeypatch):
    from crashlens.plans import queries_ml, registry

    monkeypatch.setattr(queries_ml, "validated", lambda spark, sf, *models: models)
    assert registry.queries()["cv_metrics"](spark, sf) == ("lr", "rf", "mlp", "gbt")


def test_distances_by_products_are_within_their_bound():
    r = np.random.default_rng(1)
    for a, b in ((r.normal(size=(50, 7)) + 1e4, r.normal(size=(60, 7)) + 1e4), (r.integers(0, 3, (40, 5)).astype(float),) * 2):
        d, off = neighbours.products(a, b)
        assert np.abs(d - neighbours.squares(a, b)).max() <= off
        i, j = np.indices(d.shape).reshape(2, -1)
        assert (neighbours.exact(a[i], b[j]) == neighbours.squares(a, b).ravel()).all()
    b = b.copy()
    b[3, 2] = np.nan
    d, off = neighbours.products(a, b)
    assert np.isfinite(off) and np.isnan(d[:, 3]).all() and np.isfinite(np.delete(d, 3, 1)).all()
