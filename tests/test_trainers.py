"""Trainers against small numpy versions: boosted trees, forest, gradient models, shared folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashlens.operators import boosting, forest, ml, network
from crashlens.operators.blocks import Block, blocks
from crashlens.plans import queries_ml


def sample(n=400, seed=0, classes=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)) * 2, 1).astype(np.float32)
    y = ((x[:, 0] > 0.5).astype(int) + (x[:, 1] + x[:, 2] > 0) + (r.random(n) < 0.1)).clip(0, classes - 1)
    return x, y.astype(np.int32)


def spread(spark, x, y, models, parts=3):
    """Blocks of the rows, of model i: the rows whose number is not i modulo ``models``."""
    out = []
    for m in range(models):
        at = np.flatnonzero(np.arange(len(y)) % models != m) if models > 1 else np.arange(len(y))
        out += [Block(m, x[a], y[a], np.ones(len(a)), a) for a in np.array_split(at, 4)]
    return spark.sparkContext.parallelize(out, parts)


def plain_boosting(x, y, cuts, classes, rounds, depth, rate):
    """Level-wise trees by direct search; scores after every round."""
    bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1)
    score = np.zeros((len(y), classes))
    for _ in range(rounds):
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = np.zeros_like(score)
        for c in range(classes):
            g, h = p[:, c] - (y == c), np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16)
            groups = [np.arange(len(y))]
            for _ in range(depth):
                new = []
                for rows in groups:
                    best, found = boosting.GAIN, None
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    for f in range(x.shape[1]):
                        for b in range(len(cuts[f])):
                            left = bins[rows, f] <= b
                            gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                            gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - whole
                            if hl >= 1 and hr >= 1 and gain > best + 1e-9:
                                best, found = gain, left
                    new += [rows, rows[:0]] if found is None else [rows[found], rows[~found]]
                groups = new
            for rows in groups:
                step[rows, c] = -rate * g[rows].sum() / (h[rows].sum() + 1)
        score += step
    return score


def test_boosting_equals_plain_version(spark):
    x, y = sample(300)
    cuts = [[np.unique(x[:, i])[::5] for i in range(4)] for _ in range(2)]
    trees = boosting.fit(spread(spark, x, y, 2), cuts, 3, rounds=12, depth=3)  # past a checkpoint of the scores
    assert trees.leaf.shape == (12, 2, 3, 8)
    for m in range(2):
        at = np.arange(len(y)) % 2 != m
        expected = plain_boosting(x[at], y[at], cuts[m], 3, 12, 3, 0.1)
        assert np.allclose(boosting.scores(boosting.binned(x[at], cuts[m]), m, trees).T, expected, atol=1e-9)


def test_boosting_does_not_depend_on_partitions(spark):
    x, y = sample(200, 3)
    cuts = [[np.unique(x[:, i])[::9] for i in range(4)]]
    a, b = (boosting.fit(spread(spark, x, y, 1, parts), cuts, 3, rounds=3) for parts in (1, 4))
    assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.leaf, b.leaf)


def test_cut_points_are_quantiles_per_model(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("model"), F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    cuts = boosting.cut_points(df, ["a", "b"], 3, 8)
    assert len(cuts) == 3 and len(cuts[0][0]) == 7 and cuts[0][1].tolist() == [0.0, 1.0, 2.0] and len(cuts[2][0]) == 0


@pytest.mark.parametrize("hidden", [0, 7])
def test_gradient_by_differences(hidden):
    x, y = sample(60, 1)
    r = np.random.default_rng(2)
    w, v = r.random(60) + 0.5, r.normal(size=network.length(4, hidden, 3)) * 0.4
    at = lambda u: network.loss_and_gradient(x.T, y, w, u, hidden, 3)
    for i in range(len(v)):
        step = np.zeros_like(v)
        step[i] = 1e-6
        assert abs((at(v + step)[0] - at(v - step)[0]) / 2e-6 - at(v)[1 + i]) < 1e-4


def test_linear_model_reaches_the_minimum(spark):
    x, y = sample(300, 4)
    net = network.fit(spread(spark, x, y, 2), 2, 4, 0, 3, 1.0, 200, tolerance=1e-7)
    for m in range(2):
        at = np.arange(300) % 2 != m
        v, n = net.weights[m], at.sum()
        ridge = np.concatenate([v[:12], np.zeros(3)])
        gradient = (network.loss_and_gradient(x[at].T, y[at], np.ones(n), v, 0, 3)[1:] + ridge) / n
        assert np.abs(gradient).max() < 1e-4


def test_network_learns_what_a_linear_model_cannot(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(np.int32)
    net = network.fit(spread(spark, x, y, 1), 1, 4, 20, 2, 0.001, 150)
    assert (network.probabilities(x, 0, net).argmax(1) == y).mean() > 0.95


def plain_purity(x, y, tree, node=0, rows=None):
    """Leaves hold one class, or rows that no feature tells apart."""
    rows = np.arange(len(y)) if rows is None else rows
    f = tree["feature"][node]
    if f < 0:
        return len(set(y[rows])) == 1 or (x[rows] == x[rows[0]]).all()
    left = x[rows, f] <= tree["threshold"][node]
    assert 0 < left.sum() < len(rows)
    return plain_purity(x, y, tree, tree["child"][node], rows[left]) and plain_purity(x, y, tree, tree["child"][node] + 1, rows[~left])


def test_tree_grows_until_pure():
    x, y = sample(500, 6)
    x[:20] = x[0]  # rows that nothing tells apart
    w = np.random.default_rng(1).random(500)
    tree = forest.grow(x, y, w, 3, 2, np.random.default_rng(7))
    assert plain_purity(x, y, tree)
    shares = forest.applied(x, tree)
    assert np.allclose(shares.sum(1), 1) and (shares.argmax(1) == y)[20:].all()
    assert np.allclose(shares[0], [w[:20][y[:20] == c].sum() / w[:20].sum() for c in range(3)], atol=1e-6)


def test_split_has_least_impurity():
    x, y = sample(120, 8)
    tree = forest.grow(x, y, np.ones(120), 3, 4, np.random.default_rng(7))  # all features are tried

    def impurity(left):
        return sum(part.sum() - sum((y[part] == c).sum() ** 2 for c in range(3)) / max(1, part.sum()) for part in (left, ~left))

    best = min(impurity(x[:, f] <= t) for f in range(4) for t in np.unique(x[:, f])[:-1])
    assert abs(impurity(x[:, tree["feature"][0]] <= tree["threshold"][0]) - best) < 1e-9


def test_bootstrap_counts():
    n = np.concatenate([forest.times(np.arange(4000), t, 42) for t in range(5)])
    assert abs(n.mean() - 1) < 0.03 and abs(n.var() - 1) < 0.06 and abs((n == 0).mean() - np.exp(-1)) < 0.02


@pytest.mark.parametrize("limit", [10**6, 40])
def test_forest(spark, limit):
    """With small tasks, nodes above the limit are split by passes over all rows."""
    x, y = sample(600, 9)
    rows = [(i, i % 3 == 0, int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, held boolean, label int, a double, b double, c double, d double").repartition(3)
    model = ml.fit(df.where("NOT held"), "rf", ["a", "b", "c", "d"], "id", num_trees=25, limit=limit)
    assert bool(model.body.top[0, 0]) == (limit == 40)
    got = ml.predict(model, df).collect()
    assert len(got) == 600 and all(abs(sum(r["probability"]) - 1) < 1e-6 for r in got)
    assert np.mean([r["prediction"] == r["label"] for r in got if r["held"]]) > 0.75
    assert np.mean([r["prediction"] == r["label"] for r in got if not r["held"]]) > 0.95
    biggest = model.body.subtrees.agg(F.max("n")).first()[0]
    assert limit > 100 or biggest <= 2 * limit


@pytest.mark.parametrize("kind", ml.MODELS)
def test_save_load_and_predict(spark, tmp_path, kind):
    x, y = sample(200, 10)
    df = spark.createDataFrame([(f"r{i}", int(c), float(v[0]), float(v[1]) if i % 9 else None, 9) for i, (v, c) in enumerate(zip(x, y))], "id string, label int, a double, b double, model int")
    params = {"rf": dict(num_trees=4), "gbt": dict(gbt_iter=3), "mlp": dict(mlp_iter=5), "lr": {}}[kind]
    m = ml.fit(df, kind, ["a", "b"], "id", **params)
    ml.save_model(m, str(tmp_path), kind, spark)
    again, name = ml.load_model(str(tmp_path), spark)
    a, b = ({r["id"]: (r["prediction"], r["probability"]) for r in ml.predict(w, df).collect()} for w in (m, again))
    assert name == kind and a == b and len(a) == 200
    assert ml.predict(m, df.limit(0)).count() == 0


def test_preparation_equals_numpy(spark):
    r = np.random.default_rng(11)
    values = [(i % 2, float(round(v, 1)) if i % 5 else None, 3.0) for i, v in enumerate(r.normal(size=101))]
    prep = ml.prepare(spark.createDataFrame(values, "model int, a double, b double"), ["a", "b"], 2)
    for m in range(2):
        x = np.array([np.nan if v is None else v for k, v, _ in values if k == m])
        median = np.nanmedian(x)
        filled = np.where(np.isnan(x), median, x)
        assert np.allclose([prep.medians[m, 0], prep.means[m, 0], prep.scales[m, 0]], [median, filled.mean(), filled.std()])
        assert prep.scales[m, 1] == 1.0 and prep.means[m, 1] == 3.0


def test_smote_within_groups_equals_each_group_alone(spark):
    rows = spark.createDataFrame([(str(i), i % 2, int(i % 10 < 3), float(i % 37), float((i * 7) % 11)) for i in range(300)], "id string, fold int, label int, a double, b double")
    both = ml.smote(rows, ["a", "b"], "id", within="fold")
    for fold in range(2):
        alone = ml.smote(rows.where(F.col("fold") == fold), ["a", "b"], "id")
        own = both.where(F.col("fold") == fold).select(alone.columns)
        assert own.count() == alone.count() and own.groupBy("label").count().distinct().count() == 2
        assert own.where(~F.col("id").contains("#")).exceptAll(alone).count() == 0


def test_shared_folds_equal_a_fit_of_the_other_folds(spark, sf):
    """The model of fold f, fitted beside the others, is the one fitted on the other folds alone."""
    rows = queries_ml.labelled(spark, sf).where("number_of_vehicles = 1")
    features = queries_ml.feature_names(rows)
    got = ml.cross_validate(rows, "lr", features, "row_id", 3).first()
    folded = ml.stratified_folds(rows, "row_id", 3)
    scores = []
    for f in range(3):
        m = ml.fit(folded.where(F.col("fold") != f), "lr", features, "row_id")
        scores.append(ml.macro_metrics(ml.predict(m, folded.where(F.col("fold") == f))).first()["f1_macro"])
    assert abs(got["f1_cv_mean"] - np.mean(scores)) < 0.01


def test_blocks_hold_every_row_once(spark):
    df = spark.range(1000).select(F.col("id").alias("row"), (F.col("id") % 3).cast("int").alias("model"), F.lit(1).alias("label"), F.lit(0.5).alias("weight"), F.col("id").cast("double").alias("a"))
    held = blocks(df, ["a"]).collect()
    assert sorted(int(v) for b in held for v in b.row) == list(range(1000))
    assert all((b.row % 3 == b.model).all() and (b.x[:, 0] == b.row).all() and (b.w == 0.5).all() for b in held)


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        ml.fit(spark.createDataFrame([(1, 0, 1.0)], "id long, label int, a double"), "svm", ["a"], "id")


def test_training_leaves_no_table_behind(spark, sf):
    """Samples, training rows, blocks and folds go when no later pass reads them."""
    import os

    from crashlens.plans import queries_ml
    from crashlens.session import checkpoint_dir

    rows = queries_ml.labelled(spark, sf)
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    ml.compare_models(rows, queries_ml.feature_names(rows), "row_id", 2, {"mlp": {"mlp_iter": 3}, "lr": {"lr_iter": 3}, "rf": {"num_trees": 3}, "gbt": {"gbt_iter": 2}}).collect()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert not left & {"smote", "neighbours", "neighbour-cells", "neighbour-bounds", "training", "blocks", "labelled", "folds", "held-out"}
