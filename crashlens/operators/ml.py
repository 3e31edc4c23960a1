"""Severity classification.

Data preparation, class weights, folds, resampling and metrics are DataFrame jobs.
The folds of a cross-validation are models that are prepared and fitted side by side:
a row belongs to the models whose fold it is not in, medians, scales, class counts and
SMOTE samples of all folds come from one job each, and the trainers (``boosting``,
``forest``, ``network``) make one pass over all rows for all folds.  The driver only
steers; it holds models of the size of their parameters, never rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from crashlens.functions.expr import attach_one_row, numeric_fields
from crashlens.operators import boosting, forest, neighbours, network
from crashlens.operators.blocks import Block, blocks, packed, released, summed
from crashlens.operators.cleaning import encode_target, median_impute
from crashlens.operators.quantiles import KEYS, counted, in_order, quantiles
from crashlens.operators.ranking import hash_ranks
from crashlens.session import discard, stored

LABEL = "label"
SEED = 42


def training_matrix(rows: DataFrame, features: Sequence[str], target: str = "casualty_severity",
                    id_cols: Sequence[str] = ()) -> DataFrame:
    """M1: available numeric features, -1 -> median (over all rows, as the loader),
    target filter 1..3 and encoding 0..2."""
    present = [c for c in numeric_fields(rows.select(*[c for c in features if c in rows.columns])) if c != target]
    base = rows.select(*id_cols, *present, target)
    imputed = median_impute(base, present)
    return encode_target(imputed, target, LABEL).drop(target)


def labelled_rows(rows: DataFrame, features: Sequence[str], target: str = "casualty_severity",
                  id_cols: Sequence[str] = ()) -> DataFrame:
    """The rows of :func:`training_matrix` with NULL for missing values: the input of
    cross-validation, where the medians are fitted inside the folds."""
    present = [c for c in numeric_fields(rows.select(*[c for c in features if c in rows.columns])) if c != target]
    values = [F.when(F.col(c) != -1, F.col(c).cast("double")).alias(c) for c in present]
    return encode_target(rows.select(*id_cols, *values, target), target, LABEL).drop(target)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """M2: balanced weights n / (k * n_c)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return attach_one_row(g, tot).select(
        label, "n", (F.col("__t") / (F.col("__k") * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label)  # one row per class: bounded by the label domain


def standard_scale(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = ()) -> DataFrame:
    """M3: (x - mean) / population std per feature (one aggregate row)."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    j = attach_one_row(df, stats)
    return j.select(*id_cols, *[((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)))
                                .alias(c) for c in cols], *([LABEL] if LABEL in df.columns else []))


def _id_hash(id_col: str, seed: int):
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))


def stratified_folds(df: DataFrame, id_col: str, k: int = 5, seed: int = SEED, label: str = LABEL,
                     bits: int = 16) -> DataFrame:
    """M9: exact stratified k-fold assignment, shuffled by a seeded hash: a row's
    rank in its class modulo k, so every fold holds n_c // k or n_c // k + 1 rows
    of each class."""
    ranked = class_rank(df, id_col, label, seed, bits)
    return ranked.withColumn("fold", (F.col("class_rank") % k).cast("int")).drop("class_rank")


def class_rank(df: DataFrame, id_col: str, label: str = LABEL, seed: int = SEED, bits: int = 16, within: Sequence[str] = ()) -> DataFrame:
    """``class_rank``: the row's rank in its class (of its group ``within``) in the order of a seeded hash of its id."""
    return hash_ranks(df, [*within, label], _id_hash(id_col, seed), [id_col], "class_rank", bits)


def macro_metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Macro precision / recall / F1 over the classes seen in labels or
    predictions; an undefined ratio counts as 0."""
    conf = pred.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    return metrics_of(conf)


def metrics_of(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`macro_metrics` of confusion counts (y, p, n), for each group of ``by``."""
    by = list(by)
    sides = F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                             F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
                    F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                             F.lit(0).cast("long").alias("tp")))
    cls = conf.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").groupBy(*by, "c").agg(
        *[F.sum(x).alias(x) for x in ("support", "predicted", "tp")])
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    f1 = share(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return cls.groupBy(*by).agg(F.avg(f1).alias("f1_macro"), F.avg(share(F.col("tp"), F.col("support"))).alias("recall_macro"),
                                F.avg(share(F.col("tp"), F.col("predicted"))).alias("precision_macro"))


# ---- SMOTE ------------------------------------------------------------------
def smote(df: DataFrame, features: Sequence[str], id_col: str, k: int = 5, seed: int = SEED,
          label: str = LABEL, within: str | None = None, **search) -> DataFrame:
    """M8: raise every class to the majority count with SMOTE samples, in each group of the
    integer column ``within`` by itself (all groups in the same jobs).

    Class rank r gets ``need // n_c + (r < need % n_c)`` new rows, so the number is
    exact.  Each lies between its row and one of the row's k nearest
    (``neighbours.nearest``, exact), drawn by hashes of the id, so repeated tasks make the same
    rows.  A row without neighbours is repeated.
    """
    cols, groups = list(features), [within] if within else []
    # read many times below: the input's plan runs once
    typed = stored(df.select(F.col(id_col).cast("string").alias(id_col), F.col(label).cast("int").alias(label), *[F.col(g).cast("int").alias(g) for g in groups],
                             *[F.col(c).cast("double").alias(c) for c in cols]), "smote")
    counts = typed.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("__nc"))
    most = counts.groupBy(*groups).agg(F.max("__nc").alias("__nmax"))
    plan = counts.join(most, groups) if within else attach_one_row(counts, most)
    plan = plan.select(*groups, label, "__nc", (F.col("__nmax") - F.col("__nc")).alias("__need"))
    short = typed.join(F.broadcast(plan.filter(F.col("__need") > 0)), [*groups, label])  # one row per class
    ranked = class_rank(short, id_col, label, seed, within=groups)
    copies = (F.floor(F.col("__need") / F.col("__nc")) + F.when(F.col("class_rank") < F.col("__need") % F.col("__nc"), 1).otherwise(0)).cast("int")
    # a class of a group is a class of its own, a row of a group a row of its own
    group = F.col(within).cast("long") if within else F.lit(0).cast("long")
    own = F.concat_ws(":", *groups, id_col)
    apart = short.select(own.alias("__own"), (group * (1 << 32) + F.col(label)).alias("__class"), *cols)
    near = neighbours.nearest(apart, cols, "__own", k, seed, "__class", **search)
    wanted = ranked.withColumn("__copies", copies).filter(F.col("__copies") > 0).withColumn("__own", own).join(near, "__own", "left")
    each = wanted.withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    pick = F.pmod(F.xxhash64(id_col, "__j", F.lit(seed)), F.greatest(F.size("near"), F.lit(1))).cast("int")
    share = F.shiftrightunsigned(F.xxhash64(id_col, "__j", F.lit(seed + 1)), 11) / F.lit(float(1 << 53))
    each = each.withColumn("__x", F.get("near", pick)["x"]).withColumn("__u", share)
    synth = each.select(F.concat(F.col(id_col), F.lit("#s"), F.col("__j").cast("string")).alias(id_col), label, *groups,
                        *[F.coalesce(F.col(c) + F.col("__u") * (F.get("__x", F.lit(i)) - F.col(c)), F.col(c)).alias(c)
                          for i, c in enumerate(cols)])
    return typed.unionByName(synth)


# ---- estimators ---------------------------------------------------------------
USES_SMOTE = {"mlp", "gbt"}
SCALED = {"lr", "mlp"}
MODELS = ("lr", "rf", "mlp", "gbt")
#: Rows of a file of the folds, about.
FILE_ROWS = 131_072
#: Units of the hidden layer, weight of the squared weights of the two gradient models.
HIDDEN, RIDGE = 50, {"lr": 1.0, "mlp": 0.001}


@dataclass
class Preparation:
    """Per model (row) and feature (column): median for missing values, mean and deviation."""

    features: tuple[str, ...]
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def of_model(self, table: np.ndarray, i: int) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in table[:, i]]), F.col("model") + 1)

    def values(self, scaled: bool) -> list[Column]:
        filled = [F.coalesce(F.col(c).cast("double"), self.of_model(self.medians, i)) for i, c in enumerate(self.features)]
        if not scaled:
            return [v.alias(c) for v, c in zip(filled, self.features)]
        return [((v - self.of_model(self.means, i)) / self.of_model(self.scales, i)).alias(c) for i, (v, c) in enumerate(zip(filled, self.features))]


def of_others(fold: Column, k: int) -> Column:
    """The models that see a row: those of the other folds."""
    return F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda m: m != fold)


def prepare(rows: DataFrame, features: Sequence[str], models: int, folds: bool = False) -> Preparation:
    """Exact medians, means and deviations of the filled features of the rows of each ``model``,
    all from one count of the values; ``folds``: of the rows whose ``fold`` is another, counted by fold."""
    features = tuple(features)
    blank, at = np.zeros((models, len(features))), {c: i for i, c in enumerate(features)}
    prep = Preparation(features, blank, blank.copy(), blank + 1.0)
    by = "fold" if folds else "model"
    counts = counted(rows, features, by)
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    if folds:
        each = F.explode(of_others(F.col("group_value").cast("int"), models).cast("array<string>")).alias("group_value")
        counts = counts.select("feature", each, "x", "c").groupBy(*KEYS, "x").agg(F.sum("c").alias("c"))
        sizes = {m: sum(n for f, n in sizes.items() if f != m) for m in range(models)}
    counts = in_order(counts)
    for r in quantiles(counts, [0.5]).collect():  # one row per model and feature, as below
        prep.medians[int(r["group_value"]), at[r["feature"]]] = r["q"][0]
    x, c = F.col("x"), F.col("c")
    for r in counts.groupBy("feature", "group_value").agg(F.sum(c).alias("n"), (F.sum(x * c) / F.sum(c)).alias("m"), F.sum(x * x * c).alias("s")).collect():
        i, m = at[r["feature"]], int(r["group_value"])
        n, blanks, median = sizes[m], sizes[m] - r["n"], prep.medians[m, i]
        prep.means[m, i] = (r["m"] * r["n"] + blanks * median) / n
        spread = (r["s"] + blanks * median ** 2) / n - prep.means[m, i] ** 2
        prep.scales[m, i] = np.sqrt(spread) if spread > 1e-12 * (1.0 + prep.means[m, i] ** 2) else 1.0
    return prep


@dataclass
class Fitted:
    """A fitted classifier, or several side by side (one per value of ``model``)."""

    kind: str
    prep: Preparation
    classes: int
    body: boosting.Trees | network.Net | forest.Forest

    def probabilities(self, x: np.ndarray, model: int) -> np.ndarray:
        return (boosting if self.kind == "gbt" else network).probabilities(x, model, self.body)


def train(rows: DataFrame, kind: str, prep: Preparation, id_col: str, num_trees: int = 100, gbt_iter: int = 100, mlp_iter: int = 500,
          lr_iter: int = 1000, limit: int = forest.ROWS) -> Fitted:
    """M4-M7: the estimator of every ``model`` of ``rows`` (features with NULL for missing values, ``label``)."""
    if kind not in MODELS:
        raise ValueError(f"unknown model type: {kind}")
    features, models = list(prep.features), len(prep.medians)
    values = rows.select(F.col(id_col).cast("string").alias("id"), "model", LABEL, *prep.values(kind in SCALED))
    if kind in USES_SMOTE:
        balanced = smote(values, features, "id", within="model")
        values = stored(balanced, "training")
        discard(balanced)  # it reads the tables of its own search alone
    elif kind == "rf":
        values = stored(values, "training")  # bins, ranges and blocks read it
    sizes = values.groupBy("model", LABEL).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    classes = 1 + max((r[LABEL] for r in sizes), default=0)
    counts = np.zeros((models, classes))
    for r in sizes:
        counts[r["model"], r[LABEL]] = r["n"]
    there = np.maximum((counts > 0).sum(1, keepdims=True), 1)
    weights = np.ones_like(counts) if kind in USES_SMOTE else counts.sum(1, keepdims=True) / (there * np.maximum(counts, 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights.ravel()]), F.col("model") * classes + F.col(LABEL) + 1)
    # a forest without large nodes needs no bins
    cuts = boosting.cut_points(values, features, models) if kind == "gbt" or (kind == "rf" and counts.sum(1).max() > limit) else None
    numbered = values.withColumn("weight", weight).withColumn("row", F.xxhash64("id") if kind == "rf" else F.lit(0).cast("long"))  # a forest draws by it
    data = blocks(forest.in_ranges(numbered, "row") if kind == "rf" else numbered, features, LABEL)
    if kind != "lr":
        discard(values)
    try:
        if kind in RIDGE:
            hidden, steps = (HIDDEN, mlp_iter) if kind == "mlp" else (0, lr_iter)
            body = network.fit(data, models, len(features), hidden, classes, RIDGE[kind], steps, seed=SEED)
        elif kind == "gbt":
            body = boosting.fit(data, cuts, classes, gbt_iter)
        else:
            body = forest.fit(data, cuts, models, len(features), classes, rows.sparkSession, num_trees, SEED, limit)
    finally:
        released(data)
    return Fitted(kind, prep, classes, body)


def fit(df: DataFrame, model: str, features: Sequence[str], id_col: str, **params) -> Fitted:
    """Imputer, scaler, resampling or weights and the estimator, in this order, on ``df``
    (features with NULL for missing values, ``label``)."""
    rows = stored(df.select(F.lit(0).alias("model"), id_col, LABEL, *features), "fit")
    return train(rows, model, prepare(rows, features, 1), id_col, **params)


def predict(m: Fitted, df: DataFrame) -> DataFrame:
    """``prediction`` and ``probability`` (an array over the classes) of every row; columns of
    these names are replaced."""
    own = [c for c in df.columns if c not in ("prediction", "probability")]
    names, width = [f"__x{i}" for i in range(len(m.prep.features))], len(m.prep.features)
    features = [v.alias(n) for v, n in zip(m.prep.values(m.kind in SCALED), names)]
    with_model = df.select(*own).withColumn("model", F.lit(0)) if "model" not in own else df.select(*[F.col(c).alias(f"own_{c}" if c == "model" else c) for c in own]).withColumn("model", F.lit(0))
    back = [F.col(f"own_{c}" if c == "model" else c).alias(c) for c in own]
    if m.kind == "rf":
        rows = stored(with_model.withColumn("__row", F.monotonically_increasing_id()), "predict")
        each = rows.select("model", "__row", F.lit(0).alias("y"), F.lit(1.0).alias("w"), *features)
        cells = packed(each, names, "y", "w", "__row").withColumn("part", F.monotonically_increasing_id())
        found = forest.shares(stored(cells, "predict-blocks"), m.body, width)
        return rows.join(found.mapInArrow(_rows_of_shares(m.classes), "__row long, probability array<double>"), "__row").select(
            *back, (F.array_position("probability", F.array_max("probability")) - 1).cast("double").alias("prediction"), "probability")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(n), np.float32) for n in names], 1)
            p = m.probabilities(x, 0) if len(x) else np.zeros((0, m.classes))
            kept = [c for c in batch.schema.names if c not in names]
            arrays = [batch.column(c) for c in kept] + [pa.array(p.argmax(1).astype(float)), pa.array(list(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "prediction", "probability"])

    schema = with_model.select("*").schema.add("prediction", "double").add("probability", ArrayType(DoubleType()))
    return with_model.select("*", *features).mapInArrow(run, schema).select(*back, "prediction", "probability")


def _rows_of_shares(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, s in zip(batch.column("row").to_pylist(), batch.column("share").to_pylist()):
                p = np.frombuffer(s, np.float64).reshape(-1, classes)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r, np.int64)), pa.array(list(p), pa.list_(pa.float64()))], names=["__row", "probability"])
    return run


def confusion(m: Fitted, rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """(model, class, predicted class, rows) of labelled rows of each ``model``."""
    features, classes = list(m.prep.features), max(m.classes, 1 + (rows.agg(F.max(LABEL)).first()[0] or 0))
    values = rows.select("model", LABEL, F.lit(1.0).alias("w"), F.col(LABEL).cast("long").alias("row"), *m.prep.values(m.kind in SCALED))
    if m.kind == "rf":
        cells = stored(packed(values, features, LABEL, "w", "row").withColumn("part", F.monotonically_increasing_id()), "held-out")
        known = m.classes  # not the forest's table

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for model, y, s in zip(*(batch.column(c).to_pylist() for c in ("model", "row", "share"))):
                    p = np.frombuffer(s, np.float64).reshape(-1, known).argmax(1)
                    n = np.bincount(np.frombuffer(y, np.int64) * classes + p, minlength=classes * classes)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model, np.int32)), *(pa.array(v.astype(t)) for v, t in ((at // classes, np.int32), (at % classes, np.int32), (n[at], np.int64)))], names=["model", "y", "p", "n"])

        found = forest.shares(cells, m.body, len(features)).mapInArrow(counted, "model int, y int, p int, n long")
        counts = [tuple(r) for r in found.groupBy("model", "y", "p").agg(F.sum("n")).collect()]  # classes squared
        discard(cells)
        return counts

    data = blocks(values, features, LABEL, "w", "row")

    def add(total: np.ndarray, b: Block) -> None:
        np.add.at(total[b.model], (b.y, m.probabilities(b.x, b.model).argmax(1)), 1)

    try:
        total = summed(data, (len(m.prep.medians), classes, classes), add)
    finally:
        released(data)
    return [(*map(int, at), int(total[at])) for at in zip(*np.nonzero(total))]


def compare_models(df: DataFrame, features: Sequence[str], id_col: str, k: int = 5, params: dict | None = None,
                   models: Sequence[str] = MODELS) -> DataFrame:
    """One row per model with the mean and spread of its metrics over k stratified
    folds.  Everything that learns (medians, scaling, weights, SMOTE, the model) sees the
    other folds only; folds, medians and scales are made once for all models."""
    labelled = stored(df.select(id_col, LABEL, *features), "labelled")  # read twice by the folds
    # many passes read the folds: files of like numbers of rows
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-labelled.count() // FILE_ROWS))
    folded = stored(stratified_folds(labelled, id_col, k).repartition(files, id_col), "folds")
    discard(labelled)
    rows = folded.select("*", F.explode(of_others(F.col("fold"), k)).alias("model"))
    prep = prepare(folded, features, k, folds=True)

    def confusions(name: str) -> list[tuple]:
        fitted = train(rows, name, prep, id_col, **(params or {}).get(name, {}))
        return [(name, *c) for c in confusion(fitted, folded.withColumn("model", F.col("fold")))]

    with ThreadPoolExecutor(len(models)) as pool:  # short passes of one model fill the gaps of another's
        counts = [c for found in pool.map(confusions, models) for c in found]
    discard(folded)
    conf = df.sparkSession.createDataFrame(counts, "model string, fold int, y int, p int, n long")
    per = metrics_of(conf, ["model", "fold"])
    return per.groupBy("model").agg(F.lit(k).alias("folds"), *[a for m in ("f1", "recall", "precision") for a in
                                    (F.avg(f"{m}_macro").alias(f"{m}_cv_mean"), F.stddev_pop(f"{m}_macro").alias(f"{m}_cv_std"))])


def cross_validate(df: DataFrame, model: str, features: Sequence[str], id_col: str, k: int = 5,
                   **params) -> DataFrame:
    """:func:`compare_models` of one model."""
    return compare_models(df, features, id_col, k, {model: params}, [model])


def best_model(metrics: DataFrame, score: str = "f1_cv_mean") -> DataFrame:
    """O3: the model with the highest score (ties: smallest name)."""
    highest = metrics.agg(F.max(score).alias("__best"))
    return (attach_one_row(metrics, highest).filter(F.col(score) == F.col("__best"))
            .agg(F.min("model").alias("best_model"), F.max(score).alias(f"best_{score}")))


def save_model(m: Fitted, path: str, model: str, spark) -> None:
    """The fitted model and its type; a forest's subtrees are a table beside them."""
    if m.kind == "rf":
        m.body.subtrees.write.mode("overwrite").parquet(f"{path}/trees")
    small = replace(m, body=replace(m.body, subtrees=None)) if m.kind == "rf" else m
    spark.createDataFrame([(model, bytearray(pickle.dumps(small)))], "model_type string, model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_model(path: str, spark) -> tuple[Fitted, str]:
    """(model, model type)."""
    r = spark.read.schema("model_type string, model binary").parquet(f"{path}/model").first()
    m = pickle.loads(bytes(r["model"]))
    if m.kind == "rf":
        m = replace(m, body=replace(m.body, subtrees=spark.read.parquet(f"{path}/trees")))
    return m, r["model_type"]
