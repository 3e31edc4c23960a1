"""Profiling and EDA tables.

Wide profiles are computed as ONE aggregate over all columns (a single scan
with partial aggregation), then turned into long form by exploding an array
of per-column structs of that one row.  No per-column jobs, no collect.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crashlens.functions.expr import attach_one_row, numeric_fields
from crashlens.operators.quantiles import KEYS, quantile_columns, quantiles, value_counts
from crashlens.session import stored

# Category orders of the notebook charts.
WEEKDAY_ORDER = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTH_SHORT = {1: "Jan", 2: "Feb", 3: "Mar", 4: "Apr", 5: "May", 6: "Jun"}
CATEGORICAL_FEATURES = ("weather_conditions_label", "light_conditions_label", "road_surface_conditions_label",
                        "road_type_label", "vehicle_type_label")


def _long(one_row: DataFrame, items: Sequence[tuple[str, dict[str, Column]]]) -> DataFrame:
    """Explode a one-row aggregate into one row per item."""
    structs = [F.struct(F.lit(name).alias("column_name"), *[c.alias(k) for k, c in cols.items()])
               for name, cols in items]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def missing_pct(df: DataFrame) -> DataFrame:
    """Q8: share of NULLs per column (%), as (column_name, missing_pct)."""
    agg = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}")
                                                   for i, c in enumerate(df.columns)])
    n = F.col("__n").cast("double")
    return _long(agg, [(c, {"missing_pct": F.round((n - F.col(f"c{i}")) / n * 100, 6)})
                       for i, c in enumerate(df.columns)])


def minus_one_counts(df: DataFrame, value=-1) -> DataFrame:
    """Q9: rows equal to -1 per numeric column (pandas ``(df == -1).sum()``)."""
    nums = numeric_fields(df)
    agg = df.agg(*[F.count_if(F.col(c) == value).alias(f"c{i}") for i, c in enumerate(nums)])
    return _long(agg, [(c, {"minus1_count": F.col(f"c{i}").cast("bigint")}) for i, c in enumerate(nums)])


def describe_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """Q10 (numeric part of ``describe``): count, mean, std, min, quartiles, max.

    ``exact`` gives ``percentile`` values (linear interpolation) from counted values
    (:func:`quantile_columns`); ``exact=False`` uses ``percentile_approx``.
    """
    nums = numeric_fields(df)
    aggs = []
    for i, c in enumerate(nums):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}"))
    agg = df.agg(*aggs)
    if exact:
        agg = attach_one_row(agg, quantile_columns(df, nums, [0.25, 0.5, 0.75]))
    return _long(agg, [(c, {
        "count": F.col(f"n{i}"), "mean": F.round(F.col(f"m{i}"), 6), "std": F.round(F.col(f"s{i}"), 6),
        "min": F.col(f"lo{i}"), "q25": F.round(F.col(f"q{i}")[0], 6), "q50": F.round(F.col(f"q{i}")[1], 6),
        "q75": F.round(F.col(f"q{i}")[2], 6), "max": F.col(f"hi{i}")}) for i, c in enumerate(nums)])


def text_value_counts(df: DataFrame) -> DataFrame:
    """column_name, value, c: how often each value of the columns that are not numbers
    occurs, NULLs included; values as text.  Counts of several inputs merge by
    :func:`merged_counts`, so a profile can be kept up to date."""
    nums = set(numeric_fields(df))
    names = [c for c in df.columns if c not in nums]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, c bigint")
    entries = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)]
    counted = df.select(F.explode(F.array(*entries)).alias("r")).select("r.*").groupBy("i", "value").agg(F.count(F.lit(1)).alias("c"))
    return counted.select(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("column_name"), "value", "c")


def merged_counts(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("column_name", "value").agg(F.sum("c").alias("c"))


def describe_text(counts: DataFrame) -> DataFrame:
    """Q10 (text part of ``describe``) from :func:`text_value_counts`: count, unique, top and
    freq; of equally frequent values the smallest is top.  A column of NULLs has no top."""
    some = F.col("value").isNotNull()
    best = F.min(F.when(some, F.struct((-F.col("c")).alias("less"), "value")))
    per = counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(some, F.col("c"))), F.lit(0)).alias("count"), F.count("value").alias("unique"), best.alias("best"))
    return per.select("column_name", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.less")).alias("freq"))


def describe_all(df: DataFrame) -> DataFrame:
    """Q10: ``describe(include='all')``, one row per column; the fields of the other kind are NULL."""
    text = describe_text(text_value_counts(df))
    if not numeric_fields(df):
        return text
    return describe_numeric(df).unionByName(text, allowMissingColumns=True)


def dtype_family(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(dt, T.NumericType):
        return "float"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "object"


def dtypes_table(df: DataFrame):
    """Q11: column types grouped with counts (schema metadata only)."""
    groups: dict[str, list[str]] = {}
    for f in df.schema.fields:
        groups.setdefault(dtype_family(f.dataType), []).append(f.name)
    rows = [(k, ", ".join(v), len(v)) for k, v in groups.items()]
    return df.sparkSession.createDataFrame(rows, "data_type string, column_names string, number_of_columns int")


def _value_key(f: T.StructField) -> dict[str, Column]:
    """Encoding of a value for exact distinct counting: whole numbers, dates and
    timestamps as bigint (all 64 bits count), other numbers as double, text as text."""
    c = F.col(f"`{f.name}`")
    dt = f.dataType
    whole, real, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dt, T.TimestampNTZType):  # no zone: day and time of day apart
        whole = F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000 + (
            F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    elif isinstance(dt, T.TimestampType):
        whole = F.unix_micros(c)
    elif isinstance(dt, T.DateType):
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        whole = c.cast("bigint")
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        real = c.cast("double")
    else:
        text = c.cast("string")
    return {"vl": whole, "vn": real, "vs": text}


def feature_overview(df: DataFrame, max_missing: float = 0.2, max_unique: int = 20,
                     exact: bool = True) -> DataFrame:
    """Q12: dtype, distinct values, missing count and rate, keep flag.

    One run: every row is unpivoted to (column index, value) pairs, NULLs as a pair
    of their own; a hash aggregate on (index, value) collapses repeated values
    map-side, and a second aggregate per column gives the distinct and the missing
    count.  ``exact=False`` uses HyperLogLog in a plain aggregate instead.
    """
    cols = df.columns
    fams = {f.name: dtype_family(f.dataType) for f in df.schema.fields}
    meta = df.sparkSession.createDataFrame([(i, c, fams[c]) for i, c in enumerate(cols)],
                                           "__i int, column_name string, dtype string")
    if exact:
        entries = [F.struct(F.lit(i).alias("__i"), *[v.alias(k) for k, v in _value_key(f).items()])
                   for i, f in enumerate(df.schema.fields)]
        pairs = df.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
        some = F.coalesce(F.col("vl").isNotNull() | F.col("vn").isNotNull() | F.col("vs").isNotNull(), F.lit(False))
        per = (pairs.groupBy("__i", "vl", "vn", "vs").agg(F.count(F.lit(1)).alias("__c")).withColumn("__some", some)
               .groupBy("__i").agg(F.count_if("__some").alias("n_unique"),
                                   F.sum(F.when(F.col("__some"), 0).otherwise(F.col("__c"))).alias("n_missing"),
                                   F.sum("__c").alias("__n")))
    else:
        agg = df.agg(F.count(F.lit(1)).alias("__n"),
                     *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)],
                     *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(cols)])
        per = agg.select("__n", F.explode(F.array(*[
            F.struct(F.lit(i).alias("__i"), F.col(f"u{i}").alias("n_unique"), (F.col("__n") - F.col(f"c{i}")).alias("n_missing"))
            for i in range(len(cols))])).alias("r")).select("__n", "r.*")
    # one row per column of the table
    stats = meta.join(F.broadcast(per), "__i", "left").fillna(0, subset=["n_unique", "n_missing", "__n"])
    rate = F.col("n_missing").cast("double") / F.nullif(F.col("__n").cast("double"), F.lit(0.0))
    return stats.select("column_name", "dtype", "n_unique", "n_missing", F.round(rate, 6).alias("missing_rate"),
                        ((rate < max_missing) & (F.col("n_unique") < max_unique)).alias("keep"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Q13: rows that repeat an earlier identical row (NULLs compare equal).

    A row's hash goes through the shuffle first; only rows whose hash occurs again are
    then compared by all columns, so few repeats cost few bytes."""
    df = stored(df, "rows")  # read twice
    cols = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("__hash", F.xxhash64(*cols))
    again = stored(hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__hash"), "repeated")
    per = hashed.join(again, "__hash", "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return per.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def iqr_outliers(df: DataFrame, k: float = 1.5) -> DataFrame:
    """Q14: values outside [q1 - k*IQR, q3 + k*IQR] per numeric column, from the
    counted values (one run of the input)."""
    nums = numeric_fields(df)
    counts = value_counts(df.select(*nums), nums)
    per = fenced(counts, k, [0.25, 0.75]).groupBy("feature").agg(
        F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.sum(F.when(~F.col("inside"), F.col("c")).otherwise(0)).alias("o"))
    named = df.sparkSession.createDataFrame([(c,) for c in nums], "column_name string")
    return named.join(per, F.col("column_name") == F.col("feature"), "left").select(
        "column_name", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), F.coalesce("o", F.lit(0)).cast("bigint").alias("outlier_count"))


def fenced(counts: DataFrame, k: float, probs: Sequence[float]) -> DataFrame:
    """Counted values with their group's quartiles and whether they lie within the fences.
    ``probs`` starts with the lower and ends with the upper quartile."""
    q = quantiles(counts, probs)
    j = counts.join(q, list(KEYS)).withColumns({"q1": F.col("q")[0], "q3": F.col("q")[len(probs) - 1]})
    reach = k * (F.col("q3") - F.col("q1"))
    return j.withColumn("inside", (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach))


def merge_entity_counts(merged: DataFrame) -> DataFrame:
    """Q15: distinct accidents, vehicle and casualty rows after the merge."""
    return merged.agg(
        F.count_distinct("collision_index").alias("unique_accidents"),
        F.count("vehicle_reference").alias("vehicle_records"),
        F.count("casualty_reference").alias("casualty_records"),
    ).select("*",
             F.round(F.col("vehicle_records") / F.col("unique_accidents"), 6).alias("vehicles_per_accident"),
             F.round(F.col("casualty_records") / F.col("unique_accidents"), 6).alias("casualties_per_accident"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Q16: rows per class and share of all rows."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("__t"))
    return attach_one_row(g, tot).select(label, "n", F.round(F.col("n") / F.col("__t"), 6).alias("share"))


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q17: Pearson correlation of every column pair, one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.round(F.col(f"r{i}"), 6).alias("corr"))
               for i, (a, b) in enumerate(pairs)]
    return agg.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q17: variance inflation factors = diagonal of the inverse correlation
    matrix.  Spark computes the k x k matrix (one aggregate); only that k x k
    matrix reaches the driver for the inversion."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vec = VectorAssembler(inputCols=list(cols), outputCol="__v", handleInvalid="skip").transform(
        df.select(*[F.col(c).cast("double") for c in cols]))
    m = Correlation.corr(vec, "__v").first()[0].toArray()
    inv = np.linalg.pinv(m)
    rows = [(c, float(inv[i, i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def categorical_frequencies(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Value counts of several categoricals in one pass: unpivot to
    (feature, value) and count; NULLs are dropped like ``value_counts``."""
    present = [c for c in features if c in df.columns]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                         for c in present])).alias("r")).select("r.*")
    return long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def severity_by_hour(df: DataFrame, hour: str = "hour", label: str = "casualty_severity_label",
                     classes=("Fatal", "Serious", "Slight")) -> DataFrame:
    """Hour x severity counts with 0 for missing cells (pivot on fixed values)."""
    return (df.filter(F.col(label).isNotNull() & F.col(hour).isNotNull())
            .groupBy(hour).pivot(label, list(classes)).agg(F.count(F.lit(1))).fillna(0, subset=list(classes)))


def ordered_counts(df: DataFrame, col: str, order: Sequence, out: str = "category") -> DataFrame:
    """Counts in a fixed category order; absent categories give NULL."""
    spark = df.sparkSession
    cats = spark.createDataFrame([(i, v) for i, v in enumerate(order)], f"position int, {out} string")
    # only listed categories are counted, so the counts have at most len(order) rows
    v = F.col(col).cast("string")
    counts = df.filter(v.isin(*order)).groupBy(v.alias(out)).agg(F.count(F.lit(1)).alias("n"))
    return cats.join(F.broadcast(counts), out, "left").select(out, "position", "n")


def weekday_counts(df: DataFrame, day: str = "day") -> DataFrame:
    return ordered_counts(df, day, WEEKDAY_ORDER, "weekday")


def month_counts(df: DataFrame, month: str = "month") -> DataFrame:
    short = F.date_format(F.make_date(F.lit(2000), F.col(month), F.lit(1)), "MMM")
    named = df.filter(F.col(month).isin(*MONTH_SHORT)).select(short.alias("__m"))
    return ordered_counts(named, "__m", list(MONTH_SHORT.values()), "month_name")


def severity_by_category(df: DataFrame, features: Sequence[str], label: str = "casualty_severity_label") -> DataFrame:
    """(feature, value, severity) counts for several categoricals, one pass."""
    present = [c for c in features if c in df.columns]
    long = df.select(F.col(label).alias("severity"),
                     F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                         for c in present])).alias("r")).select("r.*", "severity")
    return (long.filter(F.col("value").isNotNull() & F.col("severity").isNotNull())
            .groupBy("feature", "value", "severity").agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), from the counted values
    (one run of the input)."""
    vals = value_counts(df, [col]).select("x", "c")
    mm = vals.agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    w = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(w == 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("__lo")) / w), F.lit(bins - 1)))
    j = attach_one_row(vals, mm).select(b.cast("int").alias("bin"), "c", "__lo", "__hi")
    return j.groupBy("bin").agg(
        F.round(F.first("__lo") + F.col("bin") * (F.first("__hi") - F.first("__lo")) / bins, 6).alias("bin_start"),
        F.sum("c").alias("n"))


def boxplot_stats(df: DataFrame, cols: Sequence[str], group: str | None = None, k: float = 1.5,
                  with_all: bool = False) -> DataFrame:
    """Quartiles, whiskers (furthest values within k*IQR) and outliers,
    per column and group ('ALL' without a group; ``with_all`` adds the 'ALL'
    rows to a grouped run), all from the counted values."""
    counts = value_counts(df, cols, group, with_all)
    inside = F.when(F.col("inside"), F.col("x"))
    return fenced(counts, k, [0.25, 0.5, 0.75]).groupBy(*KEYS).agg(
        F.round(F.first("q1"), 6).alias("q1"), F.round(F.first(F.col("q")[1]), 6).alias("median"),
        F.round(F.first("q3"), 6).alias("q3"), F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
        F.sum(F.when(~F.col("inside"), F.col("c")).otherwise(0)).cast("bigint").alias("outliers"))
