"""Evaluation of five-class scores. Rows collapse to small count tables first."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

CLASSES = 5
EPSILON = sys.float_info.epsilon
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


def scored(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """Predicted class (first maximum), probability of levels 3 and 4, and the collection flag."""
    p = F.col("probabilities")
    predicted = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    urgent = p[3] + p[4]
    flag = predicted >= 3 if threshold is None else urgent >= threshold
    return rows.withColumns({"predicted_fill_level": predicted, "needs_collection_probability": urgent, "needs_collection": flag})


def probability_audit(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.size(p) != CLASSES).alias("wrong_length"), F.count_if(bad).alias("out_of_range"),
        F.count_if(F.abs(total - 1) > tolerance).alias("sum_not_one"),
    )


def _loss() -> Column:
    p = F.element_at("probabilities", F.col("fill_level") + 1)
    return -F.ln(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0)))


def counts(rows: DataFrame, groups: list[str] = [], threshold: float | None = None) -> DataFrame:
    """Rows per group, true class, predicted class and flag, with their summed log loss."""
    s = scored(rows, threshold).withColumn("loss", _loss())
    return s.groupBy(*groups, F.col("fill_level").alias("y"), F.col("predicted_fill_level").alias("p"), F.col("needs_collection").alias("flag")).agg(
        F.count("*").alias("n"), F.sum("loss").alias("loss")
    )


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """All 25 cells with counts and the share of their true class."""
    n = cells.groupBy("y", "p").agg(F.sum("n").alias("n"))
    every = cells.sparkSession.range(CLASSES * CLASSES).select((F.col("id") / CLASSES).cast("int").alias("y"), (F.col("id") % CLASSES).cast("int").alias("p"))
    full = every.join(n, ["y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    support = full.groupBy("y").agg(F.sum("n").alias("support"))
    return full.join(support, "y").withColumn("share", F.when(F.col("support") > 0, F.col("n") / F.col("support")).otherwise(0.0)).drop("support")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(cells: DataFrame, groups: list[str] = []) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is empty."""
    kinds = F.explode(F.array(*[F.lit(i) for i in range(CLASSES)]))
    c = F.col("class")
    per = cells.withColumn("class", kinds).groupBy(*groups, "class").agg(
        F.sum(F.when((F.col("y") == c) & (F.col("p") == c), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("p") == c, F.col("n")).otherwise(0)).alias("predicted"),
    )
    per = per.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support"))})
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.withColumn("f1", f1).select(*groups, "class", "precision", "recall", "f1", "support", "predicted")


def class_summary(cells: DataFrame, groups: list[str] = []) -> DataFrame:
    per = class_metrics(cells, groups)
    n = F.sum("support")
    return per.groupBy(*groups).agg(
        n.alias("rows"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"),
    )


def ordinal_metrics(cells: DataFrame, groups: list[str] = []) -> DataFrame:
    """Mean absolute class error, share of errors of two or more, quadratic weighted kappa."""
    d = F.abs(F.col("y") - F.col("p"))
    obs = cells.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * d).alias("e1"), F.sum(F.col("n") * d * d).alias("e2"),
        F.sum(F.when(d >= 2, F.col("n")).otherwise(0)).alias("severe"),
        *[F.sum(F.when(F.col(side) == i, F.col("n")).otherwise(0)).alias(f"{side}{i}") for side in ("y", "p") for i in range(CLASSES)],
    )
    expected = reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"p{j}") * float((i - j) ** 2) for i in range(CLASSES) for j in range(CLASSES)]) / F.col("n")
    return obs.select(
        *groups, (F.col("e1") / F.col("n")).alias("mean_absolute_class_error"), (F.col("severe") / F.col("n")).alias("severe_error_rate"),
        F.when(expected != 0, 1 - F.col("e2") / expected).alias("quadratic_weighted_kappa"),
    )


def log_loss(cells: DataFrame, groups: list[str] = []) -> DataFrame:
    return cells.groupBy(*groups).agg((F.sum("loss") / F.sum("n")).alias("log_loss"), F.sum("n").alias("rows"))


def binary_metrics(cells: DataFrame, groups: list[str] = []) -> DataFrame:
    """Collection needed (class 3 or 4) against the flag."""
    yes, flag = F.col("y") >= 3, F.col("flag")
    part = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    t = cells.groupBy(*groups).agg(part(yes & flag).alias("tp"), part(~yes & flag).alias("fp"), part(yes & ~flag).alias("fn"), part(~yes & ~flag).alias("tn"))
    return _binary_rates(t)


def _binary_rates(t: DataFrame) -> DataFrame:
    t = t.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return t.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def threshold_curve(rows: DataFrame) -> DataFrame:
    """Binary figures at 19 thresholds. Rows are counted per threshold band once, then summed upwards."""
    s = scored(rows)
    band = reduce(lambda a, b: a + b, [(F.col("needs_collection_probability") >= t).cast("int") for t in THRESHOLDS])
    bands = s.groupBy(band.alias("band"), (F.col("fill_level") >= 3).alias("yes")).agg(F.count("*").alias("n"))  # at most 40 rows
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS)]))
    flag, yes = F.col("band") >= F.col("t.k"), F.col("yes")
    part = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    table = bands.withColumn("t", steps).groupBy(F.col("t.threshold").alias("threshold")).agg(
        part(yes & flag).alias("tp"), part(~yes & flag).alias("fp"), part(yes & ~flag).alias("fn"), part(~yes & ~flag).alias("tn")
    )
    return _binary_rates(table)


def best_threshold(curve: DataFrame) -> DataFrame:
    """Highest F1; ties to the threshold nearest 0.5, then the lowest."""
    return curve.orderBy(F.desc("f1"), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


GROUP_COLUMNS = ["date", "waste_type", "capacity_range", "input_quality_flag"]


def group_metrics(rows: DataFrame, columns: list[str] = GROUP_COLUMNS, threshold: float | None = None) -> DataFrame:
    """All headline metrics by every value of every group column, from one pass over the rows."""
    cells = counts(rows, columns, threshold)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("group"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value")) for c in columns]))
    long = cells.select(pairs.alias("g"), "y", "p", "flag", "n", "loss").select("g.group", "g.value", "y", "p", "flag", "n", "loss")
    key = ["group", "value"]
    slim = long.groupBy(*key, "y", "p", "flag").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    b = binary_metrics(slim, key).select(*key, F.col("f1").alias("needs_collection_f1"))
    return class_summary(slim, key).join(ordinal_metrics(slim, key), key).join(log_loss(slim, key).drop("rows"), key).join(b, key)


# --- baselines ---------------------------------------------------------------------

BASELINE_KEYS = ["waste_type", "capacity_range", "object_group"]


def group_medians(train: DataFrame, keys: list[str] = BASELINE_KEYS) -> DataFrame:
    """Median label per group. Labels are counted first: at most five rows per group reach the median."""
    n = train.where(F.col("fill_level").isNotNull()).groupBy(*keys, "fill_level").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.percentile("fill_level", 0.5, F.col("n")).alias("group_median"))


def majority_class(train: DataFrame) -> DataFrame:
    """One row: the most frequent label (lowest on ties) and the cumulative class shares."""
    n = train.where(F.col("fill_level").isNotNull()).groupBy("fill_level").agg(F.count("*").alias("n"))
    at = lambda i: F.coalesce(F.sum(F.when(F.col("fill_level") == i, F.col("n"))), F.lit(0))
    one = n.agg(F.max(F.struct("n", (-F.col("fill_level")).alias("neg"))).alias("m"), *[at(i).alias(f"n{i}") for i in range(CLASSES)])
    total = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(CLASSES)])
    cumulative = [reduce(lambda a, b: a + b, [F.col(f"n{j}") for j in range(i + 1)]) / total for i in range(CLASSES)]
    return one.select((-F.col("m.neg")).cast("int").alias("majority"), F.array(*cumulative).alias("cumulative"))


def baseline_predictions(rows: DataFrame, train: DataFrame, uniform: Column, keys: list[str] = BASELINE_KEYS) -> DataFrame:
    """Majority, hash-drawn prior class, previous rating and group median, side by side."""
    out = rows.withColumn("draw", uniform).join(majority_class(train), F.lit(True))  # one-row frame
    med = group_medians(train, keys)
    renamed = med.withColumnsRenamed({k: f"m_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys])
    out = out.join(renamed, cond, "left").drop(*[f"m_{k}" for k in keys])
    drawn = F.least(F.size(F.filter("cumulative", lambda c: c < F.col("draw"))), F.lit(CLASSES - 1))
    ordinal = lambda c: F.floor(c + 0.5).cast("int")
    return out.withColumns(
        {
            "dummy_most_frequent": F.col("majority"), "dummy_stratified": drawn,
            "previous_rating": F.coalesce(ordinal(F.col("previous_worker_rating")), F.col("majority")),
            "training_group_median": F.coalesce(ordinal(F.col("group_median")), F.col("majority")),
        }
    ).drop("majority", "cumulative", "group_median", "draw")


def model_choice(figures: DataFrame) -> DataFrame:
    """The model with the best validation score and its threshold."""
    return figures.agg(F.max_by(F.struct("model", "threshold", "f1"), F.struct("f1", "model")).alias("m")).select("m.*")


def prediction_audit(predictions: DataFrame, labels: DataFrame, stored_accuracy: float) -> DataFrame:
    """Coverage, uniqueness, argmax consistency and agreement with a stored pooled score."""
    keys = ["bin_id", "date"]
    n = predictions.groupBy(*keys).agg(F.count("*").alias("n"))
    cover = labels.select(*keys).join(n, keys, "full")
    p = F.col("probabilities")
    argmax = F.array_position(p, F.array_max(p)) - 1
    figures = predictions.agg(
        F.count_if(argmax != F.col("predicted_fill_level")).alias("argmax_mismatch"),
        F.avg((F.col("fill_level") == F.col("predicted_fill_level")).cast("double")).alias("accuracy"),
    )
    return (
        n.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
        .join(cover.agg(F.count_if(F.col("n").isNull()).alias("missing_keys")), F.lit(True))
        .join(figures, F.lit(True))
        .withColumn("score_matches", F.abs(F.col("accuracy") - F.lit(stored_accuracy)) < 1e-9)
    )
