"""Next-day fill models with Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.util import inheritable_thread_target

from wastelake.functions import hashing as H
from wastelake.operators.model import forest as FO, metrics as M
from wastelake.operators.model.sampling import bottom_k
from wastelake.session import materialize

RARE = 5
CLASSES = 5
#: Values of a category that get a column of their own, the most frequent ones; bounds the width of the inputs.
VALUES = 1000
#: Labelled rows per fold that a search fits on, drawn by hash; fits that run at a time.
TUNING_ROWS, POOL = 20_000, 8
MISSING, RARE_VALUE = "__MISSING__", "__RARE__"


@dataclass(frozen=True)
class Preparation:
    """What the training rows say about the inputs: a median per number, the common values per category."""

    medians: dict[str, float]
    common: dict[str, list[str]]

    def apply(self, rows: DataFrame) -> DataFrame:
        """Numbers filled with the training median plus a missing indicator each; rare and new categories folded to one value."""
        out = {}
        for c, median in self.medians.items():
            out[f"{c}_filled"] = F.coalesce(F.col(c).cast("double"), F.lit(median))
            out[f"{c}_missing"] = F.col(c).isNull().cast("double")
        for c, values in self.common.items():
            text = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            out[f"{c}_text"] = F.when(text.isin(values), text).otherwise(RARE_VALUE)
        return rows.withColumns(out).withColumn("label", F.col("fill_level").cast("double"))


def prepare(train: DataFrame, numeric: list[str], categorical: list[str], rare: int = RARE, values: int = VALUES) -> Preparation:
    """Every input stays: a number without any training value is filled with 0, a category seen fewer than `rare` times is folded.

    So are all but the `values` most frequent ones of a category (ties by value).
    """
    medians = train.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in numeric]).first()
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in categorical]))
    counted = train.select(pairs.alias("f")).groupBy("f.feature", "f.value").agg(F.count("*").alias("n")).where(F.col("n") >= rare)
    place = F.row_number().over(W.partitionBy("feature").orderBy(F.col("n").desc(), "value"))
    seen = counted.withColumn("place", place).where(F.col("place") <= values).groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()
    common = {c: [] for c in categorical} | {r["feature"]: r["values"] for r in seen}
    return Preparation({c: 0.0 if medians[c] is None else float(medians[c]) for c in numeric}, common)


def encoding_stages(numeric: list[str], categorical: list[str]) -> list:
    return [
        StringIndexer(inputCols=[f"{c}_text" for c in categorical], outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_vec" for c in categorical], handleInvalid="keep"),
        VectorAssembler(inputCols=[*[f"{c}_filled" for c in numeric], *[f"{c}_missing" for c in numeric], *[f"{c}_vec" for c in categorical]], outputCol="features"),
    ]


@dataclass(frozen=True)
class FillModel:
    preparation: Preparation
    pipeline: PipelineModel
    forest: FO.Forest | None = None


def with_class_weights(train: DataFrame) -> DataFrame:
    """Weights inverse to the class frequency; one small joined table."""
    n = train.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    w = n.join(total, F.lit(True)).select("label", (F.col("total") / (F.col("k") * F.col("n"))).alias("class_weight"))
    return train.join(w, "label")


def estimator(kind: str, balanced: bool = True, **params):
    """A forest or a multinomial logistic regression over encoded rows."""
    weight = {"weightCol": "class_weight"} if balanced else {}
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", seed=H.SEED, maxMemoryInMB=512, **weight, **params)
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", **weight, **params)
    raise ValueError(f"unknown model {kind!r}")


def labelled(train: DataFrame) -> DataFrame:
    """The rows with a label; all five classes have to occur."""
    rows = train.where(F.col("fill_level").isNotNull())
    classes = sorted(r[0] for r in rows.select(F.col("fill_level").cast("int")).distinct().collect())
    if classes != list(range(CLASSES)):
        raise ValueError(f"training rows hold the classes {classes}; all of 0 to {CLASSES - 1} are needed")
    return rows


def fit(kind: str, train: DataFrame, numeric: list[str], categorical: list[str], balanced: bool = True, **params) -> FillModel:
    """Preparation plus a forest (`forest.fit`) or a multinomial logistic regression, class-weighted on demand; needs all five classes."""
    rows, stages = labelled(train), encoding_stages(numeric, categorical)
    preparation = prepare(rows, numeric, categorical)
    if kind == "random_forest":
        indexer = Pipeline(stages=stages[:1]).fit(preparation.apply(rows))
        sizes = [len(labels) + 1 for labels in indexer.stages[0].labelsArray]
        return FillModel(preparation, indexer, FO.fit(indexer.transform(preparation.apply(rows)), numeric, categorical, sizes, balanced, **params))
    return FillModel(preparation, Pipeline(stages=[*stages, estimator(kind, balanced, **params)]).fit(with_class_weights(preparation.apply(rows))))


def ready(model: FillModel, rows: DataFrame) -> DataFrame:
    """Rows with their prepared inputs."""
    return model.pipeline.transform(model.preparation.apply(rows))


def predict(model: FillModel, rows: DataFrame) -> DataFrame:
    """Rows with a five-class probability array and the derived class and flag."""
    keep = [F.col(f"`{c}`") for c in rows.columns]
    out = ready(model, rows)
    if model.forest:
        return M.scored(model.forest.probabilities(out, rows.schema))
    return M.scored(out.withColumn("probabilities", vector_to_array("probability")).select(*keep, "probabilities"))


def selection_score(predictions: DataFrame) -> float:
    """F1 of the collection flag at one half: what the search, the choice and the importances go by."""
    return float(M.binary_metrics(M.counts(predictions, threshold=0.5)).first()["f1"])


def expanding_folds(start: date, cuts: list[date]) -> list[tuple[tuple[date, date], tuple[date, date]]]:
    """Train from `start` to before each cut, score up to the next cut."""
    return [((start, a), (a, b)) for a, b in zip(cuts, cuts[1:])]


def candidates(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def refined(kind: str, best: dict) -> dict[str, list]:
    """A small grid around the best coarse candidate."""
    around = {"maxDepth": [max(2, best["maxDepth"] - 2), best["maxDepth"] + 2], "featureSubsetStrategy": ["sqrt", "0.7"]} if kind == "random_forest" else {"regParam": [best["regParam"] / 3, best["regParam"] * 3], "elasticNetParam": [0.0, 0.5]}
    return {name: [value] for name, value in best.items()} | around


@dataclass(frozen=True)
class Fold:
    """Encoded rows of one fold, written once: what all fits train on and are scored by."""

    train: DataFrame
    test: DataFrame

    def score(self, kind: str, params: dict) -> float:
        out = estimator(kind, **params).fit(self.train).transform(self.test)
        return selection_score(M.scored(out.select("fill_level", vector_to_array("probability").alias("probabilities"))))


def encoded_fold(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], rows: int = TUNING_ROWS) -> Fold:
    """Preparation, index and encoding are learnt from the training rows alone and applied to both sides once.

    A side with more than `rows` labelled rows is drawn down to that many by the hash of bin and date.
    """
    drawn = lambda df: bottom_k(df, rows)
    train, test = (materialize(drawn(x), "fold") for x in (labelled(train), test.where(F.col("fill_level").isNotNull())))
    preparation = prepare(train, numeric, categorical)
    ready = with_class_weights(preparation.apply(train))
    encoder = Pipeline(stages=encoding_stages(numeric, categorical)).fit(ready)
    kept = ["bin_id", "date", "fill_level", "label", "features"]
    size = lambda df: max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // 10_000))  # noqa: E731  few rows: their fits run side by side
    written = lambda df, *more: materialize(encoder.transform(df).select(*kept, *more).coalesce(size(df)).sortWithinPartitions("bin_id", "date"), "encoded")
    return Fold(written(ready, "class_weight"), written(preparation.apply(test)))


def temporal_grid_search(rows: DataFrame, grids: dict[str, dict[str, list]], folds, numeric: list[str], categorical: list[str], tuning_rows: int = TUNING_ROWS, pool: int = POOL) -> DataFrame:
    """Mean and deviation of the selection score per model, phase and candidate over expanding folds.

    Each fold is encoded and written once. The coarse grid of every model is searched first, then a refined grid around each
    model's best candidate (the first of equal ones); the fits of a phase are Spark jobs of which `pool` run side by
    side. Only scores come back.
    """
    inside = lambda r: (F.col("date") >= F.lit(r[0])) & (F.col("date") < F.lit(r[1]))
    parts = [encoded_fold(rows.where(inside(a)), rows.where(inside(b)), numeric, categorical, tuning_rows) for a, b in folds]
    best: dict[str, tuple[float, dict]] = {}
    out = []
    with ThreadPoolExecutor(pool) as threads:
        for phase in ("coarse", "refined"):
            tried = [(kind, params) for kind, grid in grids.items() for params in candidates(grid if phase == "coarse" else refined(kind, best[kind][1]))]
            jobs = [[threads.submit(inheritable_thread_target(rows.sparkSession)(fold.score), kind, params) for fold in parts] for kind, params in tried]
            for (kind, params), scores in zip(tried, jobs, strict=True):
                scores = [job.result() for job in scores]
                out += [(kind, phase, ",".join(f"{k}={v}" for k, v in params.items()), score) for score in scores]
                mean = sum(scores) / len(scores)
                if kind not in best or mean > best[kind][0]:
                    best[kind] = (mean, params)
    table = rows.sparkSession.createDataFrame(out, "model string, phase string, candidate string, score double")
    return table.groupBy("model", "phase", "candidate").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.count("*").alias("folds"))


#: Rows among which values change places; one rule at any size.
PERMUTATION_BLOCK = 10_000


def with_moved(rows: DataFrame, columns: list[str], repeat: int, block: int = PERMUTATION_BLOCK) -> DataFrame:
    """Each row with the columns of another row, `_moved`: the next in hash order, cyclic in blocks.

    Blocks are ranges of the hash, as many as give about `block` rows each.
    """
    n = max(1, -(-rows.count() // block))
    order = H.uniform(f"perm-{repeat}", F.col("bin_id"), F.col("date"))
    w = W.partitionBy("_block").orderBy("_order", "bin_id", "date")
    everything = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    boxed = rows.withColumns({"_order": order, "_own": F.struct(*columns)}).withColumn("_block", F.floor(F.col("_order") * n))
    return boxed.withColumn("_moved", F.coalesce(F.lead("_own").over(w), F.first("_own").over(everything))).drop("_order", "_block")


def permuted(rows: DataFrame, columns: list[str], repeat: int, block: int = PERMUTATION_BLOCK) -> DataFrame:
    """Each row once per column with that column's value from another row, the one `with_moved` names."""
    moved = with_moved(rows, columns, repeat, block).withColumn("feature", F.explode(F.array(*map(F.lit, columns))))
    swapped = {c: F.when(F.col("feature") == c, F.col("_moved")[c]).otherwise(F.col("_own")[c]) for c in columns}
    return moved.withColumns(swapped).drop("_own", "_moved")


def permuted_scores(model: FillModel, rows: DataFrame, columns: list[str], repeat: int) -> DataFrame:
    """Fill level and probabilities of each row once per column that changed places; a forest scores all columns of a row together."""
    if not model.forest:
        return predict(model, permuted(rows, columns, repeat))
    inputs = FO._inputs(model.forest.numeric, model.forest.categorical)
    values = [*model.forest.numeric, *model.forest.categorical]
    own = ready(model, with_moved(rows, values, repeat)).select("fill_level", "_moved", *[F.col(c).alias(f"{FO.OWN}{c}") for c in inputs])
    moved = ready(model, own.select("fill_level", "_moved.*", *[f"{FO.OWN}{c}" for c in inputs]))
    return model.forest.moved_probabilities(moved, columns)


def permutation_importance(model: FillModel, rows: DataFrame, columns: list[str], repeats: int = 3) -> DataFrame:
    """Selection score lost when a column changes places, mean over repeats; every column is scored in one job per repeat."""
    labeled = rows.where(F.col("fill_level").isNotNull())
    base = selection_score(predict(model, labeled))
    parts = []
    for r in range(repeats):
        cells = M.counts(permuted_scores(model, labeled, columns, r), ["feature"], threshold=0.5)
        parts.append(M.binary_metrics(cells, ["feature"]).select("feature", (F.lit(base) - F.col("f1")).alias("loss")))
    return reduce(DataFrame.unionByName, parts).groupBy("feature").agg(F.avg("loss").alias("importance"), F.stddev_pop("loss").alias("std"))


def encoded_importances(model: FillModel, numeric: list[str], categorical: list[str], spark) -> DataFrame:
    """Forest importances by encoded column with the original feature; bounded by the encoded width."""
    sizes = {c: len(labels) + 1 for c, labels in zip(categorical, model.pipeline.stages[0].labelsArray)}
    encoded = [(f"{c}", c) for c in numeric] + [(f"{c}_missing", c) for c in numeric]
    for c in categorical:
        encoded += [(f"{c}={i}", c) for i in range(sizes[c])]
    rows = [(name, feature, float(v)) for (name, feature), v in zip(encoded, model.forest.importances, strict=True)]
    return spark.createDataFrame(rows, "encoded string, feature string, importance double")
