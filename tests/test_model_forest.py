"""The forest: the same for any partitioning, branches handed to tasks obey the rules of a whole tree, and it learns as Spark's does."""

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wastelake.functions import hashing as H
from wastelake.operators.model import forest as FO, training as T

NUM, CAT = ["a", "b"], ["c"]
PARAMS = {"numTrees": 8, "maxDepth": 7, "minInstancesPerNode": 10, "subsamplingRate": 0.7, "balanced": True}


def made(spark, n=4000):
    u = lambda name: H.uniform(name, F.col("id"))
    rows = spark.range(n).select(F.col("id").alias("bin_id"), F.lit("2024-06-01").cast("date").alias("date"), F.when(u("gap") > 0.05, u("a")).alias("a"), F.floor(u("b") * 7).alias("b"), F.concat(F.lit("v"), F.floor(u("c") * 6).cast("string")).alias("c"), u("noise").alias("noise"))
    level = F.coalesce("a", F.lit(0.5)) * 3 + F.col("b") / 7 + (F.col("c") == "v3").cast("int") + F.col("noise") * 0.5
    return rows.withColumn("fill_level", F.least(F.floor(level), F.lit(4)).cast("int")).drop("noise")


def whole(model):
    return [t for part in model.forest.trees for t in part.value]


def test_same_forest_for_any_partitioning(spark):
    rows = made(spark, 1500)
    one, many = (T.fit("random_forest", r, NUM, CAT, **PARAMS) for r in (rows.coalesce(1), rows.repartition(7)))
    assert [t.parts() for t in whole(one)] == [t.parts() for t in whole(many)]
    assert len(one.forest.trees) == 1 and len(whole(one)) == PARAMS["numTrees"]
    assert abs(one.forest.importances.sum() - 1) < 1e-9
    scored = T.predict(one, rows).select("bin_id", "probabilities").collect()
    assert len(scored) == 1500 and all(abs(sum(r[1]) - 1) < 1e-9 for r in scored)


def test_branches_obey_depth_and_least_rows(spark, monkeypatch):
    monkeypatch.setattr(FO, "BRANCH_ROWS", 300)
    rows = made(spark)
    model = T.fit("random_forest", rows, NUM, CAT, **PARAMS)
    first = F.xxhash64(F.xxhash64("bin_id", "date", "label", *FO._inputs(NUM, CAT)), F.lit(1))
    ready = model.pipeline.transform(model.preparation.apply(rows)).select(first.alias("h"), "fill_level", *FO._inputs(NUM, CAT)).toArrow().combine_chunks().to_batches()[0]
    s = model.forest.settings
    codes, h, y = s.codes(ready, NUM, CAT), ready.column("h").to_numpy().view(np.uint64), ready.column("fill_level").to_numpy()
    for t, tree in enumerate(whole(model)):
        depth = np.zeros(len(tree.feature), int)
        for k in np.flatnonzero(tree.feature >= 0):
            depth[tree.left[k] : tree.left[k] + 2] = depth[k] + 1
        assert 4 <= depth.max() <= PARAMS["maxDepth"]
        n, ends = s.drawn(h, t), tree.ends(codes, s)
        for leaf in np.flatnonzero(tree.feature < 0):
            own = np.bincount(y[ends == leaf], weights=n[ends == leaf], minlength=5)
            assert own.sum() >= PARAMS["minInstancesPerNode"]
            assert np.allclose(tree.share[leaf], s.shares(own), atol=1e-6)


def test_equal_rows_are_drawn_one_by_one(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(FO, "materialize", lambda df, name: seen.append(df) or (_ for _ in ()).throw(StopIteration))
    rows = made(spark, 300)
    ready = T.prepare(rows, NUM, CAT).apply(rows.unionByName(rows)).withColumn("c_index", F.lit(0.0))
    try:
        FO.fit(ready, NUM, CAT, [1], **{**PARAMS})
    except StopIteration:
        pass
    assert seen[0].select("h").distinct().count() == 600


def test_learns_as_well_as_the_forest_of_spark(spark, monkeypatch):
    monkeypatch.setattr(FO, "BRANCH_ROWS", 800)
    rows = made(spark).cache()
    train, test = rows.where("bin_id % 4 > 0"), rows.where("bin_id % 4 = 0")
    params = PARAMS | {"numTrees": 20}
    model = T.fit("random_forest", train, NUM, CAT, **params)
    right = lambda out: out.agg(F.avg((F.col("predicted_fill_level") == F.col("fill_level")).cast("double"))).first()[0]
    ours = right(T.predict(model, test))
    encoder = OneHotEncoder(inputCols=["c_index"], outputCols=["c_vec"], handleInvalid="keep")
    inputs = VectorAssembler(inputCols=["a_filled", "b_filled", "a_missing", "b_missing", "c_vec"], outputCol="features")
    index = lambda r: model.pipeline.transform(model.preparation.apply(r))
    encoder = encoder.fit(index(train))
    vectors = lambda r: inputs.transform(encoder.transform(index(r)))
    plain = RandomForestClassifier(labelCol="label", weightCol="class_weight", seed=1, **{k: v for k, v in params.items() if k != "balanced"}).fit(T.with_class_weights(vectors(train)))
    theirs = right(T.M.scored(plain.transform(vectors(test)).withColumn("probabilities", vector_to_array("probability"))))
    assert ours > 0.6 and ours > theirs - 0.04, (ours, theirs)


def test_moved_columns_are_scored_together(spark, monkeypatch):
    rows = made(spark, 1500).withColumn("a", F.when(F.col("bin_id") % 7 > 0, F.col("a")))
    model = T.fit("random_forest", rows, NUM, CAT, **PARAMS)
    columns = ["c", "a", "b", "bin_size"]  # the last is no input
    rows = rows.withColumn("bin_size", F.col("bin_id") % 3)
    key = lambda df: sorted((r["feature"], r["fill_level"], *r["probabilities"]) for r in df.collect())
    one_by_one = key(T.predict(model, T.permuted(rows, columns, 1)))
    monkeypatch.setattr(T, "permuted", None)  # no row per column
    assert key(T.permuted_scores(model, rows, columns, 1)) == one_by_one
    assert T.permutation_importance(model, rows, columns, 1).count() == 4


def test_split_nodes_are_held_a_few_at_a_time(monkeypatch):
    r = np.random.default_rng(3)
    s = FO.Settings([], np.array([0, 1, 2, 2, 2]), np.array([-1, -1, 0, 1, 2]), np.ones(5), 8, 9, 2, 0.7)
    codes, y, n = r.integers(0, [32, 8, 3], (3000, 3)).astype(np.uint16), r.integers(0, 5, 3000), r.integers(1, 3, 3000).astype(float)
    tree, gains = FO.grown(s, codes, y, n, 0, 1)
    held, counts = [], FO.Settings.counts
    monkeypatch.setattr(FO, "COUNT_NODES", 5)
    monkeypatch.setattr(FO.Settings, "counts", lambda *a: held.append(len(a[-1])) or counts(*a))
    again, gains_again = FO.grown(s, codes, y, n, 0, 1)
    assert tree.parts() == again.parts() and (gains == gains_again).all() and max(held) == 5 and len(tree.feature) > 100
