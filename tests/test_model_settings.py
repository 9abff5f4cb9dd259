"""The model queries fit the reference's forest, and each audit the settings of the query it stands for."""

import pytest

from wastelake.catalog import modeling as C


class Seen(Exception):
    pass


def settings(spark, monkeypatch, name):
    def seen(kind, train, numeric, categorical, **params):
        raise Seen(kind, params)

    monkeypatch.setattr(C.T, "fit", seen)
    monkeypatch.setattr(C, "matrix", lambda spark, sf: spark.sql("select date '2024-06-01' as date"))
    with pytest.raises(Seen) as e:
        C.BOOK.queries[name](spark, "")
    return e.value.args


def test_settings(spark, monkeypatch):
    grid = C.GRIDS["random_forest"]
    assert grid == {"numTrees": [150], "maxDepth": [10, 16], "minInstancesPerNode": [10], "subsamplingRate": [0.7], "balanced": [False, True]}
    for name in ("train_forest", "train_second_model"):
        assert settings(spark, monkeypatch, name) == settings(spark, monkeypatch, f"{name}_audit")
    kind, forest = settings(spark, monkeypatch, "train_forest")
    assert kind == "random_forest" and all(forest[k] in v for k, v in grid.items())
    for name in ("forest_importances", "permutation_importance", "predict_registry_days"):
        assert settings(spark, monkeypatch, name) == (kind, forest)
    assert settings(spark, monkeypatch, "train_second_model")[1]["maxIter"] >= 1000 and min(C.GRIDS["logistic"]["maxIter"]) >= 1000


def test_search_is_the_same_in_any_order_of_fits(spark):
    rows = C.matrix(spark, "/root/testdata/sf0.001")
    grids = {"random_forest": {"numTrees": [3], "maxDepth": [3, 4], "minInstancesPerNode": [1], "subsamplingRate": [0.7], "balanced": [True]}, "logistic": {"maxIter": [5], "regParam": [0.3], "balanced": [False]}}
    folds = C.T.expanding_folds(C.date(2024, 6, 1), [C.date(2024, 6, 18), C.date(2024, 6, 24)])
    found = [sorted(map(tuple, C.T.temporal_grid_search(rows, grids, folds, C.NUM, C.CAT, pool=p).collect())) for p in (1, 6)]
    assert found[0] == found[1] and len(found[0]) == 2 + 4 + 1 + 4
    best = max((r for r in found[0] if r[:2] == ("random_forest", "coarse")), key=lambda r: r[3])
    depth = int(best[2].split("maxDepth=")[1].split(",")[0])
    assert {r[2].split("maxDepth=")[1].split(",")[0] for r in found[0] if r[:2] == ("random_forest", "refined")} == {str(max(2, depth - 2)), str(depth + 2)}


def test_fold_is_bounded_and_learns_from_its_training_rows(spark):
    rows = C.matrix(spark, "/root/testdata/sf0.001")
    early, late = rows.where("date < date '2024-06-20'"), rows.where("date >= date '2024-06-20'")
    fold = C.T.encoded_fold(early, late, C.NUM, C.CAT, rows=50)
    assert fold.train.count() == 50 and fold.test.count() == 50
    assert fold.train.select("features").first()[0].size == fold.test.select("features").first()[0].size


def test_rare_values_and_values_beyond_the_bound_are_folded(spark):
    rows = spark.createDataFrame([(1.0, v, 1) for v in "aaaabbbccccd"], "x double, c string, fill_level int")
    prepared = C.T.prepare(rows, ["x"], ["c"], rare=2, values=2)
    assert prepared.common == {"c": ["a", "c"]}
