"""Positive-unlabelled classifiers: gradients, held-out accuracy, labels kept out, awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wastelake.llm import pu, quality, toxicity
from wastelake.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("hidden", [0, 4])
def test_gradients(hidden):
    rng = np.random.default_rng(1)
    net = pu.fit(rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (90, 5)), 0.3, hidden=hidden, epochs=2)
    x, slope = rng.normal(0, 1, (7, 5)), rng.normal(0, 1, 7)
    grads = pu._gradients(net, x, slope)
    names = (["w1", "b1"] if hidden else []) + ["w", "b"]
    for name, g in zip(names, grads, strict=True):
        value = np.array(getattr(net, name), float)
        for at in np.ndindex(value.shape or (1,)):
            total = []
            for step in (1e-6, -1e-6):
                moved = value.copy()
                moved[at if value.shape else ()] += step
                setattr(net, name, moved if value.shape else float(moved))
                total.append((slope * net.margin(x)).sum())
            setattr(net, name, value if value.shape else float(value))
            assert g.reshape(-1)[np.ravel_multi_index(at, value.shape or (1,))] == pytest.approx((total[0] - total[1]) / 2e-6, abs=1e-4)


def test_learns_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.3
    u = rng.normal(0, 1, (6000, 6)) + 1.5 * y[:, None]
    p = rng.normal(1.5, 1, (1500, 6))
    net = pu.choose(p, u, 0.3, (1e-4, 1e-3), epochs=30)
    assert ((net.score(u) >= 0.5) == y).mean() > 0.93
    good, bad = pu.risk_parts(net, p, u, 0.3)
    assert good > 0 and bad > -0.05


@pytest.mark.parametrize("op, label, folds, held, least", [(toxicity.op2, "toxic", 5, 0, 0.93), (quality.op6, "quality", 3, 1, 0.95)])
def test_held_out_accuracy_and_unseen_labels(spark, op, label, folds, held, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = op(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    known = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in known) / len(known) >= least
    unseen = F.crc32(F.col("doc_id").cast("string")) % folds == held
    flipped = labels.withColumn(label, F.when(unseen, 1 - F.col(label)).otherwise(F.col(label)))
    again = op(docs.withColumn("lang", F.lit("xx")).repartition(1).sortWithinPartitions("doc_id"), flipped)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == pytest.approx({r["doc_id"]: r["score"] for r in out}, abs=0.2)


@pytest.mark.parametrize("op", [toxicity.op2, quality.op6])
def test_awkward_rows(spark, op):
    schema = "doc_id long, text string, score int, _text int, positive string"
    rows = [(1, None, 1, 1, "a"), (2, "", 1, 1, "a"), (3, " \n", 1, 1, "a"), (None, "x", 1, 1, None), (4, "word " * 200_000, 1, 1, "a"), (4, "\x00퟿ 漢字 !!", 1, 1, "a"), (4, "same", 1, 1, "a"), (4, "same", 1, 1, "a")]
    docs = spark.createDataFrame(rows, schema)
    some = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, 1, 1), (4, 0, None), (None, 1, 1), (7, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for labels in (some, some.where("false"), some.where("doc_id = 2")):
        out = op(docs, labels).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out) and [r["held_out"] for r in out if r["doc_id"] is None] == [False]
        assert op(docs.where("false"), labels).count() == 0


def test_keep_good_keeps_columns(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = quality.keep_good(docs.withColumn("_score", F.lit("x")), labels)
    assert kept.columns == [*docs.columns, "_score"]
    good = {r["doc_id"] for r in quality.op6(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good
