"""The pipeline on empty tables, nulls in every column, repeated rows and columns with clashing names."""

import pytest

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node int, _row int, key string, label int, bucket int, size int, sig string, copies int"
ROWS = [
    (1, "a plain text of some good words that go on and on for a while"), (2, None), (3, ""), (4, " \n"), (None, None), (None, "a text without id but with words enough to be a text of five and more"),
    (5, "A plain text of some good words that go on and on for a while"), (1, "a plain text of some good words that go on and on for a while"), (6, "w " * 30_000), (7, "\x00\x7f ☃ \U0001f600"), (8, "x" * 100_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, k, k, "k", None, 1, 2, "s", None) for k, (i, t) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("labels", [[(1, 1, 0), (2, 0, 0), (5, 1, None), (None, 1, 1), (6, None, None)], []])
def test_runs(spark, tmp_path, rows, labels):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
            if not rows:
                assert out.count() == 0
            docs = out


def test_stages_on_the_same_rows(spark, tmp_path):
    """Without the classifier: what copies and near copies leave of the awkward rows."""
    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    unlike = cp.drop_copies(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in unlike.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    unlike.write.parquet(f"{tmp_path}/unlike")
    kept = cp.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/unlike"), str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)]
