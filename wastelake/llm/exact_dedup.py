"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Every level groups only what the level before left in groups of two or more, so most texts are
told apart by a length and 64 bits. The full digest is computed for rows whose length and prefix
have company; at scale Spark filters the read of the texts by those rows before it moves them.

Hot groups: all groupings are counts or minima with map-side combine; groups are joined back from
a written table, so that adaptive execution can split a group that holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wastelake.llm.common import SPACES, rereadable, whole_text, with_row
from wastelake.session import materialize

PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without any white-space character."""
    return F.translate(text, SPACES, "")


def _addressed(docs: DataFrame, id: str, text: str) -> DataFrame:
    rows, row = with_row(docs)
    return rows.select(F.col(row).alias("_row"), F.col(f"`{id}`").alias("_id"), whole_text(text).alias("_text"))


def duplicate_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per input row: _row, id, keep_id, group_size, kept.

    Texts are equal when they agree after white space is deleted; null counts as empty and equals
    other empty texts. Of equal texts the one with the most code points, then the smallest id (null
    last), then the first by address stays: of repeated rows exactly one. Extra columns are not
    read. An empty table gives no rows. `docs` is read twice; a frame that is no table is written first.
    """
    rows = _addressed(rereadable(docs), id, text)
    clean = normalised(F.col("_text"))
    narrow = materialize(
        rows.withColumn("_clean", clean).select(
            "_row", "_id", F.length("_text").alias("_n"), F.length("_clean").alias("_len"), F.xxhash64(F.substring("_clean", 1, prefix)).alias("_prefix")
        ),
        "lengths",
    )
    shared_length = narrow.groupBy("_len").count().where("count > 1").select("_len")
    same_length = narrow.join(shared_length, "_len", "left_semi")
    shared_prefix = materialize(same_length.groupBy("_len", "_prefix").count().where("count > 1").select("_len", "_prefix"), "prefixes")
    left = narrow.join(shared_prefix, ["_len", "_prefix"], "left_semi").select("_row", "_id", "_n")
    hashed = materialize(rows.select("_row", "_text").join(left, "_row").select("_row", "_id", "_n", F.sha2(clean, 256).alias("_sha")), "digests")
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = materialize(hashed.groupBy("_sha").agg(F.count("*").alias("_size"), best.alias("_best")).where("_size > 1"), "groups")
    found = hashed.join(groups, "_sha").select("_row", F.col("_best.id").alias("_keep"), F.col("_best.row").alias("_keep_row"), "_size")
    alone = F.col("_size").isNull()
    return narrow.select("_row", "_id").join(found, "_row", "left").select(
        "_row",
        F.col("_id").alias("doc_id"),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The input rows, all columns, without those that repeat another text."""
    docs = rereadable(docs)
    rows, row = with_row(docs)
    gone = duplicate_rows(docs, id, text, prefix).where(~F.col("kept")).select(F.col("_row").alias(row))
    return rows.join(materialize(gone, "dropped"), row, "left_anti").drop(row)


def op10(docs: DataFrame) -> DataFrame:
    """The contract's rows: the groups of the operator with the digest of each normalised text."""
    docs = rereadable(docs)
    digests = _addressed(docs, "doc_id", "text").select("_row", F.sha2(normalised(F.col("_text")), 256).alias("text_sha256"))
    return duplicate_rows(docs).join(digests, "_row").drop("_row")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY c) AS group_size, row_number() OVER w = 1 AS kept, sha256(c) AS text_sha256
FROM d WINDOW w AS (PARTITION BY c ORDER BY length(t) DESC, doc_id NULLS LAST)
"""
