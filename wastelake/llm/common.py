"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wastelake.session import materialize

#: The six white-space characters of the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Type of a row's address.
ROW_TYPE = "struct<file:bigint,at:bigint>"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text with null counted as empty."""
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of the frame has, in either case."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def with_place(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number that orders them within one pass, and that column's name.

    Another pass over the same table may number the rows otherwise, as file splits follow the number of cores.
    """
    name = free_name(df, "_row")
    return df.withColumn(name, F.monotonically_increasing_id()), name


def rereadable(df: DataFrame) -> DataFrame:
    """The frame itself if it only selects from one table of Parquet files, else its written copy."""
    nodes = [re.sub(r"^[\s:+-]*", "", line) for line in df._jdf.queryExecution().analyzed().toString().splitlines()]
    plain = all(n.split(" ")[0] in ("Project", "Filter", "SubqueryAlias", "View", "Relation") for n in nodes)
    if plain and sum(n.startswith("Relation") and n.endswith(" parquet") for n in nodes) == 1:
        return df
    return materialize(df, "copy")


def with_row(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a re-readable frame with their address (file, place in it), and that column's name.

    The address is the same in every pass and after every loss. A frame that is no plain table is written first;
    callers that need two passes over it make it rereadable themselves.
    """
    df, name = rereadable(df), free_name(df, "_row")
    meta = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))), name


#: Hash values by which rows are thrown out before a join; bounds the broadcast to as many numbers.
BUCKETS = 1 << 20


def among(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key may be one of the wanted ones; a join that follows has far fewer rows, and texts, to move.

    Only the different hash buckets of the wanted keys are broadcast, never more than BUCKETS numbers. Where wanted keys
    are many more than that, nothing is thrown out and the join is as before.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    marks = wanted.select(bucket(wanted_key).alias("_bucket")).distinct()
    return rows.join(F.broadcast(marks), bucket(key) == F.col("_bucket"), "left_semi")
