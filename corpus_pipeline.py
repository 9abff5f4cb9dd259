"""The corpus pipeline: raw documents in, packed sequences out.

Each stage calls one operator over all that the stage before kept; `run` writes every stage's result to the
shared folder and reads it again, so a lost executor never costs more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wastelake.llm import exact_dedup, mixing, packing, quality, simhash
from wastelake.llm.common import table
from wastelake.session import materialize

#: Near duplicates in the pipeline: a Jaccard similarity of 0.8 or more over sets of five-word shingles, checked exactly in blocks.
#: Fingerprints within 7 of 64 bits, looked up in four segments, and shared MinHash bands are the candidates.
WORDS, MAX_BITS, SEGMENTS, SIMILARITY = 5, 7, 4, 0.8
#: A trained classifier, 64-bit hashes of word shingles and a greedy packer are not expressible in SQL.
ORACLE_SQL = None


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows the classifier takes for good. It scores every whole text, null and empty ones too; rows of one id are judged alike
    by their texts; without labels of both kinds the bias alone decides. An empty table stays empty, other columns go through."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space: the longest, then the least id, null ids last; repeated rows are
    copies, null counts as empty, and all empty texts are one group. An empty table stays empty, other columns go through."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by similarity: the least id, null ids last, then the first by address. Texts without words, null
    ones too, are one group; a text with fewer words than a shingle has its whole sequence as one. An empty table stays
    empty, other columns go through, whatever their names."""
    return simhash.drop_near_duplicates(docs, words=WORDS, max_bits=MAX_BITS, segments=SEGMENTS, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate and its own draw say; a null source is a source, null and empty texts are rows
    without words. An empty table stays empty, other columns go through."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and the bins that hold them; null and empty texts take their end mark alone, long texts several
    pieces; an empty table gives no rows. Columns beside id and text are not read."""
    return packing.op1(docs)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
