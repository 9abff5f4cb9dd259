"""MinHash near-duplicates by an LSH forest.

A tree of the forest is an order: each set's signature for that tree, sorted. Sets that stand side by side in an order and
share a long enough prefix are the first candidates; they join what is plainly alike, however large the group, with one
pair a row and order. Then every tree is cut into regions of equal prefix. Where a region is crowded its prefix grows, from
DEPTHS[0] to DEPTHS[-1] values, until it is small; a region that is crowded at full depth is compared in blocks. Only regions
whose sets are not all joined yet are compared, and every link is confirmed on the full sets (see `similar`).

Of two sets at the limit of 0.85, 32 trees miss a pair once in 10^6 at six values and once in 1,100 at ten,
where regions are crowded and a set has many neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wastelake.llm import similar
from wastelake.llm.common import among, rereadable, shuffle_width
from wastelake.llm.components import components
from wastelake.session import materialize

#: Trees, orders in which neighbours are compared first, prefix lengths tried, and rows that make a region crowded.
TREES, ORDERS, DEPTHS, CROWDED = 32, 8, (6, 8, 10), 64
PERCENT, WORDS = 85, 5


def _rows(classes: DataFrame, trees: int, depth: int, *columns: str) -> DataFrame:
    """tree, path (the signature bytes of that tree), node and the columns: one row a set and tree."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    return classes.select("node", *columns, "sig", tree).select("tree", F.expr(f"substring(sig, tree * {depth} + 1, {depth})").alias("path"), "node", *columns)


def neighbours(classes: DataFrame, orders: int, depths: tuple[int, ...]) -> DataFrame:
    """a, b: sets side by side in one of the first orders that share a prefix of the least depth."""
    depth = depths[-1]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).reshape(-1, depth)[:, : depths[0]]
            tree, node = batch.column("tree").to_numpy()[:, None], batch.column("node").to_numpy()
            key = np.concatenate([tree.astype("<i4").view(np.uint8).reshape(-1, 4), path], 1)
            if last is not None:
                key, node = np.concatenate([last[0], key]), np.concatenate([last[1], node])
            at = np.flatnonzero((key[1:] == key[:-1]).all(1))
            last = key[-1:], node[-1:]
            yield pa.record_batch([pa.array(np.minimum(node[at], node[at + 1])), pa.array(np.maximum(node[at], node[at + 1]))], names=["a", "b"])

    ordered = _rows(classes, orders, depth).repartitionByRange(shuffle_width(classes.sparkSession), "tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    return ordered.mapInArrow(walk, "a long, b long").distinct()


def regions(labelled: DataFrame, trees: int, depths: tuple[int, ...], crowded: int) -> DataFrame:
    """bucket, node, label, size: the members of every region that holds sets not joined yet, each region as deep as it needs."""
    open_, found = _rows(labelled, trees, depths[-1], "label", "size"), None
    for depth in depths:
        keyed = open_.withColumn("bucket", F.xxhash64("tree", F.expr(f"substring(path, 1, {depth})"), F.lit(depth)))
        counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        counts = materialize(counts.select("bucket", "n"), "regions")
        keyed = materialize(among(keyed, "bucket", counts, "bucket").join(counts, "bucket"), "region_rows")
        last = depth == depths[-1]
        part = (keyed if last else keyed.where(F.col("n") <= crowded)).select("bucket", "node", "label", "size")
        found = part if found is None else found.unionByName(part)
        open_ = keyed.where(F.col("n") > crowded).drop("bucket", "n")
    return found


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, trees: int = TREES, depths: tuple[int, ...] = DEPTHS, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: sets linked if 100 * shared >= percent * either.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing; a text with fewer words than
    a shingle has its whole sequence as one. Rows of equal sets are linked. The component is named by its least id; null ids count
    last, so a component of null ids alone has a null one. Repeated rows are rows of one component; texts are read whole; an
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    docs, values = rereadable(docs), trees * depths[-1]
    prints = materialize(similar.sketches(docs, values, id, text, words), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))).alias("first")
    classes = prints.where("size > 0").groupBy("key").agg(first, F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    where = classes.select("node", F.col("first.row").alias("_row"))
    pairs = materialize(similar.likely(materialize(neighbours(classes, min(ORDERS, trees), depths), "neighbours"), classes, percent, values), "pairs")
    sets = similar.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(where, "node"), docs, text, words)
    near = materialize(similar.linked(pairs, sets, percent), "near")
    labelled = materialize(classes.join(components(near), "node", "left").select("node", F.coalesce("root", "node").alias("label"), "size", "sig"), "labelled")
    members = regions(labelled.select("node", "label", "size", "sig"), trees, depths, crowded).join(labelled.select("node", "sig"), "node")
    units = materialize(similar.candidates(members, percent, similar.by_signature(percent, values), ["sig"]), "units")
    more = units.select("node").distinct().join(sets.select("node"), "node", "left_anti").join(where, "node")
    sets = sets.unionByName(similar.sets_of(more, docs, text, words))
    roots = components(near.unionByName(materialize(similar.unit_links(units, labelled, sets, percent), "links")))
    rooted = materialize(classes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "first"), "rooted")
    heads = materialize(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    labels = materialize(rooted.join(heads, "root").select("key", F.col("head.id").alias("head")), "labels")
    own = F.when(F.col("size") > 0, F.col("head")).otherwise(F.col("doc_id")).alias("component_id")
    return prints.join(labels, "key", "left").select("doc_id", F.col("size").alias("n_shingles"), own)


def op12(docs: DataFrame) -> DataFrame:
    """The contract's rows, as `near_groups` states them; a row is kept whose id names its component, null ids of null components too."""
    return near_groups(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
