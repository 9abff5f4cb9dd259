"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Two fingerprints
that differ in few bits differ, in at least one of m segments, by no more than that segment's radius:
if every segment i differed by more than r_i, the distances would sum to more than the sum of r_i + 1.
So each fingerprint is put under its own segment values and looks up the small Hamming ball around
them; what meets under one value is compared over all 64 bits.

A pair is looked up from one side only (towards the smaller segment value). What meets under a value is
compared in NumPy blocks of bounded size, spread by block pair, and a block hands on a spanning forest,
never all its pairs. Equal texts share a fingerprint and are compared once; the number of different
fingerprints near one centre is bounded by the ball around it, however many documents lie there.
More segments mean fewer look-ups and fuller tables: 64/m should not lie far below log2 of the number
of different fingerprints. The choice changes the work, never the links.

`similar_groups` links by similarity instead: fingerprints within max_bits, and texts that share one of
32 bands of 8 MinHash values, are candidates only; a pair is a link if the exact Jaccard similarity of the
two sets of shingles is high enough. 0.8^8 = 0.168 a band finds 99.7% of pairs at 0.8 and more above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from wastelake.llm import similar
from wastelake.llm.common import ROW_TYPE, rereadable, shuffle_width, whole_text, with_row
from wastelake.llm.components import components
from wastelake.session import materialize

BITS, SEED, WORDS, MAX_BITS, SEGMENTS = 64, 42, 4, 4, 3
#: Most rows of one side of a comparison block.
BLOCK = 500
#: Shingles hashed at a time, so that a very long text needs no more memory than a long one.
CHUNK = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Candidates by MinHash: bands and values a band.
BANDS, BAND_ROWS, SIMILARITY = 32, 8, 0.8
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of one text; 0 without words, the whole sequence where words are few."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return 0
    total = max(1, len(tokens) - words + 1)
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, total, CHUNK):
        part = tokens[at : at + CHUNK + words - 1]
        shingles = zip(*(part[k:] for k in range(words))) if len(tokens) >= words else [tokens]
        lanes = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), "<u8").view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            counts[lane] += np.bincount(lanes[:, lane], minlength=256) @ BYTE_BITS
    return int(np.packbits(2 * counts.ravel() > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """_row, doc_id, fp (the fingerprint as signed 64 bits) for every row; other columns are not read."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("_text")], "<u8").view("<i8")
            yield pa.record_batch([batch.column("_row"), batch.column("doc_id"), pa.array(fps)], names=["_row", "doc_id", "fp"])

    rows, row = with_row(docs)
    rows = rows.select(F.col(row).alias("_row"), F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("_text"))
    kind = dict(docs.dtypes)[id]
    return rows.mapInArrow(fold, f"_row {ROW_TYPE}, doc_id {kind}, fp long")


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as signed 64 bits; 0 without hashes."""
    counts = np.zeros((8, 8), np.int64)
    lanes = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for lane in range(8):
        counts[lane] += np.bincount(lanes[:, lane], minlength=256) @ BYTE_BITS
    return int(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").view("<i8")[0])


def bands(least: np.ndarray) -> list[int]:
    """One number per band of MinHash values; texts that share one are candidates. None without values."""
    rows = np.column_stack([np.arange(len(least) // BAND_ROWS, dtype="<u8"), least.reshape(-1, BAND_ROWS).astype("<u8")])
    return np.array([xxh64_intdigest(r.tobytes(), SEED) for r in rows], "<u8").view("<i8").tolist()


def plan_segments(max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment; radii sum to max_bits + 1 - segments, the widest segments first."""
    if not 2 <= segments <= max_bits + 1:
        raise ValueError("segments must lie between 2 and max_bits + 1")
    spare, out, offset = max_bits + 1 - segments, [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        out.append((offset, width, spare // segments + (i < spare % segments)))
        offset += width
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of 1 to `radius` flipped bits within `width`."""
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]


def _probes(value: Column, base: Column, masks: list[int]) -> Column:
    near = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))
    return F.transform(F.filter(near, lambda x: x < value), lambda x: F.struct((base + x).alias("bucket"), F.lit(True).alias("probe")))


def _members(prints: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """bucket, probe and the columns of `prints`: each fingerprint under its own segment values, and as a probe in the ball below them."""
    parts = []
    for i, (offset, width, radius) in enumerate(plan_segments(max_bits, segments)):
        value = F.shiftrightunsigned("fp", offset).bitwiseAND((1 << width) - 1)
        base = F.lit(i << 56).cast("long")
        parts.append(F.array(F.struct((base + value).alias("bucket"), F.lit(False).alias("probe"))))
        if radius:
            parts.append(_probes(value, base, ball(width, radius)))
    return prints.select("*", F.explode(F.concat(*parts)).alias("m")).select("m.bucket", *prints.columns, "m.probe")


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """part and the columns of `members` for buckets where something can meet; large buckets are cut into pairs of blocks."""
    w = Window.partitionBy("bucket")
    counted = members.withColumn("p", F.sum(F.col("probe").cast("long")).over(w)).withColumn("t", F.count("*").over(w) - F.col("p")).where("t > 0 and t + p > 1")
    tables, probes = F.ceil(F.col("t") / block), F.ceil(F.col("p") / block)
    mine = F.when(F.col("probe"), tables + F.pmod(F.xxhash64("fp"), probes)).otherwise(F.pmod(F.xxhash64("fp"), tables))
    blocks = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda x, m: F.least(x, m) * (1 << 31) + F.greatest(x, m)
    cut = F.transform(blocks(F.when(F.col("probe"), tables).otherwise(tables + probes)), lambda x: pair(x, F.col("mine")))
    whole = F.array(F.lit(0).cast("long"))
    placed = counted.withColumn("mine", F.when(F.col("t") + F.col("p") > block, mine)).withColumn("part", F.explode(F.when(F.col("mine").isNull(), whole).otherwise(cut)))
    return placed.select("part", *members.columns)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row linked to it, directly or not."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def _compare(fp: np.ndarray, group: np.ndarray, probe: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among rows of the same group that differ in at most max_bits bits."""
    n, left, right = len(fp), [], []
    at, step = np.arange(n), 1
    while len(at := at[at + step < n]) and len(at := at[group[at] == group[at + step]]):
        to = at + step
        near = (np.bitwise_count(fp[at] ^ fp[to]) <= max_bits) & ~(probe[at] & probe[to])
        left.append(at[near])
        right.append(to[near])
        step += 1
    if not left:
        return fp[:0], fp[:0]
    low = _forest(np.concatenate(left), np.concatenate(right), n)
    moved = np.flatnonzero(low != np.arange(n))
    return fp[moved], fp[low[moved]]


def _whole(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Group number and columns of whole groups of (bucket, part), from sorted batches that may cut a group."""
    held = None
    for batch in _ended(batches):
        part = None if batch is None else [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", *columns)]
        rows = part if held is None else held if part is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
        held = None
        if rows is None or not len(rows[0]):
            continue
        change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        if part is not None:  # the last group may go on in the next batch
            cut = int(change[-1]) if len(change) else 0
            held, rows, change = [x[cut:] for x in rows], [x[:cut] for x in rows], change[:-1]
        group = np.zeros(len(rows[0]), np.int64)
        group[change] = 1
        yield [np.cumsum(group), *rows[2:]]


def links(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """a, b: enough of the pairs of different fingerprints within max_bits to connect what such pairs connect."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, probe in _whole(batches, ["fp", "probe"]):
            a, b = _compare(fp.view("<u8"), group, probe.astype(bool), max_bits)
            if len(a):
                yield pa.record_batch([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

    dealt = _dealt(_members(prints.select("fp"), max_bits, segments), block)
    spread = dealt.repartition(shuffle_width(prints.sparkSession), "bucket", "part").sortWithinPartitions("bucket", "part")
    return spread.mapInArrow(search, "a long, b long")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """_row, doc_id, fp, component_id (least id of the component), kept, for every row.

    Words are runs of other than white space after A-Z is lowered; null counts as empty; texts without
    words have fingerprint 0 and are linked like any other. Exactly one row of a component is kept: the
    one with the least id (null last), then the first by address. A component of null ids has a null
    id. An empty table gives no rows; other columns are not read. A frame that is no table is written first.
    """
    prints = materialize(fingerprints(docs, id, text, words), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))).alias("first")
    different = materialize(prints.groupBy("fp").agg(first), "different")
    found = links(different.select("fp"), max_bits, segments, block)
    roots = components(materialize(found, "links"))
    rooted = materialize(different.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    heads = materialize(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    labels = materialize(rooted.join(heads, "root").select("fp", "head"), "labels")
    return prints.join(labels, "fp").select("_row", "doc_id", "fp", F.col("head.id").alias("component_id"), (F.col("_row") == F.col("head.row")).alias("kept"))


def _hooks(classes: DataFrame) -> DataFrame:
    """a, b: each class with the least class of each of its bands; no more pairs than members, however large a group."""
    members = classes.select("node", F.explode("bands").alias("bucket"))
    least = materialize(members.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a"), "least")
    return members.join(least, "bucket").where("a < node").select("a", F.col("node").alias("b")).distinct()


def _within(max_bits: int) -> Callable[[list[pa.Array]], Callable]:
    def of(columns: list[pa.Array]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        fp, probe = columns[0].to_numpy().view("<u8"), columns[1].to_numpy(zero_copy_only=False)
        return lambda a, b: (np.bitwise_count(fp[a] ^ fp[b]) <= max_bits) & ~(probe[a] & probe[b])

    return of


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """_row, doc_id, component_id, kept, for every row; like near_groups, but linked by the exact Jaccard similarity.

    Rows of equal shingle sets are one class, all rows without words among them. Classes are candidates if they meet within
    max_bits by the segments of their fingerprints, or share a band. Each band's least class with the others goes first, so that a
    large group of near copies is one component before the rest is compared in blocks (see `similar`): what moves
    follows the members of a group, not its pairs. `similarity` counts in hundredths.
    """
    docs, values, percent = rereadable(docs), BANDS * BAND_ROWS, round(100 * similarity)
    more = lambda hashes, least: [majority(hashes), bands(least)]
    prints = materialize(similar.sketches(docs, values, id, text, words, more, "fp long, bands array<long>"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))).alias("first")
    classes = prints.groupBy("key").agg(first, *[F.first(c).alias(c) for c in ("fp", "size", "sig", "bands")])
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    where = classes.select("node", F.col("first.row").alias("_row"))
    pairs = materialize(similar.likely(materialize(_hooks(classes), "hooks"), classes, percent, values), "pairs")
    sets = similar.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(where, "node"), docs, text, words)
    near = materialize(similar.linked(pairs, sets, percent), "near")
    labelled = classes.where("size > 0").join(components(near), "node", "left").select("node", F.coalesce("root", "node").alias("label"), "size", "fp", "sig", "bands")
    labelled = materialize(labelled, "labelled")
    by_band = similar.opened(labelled.select(F.explode("bands").alias("bucket"), "node", "label", "size")).join(labelled.select("node", "sig"), "node")
    by_bits = _members(labelled.select("node", "label", "size", "fp"), max_bits, segments)
    units = similar.candidates(by_bits, percent, _within(max_bits), ["fp", "probe"]).unionByName(similar.candidates(by_band, percent, similar.by_signature(percent, values), ["sig"]))
    units = materialize(units.distinct(), "units")
    rest = units.select("node").distinct().join(sets.select("node"), "node", "left_anti").join(where, "node")
    sets = sets.unionByName(similar.sets_of(rest, docs, text, words))
    roots = components(near.unionByName(materialize(similar.unit_links(units, labelled, sets, percent), "links")))
    rooted = materialize(classes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "first"), "rooted")
    heads = materialize(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    labels = materialize(rooted.join(heads, "root").select("key", "head"), "labels")
    return prints.join(labels, "key").select("_row", "doc_id", F.col("head.id").alias("component_id"), (F.col("_row") == F.col("head.row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float | None = None, **options) -> DataFrame:
    """The input rows, all columns, one of each component; see near_groups, and similar_groups where a similarity is given."""
    docs = rereadable(docs)
    rows, row = with_row(docs)
    groups = near_groups(docs, **options) if similarity is None else similar_groups(docs, similarity=similarity, **options)
    gone = groups.where(~F.col("kept")).select(F.col("_row").alias(row))
    return rows.join(materialize(gone, "dropped"), row, "left_anti").drop(row)


def op9(docs: DataFrame) -> DataFrame:
    """The contract's rows: fingerprints of four words, links at four bits."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
