"""Near copies by exact Jaccard similarity of shingle sets, without listing pairs.

Candidates come in groups: rows of a `bucket` may be near copies of each other. A group is cut into blocks of bounded
rows and shingles; a block throws out pairs whose sizes or MinHash signatures rule them out, hands on the rows with a
pair left, and these meet again with their shingle sets. There every pair's exact intersection comes from a sparse
product of the block's sets, and the block hands on a spanning forest of its links. So rows moved grow with the members
of a group (times its blocks), never with its pairs, and no link is lost to a limit.

A signature is the low byte of each of `values` MinHash values. The share of equal bytes estimates the similarity;
a pair is thrown out only if the estimate lies MARGIN standard deviations under the limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from wastelake.llm.common import ROW_TYPE, among, shuffle_width, whole_text, with_row
from wastelake.session import materialize

SEED, WORDS = 42, 5
#: Most rows and about most shingles of one side of a block.
BLOCK, BLOCK_GRAMS = 500, 1 << 20
#: Standard deviations by which an estimate may lie under the limit: a true link is thrown out once in 30,000.
MARGIN = 4.0
#: Shingles put through all MinHash values at a time, and columns of a block's product at a time.
MIN_CHUNK, COLUMNS = 1 << 11, 1 << 12
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered."""
    return (text or "").encode().translate(LOWER).split()


def hashed(tokens: list[bytes], words: int = WORDS) -> np.ndarray:
    """Hashes of the word shingles in order; none without words, the whole sequence where words are few."""
    if not tokens:
        return np.zeros(0, "<u8")
    each = np.fromiter(map(xxh64_intdigest, tokens, repeat(SEED)), "<u8", len(tokens))
    width = min(words, len(tokens))
    mixed = np.full(len(tokens) - width + 1, width, "<u8")
    for k in range(width):
        mixed = (mixed ^ each[k : k + len(mixed)]) * STEP
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different word shingles of a text."""
    return np.unique(hashed(words_of(text), words))


def factors(values: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(SEED).integers(0, 2**32, (2, values), "u4")
    return a | np.uint32(1), b


def least_values(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of one set."""
    least = np.full(len(a), 2**32 - 1, "u4")
    short = (grams >> np.uint64(32)).astype("u4")
    for at in range(0, len(short), MIN_CHUNK):
        np.minimum(least, (short[at : at + MIN_CHUNK, None] * a + b).min(0), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


def floor_of(percent: int, values: int) -> float:
    """Equal signature bytes below which a pair is thrown out."""
    p = percent / 100 + (1 - percent / 100) / 256
    return values * p - MARGIN * (values * p * (1 - p)) ** 0.5


def sketches(docs: DataFrame, values: int, id: str = "doc_id", text: str = "text", words: int = WORDS, more: Callable[[np.ndarray, np.ndarray], list] | None = None, more_type: str = "") -> DataFrame:
    """_row, doc_id, key (digest of the shingle set), size, sig, and what `more` adds from (hashes of all shingles in order, MinHash values), for every row."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = factors(values)
        for batch in batches:
            keys, sizes, sigs, extra = [], [], [], []
            for t in batch.column("_text"):
                hashes = hashed(words_of(t.as_py()), words)
                grams = np.unique(hashes)
                least = least_values(grams, a, b)
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                sizes.append(len(grams))
                sigs.append(signature(least))
                if more:
                    extra.append(more(hashes, least if len(grams) else least[:0]))
            columns = [batch.column("_row"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())]
            kinds = [pa.int64(), pa.list_(pa.int64())][: len(extra[0])] if extra else []
            columns += [pa.array([x[i] for x in extra], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    names = ["_row", "doc_id", "key", "size", "sig", *[x.split()[0] for x in more_type.split(", ") if x]]
    rows, row = with_row(docs)
    rows = rows.select(F.col(row).alias("_row"), F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("_text"))
    return rows.mapInArrow(fold, f"_row {ROW_TYPE}, doc_id {dict(docs.dtypes)[id]}, key binary, size long, sig binary" + (f", {more_type}" if more_type else ""))


def sets_of(wanted: DataFrame, docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """node, grams: the shingle sets of the wanted classes (node, _row), read anew from their first texts and written."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words).view("<i8") for t in batch.column("_text")]
            yield pa.record_batch([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    rows, row = with_row(docs)
    wanted = materialize(wanted, "wanted")
    texts = among(rows.select(F.col(row).alias("_row"), whole_text(text).alias("_text")), "_row", wanted, "_row").join(wanted, "_row")
    return materialize(texts.select("node", "_text").mapInArrow(fold, "node long, grams array<long>"), "grams")


def likely(pairs: DataFrame, classes: DataFrame, percent: int, values: int) -> DataFrame:
    """The pairs (a, b) of classes that sizes and signatures do not rule out."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floor_of(percent, values)
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, values) for c in ("sig_a", "sig_b"))
            yield batch.filter(pa.array((one == two).sum(1) >= least)).select(["a", "b"])

    one, two = (classes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("size").alias(f"size_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(fold, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * shared shingles >= percent * shingles of either."""
    one, two = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("shared"), (F.size("grams_a") + F.size("grams_b") - shared).alias("either"))
    return both.where(100 * F.col("shared").cast("long") >= percent * F.col("either").cast("long")).select("a", "b")


def open_members(members: DataFrame) -> DataFrame:
    """The rows (bucket, node, label, size, ...) of buckets that hold different labels, with the bucket's blocks."""
    counts = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("grams"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).alias("blocks")
    counts = materialize(counts.select("bucket", blocks), "open")
    return among(members, "bucket", counts, "bucket").join(counts, "bucket")


def opened(members: DataFrame) -> DataFrame:
    """The rows (bucket, label, ...) of buckets that hold different labels, written."""
    counts = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    counts = materialize(counts.select("bucket"), "open")
    return materialize(among(members, "bucket", counts, "bucket").join(counts, "bucket"), "opened")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], by: list[str]) -> Iterator[tuple[np.ndarray, list]]:
    """Group numbers and columns of whole groups, from sorted batches that may cut a group."""
    held = None
    for batch in _ended(batches):
        part = None if batch is None else pa.Table.from_batches([batch])
        rows = part if held is None else held if part is None else pa.concat_tables([held, part])
        held = None
        if rows is None or not rows.num_rows:
            continue
        change = np.zeros(rows.num_rows, bool)
        for c in by:
            x = rows.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(change)
        if part is not None:  # the last group may go on in the next batch
            cut = int(at[-1]) if len(at) else 0
            held, rows, change = rows.slice(cut), rows.slice(0, cut), change[:cut]
        if rows.num_rows:
            yield np.cumsum(change), [rows.column(c).combine_chunks() for c in columns]


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def candidates(members: DataFrame, percent: int, likely_pair: Callable[[list[np.ndarray]], Callable], carried: list[str]) -> DataFrame:
    """unit, node: classes of one block with at least one pair that nothing rules out, for the exact comparison.

    `members` is bucket, node, label, size and the carried columns. likely_pair takes the carried columns of some rows
    and returns the test of two arrays of places. Units with the same nodes, as several buckets give them, are one.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, found in _groups(batches, ["node", "label", "size", "part", "mine", *carried], ["bucket", "part"]):
            node, label, size, part, mine = (x.to_numpy() for x in found[:5])
            test, kept = likely_pair(found[5:]), np.zeros(len(node), bool)
            apart = part >> 31 != part & 0x7FFFFFFF  # two different blocks: pairs across them only
            at, step = np.arange(len(node)), 1
            while len(at := at[at + step < len(node)]) and len(at := at[group[at] == group[at + step]]):
                to = at + step
                near = (label[at] != label[to]) & (100 * np.minimum(size[at], size[to]) >= percent * np.maximum(size[at], size[to])) & (~apart[at] | (mine[at] != mine[to]))
                a, b = at[near], to[near]
                if len(a):
                    near = test(a, b)
                    kept[a[near]] = kept[b[near]] = True
                step += 1
            if kept.any():
                node, group = node[kept], group[kept]
                mixed = node.astype("u8") * STEP
                mixed = (mixed ^ (mixed >> np.uint64(32))) * STEP
                unit = np.zeros(int(group.max()) + 1, "u8")
                np.add.at(unit, group, mixed)
                yield pa.record_batch([pa.array(unit[group].view("i8")), pa.array(node)], names=["unit", "node"])

    dealt = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, F.col("mine")) * (1 << 31) + F.greatest(x, F.col("mine")))
    placed = open_members(members).withColumn("mine", dealt).select("bucket", "node", "label", "size", *carried, "mine", F.explode(pairs).alias("part"))
    spread = placed.repartition(shuffle_width(members.sparkSession), "bucket", "part").sortWithinPartitions("bucket", "part")
    return spread.mapInArrow(search, "unit long, node long").distinct()


def by_signature(percent: int, values: int) -> Callable[[list[pa.Array]], Callable]:
    def of(columns: list[pa.Array]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        sig, least = np.frombuffer(b"".join(columns[0].to_pylist()), np.uint8).reshape(-1, values), floor_of(percent, values)
        cut = lambda a, b: (sig[a] == sig[b]).sum(1) >= least
        return lambda a, b: np.concatenate([cut(a[i : i + 4096], b[i : i + 4096]) for i in range(0, len(a), 4096)])

    return of


def product(sets: list[np.ndarray]) -> np.ndarray:
    """Shared elements of every two of the sets."""
    n = len(sets)
    if n == 2:
        return np.array([[len(sets[0]), k := len(np.intersect1d(*sets, assume_unique=True))], [k, len(sets[1])]])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = np.flatnonzero(times > 1)
    rank = np.full(len(times), -1)
    rank[some] = np.arange(len(some))
    place = rank[place]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((n, n), np.int64)
    for start in range(0, len(some), COLUMNS):
        lo, hi = np.searchsorted(place, [start, start + COLUMNS])
        x = np.zeros((n, min(COLUMNS, len(some) - start)), np.float32)
        x[row[lo:hi], place[lo:hi] - start] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
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


def unit_links(units: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links of a spanning forest in each unit, each with 100 * shared >= percent * either."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, (node, label, grams) in _groups(batches, ["node", "label", "grams"], ["unit"]):
            node, label = node.to_numpy(), label.to_numpy()
            values, ends = grams.flatten().to_numpy(), np.cumsum(grams.value_lengths().to_numpy())
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
            left, right = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets_ = [values[(ends[i - 1] if i else 0) : ends[i]] for i in range(lo, hi)]
                size = np.array([len(s) for s in sets_])
                shared = product(sets_)
                near = (100 * shared >= percent * (size[:, None] + size - shared)) & (label[lo:hi, None] != label[lo:hi]) & (shared > 0)
                a, b = np.nonzero(np.triu(near, 1))
                low = forest(a, b, hi - lo)
                moved = np.flatnonzero(low != np.arange(hi - lo))
                left.append(node[lo:hi][moved])
                right.append(node[lo:hi][low[moved]])
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    full = units.join(labels.select("node", "label"), "node").join(sets, "node").select("unit", "node", "label", "grams")
    spread = full.repartition(shuffle_width(units.sparkSession), "unit").sortWithinPartitions("unit")
    return spread.mapInArrow(search, "a long, b long")
