"""Spelling variants: near words found through broadcast Bloom filters of edits.

Every word of the vocabulary generates its single edits as hash values (a hash of characters and places lets an
edit be priced in a few additions) and looks them up in a blocked Bloom filter of the words of the edit's length.
What the filter lets pass is written out as text and meets the vocabulary in an exact join, which removes the
false positives. A pair of words is looked up from one side only: a deletion stands for the insertion of the
other side, and a replacement is tried towards smaller characters alone.

The filters are cut into pieces of fixed size; as many pieces as `filter_mb` holds are broadcast at a time, and the
words whose edits can have such a length are probed once for each such round, so the broadcast stays bounded however
many words there are.

Runs of letters are single bytes of Latin-1 here, one byte a code point, in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wastelake.llm.common import shuffle_width, whole_text
from wastelake.session import materialize

#: Fixed values of the rule: one run in 31 loses a code point; shortest word; least count; how much more frequent a form is.
DIVISOR, SHORTEST, LEAST, RATIO = 31, 7, 2, 10
#: The letters of a run, A-Z already lowered.
LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)])
#: Bytes to letters of runs; every other byte ends a run.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in LETTERS else 0x20) for b in range(256))
#: Filter bits a word, 64-bit slots a block and slots a piece, and megabytes of filter broadcast at a time.
BITS, BLOCK, PIECE, FILTER_MB = 24, 8, 1 << 15, 64
#: Different words a task counts before it hands them on.
HELD = 1 << 18
#: Hash value of each letter, and the factor of a step to the right.
CODES = np.random.default_rng(31).integers(0, 2**64, 256, "u8")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def heard(doc_id: str | None, word: bytes) -> bytes:
    """The word as this document spells it: one pair of document and run in 31 loses a code point."""
    h = zlib.crc32(word.decode("latin-1").encode(), zlib.crc32(f"{doc_id or ''}:".encode()))
    at = h % len(word)
    return word[:at] + word[at + 1 :] if h % DIVISOR == 0 else word


def runs(text: str) -> list[bytes]:
    """The lowered runs of letters of at least SHORTEST code points; letters beyond U+00FF end a run like any sign."""
    return [w for w in text.encode("latin-1", "replace").translate(FOLD).split(b" ") if len(w) >= SHORTEST]


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """word, n for every word of at least SHORTEST code points that occurs `least` times or more over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, body in zip(batch.column("id").to_pylist(), batch.column("_text"), strict=True):
                for word, n in Counter(runs(body.as_py())).items():
                    if len(word := heard(doc_id, word)) >= SHORTEST:
                        held[word] += n
                if len(held) >= HELD:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    rows = docs.select(F.col(f"`{id}`").cast("string").alias("id"), whole_text(text).alias("_text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counted(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _powers(length: int) -> np.ndarray:
    out = np.ones(length + 1, "u8")
    out[1:] = np.uint64(BASE)
    return np.cumprod(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Raw hashes of words of one length, a row of bytes each."""
    return (CODES[codes] * _powers(codes.shape[1])[:-1]).sum(1, dtype="u8")


def _slots(mixed: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two slots of one block, and the three bits looked at in each."""
    block = ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bit = lambda shift: np.uint64(1) << ((mixed >> np.uint64(shift)) & np.uint64(63))
    one = block * np.uint64(BLOCK) + (mixed & np.uint64(3))
    two = block * np.uint64(BLOCK) + np.uint64(4) + ((mixed >> np.uint64(2)) & np.uint64(3))
    again = _mixed(mixed)
    late = lambda shift: np.uint64(1) << ((again >> np.uint64(shift)) & np.uint64(63))
    return one, bit(4) | bit(10) | bit(16), two, late(0) | late(6) | late(12)


class Filters:
    """The filters of some lengths, each as far as its pieces are here; other words are said to be absent."""

    def __init__(self, blocks: dict[int, int], pieces: dict[tuple[int, int], bytes]) -> None:
        self.blocks, self.pieces = blocks, pieces
        self.bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in {length for length, _ in pieces}:
            n = -(-blocks[length] * BLOCK // PIECE)
            place, held = np.full(n, -1, np.int64), []
            for (of, piece), bits in sorted(pieces.items()):
                if of == length:
                    place[piece] = len(held)
                    held.append(np.frombuffer(bits, "<u8"))
            self.bits[length] = place, np.concatenate(held)

    def holds(self, length: int, raw: np.ndarray) -> np.ndarray:
        """Places of the raw hashes that may be words of this length."""
        place, bits = self.bits[length]
        one, mask, two, mask2 = _slots(_mixed(raw), self.blocks[length])
        start = place[(one // np.uint64(PIECE)).astype(np.int64)] * PIECE
        at = np.flatnonzero(start >= 0)
        for slot, want in ((one, mask), (two, mask2)):
            got = bits[start[at] + (slot[at] % np.uint64(PIECE)).astype(np.int64)]
            at = at[got & want[at] == want[at]]
        return at


def _pieces(vocab: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """length, piece, bits: the filters of all lengths, in pieces of PIECE slots."""

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for length, codes, _ in _by_length(batch):
                one, mask, two, mask2 = _slots(_mixed(_hashes(codes)), blocks[length])
                slot, bits = np.concatenate([one, two]), np.concatenate([mask, mask2])
                yield pa.record_batch([pa.array(np.full(len(slot), length)), pa.array((slot // np.uint64(PIECE)).astype("i8")), pa.array((slot % np.uint64(PIECE)).astype("i8")), pa.array(bits.view("i8"))], names=["length", "piece", "slot", "bits"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(PIECE, "<u8")
        bits[frame["slot"]] = frame["bits"].to_numpy().view("<u8")
        return pd.DataFrame({"length": frame["length"][:1], "piece": frame["piece"][:1], "bits": [bits.tobytes()]})

    slots = vocab.mapInArrow(place, "length long, piece long, slot long, bits long").groupBy("length", "piece", "slot").agg(F.bit_or("bits").alias("bits"))
    return slots.groupBy("length", "piece").applyInPandas(join, "length long, piece long, bits binary")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, a row of bytes for each word of that length, and their places in the batch."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    size = np.array([len(w) for w in words], np.int64)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        yield int(length), np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), length), at


def _probe(codes: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Row, place and new letter (-1: deleted) of every edit that may be a word."""
    n, length = codes.shape
    power, coded = _powers(length), CODES[codes]
    parts = coded * power[:-1]
    raw = parts.sum(1, dtype="u8")
    if length - 1 in filters.bits:
        before = np.cumsum(parts, 1, dtype="u8") - parts
        fresh = np.ones(codes.shape, bool)  # deleting any letter of a run of equal letters gives the same word
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(fresh)
        b = before[row, at]
        hit = filters.holds(length - 1, b + (raw[row] - b - parts[row, at]) * np.uint64(INVERSE))
        yield row[hit], at[hit], -1
    if length in filters.bits:
        for letter in LETTERS[:-1]:
            row, at = np.nonzero(codes > letter)
            if len(row):
                hit = filters.holds(length, raw[row] + (CODES[letter] - coded[row, at]) * power[at])
                yield row[hit], at[hit], letter


def near_words(vocab: DataFrame, filter_mb: float = FILTER_MB, bits: int = BITS) -> DataFrame:
    """word, n, other, m: every pair of words one edit apart once, with their counts. `vocab` is a written table of different words."""
    spark = vocab.sparkSession
    blocks = {r["length"]: max(1, -(-r["n"] * bits // (64 * BLOCK))) for r in vocab.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    pieces = materialize(_pieces(vocab, blocks), "bloom")
    listed = sorted((length, p) for length, n in blocks.items() for p in range(-(-n * BLOCK // PIECE)))
    step = max(1, int(filter_mb * 2**20 / (8 * PIECE)))
    found = None
    for start in range(0, len(listed), step):
        (low, first), (high, last) = listed[start], listed[min(start + step, len(listed)) - 1]
        after = (F.col("length") > low) | ((F.col("length") == low) & (F.col("piece") >= first))
        before = (F.col("length") < high) | ((F.col("length") == high) & (F.col("piece") <= last))
        held = {(r["length"], r["piece"]): bytes(r["bits"]) for r in pieces.where(after & before).collect()}
        shared = spark.sparkContext.broadcast((blocks, held))
        words = vocab.where(F.length("word").between(low, high + 1))
        round_ = words.repartition(shuffle_width(spark)).mapInArrow(_prober(shared), "edit string, word string, n long")
        found = round_ if found is None else found.unionByName(round_)
    if found is None:
        return vocab.select("word", "n", F.col("word").alias("other"), F.col("n").alias("m"))
    return found.join(vocab.select(F.col("word").alias("edit"), F.col("n").alias("m")), "edit").select("word", "n", F.col("edit").alias("other"), "m")


def _prober(shared):  # noqa: ANN001, ANN202
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*shared.value)
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for _, codes, place in _by_length(batch):
                for rows, ats, letter in _probe(codes, filters):
                    if len(rows):
                        from_ = [words[i] for i in place[rows]]
                        new = "" if letter < 0 else chr(letter)
                        edits = [w[:i] + new + w[i + 1 :] for w, i in zip(from_, ats.tolist(), strict=True)]
                        yield pa.record_batch([pa.array(edits), pa.array(from_), pa.array([counts[i] for i in place[rows]], pa.int64())], names=["edit", "word", "n"])

    return search


def _roots(hooks: DataFrame) -> DataFrame:
    """word, root: the end of each chain of hooks (word, form), by doubling. Counts grow along a chain, so it has an end."""
    reach = materialize(hooks.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        reach = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return reach


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, ratio: int = RATIO, filter_mb: float = FILTER_MB) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus.

    A run of letters (A to Z lowered, U+00C0 to U+00FF) counts under the spelling `heard` gives it in its document; a null
    id is an empty one there. Null and empty texts hold no words; a text of any length counts whole; repeated rows
    count each; ties of near words go to the first in code-point order. An empty table, or one without words that
    occur twice, gives no rows. Columns other than id and text are not read, whatever their names.
    """
    vocab = materialize(vocabulary(docs, id, text, least), "vocabulary")
    pairs = materialize(near_words(vocab, filter_mb), "near_words")
    side = lambda word, n, other: F.struct(F.col(word).alias("word"), F.struct((-F.col(n)).alias("less"), F.col(other).alias("other")).alias("near"))
    sides = pairs.select(F.explode(F.array(side("word", "m", "other"), side("other", "n", "word"))).alias("s"))
    near = sides.groupBy(F.col("s.word").alias("word")).agg(F.count("*").alias("n_near"), F.min("s.near").alias("best"))
    formed = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    rows = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "formed")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(docs: DataFrame) -> DataFrame:
    """The contract's rows, as `variants` states them for nulls, empty and long texts, ties, repeats and other columns."""
    return variants(docs)
