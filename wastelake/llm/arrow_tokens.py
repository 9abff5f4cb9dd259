"""Token ids in Arrow IPC files of equal-length sequences.

Layout: one `ids` file and one `docs` file per part. The ids file holds record batches of BATCH sequences
(the last may be shorter) with two fixed-size-list columns: `ids` (the narrowest unsigned type that holds the
vocabulary) and `mask` (true where a position holds a token). Documents follow each other in the stream of
sequences, each closed by the end id; only the last sequence of a part is padded. The docs file tells where
each document starts. A sequence's place follows from its number alone, so a memory-mapped reader gets its ids
and mask without copying or reading anything else.

Parts are ranges of (id, place in the input), so many rows of one id spread over parts. Every attempt of a task
writes under a name of its own and returns it; the manifest, a written table, names the files that count, so a
lost executor or a repeated attempt leaves at worst a file nobody reads.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wastelake.llm.common import shuffle_width, whole_text, with_place
from wastelake.session import fresh_path, materialize

LENGTH, BATCH, END_ID = 2048, 256, 2
#: Text units of each kind and generation that a worker remembers, and documents taken from a batch at a time.
REMEMBERED, GROUP = 600_000, 200


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The sign that stands for each byte in a byte-level vocabulary. Printable bytes stand for themselves, the others
# for the signs from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
BYTE_SPACE = chr(BYTE_SIGNS[32])
MARKS = frozenset(".,;:!?")


def _letters(word: str) -> bool:
    """Whether a word is letters of the Latin blocks alone, whose kind no Unicode version disputes."""
    return word.isascii() and word.isalpha() or word.isalpha() and max(word) < "\u0250"


class _Known(dict):
    """Ids of text units as bytes; asks for what it does not hold.

    Holds two generations of at most REMEMBERED units: when the young one is full it becomes the old one, and
    what is met again comes over from there, so frequent units stay and rare ones go.
    """

    def __init__(self, ask: Callable[[str], bytes]) -> None:
        super().__init__()
        self.ask, self.old = ask, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit) or self.ask(unit)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[unit] = ids
        return ids


class Encoder:
    """The library's ids of whole texts, asked once for each different unit of text.

    A byte-level tokenizer of this family never joins characters across a single space or line break that
    stands between two other characters: the break before the space, and both sides of the line break, are
    always cut. Texts are split there, and only units not met before go to the library. A text that holds a
    special token's own string goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and type(cut).__name__ == "ByteLevel" and not cut.add_prefix_space and cut.use_regex
        self.unit = _Known(self._ask)
        self.after_space = _Known(self._ask_word)

    def _ask(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _ask_word(self, word: str) -> bytes:
        """Ids of a space and a word. Letters alone are one piece to a byte-level tokenizer and go to its model as bytes;
        a mark after letters is a piece of its own."""
        if self.plain:
            if word[-1:] in MARKS and _letters(word[:-1]):
                return self.after_space[word[:-1]] + self.unit[word[-1]]
            if _letters(word):
                ids = [t.id for t in self.tokenizer.model.tokenize(BYTE_SPACE + word.encode().decode("latin-1").translate(BYTE_SIGNS))]
                return struct.pack(f"<{len(ids)}{self.code}", *ids)
        return self._ask(" " + word)

    def _words(self, text: str) -> list[bytes] | None:
        """Ids word by word, if single spaces and line breaks are all the white space; else None."""
        out: list[bytes] = []
        for line in text.split("\n"):
            words = line.split(" ")
            if len(words) != len(line.split()):  # an empty word, or other white space
                return None
            if out:
                out.append(self.unit["\n"])
            out.append(self.unit[words[0]])
            out.extend(map(self.after_space.__getitem__, words[1:]))
        return out

    def _units(self, text: str) -> list[str]:
        """The text cut at its single spaces alone."""
        parts = text.split(" ")
        out, unit = [], parts[0]
        for part in parts[1:]:
            if part and unit and not part[0].isspace() and not unit[-1].isspace():
                out.append(unit)
                unit = " " + part
            else:
                unit += " " + part
        return [*out, unit] if unit else out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian bytes of the file's type."""
        if any(s in text for s in self.special):
            return self._ask(text)
        ids = self._words(text)
        return b"".join(map(self.unit.__getitem__, self._units(text)) if ids is None else ids)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder: what one task has learnt serves the next."""
    return Encoder(path)


class _Writer:
    """Fills sequences with ids and writes them batch by batch."""

    def __init__(self, sink: Any, kind: np.dtype, length: int) -> None:
        self.kind, self.length = kind, length
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.bytes = self.tokens = self.sequences = 0

    def add(self, ids: bytes) -> int:
        """Appends ids; returns how many."""
        self.held.append(ids)
        self.bytes += len(ids)
        n = len(ids) // self.kind.itemsize
        self.tokens += n
        full = BATCH * self.length * self.kind.itemsize
        if self.bytes >= full:
            data = b"".join(self.held)
            at = 0
            while len(data) - at >= full:
                self._write(np.frombuffer(data, self.kind, BATCH * self.length, at), BATCH * self.length)
                at += full
            self.held, self.bytes = [data[at:]], len(data) - at
        return n

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), self.kind)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        self.file.close()


class TokenFile:
    """Random access to one ids file; local files are memory-mapped and nothing is copied."""

    def __init__(self, path: str) -> None:
        store, name = pafs.FileSystem.from_uri(path)
        self.source = pa.memory_map(name) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.at is None or self.at[0] != k:
            self.at = k, self.file.get_batch(k)
        return self.at[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence i."""
        batch, row = self._batch(i // BATCH), i % BATCH
        cut = slice(row * self.length, (row + 1) * self.length)
        return batch.column("ids").values.to_numpy()[cut], batch.column("mask").values[cut].to_numpy(zero_copy_only=False)

    def stretches(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from position `start` of the file's stream, as views batch by batch."""
        size = BATCH * self.length
        while n:
            ids = self._batch(start // size).column("ids").values.to_numpy()[start % size :][:n]
            yield ids
            start, n = start + len(ids), n - len(ids)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Writes all texts in order of id (null first), repeated ids in table order; returns the manifest.

    Manifest: part, ids_path, docs_path, docs, tokens, sequences. Null and empty texts are their end id alone;
    other columns are not read; an empty table writes no files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, out = TaskContext.get().partitionId(), None, None
        ids_path = docs_path = ""
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                rows = batch.slice(at, GROUP)
                if encoder is None:
                    encoder = encoder_of(tokenizer)
                    end = np.array([end_id], encoder.type).tobytes()
                    name = f"{path}/{part:06d}-{uuid.uuid4().hex}"
                    ids_path, docs_path = f"{name}-ids.arrow", f"{name}-docs.arrow"
                    store, _ = pafs.FileSystem.from_uri(path)
                    store.create_dir(pafs.FileSystem.from_uri(path)[1], recursive=True)
                    sinks = [store.open_output_stream(pafs.FileSystem.from_uri(p)[1]) for p in (ids_path, docs_path)]
                    out = _Writer(sinks[0], encoder.type, length)
                    schema = pa.schema([("doc_id", rows.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    index = pa.ipc.new_file(sinks[1], schema)
                    n_docs = 0
                first = out.tokens
                sizes = np.array([out.add(encoder.encode(text) + end) for text in rows.column("_text").to_pylist()], np.int64)
                index.write_batch(pa.record_batch([rows.column("doc_id"), pa.array(first + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=schema))
                n_docs += len(sizes)
        if out is not None:
            out.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "ids_path": ids_path, "docs_path": docs_path, "docs": n_docs, "tokens": out.tokens, "sequences": out.sequences}])

    rows, _ = with_place(docs.select(F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("_text")))
    ranged = rows.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "_text")
    schema = "part long, ids_path string, docs_path string, docs long, tokens long, sequences long"
    return materialize(ranged.mapInArrow(write, schema), "manifest")


def read_documents(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files of the manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = TokenFile(row["ids_path"])
                store, name = pafs.FileSystem.from_uri(row["docs_path"])
                with store.open_input_file(name) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        checks = []
                        for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                            crc = 0
                            for stretch in ids.stretches(start, n):
                                crc = zlib.crc32(stretch.astype("<u4"), crc)
                            checks.append(crc)
                        starts = pa.array(docs.column("start").to_numpy() + row["base"])
                        yield pa.record_batch([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(checks, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    spread = based.select("ids_path", "docs_path", "base").repartition(shuffle_width(manifest.sparkSession), "ids_path")
    return spread.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op5(docs: DataFrame) -> DataFrame:
    """The contract's rows, from files written in the shared folder and read back."""
    manifest = write_tokens(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer_path())
    return read_documents(manifest, dict(docs.dtypes)["doc_id"])
