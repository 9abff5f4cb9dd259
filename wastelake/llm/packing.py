"""Best-fit packing of token sequences into bins of several permitted lengths.

Pieces go in order of falling length. A piece joins the open bin that it leaves with the least room, the first
opened of equals;
where none has room, the bin size is opened that stores a token at the least cost, judged by what the
waiting pieces could still put into it. At the end every bin is cut down to the least permitted length
that holds its contents.

The pieces are dealt to shards of bounded size by a hash of document, copy and chunk; a shard is one
task's work and a bin never crosses shards. Repeated rows are counted before they are numbered, so a
document repeated any number of times is spread over shards like different ones. The loss against one
single shard is at most the open bins of each shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wastelake.llm.common import whole_text, word_count
from wastelake.session import materialize

#: Permitted lengths with the cost of one bin: a token costs one unit, a bin a fixed share on top.
LENGTHS: dict[int, float] = {512: 528.0, 1024: 1040.0, 2048: 2064.0, 4096: 4112.0}
#: Pieces of one shard.
SHARD = 20_000
#: Copies of one piece that are numbered together.
STRIP = 1_000


class _Sizes:
    """A multiset of piece lengths, asked for the largest that fits."""

    def __init__(self, sizes: list[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.keys = sorted(self.count)

    def remove(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s], self.keys[bisect_left(self.keys, s)]

    def fill(self, room: int) -> int:
        """Tokens that filling `room` greedily from the largest fitting piece down would store."""
        stored, at = 0, bisect_right(self.keys, room) - 1
        while at >= 0 and room:
            s = self.keys[at]
            n = min(self.count[s], room // s)
            stored, room = stored + n * s, room - n * s
            at = min(at - 1, bisect_right(self.keys, room) - 1)
        return stored


def best_fit(sizes: list[int], lengths: Mapping[int, float] = LENGTHS) -> tuple[list[int], list[int]]:
    """Bin of each piece and permitted length of each bin; sizes from 1 to the greatest length, falling."""
    permitted = sorted(lengths)
    waiting = _Sizes(sizes)
    rooms: list[int] = []  # different rooms of open bins, rising
    with_room: dict[int, list[int]] = {}
    placed, load = [], []

    def put(bin: int, room: int) -> None:
        if room:
            if room not in with_room:
                insort(rooms, room)
                with_room[room] = []
            with_room[room].append(bin)

    for s in sizes:
        waiting.remove(s)
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            bin = heappop(with_room[room])
            if not with_room[room]:
                del with_room[room], rooms[at]
        else:
            room = min((c for c in permitted if c >= s), key=lambda c: (lengths[c] / (s + waiting.fill(c - s)), c))
            bin = len(load)
            load.append(0)
        load[bin] += s
        placed.append(bin)
        put(bin, room - s)
    return placed, [min((c for c in permitted if c >= n), key=lambda c: (lengths[c], c)) for n in load]


def pieces(docs: DataFrame, id: str, size: Column, longest: int) -> DataFrame:
    """doc_id, copy, chunk, start, n_tokens: every row cut into chunks of at most `longest` tokens.

    Rows of one id and size are counted first and then numbered from 0 in strips, each a task's handful.
    """
    counted = docs.select(F.col(f"`{id}`").alias("doc_id"), size.cast("long").alias("_size")).where("_size > 0").groupBy("doc_id", "_size").count()
    strips = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(STRIP).cast("long"))))
    copies = strips.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + STRIP, F.col("count")) - 1)))
    chunks = copies.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / longest))))
    start = F.col("chunk") * longest
    return chunks.select("doc_id", F.col("_size").alias("doc_tokens"), "copy", "chunk", start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("_size") - start).alias("n_tokens"))


def pack(docs: DataFrame, size: Column, id: str = "doc_id", lengths: Mapping[int, float] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, copy, chunk, start, n_tokens, bin_id, bin_offset, bin_length, bin_tokens.

    `size` is the token count of a row. A row above the greatest permitted length is cut into chunks of
    that length and a rest; null or zero sizes have nothing to pack and give no piece. Repeated rows (same
    id and size) are told apart by `copy`; a null id is packed like any other. Pieces of equal length go in
    order of id (null last), size, copy and chunk, so equal inputs give equal bins wherever tasks run.
    """
    longest = max(lengths)
    items = materialize(pieces(docs, id, size, longest), "pieces")
    shards = max(1, -(-items.count() // shard))
    place = F.xxhash64(F.col("doc_id").cast("string"), "doc_tokens", "copy", "chunk")
    kind = dict(items.dtypes)["doc_id"]
    schema = f"doc_id {kind}, doc_tokens long, copy long, chunk long, start long, n_tokens long, bin_id string, bin_offset long, bin_length long, bin_tokens long"
    chosen = dict(lengths)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "doc_tokens", "copy", "chunk"], ascending=[False, True, True, True, True], na_position="last", kind="stable")
        number = int(rows["shard"].iloc[0])
        bins, length = best_fit(rows["n_tokens"].tolist(), chosen)
        out = rows.drop(columns="shard").assign(bin_id=[f"{number}-{b}" for b in bins], bin_length=[length[b] for b in bins])
        out["bin_offset"] = out.groupby("bin_id")["n_tokens"].cumsum() - out["n_tokens"]
        out["bin_tokens"] = out.groupby("bin_id")["n_tokens"].transform("sum")
        return out

    return items.withColumn("shard", F.pmod(place, F.lit(shards))).groupBy("shard").applyInPandas(fill, schema)


def op1(docs: DataFrame) -> DataFrame:
    """All documents packed by their word counts plus one end mark; an empty text is its end mark alone."""
    return pack(docs, word_count(whole_text()) + 1)
