"""Ranked lexical search with K2-treaps over the grid of terms and documents.

A treap covers a few thousand documents. Its grid has a row per term (the rarest first, so that rows of like weight
lie together) and a column per document, in order of ids. It is a quadtree without its empty cells: a cell stores the
highest impact below it, a mask of its children and the place of the first one. The rows of an item's terms descend
together, always into the document ranges with the highest sum of cell maxima; that sum bounds every score in the
range, so the search ends when no range is left that could reach the ranks asked for. Leaves hold exact impacts.

Spark writes one row of postings a document (terms of the items only), counts document frequencies, and builds
the treaps where it reads the postings: nothing but the ranks of a task is shuffled. The items are a stated query set;
they are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wastelake.llm.common import whole_text
from wastelake.session import materialize

#: Ranks an item gets.
RANKS = 10
#: Documents and postings of a treap, terms of a block of items, and ranges expanded at a time.
SHARD, POSTINGS, TERMS, STEP = 4096, 1 << 20, 200_000, 32
#: Bytes to bytes of terms: A-Z lowered, every other ASCII sign but letters and digits a space; bytes of other code points stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
ONES = np.array([bin(m).count("1") for m in range(16)], np.int64)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order; none for null."""
    return (text or "").encode().translate(FOLD).split()


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class Treap:
    """Quadtree of impacts above 0 (row, column, impact), each cell with the highest impact below it."""

    def __init__(self, row: np.ndarray, col: np.ndarray, impact: np.ndarray) -> None:
        self.depth = int(max(row.max(initial=0), col.max(initial=0))).bit_length()
        code = np.zeros(len(row), np.int64)
        for b in range(self.depth):
            code |= ((row >> b & 1) << (2 * b + 1)) | ((col >> b & 1) << (2 * b))
        order = np.argsort(code)
        code, most = code[order], impact[order]
        tops, masks, firsts = [most], [np.zeros(len(code), np.uint8)], [np.zeros(len(code), np.int64)]
        for _ in range(self.depth):  # a level from the one below it; children of a cell lie side by side
            start = np.flatnonzero(np.diff(code >> 2, prepend=-1))
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & 3).astype(np.uint8), start) if len(start) else masks[0][:0])
            most = np.maximum.reduceat(most, start) if len(start) else most[:0]
            tops.append(most)
            firsts.append(start)
            code = code[start] >> 2
        sizes = [len(t) for t in tops]
        offsets = np.cumsum([0, *sizes])
        self.root, self.none = int(offsets[-2]), int(offsets[-1])
        self.top = np.concatenate([*tops, [0]])
        self.mask = np.concatenate([*masks, np.zeros(1, np.uint8)])
        self.first = np.concatenate([*(f + (offsets[i - 1] if i else 0) for i, f in enumerate(firsts)), [0]])

    def search(self, rows: np.ndarray, ranks: int = RANKS, least: int = 1) -> list[tuple[int, int]]:
        """(score, column) of the highest sums over the rows, at least `least`; equal scores by ascending column."""
        best: list[tuple[int, int]] = []
        rows = rows[rows >> self.depth == 0]  # other rows lie beyond this grid
        if not len(rows) or self.none == 0:
            return best
        full = lambda: len(best) == ranks
        useless = lambda sum_, col: sum_ < least or (full() and (sum_, -col) < best[0])
        start = np.full(len(rows), self.root)
        open_ = [(-int(self.top[start].sum()), 0, self.depth, start)]
        if self.depth == 0:
            return [(-open_[0][0], 0)] if -open_[0][0] >= least else best
        while open_ and not useless(-open_[0][0], open_[0][1]):
            taken = [heapq.heappop(open_)]
            while open_ and len(taken) < STEP and not useless(-open_[0][0], open_[0][1]):
                taken.append(heapq.heappop(open_))
            cells = np.stack([t[3] for t in taken])
            level = np.array([t[2] - 1 for t in taken])
            below = 2 * (rows >> level[:, None] & 1)
            mask, first = self.mask[cells], self.first[cells]
            for half in (0, 1):
                part = below + half
                child = np.where(mask >> part & 1, first + ONES[mask & ((1 << part) - 1)], self.none)
                sums = self.top[child].sum(1)
                for i in np.flatnonzero(sums >= least).tolist():
                    sum_, col = int(sums[i]), taken[i][1] + (half << int(level[i]))
                    if useless(sum_, col):
                        continue
                    if level[i]:
                        heapq.heappush(open_, (-sum_, col, int(level[i]), child[i]))
                    elif full():
                        heapq.heapreplace(best, (sum_, -col))
                    else:
                        heapq.heappush(best, (sum_, -col))
        return sorted(((s, -c) for s, c in best), key=lambda x: (-x[0], x[1]))


def postings(docs: DataFrame, known: dict[bytes, int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms of the document), terms, tfs (numbers and occurrences of the known terms it holds), for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            sizes, held, tfs = [], [], []
            for body in batch.column("_text"):
                found = terms(body.as_py())
                here = [(number[t], k) for t, k in Counter(found).items() if t in number]
                sizes.append(len(found))
                held.append([t for t, _ in here])
                tfs.append([k for _, k in here])
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("_text"))
    return rows.mapInArrow(fold, f"doc_id {dict(docs.dtypes)[id]}, n long, terms array<int>, tfs array<int>")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of up to SHARD documents and about POSTINGS postings, by ascending id, null last."""
    held, docs, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append(part)
            docs, size = docs + part.num_rows, size + len(part.column("terms").flatten())
            if docs >= SHARD or size >= POSTINGS:
                yield pa.Table.from_batches(held).sort_by("doc_id")
                held, docs, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).sort_by("doc_id")


def _ranked(rows: DataFrame, items: list[tuple[int, list[int]]], ranks: int, kind: str) -> DataFrame:
    """item, doc_id, score: the best documents of each task for each item. `rows` are postings with impacts to be worked out from df, N and L."""
    spark = rows.sparkSession
    stats = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    holding = {r["term"]: r["df"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    by_weight = sorted(holding, key=lambda t: (holding[t], t))
    row_of = {t: i for i, t in enumerate(by_weight)}
    row = np.full(max(holding, default=0) + 1, -1, np.int64)
    row[by_weight] = np.arange(len(by_weight))
    weights = np.array([weight(stats["docs"], holding[t]) for t in by_weight], np.int64)
    asked = [(item, np.array(sorted(row_of[t] for t in held if t in row_of), np.int64)) for item, held in items]
    shared = spark.sparkContext.broadcast((row, weights, asked, stats["docs"], stats["all"]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, weights, asked, n_docs, n_all = shared.value
        best: dict[int, list[tuple]] = {}
        for shard in _shards(batches):
            lists = shard.column("terms").combine_chunks()
            col = np.repeat(np.arange(shard.num_rows), np.diff(lists.offsets.to_numpy()))
            r, tf = row[lists.flatten().to_numpy()], shard.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 10 + (90 * shard.column("n").to_numpy() * n_docs) // max(1, n_all)
            impact = weights[r] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[col]))
            some = impact > 0
            treap = Treap(r[some], col[some], impact[some])
            ids = shard.column("doc_id")
            for item, rows_ in asked:
                had = best.get(item, [])
                found = treap.search(rows_, ranks, had[-1][0] if len(had) == ranks else 1)
                if found:
                    new = [*had, *((score, ids[c].as_py()) for score, c in found)]
                    best[item] = sorted(new, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:ranks]
        flat = [(item, d, s) for item, found in best.items() for s, d in found]
        yield pa.record_batch([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], of), pa.array([x[2] for x in flat], pa.int64())], names=["item", "doc_id", "score"])

    of = to_arrow_type(rows.schema["doc_id"].dataType)
    some = rows.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
    return some.mapInArrow(search, f"item long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, ranks: int = RANKS, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `ranks` best documents of each item with a score above 0, equal scores by ascending doc_id.

    Null and empty texts hold no term: as documents they count nowhere, as items they get no rows. Each row of items is ranked by
    itself and each row of documents counts, also where ids repeat; null ids of documents come last among equals. An empty table
    of either kind gives no rows. Texts are read whole; columns beside ids and texts are not read, whatever their names.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t.as_py()))) for t in batch.column("_text")]
            yield pa.record_batch([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), whole_text(item_text).alias("_text")).mapInArrow(held, f"item_id {dict(items.dtypes)[item_id]}, terms array<binary>")
    asked = materialize(asked.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0) // block_terms))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").collect()
        known = {t: i for i, t in enumerate(sorted({bytes(t) for r in block for t in r["terms"]}))}
        rows = materialize(postings(docs, known, id, text), "postings")
        best = _ranked(rows, [(r["item"], [known[bytes(t)] for t in r["terms"]]) for r in block], ranks, dict(docs.dtypes)[id])
        found = best if found is None else found.unionByName(best)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("rank", first("item", "part")).where(F.col("rank") <= ranks)
    last = some.withColumn("rank", first("item")).where(F.col("rank") <= ranks).select("item", "rank", "doc_id", "score")
    return last.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's rows, as `search` states them for nulls, empty and long texts, ties, repeats and other columns."""
    return search(docs, items)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS everything FROM size),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
score AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // everything))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 10
"""
