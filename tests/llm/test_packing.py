"""Packing: nothing lost, bins within their length, the greedy rule against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from wastelake.llm import packing
from wastelake.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_best_fit(sizes, lengths):
    """The rule word for word, scanning every open bin and simulating every fill."""
    bins, placed, waiting = [], [], sorted(sizes)
    for s in sizes:
        waiting.remove(s)
        fits = [b for b in bins if b["room"] >= s]
        if fits:
            least = min(b["room"] for b in fits)
            b = [b for b in fits if b["room"] == least][0]
        else:
            best = None
            for c in sorted(x for x in lengths if x >= s):
                room, stored = c - s, s
                for w in sorted(waiting, reverse=True):
                    if w <= room:
                        room, stored = room - w, stored + w
                if best is None or lengths[c] / stored < best[0]:
                    best = lengths[c] / stored, c
            b = {"id": len(bins), "room": best[1], "load": 0}
            bins.append(b)
        b["room"] -= s
        b["load"] += s
        placed.append(b["id"])
    return sorted(b["load"] for b in bins), sorted(min(c for c in lengths if c >= b["load"]) for b in bins), placed


@pytest.mark.parametrize("seed", range(6))
def test_greedy_rule(seed):
    rng = random.Random(seed)
    lengths = {8: 9.0, 16: 17.0, 40: 46.0} if seed % 2 else {8: 8.0, 16: 14.0, 40: 38.0}
    sizes = sorted((rng.choice([1, 2, 3, 5, 7, 8, 11, 17, 30, 40]) for _ in range(80)), reverse=True)
    placed, length = packing.best_fit(sizes, lengths)
    load = [0] * len(length)
    for s, b in zip(sizes, placed, strict=True):
        load[b] += s
    want_load, want_length, _ = plain_best_fit(sizes, lengths)
    assert sorted(load) == want_load and sorted(length) == want_length


def check_whole(rows, sizes, longest=4096):
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault(r["bin_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"], r["copy"]), []).append(r)
    for items in by_bin.values():
        items.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in items:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert all(r["bin_tokens"] == at and at <= r["bin_length"] and not any(at <= c < r["bin_length"] for c in packing.LENGTHS) for r in items)
    for (_, n, _), items in by_doc.items():
        items.sort(key=lambda r: r["chunk"])
        assert [r["start"] for r in items] == [k * longest for k in range(len(items))] and sum(r["n_tokens"] for r in items) == n
    assert sorted((str(d), n) for d, n, _ in by_doc) == sorted((str(d), n) for d, n in sizes if n)


def test_whole_small_table(spark):
    docs = table(spark, SF, "documents")
    rows = packing.op1(docs).collect()
    check_whole(rows, [(r["doc_id"], len(r["text"].split()) + 1) for r in docs.select("doc_id", "text").collect()])
    tokens = sum(r["n_tokens"] for r in rows)
    space = sum({r["bin_id"]: r["bin_length"] for r in rows}.values())
    assert tokens / space > 0.97
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.op1(docs.repartition(7)).collect()))


def test_awkward_rows(spark):
    rows = [(1, 5)] * 2500 + [(2, 20_000), (2, 20_000), (None, 4096), (3, None), (4, 0), (5, 4097)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, n int, count int, copy string")
    out = packing.pack(df, F.col("n"), shard=500)
    check_whole(out.collect(), rows and [(d, n) for d, n in rows if n])
    assert out.groupBy(F.split("bin_id", "-")[0]).count().agg(F.max("count")).first()[0] < 800
    assert packing.pack(df.where("false"), F.col("n")).count() == 0


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id long, text string")
    check_whole(packing.op1(df).collect(), [(1, 1), (2, 1), (3, 3), (3, 3)])
