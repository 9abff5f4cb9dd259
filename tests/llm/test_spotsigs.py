"""Spot signatures: the rule in plain Python, all pairs, the next document across ranges."""

import hashlib
import struct

import pytest
import regex
from xxhash import xxh64_intdigest

from wastelake.llm import spotsigs
from wastelake.llm.common import table

SF = "/root/testdata/sf0.01"
STOP = set(spotsigs.STOP)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain(text, chain=3):
    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    p = [i for i, x in enumerate(w) if x not in STOP]
    out = set()
    for j, i in enumerate(p):
        if i and w[i - 1] in STOP:
            h = 42
            for k in p[j : j + chain]:
                h = xxh64_intdigest(w[k].encode(), h)
            out.add(signed(h))
    return out or ({signed(xxh64_intdigest(" ".join(w).encode(), 42))} if w else set())


def printed(s):
    h = 42
    for x in sorted(s):
        h = xxh64_intdigest(struct.pack("<q", x), h)
    return f"{len(s)}-{h:016x}"


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        a, b, c = plain(text), plain(edited), plain(nxt)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), likeness(a, b), likeness(a, c)))
    return out


def got(df):
    return sorted((tuple(r) for r in spotsigs.op3(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_whole_small_table(spark):
    df = table(spark, SF, "documents")
    want = expected([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert [tuple(r) for r in got(df)] == want
    long = [r for r in want if r[1] > 200]
    assert sum(r[5] > r[6] for r in long) / len(long) > 0.97


AWKWARD = [None, "", "   ", "the", "word", "The cat", "the of and", "of the quick brown fox and the lazy dog", "Ünïcode für die Straße 𝄞x", "a" * 100_000, "the cat sat " * 20_000, "same the text", "same the text"]


def test_awkward_rows(spark, tmp_path):
    rows = [(10 * i, t) for i, t in enumerate(AWKWARD)] + [(None, "the end of all"), (-5, "first of the rows")]
    path = str(tmp_path / "d")
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, range int, next string, own int").coalesce(2).write.parquet(path)
    df = spark.read.parquet(path)
    assert got(df) == expected(rows)
    assert got(df.where("false")) == []
    assert got(df.where("doc_id = 50")) == expected([(50, "The cat")])
    nulls = df.where("doc_id is null")
    assert got(nulls) == expected([(None, "the end of all")])


def test_repeated_ids_each_have_a_next(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "the a b"), (1, "the a b"), (2, "of c d"), (2, "of c d"), (2, "of c d")], "doc_id long, text string").coalesce(1).write.parquet(path)
    out = spotsigs.op3(spark.read.parquet(path)).collect()
    assert len(out) == 5 and sum(r["near_next"] == 1.0 for r in out) == 3


def test_two_level_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spotsigs, "FINE", 3)
    path = str(tmp_path / "d")
    rows = [(i * i - 500, f"the number {i} of all") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    assert got(spark.read.parquet(path)) == expected(rows)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_matches_equal_all_pairs(spark, threshold):
    docs = table(spark, SF, "documents")
    member, pairs = spotsigs.matches(docs, threshold=threshold)
    sets = {r["doc_id"]: plain(r["text"]) for r in docs.select("doc_id", "text").collect()}
    classes = {r["doc_id"]: r["class"] for r in member.collect()}
    assert classes == {d: printed(s) for d, s in sets.items()}
    different = {printed(s): s for s in sets.values()}
    keys = sorted(different)
    want = {frozenset((a, b)): round(likeness(different[a], different[b]), 9) for i, a in enumerate(keys) for b in keys[:i] if likeness(different[a], different[b]) >= threshold}
    assert {frozenset((r["a"], r["b"])): round(r["jaccard"], 9) for r in pairs.collect()} == want and want
