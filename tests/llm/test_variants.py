"""Spelling variants against a plain count of words and a comparison of every pair."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wastelake.llm import variants
from wastelake.llm.common import table

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    n = plain_words(rows)
    near = {w: [] for w in n}
    words = sorted(n)
    letters = {w: np.bincount(np.frombuffer(w.encode("latin-1"), np.uint8), minlength=256) for w in words}
    table_ = np.array([letters[w] for w in words]).reshape(len(words), 256)
    for i, a in enumerate(words):  # words of one edit differ in at most two letter counts in all
        for j in np.flatnonzero(np.abs(table_ - letters[a]).sum(1) <= 2):
            if j != i and one_edit(a, words[j]):
                near[a].append(words[j])
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_whole_small_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    want = expected([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert len(want) > 1000 and any(r[1] for r in want)
    assert got(variants.op11(df)) == want


@pytest.mark.parametrize("filter_mb", [64, 0.25])
def test_awkward_rows(spark, filter_mb):
    common = "containers " * 30 + "containerz containerz " * 1 + "contaners contaners containrs containrs " + "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa "
    rows = [(1, common), (2, None), (3, ""), (None, "CONTAINERS école-ÉCOLETTE écolette"), (None, "écolette ćontainer"), (4, "x" * 70_000 + " " + "x" * 70_000), (4, "x" * 69_999), (4, "x" * 69_999), (5, "naïvetés naïvetés naivetés naivetés"), (1, common), (1, common)]
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, Length int")
    assert got(variants.variants(df, filter_mb=filter_mb)) == expected(rows)


def test_chain_of_forms(spark):
    rows = [(i, "rivering") for i in range(1100)] + [(i, "riverinq") for i in range(2000, 2100)] + [(i, "riverina") for i in range(3000, 3003)] + [(i, "rixerina") for i in range(4000, 4060)] + [(i, "rixeriza") for i in range(5000, 5005)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(variants.op11(df)) == expected(rows)


def test_empty_table(spark):
    assert variants.op11(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert variants.op11(spark.createDataFrame([(1, "no word here twice")], "doc_id long, text string")).collect() == []


def test_filters_in_many_pieces(spark):
    """A filter larger than one broadcast is met piece by piece."""
    df = table(spark, "/root/testdata/sf0.001", "documents")
    vocab = variants.materialize(variants.vocabulary(df), "vocab")
    pairs = lambda mb: sorted(tuple(sorted((r["word"], r["other"]))) for r in variants.near_words(vocab, mb, bits=640).collect())
    assert pairs(0.25) == pairs(64)
