"""Ranked search against plain scoring of every document, and the treap against plain sums."""

import math
import re
from collections import Counter

import numpy as np

from wastelake.llm import treap
from wastelake.llm.common import table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, ranks=10):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_all = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:ranks], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


DOCS = [(5, "Alpha beta gamma"), (3, "alpha BETA gamma"), (9, "alpha beta gamma"), (None, "alpha beta gamma"), (1, None), (2, ""), (4, "beta " * 5000), (6, "école École ÉCOLE \u3042\u3044 x1_y2"),
        (7, "delta"), (7, "delta"), (8, "alpha " + "word " * 60_000), (10, "\x7f\x00 --- "), (11, "\U0001f600 delta\u2028delta")]
ITEMS = [(1, "alpha beta"), (2, None), (3, ""), (4, "ÉCOLE \u3042\u3044 y2"), (5, "delta delta"), (6, "nowhere"), (7, "alpha " * 3000 + "word"), (7, "\U0001f600")]


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "z", 2) for d in docs], "doc_id long, text string, n int, terms string, item_id int"),
            spark.createDataFrame([(*i, 1, "z", 2) for i in items], "item_id long, text string, item int, rank string, doc_id int"))


def test_awkward_rows(spark):
    assert got(treap.op13(*frames(spark, DOCS, ITEMS))) == expected(DOCS, ITEMS)


def test_items_in_blocks(spark):
    assert got(treap.search(*frames(spark, DOCS, ITEMS), block_terms=2)) == expected(DOCS, ITEMS)


def test_many_equal_documents(spark):
    docs = [(i * 7919 % 6000, "same words of a copy") for i in range(6000)] + [(7000 + i, f"same other {i}") for i in range(300)]
    items = [(1, "words copy"), (2, "same"), (3, "other same 17")]
    assert got(treap.op13(*frames(spark, docs, items))) == expected(docs, items)


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert treap.op13(docs.limit(0), items).collect() == []
    assert treap.op13(docs, items.limit(0)).collect() == []


def test_whole_small_table(spark):
    docs, items = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    plain = lambda df, key: [(r[key], r["text"]) for r in df.collect()]
    assert got(treap.op13(docs, items)) == expected(plain(docs, "doc_id"), plain(items, "item_id"))


def test_treap_against_sums():
    rng = np.random.default_rng(7)
    for n in (1, 2, 50, 3000):
        cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, 60, n), rng.integers(0, 700, n), rng.integers(1, 9, n))}
        at = np.array(list(cells))
        grid = treap.Treap(at[:, 0], at[:, 1], np.array(list(cells.values())))
        for _ in range(20):
            rows = rng.choice(60, 8, replace=False)
            sums = Counter()
            for (r, c), v in cells.items():
                if r in rows:
                    sums[c] += v
            want = sorted(((s, c) for c, s in sums.items()), key=lambda x: (-x[0], x[1]))
            assert grid.search(np.array(rows)) == want[:10]
            assert grid.search(np.array(rows), 10, 20) == [x for x in want if x[0] >= 20][:10]
