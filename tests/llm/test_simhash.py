"""SimHash: fingerprints by the words of the rule, links against all pairs."""

import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from wastelake.llm import simhash
from wastelake.llm.common import table
from wastelake.llm.components import components

SF = "/root/testdata/sf0.01"


def plain_print(text, words=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def all_pairs(prints, max_bits):
    """Least member of each fingerprint's component by comparing every pair."""
    u = np.unique(np.array(prints, "<u8"))
    low = np.arange(len(u))
    near = [np.flatnonzero(np.bitwise_count(u ^ x) <= max_bits) for x in u]
    changed = True
    while changed:
        new = np.array([low[n].min() for n in near])
        changed, low = not np.array_equal(new, low), new
    return dict(zip(u.tolist(), low.tolist(), strict=True))


TEXTS = [None, "", " \n", "One", "one", "ÉCOLE a b c", "école a b c", "a b c", "a b c d", "a b  c\td e", "İ x y z w", "w " * 300_000, "same text here now", "Same TEXT here\x0bnow", "x" * 100_000]


def expected(rows, max_bits, words=4):
    prints = [(i, plain_print(t, words)) for i, t in rows]
    root = all_pairs([p for _, p in prints], max_bits)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i is None, i or 0), f"{p:016x}", least.get(root[p])) for i, p in prints)


def got(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in simhash.op9(df).collect())


def test_whole_small_table(spark):
    df = table(spark, SF, "documents")
    assert got(df) == expected([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], 4)


def test_awkward_texts_and_repeats(spark, tmp_path):
    rows = [*enumerate(TEXTS), (3, "One"), (3, "One"), (None, "lonely words of no id"), (None, "a b c")]
    path = str(tmp_path / "d")
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, fp int, _row int, root string").write.parquet(path)
    df = spark.read.parquet(path)
    assert got(df) == expected(rows, 4)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len({c if c is not None else f for _, f, c in got(df)})
    assert got(df.where("false")) == [] and simhash.drop_near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("max_bits, segments, block", [(4, 3, 40), (4, 2, 500), (7, 4, 60), (3, 4, 500), (1, 1, 500)])
def test_links_connect_what_all_pairs_connect(spark, max_bits, segments, block):
    rng = np.random.default_rng(5)
    flips = lambda base, n, k: [int(base) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, k + 1), replace=False)) for _ in range(n)]
    prints = [int(x) for x in rng.integers(0, 2**63, 300, dtype=np.uint64)]
    for base in list(prints[:40]):
        prints += flips(base, 6, max_bits + 2)
    prints += flips(prints[0], 700, 4) + [0, 2**64 - 1]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    if segments == 1:
        with pytest.raises(ValueError):
            simhash.links(df, max_bits, segments)
        return
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(df, max_bits, segments, block)).collect()}
    want = all_pairs(prints, max_bits)
    classes = {}
    for p in prints:
        assert classes.setdefault(want[p], roots.get(p, p)) == roots.get(p, p)
    assert len(set(classes.values())) == len(classes)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (5000, 4000), (4000, 5000)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(61)} == {0} and {out[1000 + i] for i in range(50)} == {1000} and out[5000] == 4000
