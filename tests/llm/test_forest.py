"""Near-duplicates of the LSH forest against every pair by exact similarity."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from wastelake.llm import forest, similar
from wastelake.llm.common import table


def plain_set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def expected(rows, percent=85):
    """doc_id, set size, least id of the component: pairs that share a shingle are counted, all of them."""
    sets = [plain_set(t) for _, t in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=lambda s: sorted(s))
    root = {s: i for i, s in enumerate(distinct)}
    up = list(range(len(distinct)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    holders, shared = defaultdict(list), Counter()
    for i, s in enumerate(distinct):
        for g in s:
            holders[g].append(i)
    for held in holders.values():
        for k, a in enumerate(held):
            for b in held[k + 1 :]:
                shared[a, b] += 1
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(distinct[a]) + len(distinct[b]) - k):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(root[s])] = min(i, least.get(find(root[s]), i))
    out = []
    for (i, _), s in zip(rows, sets):
        c = least.get(find(root[s])) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.random()}"
    return " ".join(out)


def test_whole_small_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    assert got(forest.op12(df)) == expected([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_awkward_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (7, "One two three four\x0bfive"), (8, "a " * 50_000), (9, "a a a a a a"),
            (None, "no id of this text at all"), (None, "no id of this text at all"), (10, "no id of this TEXT at all"), (11, "É b c d e"), (12, "é b c d e"), (6, "one two three four five"),
            (13, " ".join(map(str, range(40_000)))), (14, " ".join(map(str, range(41_000)))), (None, "alone and null here now"), (None, None), (16, "x" * 200_000)]
    path = str(tmp_path / "d")
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, node int, _row int, key string").write.parquet(path)
    want = sorted(((i, n, c, i == c) for i, n, c, _ in expected(rows)), key=str)
    assert got(forest.op12(spark.read.parquet(path))) == want


def test_group_of_all_degrees(spark, monkeypatch):
    """One crowded group: copies of one text with few to many edits, and texts that only share a passage; small blocks."""
    rng = random.Random(4)
    base, passage = [f"w{i}" for i in range(150)], [f"p{i}" for i in range(105)]
    rows = [(i, edited(rng, base, rng.randint(0, 9))) for i in range(300)]
    rows += [(1000 + i, " ".join([*passage, *(f"o{i}x{k}" for k in range(20))])) for i in range(300)]
    monkeypatch.setattr(similar, "BLOCK", 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(forest.near_groups(df, crowded=20).withColumn("kept", forest.F.col("doc_id").eqNullSafe(forest.F.col("component_id")))) == expected(rows)


def test_empty_table(spark):
    assert forest.op12(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert got(forest.op12(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == [(1, 0, 1, True)]


def test_product_counts_shared_elements():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (0, 1, 50, 3000, 8000, 8000)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got_ = similar.product(sets)
    assert [[got_[i][j] for j in range(6) if j != i] for i in range(6)] == [[want[i][j] for j in range(6) if j != i] for i in range(6)]
    assert similar.product(sets[3:5]).tolist() == [[len(sets[3]), want[3][4]], [want[3][4], len(sets[4])]]
