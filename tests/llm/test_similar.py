"""Near copies by exact similarity: what the pipeline's stage drops, against planted pairs and all pairs."""

import random
import re

import corpus_pipeline as cp
from wastelake.llm.common import table

SF = "/root/testdata/sf0.01"


def stage(spark, tmp_path, texts):
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(path)
    return {r["doc_id"] for r in cp.drop_near_copies(spark, spark.read.parquet(path), SF).collect()}


def grams(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def words(rng, n):
    return [f"{rng.getrandbits(40):x}" for _ in range(n)]


def test_shared_passages_and_repeated_lines_stay(spark, tmp_path):
    rng = random.Random(3)
    passage, line = words(rng, 304), words(rng, 7)
    texts = [" ".join(passage + words(rng, 100)) for _ in range(300)]  # Jaccard 0.6
    texts += [" ".join(line * 20 + words(rng, 150)) for _ in range(40)]  # Jaccard 0.02
    assert stage(spark, tmp_path, texts) == set(range(len(texts)))


def test_near_copies_from_the_threshold_on_go(spark, tmp_path):
    rng = random.Random(4)
    texts, copies = [], {0.8: [], 0.9: []}
    for at in copies:
        for _ in range(150):
            own = round(400 * (1 - at) / (1 + at))  # shingles only one of the two has
            shared = words(rng, 404 - own)
            texts += [" ".join(shared + words(rng, own)), " ".join(shared + words(rng, own))]
            assert jaccard(grams(texts[-1]), grams(texts[-2])) >= at
            copies[at].append(len(texts) - 1)
    kept = stage(spark, tmp_path, texts)
    assert kept >= set(range(0, len(texts), 2))
    for at, ids in copies.items():
        assert sum(i not in kept for i in ids) >= 0.97 * len(ids), at


def test_chain_keeps_one_and_unlike_neighbours_stay(spark, tmp_path):
    rng = random.Random(5)
    base = words(rng, 404)
    chain = [" ".join(base[: 404 - 20 * k] + words(rng, 20 * k)) for k in range(4)]
    texts = [*chain, "One two", "one  TWO", "one two three", None, "", " \n"]
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if jaccard(sets[i], sets[j]) >= 0.8) for i in range(len(texts))]
    assert stage(spark, tmp_path, texts) == set(root)


def test_whole_small_table_against_all_pairs(spark):
    docs = table(spark, SF, "documents")
    rows = sorted((r["doc_id"], grams(r["text"])) for r in docs.select("doc_id", "text").collect())
    root = {i: i for i, _ in rows}
    pairs = [(i, j) for k, (i, a) in enumerate(rows) for j, b in rows[k + 1 :] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(a, b) >= 0.8]
    for _ in rows:
        before = dict(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert {r["doc_id"] for r in cp.drop_near_copies(spark, docs, SF).collect()} == set(root.values())


def test_what_moves_follows_the_members_of_a_group(spark, tmp_path, monkeypatch):
    """Texts that share a passage (Jaccard about 0.7): all stay, and the rows compared grow with the texts, not with their pairs."""
    from wastelake.llm import similar

    rng, seen = random.Random(9), []
    passage = words(rng, 170)
    plain = similar.unit_links

    def counted(units, *rest):
        seen.append(units.count())
        return plain(units, *rest)

    monkeypatch.setattr(similar, "unit_links", counted)
    for n in (500, 2000):
        texts = [" ".join(passage + words(rng, 34)) for _ in range(n)]
        assert stage(spark, tmp_path / str(n), texts) == set(range(n))
    assert seen[1] <= 8 * max(seen[0], 500), seen
