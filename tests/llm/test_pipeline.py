"""The pipeline stage by stage against plain versions of what each stage decides."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from wastelake.llm import mixing, quality
from wastelake.llm.common import table

SF = "/root/testdata/sf0.01"


def grams(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    out = docs
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(out.collect())
        if k < 4:
            assert out.columns == columns and all(r == rows[r["doc_id"]] for r in kept[-1])
    good, unlike, far, mixed, packed = kept

    judged = {r["doc_id"] for r in quality.op6(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(judged)

    groups = defaultdict(list)
    for r in good:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"])].append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in unlike) == sorted(min(g)[1] for g in groups.values())

    sets = {r["doc_id"]: grams(r["text"], cp.WORDS) for r in unlike}
    root, ids = {d: d for d in sets}, sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= cp.SIMILARITY * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert near and sorted(r["doc_id"] for r in far) == sorted(set(root.values()))

    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_copies(spark.read.parquet(f"{tmp_path}/2")).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: n for d, n in plan.items() if n})

    tokens = Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) + 1
    assert tokens == want

    result = cp.run(spark, SF)
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, packed))
