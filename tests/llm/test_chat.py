"""Perspective rotation: the SQL twin, a plain rendering, crowded and awkward dialogues."""

from collections import Counter, defaultdict

from tests.compare import compare, duck
from wastelake.llm import chat
from wastelake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, row int, said int, c int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).coalesce(1)


def plain(rows):
    """Whole renderings by (conversation, perspective): text and the strings under the mask."""
    talks, out = defaultdict(list), {}
    for k, (c, t, r, x) in enumerate(rows):
        talks[c].append((t is None, t or 0, k, (r or "unknown").replace("<|", "< |"), (x or "").replace("<|", "< |")))
    for c, said in talks.items():
        said.sort()
        for me in {r for *_, r, _ in said} - {"system"}:
            name = lambda r: "assistant" if r == me else "system" if r == "system" else "user " + r  # noqa: B023, E731
            out[c, me] = "".join(f"<|start|>{name(r)}\n{x}<|end|>\n" for *_, r, x in said), [x + "<|end|>" for *_, r, x in said if r == me]
    return out


def joined(df):
    parts, out = defaultdict(list), {}
    for r in df.collect():
        parts[r["conv_id"], r["perspective"]].append((r["first_turn"] is None, r["first_turn"] or 0, r["piece"], r["text"], [r["text"][m["start"] : m["end"]] for m in r["mask"]]))
    for k, v in parts.items():
        v.sort()
        out[k] = "".join(x[3] for x in v), [m for x in v for m in x[4]]
    return out


def test_twin(spark):
    assert compare(spark, duck(SF), SF, QUERIES["op7_perspectives"], ORACLES["op7_perspectives"]) is None


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "hello"), (1, 3, "cy", None), (1, 4, "ann", ""), (2, 0, "system", "alone"), (3, 5, "ann", "one"), (3, 2, "ann", "two"),
    (4, None, "bob", "late"), (4, 7, "ann", "early"), (None, 1, None, "who"), (None, 1, "", "who"), (None, None, "<|x", "odd"), (5, 1, "ann", "same"), (5, 1, "ann", "same"), (6, -3, "é", "𝄞" * 3000), (6, -2000, "bob", "first"),
]


def test_plain_rendering(spark):
    assert joined(chat.rotate(frame(spark, ROWS))) == plain(ROWS)
    assert joined(chat.rotate(frame(spark, ROWS), span=3)) == plain(ROWS)
    assert chat.op7(frame(spark, ROWS).where("false")).count() == 0


def test_crowded_dialogue_is_cut_and_whole(spark):
    rows = [(1, k // 40, f"p{k % 3}", f"line {k}") for k in range(4000)] + [(2, k, "ann", str(k)) for k in range(3000)]
    df = chat.rotate(frame(spark, rows), crowd=1500)
    assert joined(df) == plain(rows)
    sizes = Counter((r["conv_id"], r["n_turns"]) for r in df.collect())
    assert max(n for _, n in sizes) <= 1024
