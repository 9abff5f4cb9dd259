"""Token files: the library's ids of whole texts, exact round trip, random access."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from wastelake.llm import arrow_tokens as at
from wastelake.llm.common import table

SF = "/root/testdata/sf0.01"
AWKWARD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\nb", "a\n\nb c", "it's they'll 'sand  x", "\ta\tb", "é à  ñ", "漢字 かな", "a b", "a  b", "a\x1cb \x1c c", "x\x0b y", "a\r\nb",
    "<|endoftext|>", "a <|endoftext|> b", "# ## ### #", "1 22 333 a1b2", "!!! ... ,,,", "\u0085 x", "a ́b", "𝄞 𝄞𝄞", "end\n", "\nstart", "w " * 5000, "word" * 5000, "0" * 3000, " lead\nline two\nthree",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(at.tokenizer_path())


def plain(library, rows):
    out, start = [], 0
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_units_keep_the_ids(library):
    encoder = at.Encoder(at.tokenizer_path())
    texts = [t or "" for t in AWKWARD] + [f"{a}{s}{b}" for s in (" ", "  ", "\n", " \n", "\n ", "\t", " ", "　", "\x1f", "'s ", " 's") for a in ("a", "1", "!", "é", "a ", "'") for b in ("b", "2", "?", " c", "'t")]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), encoder.type).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_small_table_word_alone(spark, library):
    encoder = at.Encoder(at.tokenizer_path())
    assert encoder.plain
    words = {w for r in table(spark, SF, "documents").select("text").collect() for w in r["text"].split()} | {"ª", "ĳ", "ǅx", "a.", "é,", "..", ".", "don't", "Ŀ!", "naïve?", "ß", "abc:", "x²", "ɐ", "한글."}
    for word in words:
        assert np.frombuffer(encoder.after_space[word], encoder.type).tolist() == library.encode(" " + word, add_special_tokens=False).ids, word


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(at, "REMEMBERED", 3)
    encoder = at.Encoder(at.tokenizer_path())
    for texts in (["a b"], ["a b c d e f", "b"], ["z a", ""]):
        assert [np.frombuffer(encoder.encode(t), encoder.type).tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_small_table(spark, library):
    docs = table(spark, SF, "documents")
    want = plain(library, sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    assert sorted(tuple(r) for r in at.op5(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_awkward_rows(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, "again"), (3, "again"), (None, "no id")]
    path = str(tmp_path / "d")
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, start int, _row string, part int").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    got = sorted((tuple(r) for r in at.op5(df).collect()), key=lambda r: r[1])
    assert got == plain(library, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert at.op5(df.where("false")).count() == 0


def test_random_access(spark, tmp_path):
    docs = table(spark, SF, "documents").where("doc_id < 60").coalesce(1)
    manifest = at.write_tokens(docs, f"file://{tmp_path}/t", at.tokenizer_path(), length=64).collect()
    for m in manifest:
        f = at.TokenFile(m["ids_path"])
        rows = [f.sequence(i) for i in range(m["sequences"])]
        assert all(len(ids) == 64 and not ids.flags.owndata for ids, _ in rows)
        mask = np.concatenate([x for _, x in rows])
        assert mask.sum() == m["tokens"] and mask[: m["tokens"]].all()
        stream = np.concatenate([x for x in f.stretches(0, m["tokens"])])
        assert np.array_equal(np.concatenate([i for i, _ in rows])[mask], stream)
        ids, _ = f.sequence(m["sequences"] // 2)
        assert np.array_equal(ids, rows[m["sequences"] // 2][0])
