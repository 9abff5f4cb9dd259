"""Text quality by positive-unlabelled learning over style features.

Trusted good texts are the positives, texts drawn from the whole corpus the unlabelled web text, the class
prior is the share of good texts among the labels that may be learned from. A small network is fitted under
the non-negative unbiased risk. Every document is scored whole, where it is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wastelake.llm import pu
from wastelake.llm.common import free_name, whole_text
from wastelake.session import materialize

#: Bounds of the fitting sample.
POSITIVES, UNLABELLED = 6_000, 18_000
HIDDEN, DECAYS = 16, (1e-4, 1e-3)
LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = ("upper", "digits", "symbols", "symbol_runs", "lines", "sentence_marks", "commas", "word_length", "long_words", "different", "top_word", "repeats", "bare_symbols", "symbol_ends", "size", "spaces")


def style(text: str) -> list[float]:
    """Shares and rates that describe how a text is written, not what it says."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    squeezed = "".join(words)
    solid = len(squeezed)
    letters = sum(map(len, LETTERS.findall(squeezed)))
    digits = sum(map(str.isdigit, squeezed)) if not squeezed.isalpha() else 0
    upper = sum(map(str.isupper, squeezed))
    counts = Counter(words)
    symbols = solid - letters - digits
    plain = squeezed.count(".") + squeezed.count(",") + squeezed.count("?") + squeezed.count(";") + squeezed.count(":") + squeezed.count("'") + squeezed.count("-")
    return [
        upper / max(1, letters),
        digits / solid,
        symbols / solid,
        (symbols - plain) / solid,
        text.count("\n") / n,
        (squeezed.count(".") + squeezed.count("?")) / n,
        squeezed.count(",") / n,
        np.log1p(solid / n),
        sum(len(w) > 16 for w in words) / n,
        np.log(len(counts)) / np.log(n + 1),
        counts.most_common(1)[0][1] / n if n > 3 else 0.0,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(not LETTERS.search(w) for w in counts) and sum(c for w, c in counts.items() if not LETTERS.search(w)) / n,
        sum(c for w, c in counts.items() if not w[-1].isalnum() and len(w) > 1 and not w[-2].isalnum()) / n,
        np.log(n) / 10,
        1 - solid / chars,
    ]


class Model:
    def __init__(self, net: pu.Net | None, centre: np.ndarray, spread: np.ndarray, constant: float = 0.0) -> None:
        self.net, self.centre, self.spread, self.constant = net, centre, spread, constant

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.constant)
        x = np.array([style(t) for t in texts], float).reshape(-1, len(FEATURES))
        return self.net.score(np.clip((x - self.centre) / self.spread, -8, 8))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """The model; without positive labels or without unlabelled texts every text scores 0 or 1."""
    drawn = pu.sample(docs, labels, label, folds, held, positives, unlabelled)
    if drawn is None:
        return Model(None, np.zeros(1), np.ones(1), 0.0)
    rows = materialize(drawn.rows, "pu_sample")

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"positive": frame["positive"], "x": [list(map(float, style(t))) for t in frame["text"]]})

    got = rows.mapInPandas(describe, "positive int, x array<double>").collect()
    got.sort(key=lambda r: (r["positive"], r["x"]))
    x, y = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["positive"] for r in got])
    if not (y == 0).any():
        return Model(None, np.zeros(1), np.ones(1), 1.0)
    centre, spread = x[y == 0].mean(0), x[y == 0].std(0) + 1e-3
    x = np.clip((x - centre) / spread, -8, 8)
    net = pu.choose(x[y == 1], x[y == 0], drawn.prior, DECAYS, hidden=HIDDEN, epochs=60, rate=0.01)
    return Model(net, centre, spread)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score for every row; null and empty texts count as texts without words; other columns are not read."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.score(list(frame["_text"]))})

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("_text")).mapInPandas(judge, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The input rows, all columns, of texts that score `threshold` or more. An empty table stays empty."""
    model = fit(docs, labels, **options)
    name = free_name(docs, "_score")

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(texts)))

    return docs.withColumn(name, judge(whole_text(text))).where(F.col(name) >= threshold).drop(name)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows. A null id is in no fold and is not held out."""
    out = score(docs, fit(docs, labels, "quality", 3, 1))
    return out.select("doc_id", F.coalesce(pu.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
