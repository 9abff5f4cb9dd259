"""Toxicity by non-negative positive-unlabelled learning over word and word-stem features.

Confirmed toxic texts are the positives; texts drawn from the whole corpus, labels unseen, are the
unlabelled set. A text is the set of its words and of their leading parts, so inflected forms share a
feature. Spark counts the features and keeps those that best tell positives from unlabelled texts, each with
its precision by the class prior: prior times its share of positives over its share of unlabelled texts. A
linear model over the features and the two highest precisions of a text is fitted under the prior-corrected
risk. Every document is then scored whole, where it is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wastelake.llm import pu
from wastelake.llm.common import whole_text
from wastelake.session import materialize

#: Bounds of the fitting sample and of the model.
POSITIVES, UNLABELLED, FEATURES, LEAST_TEXTS = 6_000, 18_000, 1_000, 5
#: Least log likelihood ratio of a feature: hundreds of thousands are tried.
LEAST_GAIN = 9.0
STEMS = (3, 4, 5, 6)
DECAYS = (1e-5, 1e-4, 1e-3)
WORDS = re.compile(r"[^\W\d_]+")
#: Words whose features a worker remembers.
REMEMBERED = 200_000


def word_features(word: str) -> list[str]:
    """The word and its leading parts, marked by a star where the word goes on."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def text_features(text: str) -> set[str]:
    return {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}


def select_features(rows: DataFrame, prior: float, features: int = FEATURES, least: int = LEAST_TEXTS, gain_least: float = LEAST_GAIN) -> dict[str, float]:
    """Precision of the features whose share of positives differs most from their share of unlabelled texts (likelihood ratio)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for frame in frames:
            for text, positive in zip(frame["text"], frame["positive"], strict=True):
                seen[positive].update(text_features(text))
        for positive, counts in seen.items():
            if counts:
                yield pd.DataFrame({"feature": list(counts), "positive": positive, "n": list(counts.values())})

    sizes = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    np_, nu = sizes.get(1, 0), sizes.get(0, 0)
    found = rows.mapInPandas(count, "feature string, positive int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("positive") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive") == 0, F.col("n")).otherwise(0)).alias("u")
    )
    rate = (F.col("p") + F.col("u") + 1.0) / (np_ + nu + 2.0)
    part = lambda n, size: (F.col(n) + 0.5) * F.log((F.col(n) + 0.5) / (rate * (size + 1)))
    gain = part("p", np_) + part("u", nu)
    best = found.where((F.col("p") + F.col("u") >= least) & (gain >= gain_least)).orderBy(gain.desc(), "feature").limit(features)
    precision = F.least(F.lit(1.0), prior * F.col("p") / max(1, np_) / ((F.col("u") + 1.0) / (nu + 1)))
    return {r["feature"]: r["precision"] for r in best.select("feature", precision.alias("precision")).collect()}


class Model:
    """Weight and precision by feature; a worker remembers the features of words it has met."""

    def __init__(self, weights: dict[str, float], precision: dict[str, float], tops: tuple[float, float], bias: float) -> None:
        self.weights, self.precision, self.tops, self.bias = weights, precision, tops, bias
        self.met: dict[str, tuple[str, ...]] = {}

    def features(self, text: str) -> list[str]:
        out: set[str] = set()
        for word in set(WORDS.findall(text.lower())):
            known = self.met.get(word)
            if known is None:
                known = tuple(f for f in word_features(word) if f in self.precision)
                if len(self.met) < REMEMBERED:
                    self.met[word] = known
            out.update(known)
        return sorted(out)

    def highest(self, found: list[str]) -> list[float]:
        return sorted([0.0, 0.0, *(self.precision[f] for f in found)])[:-3:-1]

    def score(self, text: str) -> float:
        found = self.features(text)
        margin = self.bias + sum(self.weights[f] for f in found) + sum(a * b for a, b in zip(self.tops, self.highest(found), strict=True))
        return float(pu.sigmoid(np.float64(margin)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """The model; without any positive label every text scores 0 to the last bit of its bias."""
    drawn = pu.sample(docs, labels, label, folds, held, positives, unlabelled)
    if drawn is None:
        return Model({}, {}, (0.0, 0.0), -50.0)
    rows = materialize(drawn.rows, "pu_sample")
    precision = select_features(rows, drawn.prior)
    place = {f: i for i, f in enumerate(sorted(precision))}

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model({}, precision, (0.0, 0.0), 0.0)
        for frame in frames:
            found = [model.features(t) for t in frame["text"]]
            yield pd.DataFrame({"positive": frame["positive"], "at": [[place[f] for f in x] for x in found], "tops": [model.highest(x) for x in found]})

    marked = rows.mapInPandas(mark, "positive int, at array<int>, tops array<double>").collect()
    marked.sort(key=lambda r: (r["positive"], r["at"]))
    x = np.zeros((len(marked), len(place) + 2), np.float32)
    for i, r in enumerate(marked):
        x[i, r["at"]] = 1
        x[i, -2:] = r["tops"]
    y = np.array([r["positive"] for r in marked])
    if not (y == 0).any():
        return Model({}, {}, (0.0, 0.0), 50.0)
    net = pu.centred(pu.choose(x[y == 1], x[y == 0], drawn.prior, DECAYS, epochs=40, rate=0.03), x[y == 0], drawn.prior)
    return Model({f: float(net.w[i]) for f, i in place.items()}, precision, (float(net.w[-2]), float(net.w[-1])), net.b)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score for every row; null and empty texts score by the bias alone; other columns are not read."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [model.score(t) for t in frame["_text"]]})

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("_text")).mapInPandas(judge, f"doc_id {kind}, score double")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows. A null id is in no fold and is not held out."""
    out = score(docs, fit(docs, labels, "toxic", 5, 0))
    return out.select("doc_id", F.coalesce(pu.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
