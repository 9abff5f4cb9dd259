"""Positive-unlabelled learning in NumPy: the non-negative unbiased risk, and the samples it is fitted on.

With class prior q, positives P and unlabelled rows U, the risk of a score g under the logistic loss l is
    q E_P[l(g)] + max(0, E_U[l(-g)] - q E_P[l(-g)]).
The second term estimates the risk on negatives; where a mini-batch makes it negative, the step climbs it
back instead of going further down, which keeps flexible models from fitting the positives by heart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from wastelake.llm.common import rereadable, whole_text, with_row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Net:
    """A linear model, or one hidden layer of tanh units."""

    w1: np.ndarray | None
    b1: np.ndarray | None
    w: np.ndarray
    b: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return x if self.w1 is None else np.tanh(x @ self.w1 + self.b1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w + self.b

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def _gradients(net: Net, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
    """Gradients of sum(slope * margin) by (w1, b1, w, b)."""
    h = net.hidden(x)
    out = [h.T @ slope, np.array([slope.sum()])]
    if net.w1 is not None:
        back = slope[:, None] * net.w[None, :] * (1.0 - h * h)
        out = [x.T @ back, back.sum(0), *out]
    return out


def risk_parts(net: Net, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk on positives, and the unbiased estimate of the risk on negatives."""
    soft = lambda z: np.logaddexp(0.0, z).mean()
    gp, gu = net.margin(positive), net.margin(unlabelled)
    return prior * soft(-gp), soft(gu) - prior * soft(gp)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 0, decay: float = 1e-4, epochs: int = 60, rate: float = 0.02, batch: int = 512, seed: int = 7) -> Net:
    """Adam on the non-negative risk. Rows may be stored as small integers; batches are made floating."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    if hidden:
        net = Net(rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    else:
        net = Net(None, None, np.zeros(d), 0.0)
    names = (["w1", "b1"] if hidden else []) + ["w", "b"]
    first = {n: 0.0 for n in names}
    second = {n: 0.0 for n in names}
    steps, t = max(1, -(-len(unlabelled) // batch)), 0
    for epoch in range(epochs):
        order = rng.permutation(len(unlabelled))
        at = 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for k in range(steps):
            u = unlabelled[order[k * batch : (k + 1) * batch]].astype(np.float64)
            p = positive[rng.integers(0, len(positive), batch)].astype(np.float64)
            gp, gu = net.margin(p), net.margin(u)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            below = [prior * -sigmoid(gp) / len(p), sigmoid(gu) / len(u)]
            if negative >= 0:
                grads = [a + b for a, b in zip(_gradients(net, p, below[0] - prior * sigmoid(-gp) / len(p)), _gradients(net, u, below[1]), strict=True)]
            else:
                grads = [-(a + b) for a, b in zip(_gradients(net, p, below[0]), _gradients(net, u, below[1]), strict=True)]
            t += 1
            for n, g in zip(names, grads, strict=True):
                value = getattr(net, n)
                g = g.reshape(np.shape(value)) + (decay * value if n.startswith("w") else 0.0)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                step = first[n] / (1 - 0.9**t) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
                setattr(net, n, value - rate * (at + 0.02) * step)
            net.b = float(net.b)
    return net


def choose(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decays: tuple[float, ...], **options) -> Net:
    """Fit with each decay on four fifths, keep the decay of least non-negative risk on the rest, fit on all."""
    rng = np.random.default_rng(11)
    p, u = rng.random(len(positive)) < 0.8, rng.random(len(unlabelled)) < 0.8
    if len(decays) > 1 and p.any() and u.any() and not (p.all() or u.all()):

        def held(decay: float) -> float:
            good, bad = risk_parts(fit(positive[p], unlabelled[u], prior, decay=decay, **options), positive[~p].astype(float), unlabelled[~u].astype(float), prior)
            return good + max(0.0, bad)

        decays = (min(decays, key=held),)
    return fit(positive, unlabelled, prior, decay=decays[0], **options)


def centred(net: Net, unlabelled: np.ndarray, prior: float) -> Net:
    """The same model with its bias moved so that the mean score of the unlabelled rows is the class prior."""
    margin = net.margin(unlabelled.astype(np.float64))
    low, high = -30.0, 30.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sigmoid(margin + mid).mean() < prior else (low, mid)
    return Net(net.w1, net.b1, net.w, float(net.b + (low + high) / 2))


def fold(id: Column, folds: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % folds


@dataclass
class Sample:
    """prior: share of positives among the labelled rows that may be learned from; rows: text, positive."""

    prior: float
    rows: DataFrame


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, positives: int, unlabelled: int) -> Sample | None:
    """Trusted positives of the open folds and unlabelled texts of the whole corpus, each of bounded expected size.

    A hash of the id draws positives and a hash of the row's place draws unlabelled texts, so reruns agree. Labels
    of the held-out fold are dropped before anything else is read from them. None if there is no positive.
    """
    open_ = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max(label).alias("_label"))
    n = open_.agg(F.count("*").alias("all"), F.sum(F.col("_label").cast("long")).alias("positive")).first()
    if not n["positive"]:
        return None
    unit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) / float(1 << 30)
    chosen = open_.where((F.col("_label") == 1) & (unit("doc_id") < positives / n["positive"])).select("doc_id")
    docs = rereadable(docs)
    texts = docs.select("doc_id", whole_text().alias("text"))
    good = texts.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select("text", F.lit(1).alias("positive"))
    rows, row = with_row(docs)
    any_ = rows.where(unit(row) < unlabelled / max(1, docs.count())).select(whole_text().alias("text"), F.lit(0).alias("positive"))
    return Sample(n["positive"] / n["all"], good.unionByName(any_))
