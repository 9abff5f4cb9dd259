"""A random forest whose upper levels are grown by counts of all tasks and whose branches by the task that gets their rows.

What moves: per level the class counts of the nodes above `BRANCH_ROWS` rows, then each tree's rows once, packed, to their
branch. A forest is bounded by its trees and depth, not by the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from wastelake.functions import hashing as H
from wastelake.session import materialize, spread

CLASSES = 5
#: Cuts of a number, as quantiles of the training rows; numbers with fewer values are cut between all of them.
BINS = 32
#: Drawn rows of a node up to which one task grows the rest of its branch; rows a task packs at a time; trees of one broadcast.
BRANCH_ROWS, PACK_ROWS, TREES = 160_000, 100_000, 10
#: Rows times columns with a moved value scored at a time; rows of a node from which its columns are counted one by one; nodes counted and split at a time.
MOVED_ROWS, NODE_ROWS, COUNT_NODES, SPLIT_NODES = 40_000, 500, 1_024, 64
TREE = "feature binary, cut binary, left binary, share binary"
OWN = "own_"  # before the inputs a row had before values changed places


@dataclass(frozen=True)
class Settings:
    """How rows become codes (one number per input) and encoded columns, and how trees are grown.

    Encoded column i tests the code of input `inputs[i]`: its bin, or whether it is `values[i]` (-1: its bin).
    """

    cuts: list[np.ndarray]
    inputs: np.ndarray
    values: np.ndarray
    class_weights: np.ndarray
    trees: int
    depth: int
    least: int
    rate: float

    @property
    def tried(self) -> int:
        return ceil(sqrt(len(self.inputs))) if self.trees > 1 else len(self.inputs)

    def codes(self, batch: pa.RecordBatch, numeric: list[str], categorical: list[str], before: str = "") -> np.ndarray:
        column = lambda c: batch.column(batch.schema.get_field_index(f"{before}{c}")).to_numpy(zero_copy_only=False)
        parts = [np.searchsorted(cuts, column(f"{c}_filled")) for c, cuts in zip(numeric, self.cuts, strict=True)]
        parts += [column(f"{c}_missing") for c in numeric] + [column(f"{c}_index") for c in categorical]
        return np.column_stack([p.astype(np.uint16) for p in parts])

    def bins(self, codes: np.ndarray, encoded: np.ndarray) -> np.ndarray:
        code, value = codes[np.arange(len(codes)), self.inputs[encoded]], self.values[encoded]
        return np.where(value < 0, code, code == value)

    def drawn(self, hashes: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is drawn for a tree: Poisson by the row's hash, the same in every pass."""
        z = hashes + np.uint64((0x9E3779B97F4A7C15 * (tree + 1)) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
        return np.searchsorted(np.cumsum([exp(-self.rate) * self.rate**k / factorial(k) for k in range(16)]), u, "right")

    def subset(self, nodes: int, *seed: int) -> np.ndarray:
        """Encoded columns each node may split by."""
        order = np.random.default_rng([H.SEED, *seed]).random((nodes, len(self.inputs)))
        return np.argsort(order, axis=1)[:, : self.tried]

    def counts(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray, node: np.ndarray, subset: np.ndarray) -> np.ndarray:
        """Drawn rows by node, tried column, bin and class."""
        nodes, tried = subset.shape
        out = np.zeros((CLASSES, nodes, tried, BINS))
        if len(node) < NODE_ROWS * nodes:
            first, start, flat = (y * nodes + node) * BINS, np.arange(len(codes)) * codes.shape[1], codes.ravel()
            for k in range(tried):
                asked, value = self.inputs[subset[:, k]], self.values[subset[:, k]]
                code, value = flat.take(start + asked.take(node)), value.take(node)
                at = first + np.where(value < 0, code, code == value)
                out[:, :, k] = np.bincount(at, weights=n, minlength=CLASSES * nodes * BINS).reshape(CLASSES, nodes, BINS)
        else:
            order = np.argsort(node, kind="stable")
            codes, first, n, ends = codes[order], y[order] * BINS, n[order], np.cumsum(np.bincount(node, minlength=nodes))
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                for k, column in enumerate(subset[i]):
                    code, value = codes[a:b, self.inputs[column]], self.values[column]
                    at = first[a:b] + (code if value < 0 else code == value)
                    out[:, i, k] = np.bincount(at, weights=n[a:b], minlength=CLASSES * BINS).reshape(CLASSES, BINS)
        return np.moveaxis(out, 0, -1)

    def best(self, counts: np.ndarray, subset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per node the split of largest Gini gain: encoded column, cut, gain times weight (0: no split), class counts to its left."""
        if len(counts) > SPLIT_NODES:
            parts = [self.best(counts[i : i + SPLIT_NODES], subset[i : i + SPLIT_NODES]) for i in range(0, len(counts), SPLIT_NODES)]
            return tuple(map(np.concatenate, zip(*parts)))
        counts = np.ascontiguousarray(np.moveaxis(counts, -1, 0))  # by class: sums over classes are sums of arrays
        left = counts.cumsum(3)[..., :-1]
        total = counts[:, :, 0].sum(2)
        right = total[:, :, None, None] - left
        valid = (left.sum(0) >= self.least) & (right.sum(0) >= self.least)
        weights = self.class_weights[:, None]
        w = total * weights
        pure = lambda c: (c * c).sum(0) / np.maximum(c.sum(0), 1e-300)
        gain = np.where(valid, pure(left * weights[..., None, None]) + pure(right * weights[..., None, None]) - pure(w)[:, None, None], 0.0).reshape(total.shape[1], -1)
        at, i = gain.argmax(1), np.arange(total.shape[1])
        gain = gain[i, at]
        k, cut = np.divmod(at, BINS - 1)
        return subset[i, k], cut, np.where(gain > 1e-12 * w.sum(0), gain, 0.0), left.reshape(CLASSES, len(gain), -1)[:, i, at].T

    def splits(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray, node: np.ndarray, subset: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encoded column, cut and gain of each node from its rows, `COUNT_NODES` nodes at a time, whose counts are held."""
        if len(subset) <= COUNT_NODES:
            return self.best(self.counts(codes, y, n, node, subset), subset)[:3]
        order, parts = np.argsort(node, kind="stable"), []
        ends = np.searchsorted(node[order], np.arange(0, len(subset) + COUNT_NODES, COUNT_NODES))
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            rows, of = order[a:b], subset[i * COUNT_NODES : (i + 1) * COUNT_NODES]
            parts.append(self.best(self.counts(codes[rows], y[rows], n[rows], node[rows] - i * COUNT_NODES, of), of)[:3])
        return tuple(map(np.concatenate, zip(*parts)))

    def shares(self, counts: np.ndarray) -> np.ndarray:
        w = counts * self.class_weights
        return (w / np.maximum(w.sum(-1, keepdims=True), 1e-300)).astype(np.float32)


@dataclass
class Tree:
    """Nodes as arrays: encoded column (-1: none, a leaf), cut, left child (the right one follows it), class shares."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray
    _steps: np.ndarray | None = None
    _asked: np.ndarray | None = None

    @staticmethod
    def of(feature: bytes, cut: bytes, left: bytes, share: bytes) -> Tree:
        return Tree(np.frombuffer(feature, np.int32), np.frombuffer(cut, np.int16), np.frombuffer(left, np.int32), np.frombuffer(share, np.float32).reshape(-1, CLASSES))

    def parts(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.feature.astype(np.int32).tobytes(), self.cut.astype(np.int16).tobytes(), self.left.astype(np.int32).tobytes(), self.share.astype(np.float32).tobytes()

    def ends(self, codes: np.ndarray, settings: Settings, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, or of the rows named."""
        start = (np.arange(len(codes)) if rows is None else rows) * codes.shape[1]
        steps, codes = self._walk(settings), codes.ravel()
        at = np.zeros(len(start), np.int32)
        while True:
            step = steps.take(at, axis=0)
            code = codes.take(start + step[:, 0]) - step[:, 1]
            after = step[:, 3] + ((code >= 0) & (code <= step[:, 2]))
            if np.array_equal(after, at):
                return at
            at = after

    def _walk(self, settings: Settings) -> np.ndarray:
        """Per node the input it asks, the first code and the number of further codes that go right, and the left child; a leaf stays."""
        if self._steps is None:
            value, leaf, far = settings.values[self.feature], self.feature < 0, 1 << 20
            first = np.where(leaf, far, np.where(value < 0, self.cut + 1, value))
            further = np.where(value < 0, far, 0)
            self._steps = np.column_stack([settings.inputs[self.feature], first, further, np.where(leaf, np.arange(len(leaf)), self.left)]).astype(np.int32)
        return self._steps

    def asked(self, settings: Settings, place: np.ndarray, columns: int) -> np.ndarray:
        """Per node, which columns the way to it asks; `place` names the column of each input (-1: none)."""
        if self._asked is None:
            self._asked, nodes = np.zeros((len(self.feature), columns + 1), bool), np.zeros(1, int)
            while len(nodes := nodes[self.feature[nodes] >= 0]):
                here = self._asked[nodes]
                here[np.arange(len(nodes)), place[settings.inputs[self.feature[nodes]]]] = True
                for child in (self.left[nodes], self.left[nodes] + 1):
                    self._asked[child] = here
                nodes = np.concatenate([self.left[nodes], self.left[nodes] + 1])
        return self._asked

    def with_branches(self, branches: dict[int, Tree]) -> Tree:
        """Each branch in the place of the leaf it grows from."""
        feature, cut, left, share = ([a.copy()] for a in (self.feature, self.cut, self.left, self.share))
        size = len(self.feature)
        for node, b in sorted(branches.items()):
            moved = np.where(b.feature >= 0, b.left - 1 + size, 0)
            feature[0][node], cut[0][node], left[0][node], share[0][node] = b.feature[0], b.cut[0], moved[0], b.share[0]
            for whole, part in ((feature, b.feature), (cut, b.cut), (left, moved), (share, b.share)):
                whole.append(part[1:])
            size += len(b.feature) - 1
        return Tree(*map(np.concatenate, (feature, cut, left, share)))


def grown(settings: Settings, codes: np.ndarray, y: np.ndarray, n: np.ndarray, depth: int, *seed: int) -> tuple[Tree, np.ndarray]:
    """The rest of a branch from its rows, level by level, and the gain by encoded column."""
    levels, gains, node, nodes, size = [], np.zeros(len(settings.inputs)), np.zeros(len(y), np.int64), 1, 1
    while nodes:
        total = np.bincount(node * CLASSES + y, weights=n, minlength=nodes * CLASSES).reshape(nodes, CLASSES)
        feature, cut, left = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes, int)
        levels.append((feature, cut, left, settings.shares(total)))
        open_ = np.flatnonzero((total.sum(1) >= 2 * settings.least) & (total.max(1) < total.sum(1))) if depth < settings.depth else []
        if not len(open_):
            break
        place = np.full(nodes, -1)
        place[open_] = np.arange(len(open_))
        keep = place[node] >= 0
        codes, y, n, node = codes[keep], y[keep], n[keep], place[node[keep]]
        subset = settings.subset(len(open_), *seed, depth)
        chosen, cuts, gain = settings.splits(codes, y, n, node, subset)
        np.add.at(gains, chosen, gain)
        split = np.flatnonzero(gain > 0)
        child = np.full(len(open_), -1)
        child[split] = 2 * np.arange(len(split))
        feature[open_[split]], cut[open_[split]], left[open_[split]] = chosen[split], cuts[split], size + child[split]
        keep = child[node] >= 0
        codes, y, n, node = codes[keep], y[keep], n[keep], node[keep]
        node = child[node] + (settings.bins(codes, chosen[node]) > cuts[node])
        nodes, depth, size = 2 * len(split), depth + 1, size + 2 * len(split)
    return Tree(*map(np.concatenate, zip(*levels))), gains


def _packed(batches):
    """Hash, class and codes of a task's rows, `PACK_ROWS` or so at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACK_ROWS:
            yield _unpack(held)
            held, rows = [], 0
    if rows:
        yield _unpack(held)


def _unpack(held):
    t = pa.Table.from_batches(held)
    x = b"".join(t.column("x").to_pylist())
    return t.column("h").to_numpy().view(np.uint64), t.column("y").to_numpy().astype(np.int64), np.frombuffer(x, np.uint16).reshape(t.num_rows, -1)


def _level(settings: Settings, trees: list[Tree], depths: list[dict[int, int]]):
    """Class counts of the open nodes of all trees over one task's rows."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for h, y, codes in _packed(batches):
            for t, (tree, nodes) in enumerate(zip(trees, depths)):
                if not nodes:
                    continue
                place = np.full(len(tree.feature), -1)
                place[list(nodes)] = np.arange(len(nodes))
                n = settings.drawn(h, t)
                rows = np.flatnonzero(n)
                node = place[tree.ends(codes[rows], settings)]
                rows, node = rows[node >= 0], node[node >= 0]
                subset = np.concatenate([settings.subset(1, t, k) for k in nodes])
                found = settings.counts(codes[rows], y[rows], n[rows], node, subset)
                for k, c in zip(nodes, found):
                    sums[t, k] = sums[t, k] + c if (t, k) in sums else c
        if sums:
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t for t, _ in sums], pa.int32()), "node": pa.array([k for _, k in sums], pa.int32()), "counts": pa.array([c.astype(np.int32).tobytes() for c in sums.values()], pa.binary())})

    return run


def _split(settings: Settings):
    def run(key, rows):
        t, k = map(int, key)
        counts = sum(np.frombuffer(c, np.int32).astype(float) for c in rows["counts"]).reshape(1, settings.tried, BINS, CLASSES)
        feature, cut, gain, left = settings.best(counts, settings.subset(1, t, k))
        total = counts[0, 0].sum(0)
        return pd.DataFrame([(t, k, int(feature[0]), int(cut[0]), float(gain[0]), left[0].tolist(), (total - left[0]).tolist())], columns=["tree", "node", "feature", "cut", "gain", "below", "above"])

    return run


def _to_branches(settings: Settings, trees: list[Tree], depths: list[dict[int, int]]):
    """Each tree's rows, packed by branch: class, times drawn, codes."""

    def run(batches):
        for h, y, codes in _packed(batches):
            for t, (tree, nodes) in enumerate(zip(trees, depths)):
                n = settings.drawn(h, t)
                rows = np.flatnonzero(n)
                end = tree.ends(codes[rows], settings)
                order = np.argsort(end, kind="stable")
                rows, end = rows[order], end[order]
                starts = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else []
                out = [(int(end[i]), rows[i:j]) for i, j in zip(starts, [*starts[1:], len(end)]) if int(end[i]) in nodes]
                if out:
                    blob = lambda a: pa.array([a[r].tobytes() for _, r in out], pa.binary())
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t] * len(out), pa.int32()), "node": pa.array([k for k, _ in out], pa.int32()), "depth": pa.array([nodes[k] for k, _ in out], pa.int32()), "y": blob(y.astype(np.uint8)), "n": blob(n.astype(np.uint8)), "x": blob(codes)})

    return run


def _branch(settings: Settings):
    def run(key, rows):
        t, k, depth = map(int, key)
        joined = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)
        y = joined("y", np.uint8).astype(np.int64)
        tree, gains = grown(settings, joined("x", np.uint16).reshape(len(y), -1), y, joined("n", np.uint8).astype(float), depth, t, k)
        return pd.DataFrame([(t, k, gains.tolist(), *tree.parts())], columns=["tree", "node", "gains", "feature", "cut", "left", "share"])

    return run


@dataclass(frozen=True)
class Forest:
    settings: Settings
    numeric: list[str]
    categorical: list[str]
    trees: list  # broadcast lists of trees
    importances: np.ndarray

    def probabilities(self, rows: DataFrame, kept: T.StructType) -> DataFrame:
        """The kept columns and five class probabilities: the mean of the leaves' class shares."""
        names, settings, trees, numeric, categorical = kept.names, self.settings, self.trees, self.numeric, self.categorical

        def run(batches):
            for batch in batches:
                codes = settings.codes(batch, numeric, categorical)
                total = np.zeros((batch.num_rows, CLASSES))
                for part in trees:
                    for tree in part.value:
                        total += tree.share[tree.ends(codes, settings)]
                total /= np.maximum(total.sum(1, keepdims=True), 1e-300)
                found = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, CLASSES), pa.int32()), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), found], names=[*names, "probabilities"])

        inputs = [c for c in _inputs(numeric, categorical) if c not in names]
        schema = T.StructType([*kept.fields, T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
        return spread(rows.select(*[f"`{c}`" for c in names], *inputs)).mapInArrow(run, schema)

    def moved_probabilities(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Per row and column the fill level and five class probabilities when this column alone has its moved value.

        rows: fill_level, the inputs, and the row's own inputs after `OWN`. A tree is walked once a row, and again only for a
        column whose moved value has another code and that the way to the row's leaf asks.
        """
        settings, trees, numeric, categorical = self.settings, self.trees, self.numeric, self.categorical
        k, named = len(columns), [*numeric, *numeric, *categorical]
        place, size = np.array([columns.index(c) if c in columns else k for c in named]), max(1, MOVED_ROWS // k)

        def run(batches):
            for whole in batches:
                for i in range(0, whole.num_rows, size):
                    batch = whole.slice(i, size)
                    own, moved = settings.codes(batch, numeric, categorical, OWN), settings.codes(batch, numeric, categorical)
                    other = np.zeros((k + 1, len(own)), bool)
                    for j, differs in zip(place, (own != moved).T):
                        other[j] |= differs
                    column, row = np.nonzero(other[:k])
                    codes = np.where(place == column[:, None], moved[row], own[row])
                    total = np.zeros((k, len(own), CLASSES))
                    for part in trees:
                        for tree in part.value:
                            end = tree.ends(own, settings)
                            again = np.flatnonzero(tree.asked(settings, place, k)[end[row], column])
                            ends = np.tile(end, (k, 1))
                            ends[column[again], row[again]] = tree.ends(codes, settings, again)
                            total += tree.share.take(ends, axis=0)
                    total /= np.maximum(total.sum(2, keepdims=True), 1e-300)
                    found = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, CLASSES), pa.int32()), pa.array(total.ravel()))
                    level = batch.column(batch.schema.get_field_index("fill_level")).take(pa.array(np.tile(np.arange(len(own)), k)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(columns, len(own)), pa.string()), level, found], names=["feature", "fill_level", "probabilities"])

        inputs = _inputs(numeric, categorical)
        schema = T.StructType([T.StructField("feature", T.StringType()), rows.schema["fill_level"], T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
        return spread(rows.select("fill_level", *inputs, *[f"{OWN}{c}" for c in inputs])).mapInArrow(run, schema)


def _inputs(numeric: list[str], categorical: list[str]) -> list[str]:
    return [*(f"{c}_filled" for c in numeric), *(f"{c}_missing" for c in numeric), *(f"{c}_index" for c in categorical)]


def cuts_of(rows: DataFrame, numeric: list[str]) -> list[np.ndarray]:
    """A number goes left of a cut it does not exceed: between all values where they are few, else at quantiles."""
    steps = [(i + 1) / BINS for i in range(BINS - 1)]
    col = lambda c: F.col(f"{c}_filled")
    found = rows.agg(*[F.approx_count_distinct(col(c)).alias(f"n_{c}") for c in numeric], *[F.percentile_approx(col(c), steps, 10_000).alias(c) for c in numeric]).first()
    few = [c for c in numeric if found[f"n_{c}"] <= BINS * 3 // 2]
    values = rows.agg(F.lit(0).alias("_"), *[F.sort_array(F.collect_set(col(c))).alias(c) for c in few]).first()
    middle = lambda v: (v[1:] + v[:-1]) / 2
    return [middle(np.array(values[c])) if c in few and len(values[c]) <= BINS else np.unique(np.array(found[c], float)) for c in numeric]


def fit(rows: DataFrame, numeric: list[str], categorical: list[str], sizes: list[int], balanced: bool, numTrees: int, maxDepth: int, minInstancesPerNode: int, subsamplingRate: float) -> Forest:  # noqa: N803  Spark ML's names
    """rows: bin_id, date, label and per input a filled number and a missing mark, or an index below the category's size."""
    h, copy = F.xxhash64("bin_id", "date", "label", *_inputs(numeric, categorical)), F.row_number().over(W.partitionBy("h").orderBy("h"))
    rows = rows.withColumn("h", h).withColumn("h", F.xxhash64("h", copy))  # equal rows are drawn one by one
    rows = materialize(rows.select("h", F.col("label").cast("int").alias("y"), *_inputs(numeric, categorical)), "indexed")
    by_class = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(by_class.values())
    weights = np.array([total / (len(by_class) * by_class[c]) if balanced and c in by_class else 1.0 for c in range(CLASSES)])
    n = len(numeric)
    inputs = np.concatenate([np.arange(2 * n), *[np.full(s, 2 * n + i) for i, s in enumerate(sizes)]]).astype(np.int64)
    values = np.concatenate([np.full(2 * n, -1), *[np.arange(s) for s in sizes]]).astype(np.int64)
    settings = Settings(cuts_of(rows, numeric), inputs, values, weights, numTrees, maxDepth, minInstancesPerNode, subsamplingRate)

    def encoded(batches):
        for b in batches:
            codes = settings.codes(b, numeric, categorical)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["h", "y", "x"])

    data = materialize(spread(rows, "h").mapInArrow(encoded, "h long, y int, x binary"), "coded")
    spark, importances = rows.sparkSession, np.zeros((numTrees, len(inputs)))
    trees = [Tree(np.array([-1], np.int32), np.zeros(1, np.int16), np.zeros(1, np.int32), np.zeros((1, CLASSES), np.float32)) for _ in range(numTrees)]
    whole = total * subsamplingRate > BRANCH_ROWS
    open_: list[dict[int, int]] = [{0: 0} if whole else {} for _ in trees]
    branches: list[dict[int, int]] = [{} if whole else {0: 0} for _ in trees]
    while any(open_):
        level = spark.sparkContext.broadcast((trees, open_))
        counted = data.mapInArrow(_of(level, settings, _level), "tree int, node int, counts binary")
        splits = spread(counted, "tree", "node").groupBy("tree", "node").applyInPandas(_split(settings), "tree int, node int, feature int, cut int, gain double, below array<double>, above array<double>").collect()
        after: list[dict[int, int]] = [{} for _ in trees]
        for s in sorted(splits, key=lambda s: (s["tree"], s["node"])):
            t, k, sides = s["tree"], s["node"], np.array([s["below"], s["above"]])
            depth = open_[t][k] + 1
            tree = trees[t]
            if not s["gain"]:
                tree.share[k] = settings.shares(sides.sum(0))
                continue
            importances[t, s["feature"]] += s["gain"]
            tree.feature[k], tree.cut[k], tree.left[k] = s["feature"], s["cut"], len(tree.feature)
            trees[t] = Tree(np.r_[tree.feature, [-1, -1]].astype(np.int32), np.r_[tree.cut, [0, 0]].astype(np.int16), np.r_[tree.left, [0, 0]].astype(np.int32), np.r_[tree.share, settings.shares(sides)])
            for i, side in enumerate(sides):
                if depth < maxDepth:
                    (after if side.sum() > BRANCH_ROWS else branches)[t][len(tree.feature) + i] = depth
        open_ = after
    last = spark.sparkContext.broadcast((trees, branches))
    moved = data.mapInArrow(_of(last, settings, _to_branches), "tree int, node int, depth int, y binary, n binary, x binary")
    done = materialize(moved.groupBy("tree", "node", "depth").applyInPandas(_branch(settings), f"tree int, node int, gains array<double>, {TREE}"), "branches")
    parts = []
    for first in range(0, numTrees, TREES):
        grown_: dict[int, dict[int, Tree]] = {}
        for r in done.where(F.col("tree").between(first, first + TREES - 1)).orderBy("tree", "node").collect():
            importances[r["tree"]] += r["gains"]
            grown_.setdefault(r["tree"], {})[r["node"]] = Tree.of(r["feature"], r["cut"], r["left"], r["share"])
        parts.append(spark.sparkContext.broadcast([trees[t].with_branches(grown_.get(t, {})) for t in range(first, min(first + TREES, numTrees))]))
    per_tree = importances / np.maximum(importances.sum(1, keepdims=True), 1e-300)
    return Forest(settings, numeric, categorical, parts, per_tree.sum(0) / max(per_tree.sum(), 1e-300))


def _of(shared, settings: Settings, step):
    """A step over trees and nodes that come by broadcast."""

    def run(batches):
        yield from step(settings, *shared.value)(batches)

    return run
