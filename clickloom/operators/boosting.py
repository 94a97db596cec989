"""Boosted histogram trees with one-side sampling by gradient and a learned branch for missing values.

Rows are binned once and written; a tree costs a pass for each level. In a pass every task adds up gradients by
(node, column, bin) with numpy, Spark sums these histograms by (node, column) and finds each pair's best split, and only
the best split of each node comes to the driver. Of the rows, those with the largest gradients are all used and a share of
the others with more weight. A missing value has a bin of its own, tried on either side of every split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KEY, number_of, ref
from ..functions.storage import discard, written_at

_ROWS = "id long, y double, w double, score double, bins binary"
_HISTOGRAM = "node int, col int, sums binary"
_SPLIT = "node int, col int, gain double, at int, missing_left boolean, left_g double, left_h double, right_g double, right_h double, left_n long, right_n long"


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) that hang on the ids and the salt alone."""
    x = ids.astype(np.int64).view(np.uint64).copy()
    for s in salt:
        x = (x ^ np.uint64(s & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


@dataclass
class Tree:
    """A binary tree as a heap: node ``i`` has children ``2 i + 1`` and ``2 i + 2``; a leaf's column is -1."""

    column: np.ndarray
    at: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels. Bin 0 is missing; the others go left up to ``at``."""
        node = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            column = self.column[node]
            inner = np.flatnonzero(column >= 0)
            here = node[inner]
            b = bins[inner, column[inner]]
            left = np.where(b == 0, self.missing_left[here], b <= self.at[here])
            node[inner] = 2 * here + 2 - left
        return node

    @property
    def depth(self) -> int:
        return (len(self.column) + 1).bit_length() - 2

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, self.depth)]


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for NaN, else 1 + the number of edges below the value."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, "left") + 1).astype(np.uint8)


def best_split(sums: np.ndarray, l1: float, l2: float, min_rows: int) -> tuple | None:
    """(gain, at, missing left, left g, h, right g, h, left n, right n) of a (bins, 3) histogram; None if none is allowed.

    The missing bin is tried right and then left; of equal gains the first is taken, at the least bin.
    """
    g, h, n = sums.T
    whole = sums.sum(0)

    def worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cut = np.maximum(np.abs(a) - l1, 0.0)
        return cut * cut / (b + l2)

    known = np.cumsum(sums[1:], 0)
    best = None
    for missing_left in (False, True):
        left = known + sums[0] if missing_left else known
        right = whole - left
        gain = worth(left[:, 0], left[:, 1]) + worth(right[:, 0], right[:, 1]) - worth(whole[0], whole[1])
        gain = np.where((left[:, 2] >= min_rows) & (right[:, 2] >= min_rows), gain, -np.inf)
        i = int(np.argmax(np.round(gain, 9)))
        if gain[i] > -np.inf and (best is None or round(gain[i], 9) > round(best[0], 9)):
            best = (float(gain[i]), i + 1, missing_left, *left[i, :2].tolist(), *right[i, :2].tolist(), int(round(left[i, 2])), int(round(right[i, 2])))
    return best


@dataclass
class BoostedTrees:
    """A fitted model: the columns, their bin edges, the first score, the trees and each column's gain."""

    columns: list[str]
    edges: list[np.ndarray]
    first: float
    trees: list[Tree] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def _batches(self, of: Callable[[np.ndarray], list[pa.Array]], names: list[str]):
        edges = self.edges

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = np.empty((batch.num_rows, len(edges)), np.uint8)
                for c, e in enumerate(edges):
                    bins[:, c] = binned(batch.column(c + 1).to_numpy(zero_copy_only=False).astype(np.float64), e)
                yield pa.RecordBatch.from_arrays([batch.column(0), *of(bins)], names=[KEY, *names])

        return scan

    def _inputs(self, df: DataFrame) -> DataFrame:
        return df.select(KEY, *(ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.columns)))

    def predict(self, df: DataFrame) -> DataFrame:
        """(cookie_id, score in [0, 1])."""
        first, trees = self.first, self.trees
        score = lambda bins: [pa.array(1 / (1 + np.exp(-(first + sum((t.scores(bins) for t in trees), np.zeros(len(bins)))))))]
        key = df.schema[KEY].dataType.simpleString()
        return self._inputs(df).mapInArrow(self._batches(score, ["score"]), f"`{KEY}` {key}, score double")

    def staged(self, df: DataFrame, step: int = 1) -> DataFrame:
        """(cookie_id, round, score): the score after every ``step`` rounds."""
        first, trees = self.first, self.trees

        def stages(bins: np.ndarray) -> list[pa.Array]:
            sums, rounds = np.full(len(bins), first), []
            for i, t in enumerate(trees):
                sums = sums + t.scores(bins)
                if (i + 1) % step == 0 or i + 1 == len(trees):
                    rounds.append((i + 1, sums))
            flat = np.stack([1 / (1 + np.exp(-s)) for _, s in rounds], 1)
            return [pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), len(rounds)).cast(pa.list_(pa.float64()))]

        key = df.schema[KEY].dataType.simpleString()
        if not trees:
            raise ValueError("the model has no tree, so there is no round to score")
        told = [i + 1 for i in range(len(trees)) if (i + 1) % step == 0 or i + 1 == len(trees)]
        rows = self._inputs(df).mapInArrow(self._batches(stages, ["scores"]), f"`{KEY}` {key}, scores array<double>")
        return rows.select(KEY, F.posexplode("scores").alias("i", "score")).select(KEY, F.element_at(F.array(*map(F.lit, told)), F.col("i") + 1).alias("round"), "score")

    def importances(self, top: int) -> list[tuple[str, float]]:
        whole = sum(self.gains.values()) or 1.0
        return sorted(((c, g / whole) for c, g in self.gains.items()), key=lambda x: (-x[1], x[0]))[:top]


@dataclass(frozen=True)
class Boosting:
    """Settings of a model. Of each tree's rows the share ``top`` with the largest gradients is used whole; of the others so
    many as make the share ``other`` of all, each weighing for those left out. ``top`` of 1 uses all rows."""

    rounds: int = 40
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    l1: float = 0.0
    l2: float = 5.0
    min_rows: int = 20
    min_gain: float = 0.0
    columns_share: float = 0.7
    top: float = 0.2
    other: float = 0.1
    seed: int = 42
    refresh: int = 25
    rows_per_task: int = 100_000

    def setParams(self, **changes) -> Boosting:  # noqa: N802  as the learners of Spark ML are changed
        return replace(self, **changes)

    def fit(self, df: DataFrame, columns: list[str]) -> BoostedTrees:
        """A model of ``df`` (cookie_id, columns, target, weight). Numbers of rows in a leaf count rows used, not weights."""
        probabilities = [i / self.bins for i in range(1, self.bins)]
        rows = df.select(number_of(df, KEY).alias("id"), F.col("target").cast("double").alias("y"), F.col("weight").cast("double").alias("w"), *(ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
        found = rows.approxQuantile([f"c{i}" for i in range(len(columns))], probabilities, 0.1 / self.bins)  # a few numbers a column
        edges = [np.unique(np.array(e, np.float64)) for e in found]
        told = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p"), F.count("*").alias("n")).first()
        share = min(max((told["p"] or 0.0) / (told["w"] or 1.0), 1e-6), 1 - 1e-6)
        model = BoostedTrees(list(columns), edges, float(np.log(share / (1 - share))))
        if not told["n"]:
            return model
        parts = max(1, min(told["n"] // self.rows_per_task + 1, rows.sparkSession.sparkContext.defaultParallelism * 16))
        first = model.first

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.empty((batch.num_rows, len(edges)), np.uint8)
                for c, e in enumerate(edges):
                    x[:, c] = binned(batch.column(c + 3).to_numpy(zero_copy_only=False).astype(np.float64), e)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array(np.full(batch.num_rows, first)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "w", "score", "bins"])

        table, path = written_at(rows.mapInArrow(pack, _ROWS).repartition(parts), "boosting-rows")
        since: list[Tree] = []
        for k in range(self.rounds):
            tree, gains = self._grow(table, since, k, len(columns), told["n"])
            if tree.column[0] < 0:
                break
            since.append(tree)
            model.trees.append(tree)
            for c, g in gains:
                model.gains[columns[c]] = model.gains.get(columns[c], 0.0) + g
            if len(since) == self.refresh:
                table, new = written_at(table.mapInArrow(_rescored(since), _ROWS), "boosting-rows")
                discard(path)
                path, since = new, []
        discard(path)
        return model

    def _grow(self, table: DataFrame, since: list[Tree], k: int, n_columns: int, n_rows: int) -> tuple[Tree, list[tuple[int, float]]]:
        tree, gains = Tree.empty(self.depth), []
        take = max(1, int(np.ceil(self.columns_share * n_columns)))
        chosen = np.sort(np.argsort(_uniform(np.arange(n_columns), self.seed, k, 1), kind="stable")[:take])
        cut = self._cut(table, since, n_rows) if self.top < 1 else None
        width, spec = self.bins + 2, (self.l1, self.l2, self.min_rows)
        for level in range(self.depth):
            sums = table.mapInArrow(_histograms(since, tree, level, chosen, width, self._weigher(cut, k)), _HISTOGRAM)
            splits = sums.groupBy("node", "col").applyInPandas(_splitter(width, *spec), _SPLIT)
            best = splits.groupBy("node").agg(F.max_by(F.struct(*(c.split()[0] for c in _SPLIT.split(", "))), F.struct(F.round("gain", 9), -F.col("col"))).alias("s")).select("s.*")
            found = [s for s in best.collect() if s["gain"] > max(self.min_gain, 1e-9)]  # a row a node
            for s in found:
                node = s["node"]
                tree.column[node], tree.at[node], tree.missing_left[node] = s["col"], s["at"], s["missing_left"]
                for child, side in ((2 * node + 1, "left"), (2 * node + 2, "right")):
                    g = s[f"{side}_g"]
                    tree.value[child] = -np.sign(g) * max(abs(g) - self.l1, 0.0) / (s[f"{side}_h"] + self.l2) * self.rate
                gains.append((s["col"], s["gain"]))
            if not found:
                break
        return tree, gains

    def _cut(self, table: DataFrame, since: list[Tree], n_rows: int) -> tuple[int, float]:
        """The bits (as float32) of the gradient that the ``top`` share reaches, and the share of rows at just it to take.

        Two counts find it: one by the upper half of the bits, which order floats that are not negative, and one by the
        lower half of those that lie at it.
        """
        want, high = self.top * n_rows, None
        for _ in range(2):
            counts = table.mapInArrow(_gradient_bits(since, high), "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n"))
            for r in sorted(counts.collect(), key=lambda r: -r["bits"]):  # at most 2 ** 16 rows
                if r["n"] >= want:
                    break
                want -= r["n"]
            if high is not None:
                return (high << 16) + r["bits"], want / r["n"]
            high = r["bits"]
        raise AssertionError

    def _weigher(self, cut: tuple[int, float] | None, k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        if cut is None:
            return lambda ids, size: np.ones(len(ids))
        bits, share = cut
        rest = self.other / (1 - self.top)
        seed = self.seed

        def weigh(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
            own = _bits(size)
            top = (own > bits) | ((own == bits) & (_uniform(ids, seed, k, 2) < share))
            return np.where(top, 1.0, np.where(_uniform(ids, seed, k, 3) < rest, 1 / rest, 0.0))

        return weigh


def _bits(size: np.ndarray) -> np.ndarray:
    return size.astype(np.float32).view(np.uint32).astype(np.int64)


def _gradients(batch: pa.RecordBatch, since: list[Tree]) -> tuple:
    """(ids, bins, g, h) of a batch of rows under the trees since its scores were written."""
    ids, y, w, score = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    p = 1 / (1 + np.exp(-sum((t.scores(bins) for t in since), score)))
    return ids, bins, w * (p - y), w * p * (1 - p)


def _gradient_bits(since: list[Tree], high: int | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(np.abs(_gradients(batch, since)[2]))
            found, n = np.unique(bits >> 16 if high is None else bits[bits >> 16 == high] & 0xFFFF, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["bits", "n"])

    return scan


def _histograms(since: list[Tree], tree: Tree, level: int, chosen: np.ndarray, width: int, weigh: Callable):
    """Sums of (g, h, rows) by bin for each node of a level and chosen column, one row each a task."""
    base, n_nodes = 2**level - 1, 2**level

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(chosen), n_nodes * width, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bins, g, h = _gradients(batch, since)
            times = weigh(ids, np.abs(g))
            node = tree.nodes(bins, level) - base
            used = np.flatnonzero((times > 0) & (node >= 0))
            node, times, bins = node[used], times[used], bins[used]
            g, h = g[used] * times, h[used] * times
            for i, c in enumerate(chosen.tolist()):
                cell = node * width + bins[:, c]
                for j, v in enumerate((g, h, None)):
                    sums[i, :, j] += np.bincount(cell, v, n_nodes * width)
        met = np.flatnonzero(sums[:1, :, 2].reshape(-1, n_nodes, width).sum((0, 2)))  # every column has all rows of a node
        rows = [(base + n, c, sums[i, n * width : (n + 1) * width].tobytes()) for n in met.tolist() for i, c in enumerate(chosen.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["node", "col", "sums"])

    return scan


def _splitter(width: int, l1: float, l2: float, min_rows: int):
    names = [c.split()[0] for c in _SPLIT.split(", ")]

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(x, np.float64).reshape(width, 3) for x in rows["sums"])  # a row a task
        found = best_split(sums, l1, l2, min_rows)
        return pd.DataFrame([(rows["node"].iloc[0], rows["col"].iloc[0], *found)] if found else [], columns=names)

    return split


def _rescored(since: list[Tree]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            score = sum((t.scores(bins) for t in since), batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score), batch.column(4)], names=["id", "y", "w", "score", "bins"])

    return scan
