"""Metrics under many weightings of the same rows at once: the bootstrap, hashed samples and half splits.

A weighting is a vector of weights for each row, made by a function of the row's id where it is needed. Rows are ranged
by score and the curve of all weightings is walked piece by piece with vectors, so rows are never repeated for the draws.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import number_of, percent_ranks, rounded
from ..functions.storage import scratch, written, written_together
from .metrics import METRICS

Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Weights that a task holds at once.
_AT_ONCE = 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for every (id, draw), the same on every run."""
    of_id = _mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    of_draw = _mixed(draws.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(2 * seed + 1))
    return (_mixed(of_id[:, None] ^ of_draw[None, :]) >> np.uint64(11)).astype(np.float64) / 2.0**53


def poisson(mean: float, seed: int) -> Weigh:
    """How often a row is drawn in each of many samples with replacement, of ``mean`` times the rows each."""
    tail, p = [], np.exp(-mean)
    total, k = p, 0
    while total < 1 - 1e-12 and k < 1000:
        tail.append(total)
        k += 1
        p *= mean / k
        total += p
    table = np.array(tail)
    return lambda ids, draws: np.searchsorted(table, uniform(ids, draws, seed), "right").astype(np.float64)


def halves(seed: int) -> Weigh:
    """Draw 2 k has about half of the rows, draw 2 k + 1 the others."""
    return lambda ids, draws: ((uniform(ids, draws // 2, seed) < 0.5) == (draws % 2 == 0)).astype(np.float64)


def _share(ids: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """``analysis.share_of_hash`` of (seed, draw, id); a draw that stands there twice is hashed once."""
    draws, where = np.unique(draws, return_inverse=True)
    of = lambda d, i: int.from_bytes(hashlib.md5(f"{seed}:{d}:{i}".encode()).digest()[:4], "big")
    return np.array([[of(d, i) for d in draws.tolist()] for i in ids.tolist()], np.float64).reshape(len(ids), len(draws))[:, where] / 2.0**32


def hashed_share(share: float, seed: int) -> Weigh:
    """Each draw has the rows whose MD5 of (seed, draw, id) lies in the first ``share``, as SQL can tell them too."""
    return lambda ids, draws: (_share(ids, draws, seed) < share).astype(np.float64)


def hashed_halves(seed: int) -> Weigh:
    """``halves`` by MD5, as SQL can tell them too."""
    return lambda ids, draws: ((_share(ids, draws // 2, seed) < 0.5) == (draws % 2 == 0)).astype(np.float64)


def packed(weights: np.ndarray) -> list[bytes]:
    """Each row's weights as bytes: bits if all of them are 0 or 1, else doubles."""
    bits = ((weights == 0) | (weights == 1)).all()
    return [r.tobytes() for r in (np.packbits(weights.astype(np.uint8), axis=1) if bits else weights.astype(np.float64))]


def unpacked(rows: list[bytes], draws: int) -> np.ndarray:
    """``packed`` weights; rows of bits and of doubles have different lengths."""
    n = (draws + 7) // 8
    bits = np.fromiter((len(r) == n for r in rows), bool, len(rows))
    out = np.empty((len(rows), draws))
    out[bits] = np.unpackbits(np.frombuffer(b"".join(r for r in rows if len(r) == n), np.uint8).reshape(-1, n), axis=1, count=draws)
    out[~bits] = np.frombuffer(b"".join(r for r in rows if len(r) != n), np.float64).reshape(-1, draws)
    return out


def with_weights(scored: DataFrame, weigh: Weigh, draws: int, pieces: int | None = None) -> DataFrame:
    """``scored`` with ``w``, each id's packed weights under every draw, told once for an id whatever its number of rows.

    Ids are dealt evenly over ``pieces``, as Spark would put these short rows into few tasks.
    """
    spark = scored.sparkSession
    number = F.coalesce(number_of(scored, "id"), F.lit(-(2**63)))  # rows without id are weighed alike
    ids = scored.select(number.alias("_id")).distinct()
    which = np.arange(draws)
    step = max(1, _AT_ONCE // max(draws, 1))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                some = batch.column(0).slice(a, step)
                yield pa.RecordBatch.from_arrays([some, pa.array(packed(weigh(some.to_numpy(zero_copy_only=False), which)), pa.binary())], names=["_id", "w"])

    ids = ids.repartition(pieces or 4 * spark.sparkContext.defaultParallelism, "_id").mapInArrow(told, "_id long, w binary")
    return scored.join(written(ids, "resampling-weights"), number == F.col("_id")).drop("_id")


class _Curve:
    """The curves of all draws, walked down the scores: sums so far, and what the metrics gather at each point."""

    def __init__(self, n_pos: np.ndarray, n_all: np.ndarray, tp: np.ndarray, seen: np.ndarray, least_recall: float, most_fpr: float) -> None:
        self.n_pos, self.n_neg, self.tp, self.seen = n_pos, n_all - n_pos, tp.copy(), seen.copy()
        self.least, self.most = least_recall, most_fpr
        self.area, self.pairs, self.best, self.reached = (np.zeros(len(n_pos)) for _ in range(4))

    def point(self, pos: np.ndarray, n: np.ndarray) -> None:
        """One group of equal scores: its positives and rows in every draw; draws without rows there have no point."""
        self.tp += pos
        self.seen += n
        fp = self.seen - self.tp
        with np.errstate(divide="ignore", invalid="ignore"):
            precision, recall = self.tp / self.seen, self.tp / self.n_pos
        here = n > 0
        self.area += np.where(here & (pos > 0), pos * precision, 0.0)
        self.pairs += pos * (self.n_neg - fp + (n - pos) / 2)
        self.best = np.where(here & (recall >= self.least), np.maximum(self.best, precision), self.best)
        self.reached = np.where(here & (fp <= self.most * self.n_neg), np.maximum(self.reached, recall), self.reached)


_SUMS = "piece int, first double, last double, groups long, sums binary"
_PARTS = "piece int, parts binary"


def _weighed(rows: pd.DataFrame, weigh: Weigh | None, draws: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positives, rows) of all draws for each run of equal scores, best first; rows are sorted. ``w`` holds weights if there is no ``weigh``."""
    s, y = rows["s"].to_numpy(float), rows["y"].to_numpy(float)
    ids = rows["id"].to_numpy(np.int64) if weigh else None
    same = np.concatenate(([False], (s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))))
    starts = np.flatnonzero(~same)
    step = max(1, _AT_ONCE // len(draws))
    open_: tuple | None = None
    for a in range(0, len(s), step):
        w = weigh(ids[a : a + step], draws) if weigh else unpacked(rows["w"].iloc[a : a + step].tolist(), len(draws))
        p = w * y[a : a + step, None]
        inside = starts[(starts >= a) & (starts < a + step)] - a
        cuts = np.concatenate(([0], inside)) if not len(inside) or inside[0] else inside
        pos, n = np.add.reduceat(p, cuts, axis=0), np.add.reduceat(w, cuts, axis=0)
        for k in range(len(cuts)):
            if k == 0 and same[a] and open_ is not None:
                open_ = (open_[0] + pos[0], open_[1] + n[0])
                continue
            if open_ is not None:
                yield open_
            open_ = (pos[k], n[k])
    if open_ is not None:
        yield open_


def weighted_metrics(scored: DataFrame, weigh: Weigh | None, draws: int, least_recall: float = 0.70, most_fpr: float = 0.01) -> DataFrame:
    """(draw, p_at_r, roc_auc, average_precision, recall_at_fpr) of ``scored(id, y, s)`` under every draw's weights.

    The four metrics are those of ``metrics.score``: equal scores are one point, NaN stands on top and NULL last; a draw
    without positives, or for roc_auc without one class, has NULL. An id that is no whole number is told by its hash. Without
    ``weigh`` the rows have their weights in ``w``, from ``with_weights``.

    A range sort by (score, id) makes pieces; equal scores may lie in several. A pass adds up each piece's draws, with its
    first and last group apart; one task walks the pieces' sums, a row each, and joins groups that pieces share; a second
    pass walks the groups inside every piece from what lies before it.
    """
    which = np.arange(draws)
    rows = scored.select(number_of(scored, "id").alias("id"), F.col("y").cast("double").alias("y"), F.col("s").cast("double").alias("s"), *(() if weigh else ("w",)))
    rows = rows.withColumns({"hole": F.col("s").isNull(), "s": F.coalesce("s", F.lit(0.0))})
    order = [F.asc("hole"), F.desc("s"), F.asc("id")]
    rows = written(rows.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "resampling")

    def groups(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Missing scores are a group of their own behind all numbers."""
        for hole in (False, True):
            of = part[part["hole"] == hole]
            if len(of):
                yield from _weighed(of.sort_values("s", ascending=False, na_position="first", kind="stable"), weigh, which)

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        total, first, last, k = np.zeros((2, draws)), np.zeros((2, draws)), np.zeros((2, draws)), 0
        for k, (pos, n) in enumerate(groups(part), 1):
            total += (pos, n)
            last = np.stack((pos, n))
            first = last if k == 1 else first
        known = part[~part["hole"]]["s"].to_numpy(float)
        top = lambda x: float("nan") if np.isnan(x).any() else float(x.max())
        low = lambda x: float(np.nanmin(x)) if not np.isnan(x).all() else float("nan")
        # ends as told between pieces: a missing score is None
        a = top(known) if len(known) else None
        b = None if part["hole"].any() else low(known)
        return pd.DataFrame([(part["piece"].iloc[0], a, b, k, np.stack((total, first, last)).tobytes())], columns=["piece", "first", "last", "groups", "sums"]).astype({"first": object, "last": object})

    def ends(value: float | None) -> object:
        return "missing" if value is None else "nan" if np.isnan(value) else value

    sums = rows.groupBy("piece").applyInArrow(lambda t: _table(summed(t.to_pandas()), _SUMS), _SUMS)

    def walked(table: pa.Table) -> pa.Table:
        """Before each piece: sums and, where its first or last group is shared, what is told here instead."""
        pieces = sorted(table.to_pylist(), key=lambda r: r["piece"])
        parts = [np.frombuffer(r["sums"], np.float64).reshape(3, 2, draws) for r in pieces]
        n_pos, n_all = sum(p[0, 0] for p in parts), sum(p[0, 1] for p in parts)
        shared = [ends(a["last"]) == ends(b["first"]) for a, b in zip(pieces, pieces[1:])]
        curve = _Curve(n_pos, n_all, np.zeros(draws), np.zeros(draws), least_recall, most_fpr)
        out, before, open_ = [], np.zeros((2, draws)), None
        for i, (r, p) in enumerate(zip(pieces, parts)):
            joins, goes_on = i > 0 and shared[i - 1], i < len(shared) and shared[i]
            if joins:
                open_ = p[1] if open_ is None else open_ + p[1]
                if r["groups"] > 1 or not goes_on:  # the shared group ends in this piece
                    curve.tp, curve.seen = open_before[0].copy(), open_before[1].copy()
                    curve.point(*open_)
                    open_ = None
            if goes_on and open_ is None:
                open_, open_before = p[2].copy(), before + p[0] - p[2]
            skip_first = joins
            skip_last = goes_on and not (joins and r["groups"] == 1)
            out.append({"piece": r["piece"], "skip_first": skip_first, "skip_last": skip_last, "before": before.tobytes()})
            before = before + p[0]
        told = np.stack((curve.area, curve.pairs, curve.best, curve.reached, n_pos, n_all))
        out.append({"piece": -1, "skip_first": False, "skip_last": False, "before": told.tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("piece", pa.int32()), ("skip_first", pa.bool_()), ("skip_last", pa.bool_()), ("before", pa.binary())]))

    starts = written(sums.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(walked, "piece int, skip_first boolean, skip_last boolean, before binary"), "resampling-pieces")
    whole = starts.where("piece = -1").select(F.col("before").alias("whole"))
    starts = starts.where("piece >= 0").join(F.broadcast(whole))  # one row, six numbers a draw

    def inside(part: pa.Table, start: pa.Table) -> pa.Table:
        told = start.to_pylist()[0]
        first = np.frombuffer(told["before"], np.float64).reshape(2, draws)
        n_pos, n_all = np.frombuffer(told["whole"], np.float64).reshape(6, draws)[4:]
        curve = _Curve(n_pos, n_all, *first, least_recall, most_fpr)
        held: tuple | None = None
        for k, (pos, n) in enumerate(groups(part.to_pandas())):
            if held is not None:
                curve.point(*held)
                held = None
            if k == 0 and told["skip_first"]:
                curve.tp += pos
                curve.seen += n
                continue
            held = (pos, n)
        if held is not None and not told["skip_last"]:
            curve.point(*held)
        parts = np.stack((curve.area, curve.pairs, curve.best, curve.reached)).tobytes()
        return pa.Table.from_pylist([{"piece": told["piece"], "parts": parts}], schema=pa.schema([("piece", pa.int32()), ("parts", pa.binary())]))

    own = rows.groupBy("piece").cogroup(starts.groupBy("piece")).applyInArrow(inside, _PARTS)
    every = own.unionByName(whole.select(F.lit(-1).alias("piece"), F.col("whole").alias("parts")))

    def merged(table: pa.Table) -> pa.Table:
        n_pos = n_all = None
        area, pairs, best, reached = (np.zeros(draws) for _ in range(4))
        for r in sorted(table.to_pylist(), key=lambda r: r["piece"]):
            p = np.frombuffer(r["parts"], np.float64).reshape(-1, draws)
            area, pairs, best, reached = area + p[0], pairs + p[1], np.maximum(best, p[2]), np.maximum(reached, p[3])
            if r["piece"] == -1:
                n_pos, n_all = p[4], p[5]
        none = n_pos == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            values = {"p_at_r": best, "roc_auc": pairs / (n_pos * (n_all - n_pos)), "average_precision": area / n_pos, "recall_at_fpr": reached}
        gone = {"roc_auc": none | (n_all == n_pos)}
        return pa.table({"draw": pa.array(which, pa.int32())} | {k: pa.array(v, pa.float64(), mask=gone.get(k, none)) for k, v in values.items()})

    return every.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(merged, "draw int, " + ", ".join(f"{m} double" for m in ("p_at_r", "roc_auc", "average_precision", "recall_at_fpr")))


def _table(rows: pd.DataFrame, ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table({n: pa.array(rows[n].tolist(), kinds[k], from_pandas=False) for n, k in fields})


def bootstrap(scored: DataFrame, size: int | None = None, draws: int = 4000, seed: int = 42, least_recall: float = 0.70, most_fpr: float = 0.01) -> DataFrame:
    """(metric, n_draws, mean, deviation, low, high): spread over samples with replacement of about ``size`` rows.

    low and high are the 5th and 95th percentile. A row's number in a sample is a Poisson weight hashed from its id.
    """
    n = scored.count()
    each = weighted_metrics(scored, poisson((size or n) / max(n, 1), seed), draws, least_recall, most_fpr)
    long = each.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(
        F.count("v").alias("n_draws"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"), F.expr("percentile(v, 0.05)").alias("low"), F.expr("percentile(v, 0.95)").alias("high")
    )


def surrogate_agreement(each: DataFrame, target: str = "p_at_r") -> DataFrame:
    """(surrogate, n_splits, agreement, target): how well each metric on one half ranks models as ``target`` on the other does.

    ``each`` is (model, draw, metrics) with draws 2 k and 2 k + 1 the two halves of split k. Agreement is the rank
    correlation over models, ties sharing their mean rank, averaged over splits; a split where one side is constant has
    none.
    """
    names = [F.struct(F.lit(m).alias("surrogate"), F.col(m).alias("a")) for m in METRICS]
    first = each.where("draw % 2 = 0").select("model", F.expr("draw div 2").alias("split"), F.explode(F.array(*names)).alias("x")).select("model", "split", "x.*")
    second = each.where("draw % 2 = 1").select("model", F.expr("draw div 2").alias("split"), F.col(target).alias("b"))
    both = first.join(second, ["model", "split"]).where("a IS NOT NULL AND b IS NOT NULL").withColumns({"a": rounded("a", 12), "b": rounded("b", 12)})
    ranked = percent_ranks(percent_ranks(both, "a", "ra", ("surrogate", "split")), "b", "rb", ("surrogate", "split"))
    spread = lambda c: F.stddev_pop(c)
    known = F.when((spread("ra") > 0) & (spread("rb") > 0), F.covar_pop("ra", "rb") / (spread("ra") * spread("rb")))
    splits = ranked.groupBy("surrogate", "split").agg(known.alias("r"))
    return splits.groupBy("surrogate").agg(F.count("r").alias("n_splits"), F.avg("r").alias("agreement")).withColumn("target", F.lit(target))


def of_models(scores: DataFrame, weigh: Weigh, draws: int, **options) -> DataFrame:
    """``weighted_metrics`` of each ``model`` of ``scores(model, id, y, s)``; the models are few, some are taken at once.

    An id's weights are told once for all models, and the metrics are written, as what ranks them reads them several times.
    """
    names = [r["model"] for r in scores.select("model").distinct().orderBy("model").collect()]  # a row a model
    with scratch():
        weighed = written(with_weights(scores, weigh, draws), "resampling-models")
        of = lambda n: weighted_metrics(weighed.where(F.col("model") == n), None, draws, **options).select(F.lit(n).alias("model"), "*")
        parts = written_together({f"resampling-model-{i}": (lambda n=n: of(n)) for i, n in enumerate(names)}, at_once=4)
        return written(reduce(DataFrame.unionByName, parts), "resampling-metrics", keep=True)
