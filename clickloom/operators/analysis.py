"""Analyses of scores and protocols: reliability, likelihood ratios, prevalence, spread over draws, ablation, search."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KEY
from .metrics import score
from .models import LEARNERS, fit, out_of_fold, predict
from .resampling import hashed_share, weighted_metrics


def share_of_hash(*parts: str | Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same on every run and engine."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """By bin of a score in [0, 1]: rows, mean score and share of positives. A score of 1 is in the last bin."""
    bin_ = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).alias("bin")
    return scored.where("s IS NOT NULL").groupBy(bin_).agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("positive_rate"))


def likelihood_ratios(scored: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """By right-open bin of ``value``: its share among positives over its share among negatives, NULL without negatives.

    Only the bins' counts are summed to totals.
    """
    bin_ = F.expr("+".join(f"int({value} >= {e}D)" for e in edges)).cast("long").alias("bin")
    counts = scored.where(F.col(value).isNotNull()).groupBy(bin_).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    whole = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    ratio = F.try_divide(F.col("pos") * F.col("all_neg").cast("double"), F.col("neg") * F.col("all_pos").cast("double"))
    return counts.join(F.broadcast(whole)).select("bin", "pos", "neg", ratio.alias("ratio"))  # one row


def at_prevalence(rows: DataFrame, prevalence: float, seed: int = 42) -> DataFrame:
    """Rows of ``(id, y)`` whose positives have about the stated share: the class in excess is thinned by a hash of the id.

    With one class alone no share can be reached, and all rows stay.
    """
    told = rows.agg(F.sum(F.col("y").cast("double")).alias("_p"), F.sum(1 - F.col("y").cast("double")).alias("_q"))
    keep_neg = F.try_divide(F.col("_p") * (1 - prevalence), F.col("_q") * prevalence)
    keep_pos = F.try_divide(F.col("_q") * prevalence, F.col("_p") * (1 - prevalence))
    share = F.when(F.col("y") == 1, keep_pos).otherwise(keep_neg)
    return rows.join(F.broadcast(told)).where(share_of_hash(F.lit(str(seed)), "id") < F.coalesce(F.nullif(share, F.lit(0.0)), F.lit(1.0))).drop("_p", "_q")  # one row


def spread_over_draws(scored: DataFrame, share: float, draws: int, seed: int = 42) -> DataFrame:
    """Mean and deviation of average precision over ``draws`` hashed samples of ``share`` of the rows."""
    each = weighted_metrics(scored, hashed_share(share, seed), draws)
    return each.agg(F.count("average_precision").alias("n_draws"), F.avg("average_precision").alias("ap_mean"), F.stddev_samp("average_precision").alias("ap_std"))


def calibrated(known: DataFrame, scored: DataFrame) -> DataFrame:
    """``scored(id, s)`` with ``p``, the isotonic fit of ``known(y, s)``."""
    model = IsotonicRegression(featuresCol="s", labelCol="y", predictionCol="p").fit(known.select(F.col("y").cast("double").alias("y"), "s"))
    return model.transform(scored)


def _of_folds(df: DataFrame, columns: list[str], learner: str, k: int, seed: int) -> dict[str, float]:
    scores = out_of_fold(df, columns, learner, k, seed).join(df.select(KEY, F.col("target").alias("y")), KEY)
    return score(scores.select("y", F.col("score").alias("s"))).first().asDict()


def ablation(df: DataFrame, columns: list[str], blocks: dict[str, str], learner: str = "gbt", k: int = 5, seed: int = 42) -> list[dict]:
    """Fold metrics with all columns, and without each block; a block is a pattern of column names.

    ``uncovered`` in the first entry lists columns that no block names.
    """
    told = [{"without": None, "uncovered": [c for c in columns if not any(re.search(p, c) for p in blocks.values())]} | _of_folds(df, columns, learner, k, seed)]
    for name, pattern in blocks.items():
        kept = [c for c in columns if not re.search(pattern, c)]
        if kept and len(kept) < len(columns):
            told.append({"without": name} | _of_folds(df, kept, learner, k, seed))
    return told


def search(df: DataFrame, columns: list[str], grid: dict[str, Iterable], learner: str = "gbt", k: int = 3, seed: int = 42) -> list[tuple[dict, float]]:
    """Every setting of a grid with its average precision over folds, best first, ties to the earlier setting."""
    base, found = LEARNERS[learner], []
    for values in itertools.product(*grid.values()):
        setting = dict(zip(grid, values))
        name = f"{learner}{sorted(setting.items())}"
        LEARNERS[name] = lambda s, x=setting: base(s).setParams(**x)
        try:
            found.append((setting, _of_folds(df, columns, name, k, seed)["average_precision"]))
        finally:
            del LEARNERS[name]
    return sorted(found, key=lambda x: -(x[1] or 0.0))


def stacked(df: DataFrame, test: DataFrame, columns: list[str], learners: tuple[str, ...], top: str = "linear", k: int = 5, seed: int = 42) -> DataFrame:
    """(cookie_id, score): a learner over the learners' scores; its inputs on ``df`` are out of fold."""
    level, apply = df.select(KEY, "target"), test.select(KEY)
    for name in learners:
        level = level.join(out_of_fold(df, columns, name, k, seed).select(KEY, F.col("score").alias(name)), KEY)
        apply = apply.join(predict(fit(df, columns, name, seed), test, columns).withColumnRenamed("score", name), KEY)
    return predict(fit(level, list(learners), top, seed), apply, list(learners))
