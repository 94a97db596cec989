"""Ranking metrics of ``scored(y, s)``; equal scores are one point of the curve, whatever their order.

A NaN score stands above infinity and a missing one below all, each a point of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import beside, percent_ranks, rounded, running


def pr_curve(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, precision and recall at the end of each group of equal scores, best first, per slice of ``by``."""
    groups = scored.groupBy(*by, "s").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    curve = running(groups, "s", {"tp": "pos", "seen": "n"}, by, descending=True)
    total = curve.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("n").alias("n_all"))
    curve = beside(curve, total, by) if by else curve.join(F.broadcast(total))  # one row
    return curve.withColumns({"fp": F.expr("seen - tp"), "precision": F.expr("tp / double(seen)"), "recall": F.expr("try_divide(double(tp), double(n_pos))")})


def _per(by: tuple[str, ...], curve: DataFrame, **facts: str) -> DataFrame:
    return curve.groupBy(*by).agg(*(F.expr(e).alias(n) for n, e in facts.items()))


def precision_at_recall(scored: DataFrame, least: float = 0.70, by: tuple[str, ...] = ()) -> DataFrame:
    """Best precision among points of recall >= least; NULL without positives."""
    return _per(by, pr_curve(scored, by), p_at_r=f"CASE WHEN max(n_pos) > 0 THEN coalesce(max(CASE WHEN recall >= {least}D THEN precision END), 0D) END")


def recall_at_fpr(scored: DataFrame, most: float = 0.01, by: tuple[str, ...] = ()) -> DataFrame:
    return _per(by, pr_curve(scored, by), recall_at_fpr=f"CASE WHEN max(n_pos) > 0 THEN coalesce(max(CASE WHEN fp <= {most}D * (n_all - n_pos) THEN recall END), 0D) END")


def roc_auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties half; NULL without both."""
    return _per(by, pr_curve(scored, by), roc_auc="try_divide(sum(pos * ((n_all - n_pos) - fp + (n - pos) / 2D)), double(max(n_pos) * (max(n_all) - max(n_pos))))")


def average_precision(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Step-wise area: each group's share of the positives times the precision at its end."""
    return _per(by, pr_curve(scored, by), average_precision="try_divide(sum(pos * precision), double(max(n_pos)))")


def score(scored: DataFrame, least_recall: float = 0.70, most_fpr: float = 0.01, by: tuple[str, ...] = ()) -> DataFrame:
    """The four metrics from one curve."""
    return _per(
        by,
        pr_curve(scored, by),
        p_at_r=f"CASE WHEN max(n_pos) > 0 THEN coalesce(max(CASE WHEN recall >= {least_recall}D THEN precision END), 0D) END",
        roc_auc="try_divide(sum(pos * ((n_all - n_pos) - fp + (n - pos) / 2D)), double(max(n_pos) * (max(n_all) - max(n_pos))))",
        average_precision="try_divide(sum(pos * precision), double(max(n_pos)))",
        recall_at_fpr=f"CASE WHEN max(n_pos) > 0 THEN coalesce(max(CASE WHEN fp <= {most_fpr}D * (n_all - n_pos) THEN recall END), 0D) END",
    )


METRICS = ("p_at_r", "roc_auc", "average_precision", "recall_at_fpr")


def metric_spread(scored: DataFrame, by: str) -> DataFrame:
    """How each metric differs between the groups of ``by``, such as folds, days or seeds: mean, deviation and ends."""
    each = score(scored, by=(by,)).select(F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("v")) for m in METRICS))).alias("x")).select("x.*")
    return each.groupBy("name").agg(F.count("v").alias("n_groups"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most"))


def rank_average(scores: DataFrame) -> DataFrame:
    """``scores(id, bag, s, w)`` to the weighted mean of each bag's percentile ranks."""
    ranked = percent_ranks(scores, "s", "r", ("bag",))
    return ranked.groupBy("id").agg((F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("score"))


def minmax(scores: DataFrame) -> DataFrame:
    """Scores rescaled to [0, 1]; a constant becomes 0.5. The two ends are one broadcast row."""
    ends = scores.agg(F.min("s").alias("a"), F.max("s").alias("b"))
    return scores.join(F.broadcast(ends)).select("id", F.expr("CASE WHEN b > a THEN (s - a) / (b - a) ELSE 0.5D END").alias("score"))


def blend_weights(ranks: DataFrame, families: tuple[str, ...], grid: int = 5) -> DataFrame:
    """The whole-number weights of score families with the best average precision, the first in product order.

    ``ranks`` has y and a column per family. The grid is a stated set of grid ** families weightings, exploded.
    """
    axes = "explode(sequence(0, {}))".format(grid - 1)
    grids = ranks.sparkSession.range(1)
    for f in families:
        grids = grids.withColumn(f"w_{f}", F.expr(axes))
    total = " + ".join(f"w_{f}" for f in families)
    grids = grids.drop("id").where(f"{total} > 0")
    blended = ranks.select("y", *families).join(F.broadcast(grids))
    s = rounded(F.expr("(" + " + ".join(f"w_{f} * {f}" for f in families) + f") / double({total})"), 9)
    names = tuple(f"w_{f}" for f in families)
    found = average_precision(blended.select("y", s.alias("s"), *names), by=names).withColumn("ap", rounded("average_precision", 9))
    return found.orderBy(F.desc("ap"), *names).limit(1).select(*names, "ap")


def regime_slices(scored: DataFrame, slices: dict[str, str], least_positives: int = 5) -> DataFrame:
    """The metrics of each named filter that has enough positives; a row may be in several slices."""
    tags = F.explode(F.array_compact(F.array(*(F.when(F.expr(e), F.lit(n)) for n, e in slices.items()))))
    rows = scored.select("*", tags.alias("regime"))
    enough = rows.groupBy("regime").agg(F.sum("y").alias("n_pos"), F.count("*").alias("n")).where(F.col("n_pos") >= least_positives)
    return enough.join(score(rows.select("regime", "y", "s"), by=("regime",)), "regime")


def caught_and_missed(scored: DataFrame, columns: tuple[str, ...], least_recall: float = 0.70, top: int = 15) -> DataFrame:
    """Means of features over positives above and below the score of the recall floor, and over negatives.

    The gap is the difference of missed and caught positives over the caught ones' mean; the widest come first.
    """
    cut = pr_curve(scored.select("y", "s")).where(F.col("recall") >= least_recall).agg(F.max("s").alias("cut"))
    rows = scored.join(F.broadcast(cut)).withColumn("part", F.expr("CASE WHEN y <> 1 THEN 'other' WHEN s >= cut THEN 'caught' ELSE 'missed' END"))
    long = rows.select("part", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("part", "x.*")
    out = long.groupBy("feature").agg(*(F.expr(f"avg(CASE WHEN part = '{p}' THEN v END)").alias(f"{p}_mean") for p in ("missed", "caught", "other")))
    gap = F.expr("abs(missed_mean - caught_mean) / (abs(caught_mean) + 1e-6D)")
    return out.withColumn("gap", rounded(gap, 9)).orderBy(F.desc_nulls_last("gap"), "feature").limit(top)


def subgroup_reorder(scores: DataFrame, weight: float = 1.0) -> DataFrame:
    """``scores(id, s, r, inside)``: a subgroup keeps its own score values but takes them in the order of a blend.

    The blend is the percentile rank of ``s`` and, by ``weight``, that of ``r``, both inside the subgroup; equal blends
    stand by id.
    """
    part = percent_ranks(percent_ranks(scores.where("inside"), "s", "a"), "r", "b")
    part = part.withColumn("blend", rounded((1 - weight) * F.col("a") + weight * F.col("b"), 12))
    part = part.withColumn("one", F.lit(1))
    values = running(part.select("s", "id", "one"), ("s", "id"), {"k": "one"}).select("k", F.col("s").alias("new"))
    owners = running(part.select("blend", "id", "one"), ("blend", "id"), {"k": "one"}).select("id", "k")
    return scores.join(owners.join(values, "k").select("id", "new"), "id", "left").select("id", F.coalesce("new", "s").alias("score"))


def subgroup_columns(features: DataFrame, columns: tuple[str, ...], least_cover: float = 0.02) -> DataFrame:
    """Columns with enough coverage and more than one value, from one pass."""
    facts = [F.struct(F.lit(c).alias("name"), (F.count(c) / F.count("*")).alias("cover"), F.countDistinct(c).alias("n_values")) for c in columns]
    return features.agg(F.array(*facts).alias("x")).select(F.explode("x").alias("x")).select("x.*").where((F.col("cover") >= least_cover) & (F.col("n_values") > 1))
