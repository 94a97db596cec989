"""Scoring models over the feature matrix: boosted trees and Spark ML learners, bags of seeds, fold and forward scores.

``gbt`` samples rows by gradient and takes missing values as they are (``boosting``). For the learners of Spark ML missing
values become the median with a flag beside it.
"""

from __future__ import annotations

import re
from statistics import median

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KEY, percent_ranks
from ..functions.storage import written
from .boosting import BoostedTrees, Boosting
from .metrics import METRICS, average_precision, metric_spread, rank_average, score, subgroup_columns
from .validation import stratified_folds

LEARNERS = {
    "gbt": lambda seed: Boosting(seed=seed),
    "spark_gbt": lambda seed: GBTClassifier(labelCol="target", weightCol="weight", maxIter=40, maxDepth=4, stepSize=0.1, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed),
    "forest": lambda seed: RandomForestClassifier(labelCol="target", weightCol="weight", numTrees=300, minInstancesPerNode=3, seed=seed),
    # a short one that only ranks inputs by gain
    "screen": lambda seed: GBTClassifier(labelCol="target", weightCol="weight", maxIter=10, maxDepth=4, stepSize=0.3, subsamplingRate=0.7, seed=seed),
    "linear": lambda seed: LogisticRegression(labelCol="target", weightCol="weight", regParam=0.05, standardization=True),
}


def flagged(df: DataFrame, columns: list[str]) -> DataFrame:
    """Doubles, and a 0/1 flag for each column's missing values."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns} | {f"{c}__missing": F.col(c).isNull().cast("double") for c in columns})


def balanced(df: DataFrame) -> DataFrame:
    """Positives weigh n_neg / n_pos; an existing ``weight`` is kept as a factor."""
    share = df.agg((F.sum(1 - F.col("target")) / F.sum("target")).alias("_ratio"))
    base = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    return df.join(F.broadcast(share)).withColumn("weight", base * F.when(F.col("target") == 1, F.coalesce("_ratio", F.lit(1.0))).otherwise(1.0)).drop("_ratio")


def fit(df: DataFrame, columns: list[str], learner: str = "gbt", seed: int = 42) -> PipelineModel | BoostedTrees:
    """Boosted trees, or a pipeline of imputing, assembling and learning; columns without any value are left out there."""
    made = LEARNERS[learner](seed)
    if isinstance(made, Boosting):
        return made.fit(balanced(df), columns)
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    known = [c for c in columns if counts[c]]
    filled = [f"{c}__filled" for c in known]
    stages = [
        Imputer(strategy="median", inputCols=known, outputCols=filled),
        VectorAssembler(inputCols=filled + [f"{c}__missing" for c in known], outputCol="features"),
        made,
    ]
    return Pipeline(stages=stages).fit(balanced(flagged(df, columns)))


def predict(model: PipelineModel | BoostedTrees, df: DataFrame, columns: list[str]) -> DataFrame:
    if isinstance(model, BoostedTrees):
        return model.predict(df)
    out = model.transform(flagged(df, columns).withColumn("weight", F.lit(1.0)))
    return out.select(KEY, vector_to_array("probability")[1].alias("score"))


def importances(model: PipelineModel | BoostedTrees, top: int) -> list[tuple[str, float]]:
    """The inputs with the largest gain, from a fitted tree model."""
    if isinstance(model, BoostedTrees):
        return model.importances(top)
    names = model.stages[1].getInputCols()
    ranked = sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    return ranked[:top]


def bagged(train: DataFrame, test: DataFrame, columns: list[str], learner: str = "gbt", seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rank average of a learner's scores over seeds."""
    bags = None
    for seed in seeds:
        one = predict(fit(train, columns, learner, seed), test, columns).select(F.col(KEY).alias("id"), F.lit(seed).alias("bag"), F.col("score").alias("s"), F.lit(1.0).alias("w"))
        bags = one if bags is None else bags.unionByName(one)
    return rank_average(bags).withColumnRenamed("id", KEY)


def select_columns(df: DataFrame, columns: list[str], top: int, seed: int = 42) -> list[str]:
    """The ``top`` columns by the gain of a screening model; a column's gain includes that of its missing flag."""
    gains: dict[str, float] = {}
    for name, gain in importances(fit(df, columns, "screen", seed), 2 * len(columns)):
        column = name.removesuffix("__filled").removesuffix("__missing")
        gains[column] = gains.get(column, 0.0) + gain
    return sorted(gains, key=lambda c: (-gains[c], c))[:top]


def out_of_fold(df: DataFrame, columns: list[str], learner: str = "gbt", k: int = 5, seed: int = 42, select: int = 0) -> DataFrame:
    """(cookie_id, fold, score): each visitor scored by the model of the other folds.

    With ``select`` every fold chooses so many columns from its own training rows.
    """
    folds = df.join(stratified_folds(df.select(KEY, "target"), k, seed).select(KEY, "fold"), KEY)
    out = None
    for f in range(k):
        train = folds.where(F.col("fold") != f).drop("fold")
        used = select_columns(train, columns, select, seed) if select else columns
        one = predict(fit(train, used, learner, seed), folds.where(F.col("fold") == f), used).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


def estimate_rounds(df: DataFrame, columns: list[str], k: int = 3, most: int = 60, patience: int = 10, seed: int = 42, learner: str = "gbt") -> int:
    """Median over folds of the boosting rounds that rank the fold left out best, stopped after ``patience`` rounds without gain.

    The metric is average precision, of the scores after every round.
    """
    folds = df.join(stratified_folds(df.select(KEY, "target"), k, seed).select(KEY, "fold"), KEY)
    best = []
    for f in range(k):
        model = LEARNERS[learner](seed).setParams(rounds=most).fit(balanced(folds.where(F.col("fold") != f).drop("fold")), columns)
        if not model.trees:
            best.append(1)
            continue
        staged = model.staged(folds.where(F.col("fold") == f)).join(df.select(KEY, F.col("target").alias("y")), KEY)
        reached = dict(average_precision(staged.select("round", "y", F.round("score", 12).alias("s")), ("round",)).collect())  # a row a round
        at = 1
        for i in sorted(reached):
            if (reached[i] or 0.0) > (reached[at] or 0.0):
                at = i
            elif i - at >= patience:
                break
        best.append(at)
    return int(median(best))


def repeated_cv(df: DataFrame, columns: list[str], learner: str = "gbt", k: int = 5, seeds: tuple[int, ...] = (42, 43, 44), select: int = 0) -> tuple[DataFrame, DataFrame]:
    """Folds drawn anew for each seed: (metric, n_groups, mean, deviation, least, most, blend) and the blended scores.

    ``blend`` is the metric of the mean of the seeds' percentile ranks, which are the second table's (cookie_id, score).
    """
    each = None
    for seed in seeds:
        one = out_of_fold(df, columns, learner, k, seed, select).select(F.col(KEY).alias("id"), F.lit(seed).alias("bag"), F.col("score").alias("s"), F.lit(1.0).alias("w"))
        each = one if each is None else each.unionByName(one)
    each = written(each, "cv-scores")
    labels = df.select(F.col(KEY).alias("id"), F.col("target").cast("long").alias("y"))
    blended = rank_average(each)
    spread = metric_spread(each.join(labels, "id").select("bag", "y", "s"), "bag")
    whole = score(blended.join(labels, "id").select("y", F.round("score", 12).alias("s")))
    whole = whole.select(F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("blend")) for m in METRICS))).alias("x")).select("x.*")
    return spread.join(F.broadcast(whole), "name").withColumnRenamed("name", "metric"), blended.withColumnRenamed("id", KEY)  # a row per metric


def specialist_out_of_fold(df: DataFrame, columns: list[str], inside: str, learner: str = "gbt", k: int = 5, seed: int = 42) -> DataFrame:
    """(cookie_id, score): out-of-fold scores of a model of the subgroup where ``inside`` holds, NULL outside.

    The folds are stratified inside the subgroup; columns that are empty or constant there are left out.
    """
    part = df.where(inside)
    used = [r["name"] for r in subgroup_columns(part, tuple(columns)).select("name").collect()]  # at most a row per column
    return df.select(KEY).join(out_of_fold(part, used, learner, k, seed).select(KEY, "score"), KEY, "left")


def forward_scores(df: DataFrame, columns: list[str], first_valid: int = 2, learner: str = "gbt", seed: int = 42) -> DataFrame:
    """(cookie_id, day_index, score): each day scored by the model of the days before it."""
    days = [r["day_index"] for r in df.select("day_index").distinct().orderBy("day_index").collect()]  # a row per day
    out = None
    for day in days[first_valid:]:
        model = fit(df.where(F.col("day_index") < day), columns, learner, seed)
        one = predict(model, df.where(F.col("day_index") == day), columns).withColumn("day_index", F.lit(day))
        out = one if out is None else out.unionByName(one)
    return out


def pseudo_labelled(df: DataFrame, unlabelled: DataFrame, columns: list[str], learner: str = "gbt", k: int = 5, tail: float = 0.10, weight: float = 0.3, rounds: int = 1, seed: int = 42) -> DataFrame:
    """(cookie_id, fold, score): out-of-fold scores of models that also learn from the surest of ``unlabelled``.

    In each fold the model of the other folds scores the unlabelled rows; those among the ``tail`` best and worst by
    percentile rank join its training rows as positives and negatives at ``weight``, and it is fitted again, ``rounds``
    times. Nothing of the fold that is scored, nor its labels, reaches its model.
    """
    folds = df.join(stratified_folds(df.select(KEY, "target"), k, seed).select(KEY, "fold"), KEY)
    out = None
    for f in range(k):
        train = folds.where(F.col("fold") != f).select(KEY, "target", *columns).withColumn("weight", F.lit(1.0))
        model = fit(train, columns, learner, seed)
        for _ in range(rounds):
            placed = percent_ranks(predict(model, unlabelled, columns).withColumn("score", F.round("score", 12)), "score", "_at")
            sure = placed.where((F.col("_at") <= tail) | (F.col("_at") > 1 - tail)).select(KEY, (F.col("_at") > 1 - tail).cast("int").alias("target"))
            more = unlabelled.select(KEY, *columns).join(sure, KEY).withColumn("weight", F.lit(weight))
            model = fit(train.unionByName(written(more.select(*train.columns), "pseudo")), columns, learner, seed)
        one = predict(model, folds.where(F.col("fold") == f), columns).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


def adversarial(fitted: DataFrame, scored: DataFrame, columns: list[str], learner: str = "gbt", k: int = 5, seed: int = 42) -> float | None:
    """ROC-AUC of an out-of-fold model that tells ``scored`` rows from ``fitted`` ones; 0.5 where nothing drifts."""
    rows = fitted.select(KEY, *columns, F.lit(0).alias("target")).unionByName(scored.select(KEY, *columns, F.lit(1).alias("target")))
    told = out_of_fold(rows, columns, learner, k, seed).join(rows.select(KEY, F.col("target").alias("y")), KEY)
    return score(told.select("y", F.round("score", 12).alias("s"))).first()["roc_auc"]


def columns_like(columns: list[str], keep: str = "", drop: str = "") -> list[str]:
    """The columns that a pattern finds, without those that another one finds; an empty pattern keeps or drops nothing."""
    return [c for c in columns if (not keep or re.search(keep, c)) and not (drop and re.search(drop, c))]
