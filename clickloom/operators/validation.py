"""Validation protocols: folds, forward chaining, the strict split, recency weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import KEY, running


def stratified_folds(cookies: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold numbers that deal each class out evenly, in the order of an MD5 of seed and id."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(KEY).cast("string"))).alias("_order")
    placed = running(cookies.select(KEY, "target", order, F.lit(1).alias("_one")), ("_order", KEY), {"_place": "_one"}, ("target",))
    return placed.select(KEY, "target", ((F.col("_place") - 1) % k).cast("int").alias("fold"))


def forward_chain(cookies: DataFrame, first_valid: int = 2) -> DataFrame:
    """(day, role, n, n_pos) of each step: train on earlier days, validate on the day."""
    days = cookies.where("day_index IS NOT NULL").groupBy(F.col("day_index").alias("day")).agg(F.count("*").alias("n"), F.sum("target").alias("n_pos"))
    by_day = Window.orderBy("day")  # a row per day
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    steps = days.select("day", F.row_number().over(by_day).alias("k"), F.struct(F.lit("valid").alias("role"), "n", "n_pos").alias("a"), F.struct(F.lit("train").alias("role"), F.sum("n").over(before).alias("n"), F.sum("n_pos").over(before).alias("n_pos")).alias("b"))
    return steps.where(F.col("k") > first_valid).select("day", F.inline(F.array("a", "b"))).where("n IS NOT NULL")


def strict_split(cookies: DataFrame, cut: int) -> DataFrame:
    """Visitors of days before the cut may shape fitted statistics; the others are scored."""
    return cookies.withColumn("is_fit", F.col("day_index") < cut)


def recency_weights(cookies: DataFrame, half_life: float) -> DataFrame:
    last = cookies.agg(F.max("day_index").alias("last"))
    return cookies.join(F.broadcast(last)).select(KEY, F.pow(F.lit(0.5), (F.col("last") - F.col("day_index")) / half_life).alias("weight"))


def keep_first(rows: DataFrame, name: str, stamp: str, last: bool = False) -> DataFrame:
    """One row per name, the first (or last) by ``stamp``."""
    order = F.desc(stamp) if last else F.asc(stamp)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("_k = 1").drop("_k")
