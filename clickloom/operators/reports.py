"""Exploration and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KEY


def value_counts(ev: DataFrame, column: str) -> DataFrame:
    return ev.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def missing_shares(ev: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    row = ev.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return row.unpivot([], list(columns), "name", "missing")


def portrait(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Means of features by class, a row per feature."""
    row = features.agg(*(F.expr(f"avg(CASE WHEN target = {t} THEN {c} END)").alias(f"{c}__{t}") for c in columns for t in (0, 1)))
    parts = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"{c}__0").alias("mean_0"), F.col(f"{c}__1").alias("mean_1")) for c in columns))
    return row.select(F.explode(parts).alias("x")).select("x.*")


def windows_per_day(cookies: DataFrame) -> DataFrame:
    return cookies.groupBy(F.date_format("window_start_ts", "yyyy-MM-dd").alias("day"), "is_fit").agg(F.count("*").alias("n"), F.sum("target").alias("n_pos"))


def basic_features(ev: DataFrame, cookies: DataFrame) -> DataFrame:
    """Events and distinct items of every visitor, zero for one without events."""
    got = ev.groupBy(KEY).agg(F.count("*").alias("n_events"), F.countDistinct("item_id").alias("n_items"))
    return cookies.select(KEY).join(got, KEY, "left").na.fill(0, ["n_events", "n_items"])


def id_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the difference, the intersection and the union of two id sets."""
    tagged = a.select(KEY).withColumn("a", F.lit(1)).unionByName(b.select(KEY).withColumn("b", F.lit(1)), allowMissingColumns=True)
    each = tagged.groupBy(KEY).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(
        F.expr("count_if(a = 1 AND b IS NULL)").alias("only_a"),
        F.expr("count_if(b = 1 AND a IS NULL)").alias("only_b"),
        F.expr("count_if(a = 1 AND b = 1)").alias("both"),
        F.count("*").alias("either"),
    )
