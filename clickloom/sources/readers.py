"""Readers and writers of the click log, the visitors and the results."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_N = T.StructField
EVENTS = T.StructType(
    [
        _N("event_id", T.LongType()), _N("cookie_id", T.StringType()), _N("event_ts", T.TimestampNTZType()), _N("event_name", T.StringType()),
        _N("platform", T.StringType()), _N("user_agent", T.StringType()), _N("item_id", T.LongType()), _N("item_category", T.StringType()),
        _N("item_location", T.StringType()), _N("search_query", T.StringType()), _N("search_page", T.IntegerType()), _N("seller_type", T.StringType()),
        _N("pointer_x", T.DoubleType()), _N("pointer_y", T.DoubleType()),
    ]
)
COOKIES = T.StructType([_N("cookie_id", T.StringType()), _N("cookie_created_at", T.TimestampNTZType()), _N("window_start_ts", T.TimestampNTZType()), _N("window_end_ts", T.TimestampNTZType()), _N("target", T.IntegerType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header under a stated schema, gzip included; columns that the file lacks are null."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Gzip files do not split, so the rows are spread by visitor at once."""
    return read_csv(spark, path, EVENTS).repartition("cookie_id")


def read_cookies(spark: SparkSession, path: str, with_target: bool = True) -> DataFrame:
    return read_csv(spark, path, COOKIES if with_target else T.StructType(COOKIES.fields[:-1]))


def all_cookies(fit: DataFrame, scored: DataFrame) -> DataFrame:
    """Fit and scored visitors in one frame, marked by ``is_fit``; the scored ones have no target."""
    return fit.withColumn("is_fit", F.lit(True)).unionByName(scored.withColumn("is_fit", F.lit(False)), allowMissingColumns=True)


def cached(df: DataFrame, folder: str, *parts: object) -> DataFrame:
    """A Parquet cache whose name is a hash of everything that shapes it."""
    spark = df.sparkSession
    path = f"{folder}/{hashlib.sha256(json.dumps([str(p) for p in parts]).encode()).hexdigest()[:16]}"
    df.write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def source_digest() -> str:
    """Hash of the engine's source, for ``cached``."""
    found = sorted(Path(__file__).resolve().parents[1].rglob("*.py"))
    return hashlib.sha256(b"".join(p.read_bytes() for p in found if "llm" not in p.parts)).hexdigest()


def append_results(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def read_results(spark: SparkSession, folder: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """All result rows; columns that a run lacks are null, as are those of ``columns`` that no run has."""
    found = spark.read.json(folder)
    return found.withColumns({c: F.lit(None).cast("double") for c in columns if c not in found.columns})


def report_table(results: DataFrame, by: str) -> DataFrame:
    """The newest row of each name, the best ``by`` first, names without it last."""
    newest = results.groupBy("name").agg(F.max_by(F.struct(*results.columns), "ts").alias("r")).select("r.*")
    return newest.orderBy(F.desc_nulls_last(by), "name")


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Tuned parameters as one JSON line."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def check_scores(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of checks of ``scores(cookie_id, score)`` against the ids that should be scored; nothing is collected."""
    told = scores.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("cookie_id").alias("n_ids"),
        F.countDistinct("score").alias("n_scores"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("n_missing"),
        F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("n_outside"),
    )
    extra = scores.join(wanted, "cookie_id", "left_anti").agg(F.count("*").alias("n_extra"))
    absent = wanted.join(scores, "cookie_id", "left_anti").agg(F.count("*").alias("n_absent"))
    row = told.join(F.broadcast(extra)).join(F.broadcast(absent))  # one row each
    fine = "n_rows = n_ids AND n_missing = 0 AND n_outside = 0 AND n_extra = 0 AND n_absent = 0 AND n_scores > 0.9 * n_rows"
    return row.withColumn("passes", F.expr(fine))


def write_scores(scores: DataFrame, wanted: DataFrame, path: str) -> None:
    """The result file: cookie_id and score; refuses scores that fail a check."""
    row = check_scores(scores, wanted).first()
    if not row["passes"]:
        raise ValueError(f"the scores fail: {row.asDict()}")
    scores.select("cookie_id", "score").coalesce(1).write.mode("overwrite").csv(path, header=True)
