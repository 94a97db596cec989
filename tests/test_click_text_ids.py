"""Visitors whose ids are texts, as the click log's files have them."""

import random

import pytest
from pyspark.sql import functions as F

from clickloom.config import FIXTURE
from clickloom.operators import covisits, encoding, metrics, models, resampling, validation
from clickloom.operators.boosting import Boosting


def test_covisits_of_text_ids_are_those_of_numbers(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(v, rng.randrange(12)) for v in range(30) for _ in range(3)], "cookie_id long, item_id long").cache()
    text = rows.withColumn("cookie_id", F.concat(F.lit("c-"), "cookie_id"))
    one, two = (covisits.covisitation(x, FIXTURE, blocks=3).collect() for x in (rows, text))
    assert {f"c-{r['cookie_id']}": r["cv_jaccard_mean"] for r in one} == pytest.approx({r["cookie_id"]: r["cv_jaccard_mean"] for r in two})


def test_models_and_weights_of_text_ids(spark):
    rows = spark.range(200).select(F.concat(F.lit("c-"), "id").alias("cookie_id"), (F.col("id") % 2).cast("int").alias("target"), (F.col("id") % 2 + F.rand(1)).alias("x")).cache()
    models.LEARNERS["small"] = lambda seed: Boosting(rounds=2, depth=2, top=0.5, other=0.3, min_rows=5, seed=seed)
    try:
        got = models.out_of_fold(rows, ["x"], "small", 2).join(rows, "cookie_id")
        scored = got.select(F.col("cookie_id").alias("id"), F.col("target").alias("y"), F.col("score").alias("s")).cache()
    finally:
        del models.LEARNERS["small"]
    assert scored.count() == 200 and metrics.roc_auc(scored).first()[0] > 0.7
    spread = {r["metric"]: r for r in resampling.bootstrap(scored, draws=50).collect()}
    assert spread["roc_auc"]["n_draws"] == 50 and spread["roc_auc"]["low"] > 0.5
    folds = validation.stratified_folds(rows.select("cookie_id", "target"), 4)
    keyed = rows.join(folds.select("cookie_id", "fold"), "cookie_id").select("cookie_id", F.col("target").alias("y"), F.lit(True).alias("is_fit"), F.lit("k").alias("k"))
    assert encoding.encode_ordered(keyed, "k", "is_fit").where("rate IS NULL").count() == 0
