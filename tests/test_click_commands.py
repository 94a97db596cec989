"""The commands over small tables."""

import json

import pytest
from pyspark.sql import functions as F

from clickloom.__main__ import main, parser
from clickloom.sources import readers


@pytest.fixture
def matrix(spark, tmp_path):
    rows = spark.range(90).select(
        F.col("id").alias("cookie_id"), F.when(F.col("id") >= 80, None).otherwise(F.col("id") % 2).cast("int").alias("target"), (F.col("id") % 9).alias("day_index"),
        (F.col("id") % 2 + F.rand(1)).alias("pop_good"), F.rand(2).alias("noise"), F.lit("web").alias("dominant_platform"),
    )
    rows.write.parquet(f"{tmp_path}/matrix")
    return f"{tmp_path}/matrix"


def test_experiments_are_appended_and_ranked(spark, matrix, tmp_path, capsys):
    results = f"{tmp_path}/results"
    for name, keep in (("good", "^pop"), ("bad", "noise")):
        main(["experiment", "--matrix", matrix, "--learner", "linear", "--seeds", "1", "--folds", "2", "--keep", keep, "--results", results, "--name", name])
    rows = {r["name"]: r for r in readers.read_results(spark, results).collect()}
    assert rows["good"]["average_precision"] > 0.8 > rows["bad"]["average_precision"]
    main(["report", "--results", results])
    shown = capsys.readouterr().out
    assert shown.rindex("|good") < shown.rindex("|bad")


def test_ablation_and_tuning_by_command(spark, matrix, tmp_path, capsys):
    main(["ablation", "--matrix", matrix, "--learner", "linear", "--folds", "2", "--blocks", json.dumps({"pop": "^pop"})])
    told = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["name"] for x in told] == ["run", "run-without-pop"] and told[0]["roc_auc"] > told[1]["roc_auc"]
    main(["tune", "--matrix", matrix, "--learner", "linear", "--folds", "2", "--trials", "1", "--cuts", "5", "--out", f"{tmp_path}/best"])
    assert readers.read_settings(spark, f"{tmp_path}/best")["learner"] == "linear"


def test_scores_are_submitted(spark, matrix, tmp_path):
    main(["submit", "--matrix", matrix, "--learner", "linear", "--seeds", "1", "--keep", "pop", "--out", f"{tmp_path}/scores"])
    got = spark.read.csv(f"{tmp_path}/scores", header=True, inferSchema=True).collect()
    assert sorted(r["cookie_id"] for r in got) == list(range(80, 90))


def test_features_by_command(spark, tmp_path):
    from clickloom.sources import fixture

    sf = "/root/testdata/sf0.001"
    fixture.clicks(spark, sf).write.parquet(f"{tmp_path}/clicks")
    fixture.cookies(spark, sf).write.parquet(f"{tmp_path}/cookies")
    main(["features", "--clicks", f"{tmp_path}/clicks", "--cookies", f"{tmp_path}/cookies", "--out", f"{tmp_path}/matrix"])
    got = spark.read.parquet(f"{tmp_path}/matrix")
    assert got.count() == 15 and {"n_events", "target", "day_index"} <= set(got.columns)
    with pytest.raises(SystemExit):
        parser().parse_args(["unknown"])
