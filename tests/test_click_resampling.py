"""Many weightings at once against one at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import metrics, resampling

NAN, INF = float("nan"), float("inf")


def brute(rows, w):
    """The four metrics of weighted (y, s) rows by walking the groups of equal scores; None where undefined."""
    key = lambda s: (-2, 0) if s is None else (2, 0) if math.isnan(s) else (0, s)
    n_pos, n_all = sum(y * x for (y, _), x in zip(rows, w)), sum(w)
    tp = seen = area = pairs = best = reached = 0.0
    for k in sorted({key(s) for _, s in rows}, reverse=True):
        here = [(y, x) for (y, s), x in zip(rows, w) if key(s) == k]
        pos, n = sum(y * x for y, x in here), sum(x for _, x in here)
        tp, seen = tp + pos, seen + n
        if not n:
            continue
        fp = seen - tp
        area += pos * tp / seen
        pairs += pos * ((n_all - n_pos) - fp + (n - pos) / 2)
        if n_pos and tp / n_pos >= 0.7:
            best = max(best, tp / seen)
        if n_pos and fp <= 0.01 * (n_all - n_pos):
            reached = max(reached, tp / n_pos)
    if not n_pos:
        return None, None, None, None
    return best, pairs / (n_pos * (n_all - n_pos)) if n_all > n_pos else None, area / n_pos, reached


@pytest.mark.parametrize("pool", [[None, NAN, INF, -INF, 0.0, 1.0, 2.0], [1.0], [float(i) for i in range(200)], [None]])
@pytest.mark.parametrize("pieces", [1, 4, 9])
def test_all_draws_match_counting_one_by_one(spark, pool, pieces):
    rng = random.Random(len(pool))
    rows = [(i, int(rng.random() < 0.3), rng.choice(pool)) for i in range(90)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(pieces))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = resampling.weighted_metrics(spark.createDataFrame(rows, "id long, y int, s double"), resampling.poisson(0.6, 3), 7).orderBy("draw").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    w = resampling.poisson(0.6, 3)(np.array([r[0] for r in rows]), np.arange(7))
    for k, r in enumerate(got):
        want = brute([x[1:] for x in rows], w[:, k].tolist())
        assert tuple(r[m] for m in ("p_at_r", "roc_auc", "average_precision", "recall_at_fpr")) == tuple(v if v is None else pytest.approx(v) for v in want)


def test_equal_weights_give_the_plain_metrics(spark):
    rows = spark.range(500).select("id", (F.rand(1) < 0.2).cast("int").alias("y"), F.floor(F.rand(2) * 40).cast("double").alias("s")).cache()
    got = resampling.weighted_metrics(rows, lambda ids, draws: np.ones((len(ids), len(draws))), 2).collect()
    want = metrics.score(rows).first()
    assert all(r[m] == pytest.approx(want[m]) for r in got for m in metrics.METRICS)


def test_bootstrap_matches_numpy_and_repeats(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.25).astype(int)
    s = np.round(y * 0.7 + rng.normal(size=400), 1)
    rows = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, y int, s double")
    got = {r["metric"]: r for r in resampling.bootstrap(rows, size=200, draws=600).collect()}
    again = {r["metric"]: r for r in resampling.bootstrap(rows.repartition(7), size=200, draws=600).collect()}
    assert all(got[m]["mean"] == pytest.approx(again[m]["mean"]) and got[m]["low"] == pytest.approx(again[m]["low"]) for m in metrics.METRICS)
    plain = []
    for _ in range(400):  # samples with replacement by numpy
        k = rng.integers(400, size=200)
        plain.append(brute(list(zip(y[k].tolist(), s[k].tolist())), [1.0] * 200))
    for i, m in enumerate(metrics.METRICS):
        own = np.array([p[i] for p in plain])
        assert got[m]["mean"] == pytest.approx(own.mean(), abs=0.02) and got[m]["deviation"] == pytest.approx(own.std(), rel=0.25)
        assert got[m]["low"] == pytest.approx(np.quantile(own, 0.05), abs=0.05) and got[m]["high"] == pytest.approx(np.quantile(own, 0.95), abs=0.05)


def test_weights_are_poisson_and_halves_part_the_rows():
    ids, draws = np.arange(2000), np.arange(50)
    w = resampling.poisson(1.0, 1)(ids, draws)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    for make in (resampling.halves, resampling.hashed_halves):
        h = make(1)(ids[:300], draws)
        assert (h[:, 0::2] + h[:, 1::2] == 1).all() and abs(h.mean() - 0.5) < 0.01


def test_agreement_of_models(spark):
    each = [(m, d, v, 0.5, v, 1 - v) for d in range(6) for m, v in zip("abcd", (0.1, 0.2, 0.2, 0.4))]
    got = {r["surrogate"]: r for r in resampling.surrogate_agreement(spark.createDataFrame(each, "model string, draw int, p_at_r double, roc_auc double, average_precision double, recall_at_fpr double")).collect()}
    assert got["average_precision"]["agreement"] == pytest.approx(1) and got["recall_at_fpr"]["agreement"] == pytest.approx(-1)
    assert got["roc_auc"]["n_splits"] == 0 and got["roc_auc"]["agreement"] is None
