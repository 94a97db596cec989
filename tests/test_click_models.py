"""Boosted trees against a brute-force tree, and the Parzen search against a grid."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import boosting, metrics, models, tuning
from clickloom.operators.boosting import Boosting
from clickloom.sources import readers


def rows_of(rng, n=160):
    """Two columns that matter, one of them missing where it says something, and one that does not."""
    out = []
    for i in range(n):
        a, b, c = rng.choice([0.0, 1.0, 2.0, 3.0, 4.0]), rng.choice([0.0, 1.0, 2.0, None, float("nan")]), float(rng.randrange(6))
        missing = b is None or b != b
        y = int((a > 2) != missing) if rng.random() < 0.9 else rng.randrange(2)
        out.append((i, y, a, b, c))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "cookie_id long, target int, a double, b double, c double").repartition(3)


def brute_tree(x, g, h, depth, l2, least):
    """Column, threshold and missing side of every node by trying each value on both sides; leaf values by node."""
    splits, leaves = {}, {}

    def worth(i):
        return g[i].sum() ** 2 / (h[i].sum() + l2)

    def grow(node, i, level):
        leaves[node] = -g[i].sum() / (h[i].sum() + l2)
        if level == depth:
            return
        best = None
        for c in range(x.shape[1]):
            known = ~np.isnan(x[i, c])
            for missing_left in (False, True):
                for t in sorted(set(x[:, c][~np.isnan(x[:, c])])):
                    left = np.where(known, x[i, c] <= t, missing_left)
                    if min(left.sum(), (~left).sum()) >= least:
                        gain = round(worth(i[left]) + worth(i[~left]) - worth(i), 9)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, c, i[left], i[~left])
        if best:
            splits[node] = best[1]
            grow(2 * node + 1, best[2], level + 1)
            grow(2 * node + 2, best[3], level + 1)

    grow(0, np.arange(len(x)), 0)
    return splits, leaves


def test_one_tree_is_that_of_brute_force(spark):
    rows = rows_of(random.Random(1))
    x = np.array([[v if v is not None else np.nan for v in r[2:]] for r in rows])
    y = np.array([r[1] for r in rows], float)
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    model = Boosting(rounds=1, depth=3, rate=1.0, top=1.0, columns_share=1.0, min_rows=5).fit(models.balanced(frame(spark, rows)), ["a", "b", "c"])
    p = 1 / (1 + np.exp(-model.first))
    splits, leaves = brute_tree(x, w * (p - y), w * p * (1 - p), 3, 5.0, 5)
    tree = model.trees[0]
    assert {i: int(c) for i, c in enumerate(tree.column) if c >= 0} == splits
    bins = np.stack([boosting.binned(x[:, c], e) for c, e in enumerate(model.edges)], 1)
    got = {r["cookie_id"]: r["score"] for r in model.predict(frame(spark, rows)).collect()}
    want = 1 / (1 + np.exp(-(model.first + np.array([leaves[i] for i in tree.nodes(bins, 3).tolist()]))))
    assert np.allclose([got[i] for i in range(len(rows))], want)
    assert "b" in dict(model.importances(3)) and sum(dict(model.importances(3)).values()) == pytest.approx(1)


def test_boosting_learns_with_missing_values_and_sampled_rows(spark):
    rng = random.Random(2)
    train, test = frame(spark, rows_of(rng, 600)), frame(spark, rows_of(rng, 300))
    spec = Boosting(rounds=6, depth=3, rate=0.4, top=0.3, other=0.2, min_rows=5, refresh=4, columns_share=1.0)
    one, two = (spec.fit(models.balanced(train), ["a", "b", "c"]) for _ in range(2))
    a, b = ({r["cookie_id"]: r["score"] for r in m.predict(test).collect()} for m in (one, two))
    assert a == pytest.approx(b)  # reruns agree
    scored = one.predict(test).join(test, "cookie_id").select(F.col("target").alias("y"), F.col("score").alias("s"))
    assert metrics.roc_auc(scored).first()[0] > 0.85
    staged = {(r["cookie_id"], r["round"]): r["score"] for r in one.staged(test, 4).collect()}
    assert {k for _, k in staged} == {4, 6} and all(staged[i, 6] == pytest.approx(s) for i, s in a.items())


def test_the_largest_gradients_are_kept_whole(spark):
    rng = np.random.default_rng(3)
    ids, size = np.arange(10_000), np.round(np.abs(rng.normal(size=10_000)), 2)
    spec = Boosting(top=0.2, other=0.1)
    order = np.sort(size.astype(np.float32))[::-1]
    cut = order[1999]
    share = (2000 - (size.astype(np.float32) > cut).sum()) / (size.astype(np.float32) == cut).sum()
    times = spec._weigher((int(boosting._bits(np.array([cut]))[0]), share), 0)(ids, size)
    assert (times[size.astype(np.float32) > cut] == 1).all() and abs((times == 1).sum() - 2000) < 60
    assert set(np.unique(times)) <= {0.0, 1.0, 8.0} and abs((times == 8).sum() - 1000) < 150
    rows = spark.createDataFrame([(int(i), 0.0, float(s) * 2, 0.0, b"\1") for i, s in zip(ids, size)], boosting._ROWS)
    assert spec._cut(rows, [], 10_000) == (int(boosting._bits(np.array([cut]))[0]), pytest.approx(share))


def test_boosting_of_odd_tables(spark):
    rows = frame(spark, [(i, i % 2, None, float("nan"), 1.0) for i in range(60)])
    model = Boosting(rounds=2, top=1.0).fit(models.balanced(rows), ["a", "b", "c"])
    assert model.trees == [] and {r["score"] for r in model.predict(rows).collect()} == {0.5}
    assert Boosting().fit(models.balanced(rows.limit(0)), ["a"]).predict(rows).count() == 60
    one_class = rows.withColumn("target", F.lit(0))
    assert Boosting(rounds=1, top=1.0).fit(models.balanced(one_class), ["c"]).predict(rows).count() == 60


def test_models_take_boosted_trees(spark):
    rng = random.Random(4)
    df = frame(spark, rows_of(rng, 200))
    models.LEARNERS["small"] = lambda seed: Boosting(rounds=2, depth=2, top=1.0, min_rows=5, seed=seed)
    try:
        scores = models.out_of_fold(df, ["a", "b"], "small", 2)
        assert scores.count() == 200
        assert 1 <= models.estimate_rounds(df, ["a", "b"], k=2, most=3, patience=2, learner="small") <= 3
        assert models.importances(models.fit(df, ["a", "b"], "small"), 1)[0][0] in "ab"
    finally:
        del models.LEARNERS["small"]


# Search


SPACE = {"x": tuning.Range(0.01, 10.0, log=True), "y": tuning.Range(0.0, 1.0), "k": tuning.Range(1, 9, whole=True), "z": tuning.Range(0.0, 0.9, less="y")}


def hill(t):
    return -((np.log10(t["x"]) - 0.3) ** 2) - (t["y"] - 0.27) ** 2 - ((t["k"] - 6) / 8) ** 2 - (t["z"] - 0.4) ** 2


def test_search_beats_the_grid_at_equal_trials():
    axes = {"x": [0.1, 1.0, 9.0], "y": [0.1, 0.5, 0.9], "k": [2, 5, 8], "z": [0.0, 0.3]}
    grid = [dict(zip(axes, v)) for v in itertools.product(*axes.values())]
    for seed in range(5):
        found = tuning.parzen_search(hill, SPACE, len(grid), seed)
        best = [max(v for _, v in found[:n]) for n in (8, len(grid))]
        assert best[1] > max(map(hill, grid)) and best[1] > best[0]
        assert all(t["z"] <= 0.9 - t["y"] + 1e-12 and isinstance(t["k"], int) and 0.01 <= t["x"] <= 10 for t, _ in found)
    assert tuning.parzen_search(hill, SPACE, 20, 3) == tuning.parzen_search(hill, SPACE, 20, 3)


def test_a_search_goes_on_where_it_was_broken_off(spark, tmp_path):
    calls = []

    def counted(t):
        calls.append(t)
        return hill(t)

    whole = tuning.parzen_search(hill, SPACE, 14, 7)
    tuning.parzen_search(counted, SPACE, 10, 7, spark, f"{tmp_path}/trials")
    again = tuning.parzen_search(counted, SPACE, 14, 7, spark, f"{tmp_path}/trials")
    assert len(calls) == 14 and [t for t, _ in again] == [t for t, _ in whole]


def test_density_is_one(spark):
    x = np.linspace(0, 1, 20_001)
    assert np.exp(tuning.Density([0.1, 0.15, 0.9]).log(x)).mean() == pytest.approx(1, abs=1e-3)


def test_tuned_settings_are_written(spark, tmp_path):
    rows = spark.range(80).select(F.col("id").alias("cookie_id"), (F.col("id") % 2).cast("int").alias("target"), (F.col("id") % 2 + F.rand(1)).alias("good"), (F.col("id") % 4).alias("day_index"))
    told = tuning.tune(rows.cache(), ["good"], "linear", trials=2, k=2, cuts=(2,), folder=f"{tmp_path}/trials", out=f"{tmp_path}/best")
    assert told["value"] > 0.8 and readers.read_settings(spark, f"{tmp_path}/best") == told and "linear:trial" not in models.LEARNERS


# Labels that must not leak


def test_ordered_rates_never_hold_the_own_label(spark):
    from clickloom.operators import encoding

    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 1, None]) if i < 60 else 1, i < 60) for i in range(80)]
    schema = "cookie_id long, k string, y int, is_fit boolean"
    rate = lambda x: {r["cookie_id"]: r["rate"] for r in encoding.encode_ordered(spark.createDataFrame(x, schema), "k", "is_fit", seed=1).collect()}
    got = rate(rows)
    assert len(got) == 80 and all(0 < v < 1 for v in got.values())
    for k in (3, 17):
        turned = [(i, c, 1 - (y or 0) if i == k else y, f) for i, c, y, f in rows]
        other = rate(turned)
        assert other[k] == got[k] and other != got
    for c in ("a", None):
        own = [y for _, x, y, f in rows if f and x == c and y is not None]
        assert all(got[i] == pytest.approx((sum(own) + 0.5) / (len(own) + 1)) for i, x, _, f in rows if not f and x == c)


def test_pseudo_labels_leave_the_scored_fold_out(spark):
    rng = random.Random(10)
    df = frame(spark, rows_of(rng, 120)).select("cookie_id", "target", "a", "c").cache()
    new = frame(spark, [(1000 + i, 0, *r[2:]) for i, r in enumerate(rows_of(rng, 80))]).select("cookie_id", "a", "c").cache()
    one = {r["cookie_id"]: (r["fold"], r["score"]) for r in models.pseudo_labelled(df, new, ["a", "c"], "linear", 2).collect()}
    assert len(one) == 120
    from clickloom.operators import validation

    folds = validation.stratified_folds(df.select("cookie_id", "target"), 2).cache()
    held = {r["cookie_id"] for r in folds.where("fold = 0").collect()}
    # labels of the scored fold changed within the classes' sizes, with the same folds
    import unittest.mock

    turned = df.withColumn("target", F.when(F.col("cookie_id").isin(*held), 1 - F.col("target")).otherwise(F.col("target")))
    with unittest.mock.patch.object(models, "stratified_folds", lambda *_: folds):
        two = {r["cookie_id"]: r["score"] for r in models.pseudo_labelled(turned, new, ["a", "c"], "linear", 2).where("fold = 0").collect()}
        three = {r["cookie_id"]: r["score"] for r in models.pseudo_labelled(df, new, ["a", "c"], "linear", 2).where("fold = 0").collect()}
    assert two == pytest.approx(three) and set(two) == held


def test_adversarial_model_tells_drift(spark):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, float(x), float(x + (i % 2))) for i, x in enumerate(rng.normal(size=160))], "cookie_id long, same double, moved double").cache()
    a, b = rows.where("cookie_id % 2 = 0"), rows.where("cookie_id % 2 = 1")
    assert models.adversarial(a, b, ["moved"], "linear", 2) > 0.65 and abs(models.adversarial(a, b, ["same"], "linear", 2) - 0.5) < 0.17
    assert models.columns_like(["pop_a", "pop_b", "dt"], "^pop", "b$") == ["pop_a"]
