"""What shows only on larger tables: ties in the last digit, and work that must not grow in one task."""

import random
import tracemalloc
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.config import FIXTURE
from clickloom.functions import kernels as K
from clickloom.operators import covisits, events, families, resampling
from clickloom.plans.queries import tidy


def test_ties_round_as_in_sql(spark):
    values = [135432 / 2073600.0, -135432 / 2073600.0, 1 / 128, 2.675, 0.5, 1e15 + 0.3, 1.5e307, 3.0, *(k / 2073600.0 for k in range(81, 2073600, 3240))]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v double").coalesce(1)
    got = tidy(rows).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["k"])] == want
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(K.rounded("v", 6).alias("v")).collect()
    assert [str(r["v"]) for r in odd] == ["nan", "inf", "None"]


def cell(n, items, own, sides):
    """Arrays of a cell: ``n`` visitors with about ``own`` of ``items`` each."""
    rng = np.random.default_rng(5)
    pairs = np.unique(np.stack((np.repeat(np.arange(n), own), rng.integers(0, items, n * own))), axis=1)
    return (pairs[0] % 2 + 1 if sides == 2 else np.zeros(pairs.shape[1], np.int64)), pairs[1], pairs[0] + 100, np.bincount(pairs[0])[pairs[0]]


def test_a_cell_holds_no_more_for_more_meetings():
    peaks = []
    for items in (400, 25):  # 16 times the meetings of as many rows
        rows = cell(12000, items, 5, 2)
        tracemalloc.start()
        list(covisits._of_cell(*rows))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 200e6


@pytest.mark.parametrize("sides", [1, 2])
@pytest.mark.parametrize("at_once", [1, 7, 100, 1 << 20])
@pytest.mark.parametrize("sparse", [0, 8])
def test_cells_in_slices_match_all_pairs(monkeypatch, sides, at_once, sparse):
    monkeypatch.setattr(covisits, "_AT_ONCE", at_once)
    monkeypatch.setattr(covisits, "_SPARSE", sparse)
    side, item, visitor, n_items = cell(30, 12, 4, sides)
    sets = {v: set(item[visitor == v].tolist()) for v in visitor.tolist()}
    side_of = dict(zip(visitor.tolist(), side.tolist()))
    got = {r["visitor"]: r for b in covisits._of_cell(side, item, visitor, n_items) for r in b.to_pylist()}
    for v, own in sets.items():
        met = {w: len(own & s) for w, s in sets.items() if w != v and own & s and (sides == 1 or side_of[w] != side_of[v])}
        assert (v in got) == bool(met)
        if met:
            j = [k / (len(own) + len(sets[w]) - k) for w, k in met.items()]
            want = (len(met), sum(met.values()), max(met.values()), sum(k > 1 for k in met.values()))
            assert tuple(got[v][c] for c in ("neighbours", "shared", "widest", "repeated")) == want
            assert (got[v]["jaccard_sum"], got[v]["jaccard_max"]) == (pytest.approx(sum(j)), pytest.approx(max(j)))


def test_packed_weights_come_back():
    for w in (np.array([[0.0, 1, 1], [1, 0, 0]]), np.array([[0.0, 2, 1]]), np.ones((3, 9))):
        assert (resampling.unpacked(resampling.packed(w), w.shape[1]) == w).all()
    mixed = resampling.packed(np.array([[1.0, 0, 1]])) + resampling.packed(np.array([[1.5, 0, 1]]))
    assert resampling.unpacked(mixed, 3).tolist() == [[1, 0, 1], [1.5, 0, 1]]


def test_weights_are_told_once_for_all_models(spark):
    told = spark.sparkContext.accumulator(0)
    of = resampling.poisson(0.7, 3)

    def weigh(ids, draws):
        told.add(len(ids))
        return of(ids, draws)

    rows = spark.range(60).selectExpr("IF(id = 59, NULL, id) AS id", "int(id % 4 = 0) AS y", "explode(array('a', 'b', 'c')) AS model").withColumn("s", F.expr("double((id * 7 + ascii(model)) % 11)"))
    got = resampling.of_models(rows, weigh, 6)
    first = {(r["model"], r["draw"]): r for r in got.collect()}
    got.collect()
    assert told.value == 60 and len(first) == 18
    for m in "abc":
        want = resampling.weighted_metrics(rows.where(F.col("model") == m).na.fill(-(2**63), ["id"]), of, 6).collect()
        assert all(first[m, r["draw"]][c] == (None if r[c] is None else pytest.approx(r[c])) for r in want for c in ("p_at_r", "roc_auc", "average_precision", "recall_at_fpr"))


def test_runs_come_from_one_exchange_and_match_counting_by_hand(spark):
    rng = random.Random(3)
    names = ("item_view", "photo_swipe", "photo_swipe", "search_results_view", None)
    rows = [(i, rng.randrange(12), i, rng.choice(names), rng.choice((None, "a", "b")), rng.choice(("x", "x", "y", None)), None, rng.choice((None, 1, 2, 3))) for i in range(150)] + [(150, 99, 0, "login", None, None, None, None)]
    log = spark.createDataFrame(rows, "event_id long, cookie_id long, at long, event_name string, item_category string, item_location string, search_query string, item_id long").withColumn("event_ts", F.expr("timestamp_seconds(at)"))
    out = families.navigation(events.enrich(log, FIXTURE), FIXTURE)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    got = {r["cookie_id"]: r for r in out.collect()}
    assert len(got) == len({r[1] for r in rows})
    for v, r in got.items():
        own = [x for x in rows if x[1] == v]
        for k, at in (("cat", 4), ("loc", 5), ("query", 6)):
            values = [x[at] for x in own if x[at] is not None]
            changed = [a != b for a, b in zip(values, values[1:])]
            island = [sum(changed[: i + 1]) for i in range(len(changed))]
            lengths = [len(list(g)) for _, g in groupby(island)]
            want = (sum(changed) / len(changed), sum(lengths) / len(lengths), max(lengths)) if changed else (None,) * 3
            assert tuple(r[f"nav_{k}_{x}"] for x in ("switch_rate", "run_mean", "run_max")) == want
        assert r["swipe_run_max"] == max((len(list(g)) for s, g in groupby(own, lambda x: x[3] == "photo_swipe") if s), default=0)
        items = [x[7] for x in own if x[7] is not None]
        assert r["item_revisit_max"] == max((items.count(i) for i in items), default=None)


def test_agents_are_read_once_for_each_visitor(spark, monkeypatch):
    seen = []
    facts = families.user_agent_facts
    monkeypatch.setattr(families, "user_agent_facts", lambda rows, s: (seen.append(rows), facts(rows, s))[1])
    log = spark.range(40).selectExpr("id AS event_id", "id % 4 AS cookie_id", "IF(id % 2 = 0, 'curl/8', 'NativeApp/7 (Android 13; Pixel 6)') AS user_agent", "'web' AS platform")
    got = {r["cookie_id"]: r for r in families.client(log, FIXTURE).collect()}
    assert seen[0].count() == 4 and [got[v]["ua_freq_min"] for v in range(4)] == [20] * 4
    assert [got[v]["ua_script_rate"] for v in range(4)] == [1, 0, 1, 0] and got[1]["ua_device_freq"] == 1 and got[0]["ua_device_freq"] is None
