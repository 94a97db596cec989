"""Running sums with odd values, co-visitation, class shapes and drift against plain counting."""

import math
import random
from collections import Counter, defaultdict
from threading import Barrier, Thread

import pytest
from pyspark.sql import functions as F

from clickloom.config import FIXTURE
from clickloom.functions import kernels as K
from clickloom.functions import storage
from clickloom.operators import covisits, metrics, shapes, validation
from clickloom.operators.events import enrich

INF, NAN = float("inf"), float("nan")


def place(v):
    """Ascending order: NULL, numbers with infinities, NaN."""
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("values", [[None, -INF, -3.0, 0.0, 2.0, 1e300, INF, NAN], [1.0], [NAN, INF], [None], [*map(float, range(300)), 1e12]])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_of_odd_values(spark, values, descending):
    rows = [(g, v, i + 1) for g in ("a", None) for i, v in enumerate(values)]
    got = K.running(spark.createDataFrame(rows, "g string, v double, n long"), "v", {"upto": "n"}, ("g",), descending).collect()
    assert len(got) == len(rows)
    for r in got:
        own = place(r["v"])
        want = sum(n for g, v, n in rows if g == r["g"] and (place(v) >= own if descending else place(v) <= own))
        assert r["upto"] == want


def test_outliers_leave_pieces_of_equal_rows(spark):
    rows = spark.range(4000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n")).unionByName(spark.createDataFrame([(1e12, 1)], "v double, n int"))
    pieces = rows.repartitionByRange(8, "v").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(pieces) == 8 and max(r["count"] for r in pieces) < 1200
    got = {r["v"]: r["upto"] for r in K.running(rows, "v", {"upto": "n"}, pieces=8).collect()}
    assert got[1e12] == 4001 and all(got[float(i)] == i + 1 for i in range(0, 4000, 371))


def test_metrics_with_odd_scores_match_counting(spark):
    rng = random.Random(3)
    pool = [None, NAN, INF, -INF, 0.0, 1.0, 2.0, 2.0, 5.0]
    rows = [(rng.randrange(2), rng.choice(pool)) for _ in range(60)]
    got = metrics.score(spark.createDataFrame(rows, "y int, s double")).first()
    key = [(y, place(s)) for y, s in rows]
    pairs = [(a > b) + (a == b) / 2 for y, a in key if y for z, b in key if not z]
    assert got["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    n_pos, seen, tp, area = sum(y for y, _ in key), 0, 0, 0.0
    for s in sorted({s for _, s in key}, reverse=True):
        here = [y for y, x in key if x == s]
        seen, tp = seen + len(here), tp + sum(here)
        area += sum(here) / n_pos * tp / seen
    assert got["average_precision"] == pytest.approx(area)
    assert metrics.pr_curve(spark.createDataFrame(rows, "y int, s double")).count() == 8


def test_percent_ranks_of_odd_values_and_groups(spark):
    rows = [("a", x) for x in (None, NAN, INF, 1.0, 1.0)] + [(None, 3.0), (None, None), ("b", None)]
    got = sorted(K.percent_ranks(spark.createDataFrame(rows, "g string, x double"), "x", "p", ("g",)).collect(), key=str)
    for r in got:
        group = [place(x) for g, x in rows if g == r["g"] and x is not None]
        own = place(r["x"])
        want = None if r["x"] is None else (sum(v < own for v in group) + (sum(v == own for v in group) + 1) / 2) / len(group)
        assert same(r["p"], want) or r["p"] == pytest.approx(want)
    assert len(got) == len(rows)


def test_folds_deal_out_classes_that_lie_in_many_pieces(spark):
    rows = spark.range(1000).select(F.col("id").alias("cookie_id"), F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 97 == 1, None).otherwise(0).alias("target"))
    got = validation.stratified_folds(rows, 5).groupBy("target", "fold").count().collect()
    for target in (0, 1, None):
        sizes = [r["count"] for r in got if r["target"] == target]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_gaps_do_not_hang_on_the_session_s_zone(spark):
    rows = [(1, i, t) for i, t in enumerate(("2024-03-31 01:30:00", "2024-03-31 03:30:00", "2024-10-27 01:30:00", "2024-10-27 03:30:00"))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        ev = spark.createDataFrame(rows, "cookie_id long, event_id long, t string").selectExpr("cookie_id", "event_id", "CAST(t AS TIMESTAMP_NTZ) AS event_ts", "'x' AS event_name")
        dts = [r["dt"] for r in enrich(ev, FIXTURE).orderBy("event_id").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert dts[1] == dts[3] == 7200


def test_scratches_of_two_threads_do_not_meet(spark):
    barrier, found = Barrier(2), {}

    def work(name):
        with storage.scratch():
            mine = storage.written(spark.range(5), name)
            barrier.wait()
            if name == "first":
                return found.setdefault(name, mine)  # leaves, and its tables go
            Barrier(1).wait()
            while "first" not in found:
                pass
            found[name] = mine.count()

    threads = [Thread(target=work, args=(n,)) for n in ("first", "second")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert found["second"] == 5
    with pytest.raises(Exception, match="exist|PATH_NOT_FOUND|FILE"):
        spark.read.parquet(found["first"].inputFiles()[0]).count()


@pytest.mark.parametrize("blocks", [1, 2, 5, None])
def test_covisits_match_all_pairs(spark, blocks):
    rng = random.Random(4)
    rows = [(v, rng.choice([7, 8, rng.randrange(30), None])) for v in range(40) for _ in range(rng.randrange(6))]
    got = {r["cookie_id"]: r for r in covisits.covisitation(spark.createDataFrame(rows, "cookie_id long, item_id long"), FIXTURE, blocks=blocks).collect()}
    sets = defaultdict(set)
    for v, i in rows:
        if i is not None:
            sets[v].add(i)
    assert set(got) == set(sets)
    for v, own in sets.items():
        met = {w: len(own & s) for w, s in sets.items() if w != v and own & s}
        j = [n / (len(own) + len(sets[w]) - n) for w, n in met.items()]
        r = got[v]
        assert (r["cv_degree"], r["cv_shared_sum"], r["cv_shared_max"]) == (len(met), sum(met.values()), max(met.values(), default=None))
        assert r["cv_deg_per_item"] == pytest.approx(len(met) / len(own))
        if met:
            assert r["cv_repeat"] == pytest.approx(sum(n > 1 for n in met.values()) / len(met))
            assert (r["cv_jaccard_max"], r["cv_jaccard_mean"]) == (pytest.approx(max(j)), pytest.approx(sum(j) / len(j)))
        else:
            assert r["cv_repeat"] is r["cv_jaccard_max"] is r["cv_shared_mean_pct"] is None


def test_covisits_stay_inside_a_pool_and_cells_grow(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 5, "b"), (4, 5, None), (5, 6, None)], "cookie_id long, item_id long, pool string")
    got = {r["cookie_id"]: r["cv_degree"] for r in covisits.covisitation(rows, FIXTURE, pool="pool").collect()}
    assert got[1] == got[2] == 1 and got[3] == 0
    assert covisits.blocks_for(10, 10) == 1 and covisits.blocks_for(10**9, 10**13) == 4000
    assert covisits.covisitation(rows.limit(0), FIXTURE).count() == 0


def test_class_shapes_leave_the_own_fold_out(spark):
    rng = random.Random(5)
    cookies = [(v, v % 3 != 0, v % 2, v % 4) for v in range(24)]
    events = [(v, fit, rng.choice("abc") if rng.random() < 0.9 else None, float(rng.randrange(4))) for v, fit, *_ in cookies for _ in range(rng.randrange(1, 8))]
    ev = spark.createDataFrame(events, "cookie_id long, is_fit boolean, name string, x double")
    table = spark.createDataFrame(cookies, "cookie_id long, is_fit boolean, target int, fold int")
    got = {(r["cookie_id"], r["channel"]): r for r in shapes.class_shapes(ev, table, {"name": ("name", "0D"), "x": ("''", "x")}, bins=3).collect()}
    label, fold, fit = {c[0]: c[2] for c in cookies}, {c[0]: c[3] for c in cookies}, {c[0]: c[1] for c in cookies}
    own = sorted(x for _, f, _, x in events if f)
    keys = {"name": lambda e: e[2], "x": lambda e: min(2, 3 * sum(y < e[3] for y in own) // len(own))}
    for channel, key in keys.items():
        rows = [(e[0], key(e)) for e in events if key(e) is not None]
        bins = {b for v, b in rows if fit[v]}

        def ratio(b, without):
            used = [(v, x) for v, x in rows if fit[v] and fold[v] != without]
            n = lambda y: Counter(x for v, x in used if label[v] == y)
            p, q = n(1), n(0)
            return math.log((p[b] + 1) / (sum(p.values()) + len(bins))) - math.log((q[b] + 1) / (sum(q.values()) + len(bins))) if b in bins else 0.0

        for v in label:
            scores = [ratio(b, fold[v] if fit[v] else None) for w, b in rows if w == v]
            if scores:
                r = got[v, channel]
                assert r["mean"] == pytest.approx(sum(scores) / len(scores)) and (r["least"], r["most"]) == (pytest.approx(min(scores)), pytest.approx(max(scores)))
    # a fit visitor's label does not reach its own scores
    turned = spark.createDataFrame([(v, f, 1 - t if v == 4 else t, k) for v, f, t, k in cookies], table.schema)
    other = {(r["cookie_id"], r["channel"]): r["mean"] for r in shapes.class_shapes(ev, turned, {"name": ("name", "0D")}).collect()}
    first = {(r["cookie_id"], r["channel"]): r["mean"] for r in shapes.class_shapes(ev, table, {"name": ("name", "0D")}).collect()}
    assert other[4, "name"] == first[4, "name"] and other != first


def test_drift_of_columns(spark):
    rows = [(i % 2 == 1, float(i), 1.0, None if i % 2 else 2.0, NAN if i % 2 else INF) for i in range(20)]
    got = {r["name"]: r for r in shapes.column_drift(spark.createDataFrame(rows, "b boolean, x double, flat double, gone double, odd double"), ("x", "flat", "gone", "odd"), "b").collect()}
    assert got["x"]["auc"] == pytest.approx(0.55) and got["flat"]["auc"] == 0.5 and got["odd"]["auc"] == 1.0
    assert got["gone"]["auc"] is None and (got["gone"]["n_b"], got["gone"]["missing_b"], got["gone"]["missing_a"]) == (0, 1.0, 0.0)
